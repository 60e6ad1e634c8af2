"""Weighted pair-merge training.

``rounds``: a round applies the longest run of best pairs that share no symbol (a pair of equal symbols only as its last), which
gives the merges of one-at-a-time training, and adds to the pair counts what changes in the segments that hold one of the pairs.
The counts are with the driver while they are few, else a written table. ``collect``: Spark counts the segments, the driver merges over arrays of their symbols,
which are in files of its own, with incremental pair counts. ``auto`` collects while the arrays fit in ``driver_bytes`` and works in rounds beyond.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TokenError, unwrapped
from ..functions.tokens import BASE, MAX_VOCAB, check_target, symbol, token_of
from .presegment import statistics
from .stats import SCALE, pair_counts, symbol_words, top_pairs, word_counts
from .tokenizer import Tokenizer
from .written import remove, written

HELD_PAIRS = 1 << 21  # pair counts that the driver holds in rounds
SYMBOL_BYTES = 64  # counted against ``driver_bytes`` for each symbol of a distinct segment
CHUNK = 1 << 20  # places that the driver counts at once


@dataclass(frozen=True)
class TrainConfig:
    vocab_size: int = MAX_VOCAB
    min_frequency: int = 2
    deterministic: bool = True
    strategy: str = "auto"
    driver_bytes: int = 2 << 30
    look: int = 64


@dataclass(frozen=True)
class Merge:
    a: int
    b: int
    merged: int
    count: int


@dataclass(frozen=True)
class TrainingStats:
    """loaded_sequences: accepted lines; loaded_tokens: their bytes, a token each before any merge."""

    loaded_sequences: int
    skipped_lines: int
    loaded_tokens: int
    unique_words: int
    learned_merges: int
    final_vocab: int


def batch(ranked: list[tuple[str, int]], threshold: int, room: int) -> list[tuple[str, int]]:
    """The pairs of one round, from (pair, count) in order."""
    out: list[tuple[str, int]] = []
    used: set[str] = set()
    for pair, n in ranked[:room]:
        if n < threshold or used & set(pair):
            break
        out.append((pair, n))
        used |= set(pair)
        if pair[0] == pair[1]:
            break
    return out


class _PairCounts:
    """Counts of pairs: on the driver while there are at most ``HELD_PAIRS``, else a written table."""

    def __init__(self, counts: DataFrame):
        self.spark, self.held, self.path = counts.sparkSession, None, None
        self._write(counts)
        if self.table.count() <= HELD_PAIRS:
            rows = self.table.toArrow()
            self.held = dict(zip(rows["pair"].to_pylist(), rows["n"].to_pylist()))
            self.close()

    def _write(self, counts: DataFrame) -> None:
        after, to = written(counts, "pairs")
        self.close()  # only now: ``counts`` may read it
        self.table, self.path, self.held = after, to, None

    def close(self) -> None:
        if self.path:
            remove(self.spark, self.path)
            self.path = None

    def top(self, k: int) -> list[tuple[str, int]]:
        if self.held is None:
            return [(r.pair, r.n) for r in top_pairs(self.table, k).collect()]
        return heapq.nsmallest(k, self.held.items(), key=lambda x: (-x[1], x[0]))

    def add(self, less: DataFrame, more: DataFrame) -> None:
        change = less.select("pair", (-F.col("n")).alias("n")).unionByName(more).groupBy("pair").agg(F.sum("n").alias("n")).filter("n <> 0")
        if self.held is not None:
            rows = change.limit(HELD_PAIRS + 1).toArrow()
            if rows.num_rows + len(self.held) <= HELD_PAIRS:
                for pair, n in zip(rows["pair"].to_pylist(), rows["n"].to_pylist()):
                    n += self.held.get(pair, 0)
                    if n > 0:
                        self.held[pair] = n
                    else:
                        del self.held[pair]
                return
            self._write(self.spark.createDataFrame(list(self.held.items()), "pair string, n long"))
        self._write(self.table.unionByName(change).groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 0"))


def train_rounds(words: DataFrame, target: int, threshold: int, look: int = 64, one_by_one: bool = False) -> list[Merge]:
    """words: (sym, freq)."""
    spark = words.sparkSession
    merges: list[Merge] = []
    now, path = written(words.filter(F.length("sym") > 1), "train")
    counts = _PairCounts(pair_counts(now))
    pending = 0
    while BASE + len(merges) < target:
        chosen = batch(counts.top(1 if one_by_one else look), threshold, target - BASE - len(merges))
        if not chosen:
            break
        old: Column = F.col("sym")
        held, new = F.lit(False), old
        for pair, n in chosen:
            held = held | old.contains(F.lit(pair))
            new = F.replace(new, F.lit(pair), F.lit(symbol(BASE + len(merges))))
            merges.append(Merge(token_of(pair[0]), token_of(pair[1]), BASE + len(merges), n))
        if BASE + len(merges) >= target:
            break
        touched = now.filter(held)
        counts.add(pair_counts(touched), pair_counts(touched.select(new.alias("sym"), "freq")))
        now, pending = now.select(new.alias("sym"), "freq").filter(F.length("sym") > 1), pending + len(chosen)
        if pending >= 24:
            after, to = written(now, "train")
            remove(spark, path)
            now, path, pending = after, to, 0
    remove(spark, path)
    counts.close()
    return merges


def _mapped(n: int, dtype) -> np.ndarray:
    """Zeros in a file of the driver's own, which goes with the array."""
    with tempfile.TemporaryFile(prefix="pairloom-") as f:
        return np.asarray(np.memmap(f, dtype, "w+", shape=(n,)))


class _Noted:
    """Places put away in a file, by where they stand there."""

    def __init__(self, dtype):
        self.file, self.dtype, self.size, self.n = tempfile.TemporaryFile(prefix="pairloom-", buffering=0), dtype, np.dtype(dtype).itemsize, 0

    def put(self, at: np.ndarray) -> int:
        data, done = memoryview(np.ascontiguousarray(at, self.dtype)).cast("B") if len(at) else b"", 0
        while done < len(data):
            done += os.pwrite(self.file.fileno(), data[done:], self.n * self.size + done)
        self.n += len(at)
        return self.n - len(at)

    def get(self, parts: list[tuple[int, int]]) -> np.ndarray:
        return np.concatenate([np.frombuffer(os.pread(self.file.fileno(), n * self.size, lo * self.size), self.dtype) for lo, n in parts])


def train_blocks(blocks, n_symbols: int, n_words: int, target: int, threshold: int) -> list[Merge]:
    """The same merges on the driver, from blocks (token ids of words in a row, the words' lengths, their weights).

    ``seq`` has a 0 before and behind each word. A token holds its id at the first and the last of the places of its bytes, and
    the second part of a merge loses its first place, so neighbours are found by the tokens' lengths (``span``). ``where`` has,
    for each pair, the places at which it began when they were found; of them, those that have changed since are left out when
    the pair is taken. What grows with the words' symbols is in files, and ``CHUNK`` places are counted at once.
    """
    total = n_symbols + n_words + 1
    place = np.int32 if total < 1 << 31 else np.int64
    seq, word, freq = _mapped(total, np.uint32), _mapped(total, np.int32), np.zeros(n_words, np.int64)
    end, known = 1, 0
    for symbols, lengths, weights in blocks:
        own = np.repeat(np.arange(len(lengths)), lengths)
        at = end + np.arange(len(symbols)) + own
        seq[at], word[at], freq[known : known + len(lengths)] = symbols, known + own, weights
        end, known = end + len(symbols) + len(lengths), known + len(lengths)
    if (end, known) != (total, n_words):
        raise TokenError("WordsChanged", f"{known} words of {n_words}")
    span = np.ones(MAX_VOCAB + 1, place)
    noted = _Noted(place)
    counts: dict[int, int] = {}
    where: dict[int, list[tuple[int, int]]] = {}
    heap: list[tuple[int, int]] = []

    def tally(places: np.ndarray, sign: int, change: dict[int, int]) -> None:
        """Weights of the pairs that begin at distinct places; new places of a pair are noted where they are added."""
        for start in range(0, len(places), CHUNK):
            at = places[start : start + CHUNK]
            own = seq[at]
            then = seq[at + span[own]]
            key = (own.astype(np.uint64) << np.uint64(32)) | then
            at, key = at[then != 0], key[then != 0]
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            sums = np.add.reduceat(freq[word[at]], first) if len(first) else np.zeros(0, np.int64)
            base = noted.put(at) if sign > 0 else 0
            for k, n, lo, hi in zip(key[first].tolist(), sums.tolist(), first.tolist(), [*first[1:].tolist(), len(key)]):
                change[k] = change.get(k, 0) + sign * n
                if sign > 0:
                    where.setdefault(k, []).append((base + lo, hi - lo))

    def settle(change: dict[int, int]) -> None:
        for k, d in change.items():
            if d:
                n = counts.get(k, 0) + d
                if n > 0:
                    counts[k] = n
                    heapq.heappush(heap, (-n, k))
                else:
                    counts.pop(k, None)
                    where.pop(k, None)

    change: dict[int, int] = {}
    for lo in range(0, total, CHUNK):
        tally((lo + np.flatnonzero(seq[lo : lo + CHUNK])).astype(place), 1, change)
    settle(change)
    merges: list[Merge] = []
    while heap and BASE + len(merges) < target:
        n, key = heapq.heappop(heap)
        if counts.get(key) != -n:
            continue
        if -n < threshold:
            break
        a, b = key >> 32, key & 0xFFFFFFFF
        new = BASE + len(merges)
        merges.append(Merge(a, b, new, -n))
        if BASE + len(merges) >= target:
            break
        at = np.unique(noted.get(where.pop(key)))
        at = at[seq[at] == a]
        at = at[seq[at + span[a]] == b]
        if a == b:  # of a run, from its left, every second pair
            run = np.flatnonzero(np.r_[True, at[:-1] + span[a] != at[1:]])
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
        gone, inner = at + span[a], at[seq[at - 1] != 0]
        change = {}
        tally(np.unique(np.concatenate([inner - span[seq[inner - 1]], at, gone])), -1, change)
        span[new] = span[a] + span[b]
        seq[gone] = MAX_VOCAB
        seq[at] = new
        seq[at + (span[new] - 1)] = new
        tally(np.unique(np.concatenate([inner - span[seq[inner - 1]], at])), 1, change)
        counts.pop(key, None)
        change.pop(key, None)
        settle(change)
    return merges


def train_arrays(symbols: np.ndarray, lengths: np.ndarray, freq: np.ndarray, target: int, threshold: int) -> list[Merge]:
    """The same from the token ids of all words in a row, the words' lengths and weights."""
    return train_blocks([(symbols, lengths, freq)], len(symbols), len(lengths), target, threshold)


def train_words(words: list[tuple[str, int]], target: int, threshold: int) -> list[Merge]:
    """The same from (symbols, weight)."""
    text = "".join(sym for sym, _ in words)
    lengths, freq = np.array([len(sym) for sym, _ in words], np.int64), np.array([f for _, f in words], np.int64)
    return train_arrays(_ids(text), lengths, freq, target, threshold)


def _ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.where(points < 0xD800, points - 0x100, points - 0x900)


def _packed(batches):
    """Arrow batches of (sym, freq) as one row each: ids, lengths, weights."""
    import pyarrow as pa

    for batch in batches:
        words = batch.column("sym").to_pylist()
        arrays = _ids("".join(words)).astype("<u4"), np.array([len(w) for w in words], "<i4"), batch.column("freq").to_numpy(zero_copy_only=False).astype("<i8")
        yield pa.RecordBatch.from_pylist([{name: x.tobytes() for name, x in zip(("ids", "lengths", "freq"), arrays)}], pa.schema([(name, pa.binary()) for name in ("ids", "lengths", "freq")]))


def train_collected(words: DataFrame, target: int, threshold: int) -> list[Merge]:
    """The same from a written table (sym, freq), which comes to the driver packed and by partition."""
    kept = words.filter(F.length("sym") > 1).select("sym", "freq")
    seen = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("sym")), F.lit(0)).alias("symbols")).first()
    rows = kept.mapInArrow(_packed, "ids binary, lengths binary, freq binary").toLocalIterator()
    blocks = ((np.frombuffer(r.ids, "<u4"), np.frombuffer(r.lengths, "<i4"), np.frombuffer(r.freq, "<i8")) for r in rows)
    return train_blocks(blocks, seen.symbols, seen.n, target, threshold)


def train(docs: DataFrame, config: TrainConfig = TrainConfig(), text: str = "text", weight: Column | int = SCALE) -> tuple[Tokenizer, list[Merge]]:
    tokenizer, merges, _ = train_with_stats(docs, config, text, weight, False)
    return tokenizer, merges


def train_with_stats(docs: DataFrame, config: TrainConfig = TrainConfig(), text: str = "text", weight: Column | int = SCALE, measured: bool = True) -> tuple[Tokenizer, list[Merge], TrainingStats | None]:
    """Tokenizer, merges with their counts, and counts of what was read (one more pass over the documents)."""
    target = check_target(config.vocab_size)
    if target == BASE:
        return Tokenizer.from_merges([]), [], TrainingStats(0, 0, 0, 0, 0, BASE)
    spark, threshold, strategy = docs.sparkSession, config.min_frequency * SCALE, config.strategy
    with unwrapped():
        kept, path = written(symbol_words(word_counts(docs, text, weight)), "words")
        try:
            seen = kept.agg(F.count("*").alias("n"), F.sum(F.length("sym")).alias("symbols")).first()
            if not seen.n:
                raise TokenError("NoTrainingData")
            if strategy == "auto":
                strategy = "collect" if seen.symbols * SYMBOL_BYTES <= config.driver_bytes else "rounds"
            merges = train_collected(kept, target, threshold) if strategy == "collect" else train_rounds(kept, target, threshold, config.look)
        finally:
            remove(spark, path)
        stats = None
        if measured:
            s = statistics(docs, text).first()
            stats = TrainingStats(s.accepted_lines, s.skipped_empty_lines + s.skipped_special_only_lines, s.accepted_line_bytes, seen.n, len(merges), BASE + len(merges))
    return Tokenizer.from_merges([(m.a, m.b) for m in merges]), merges, stats
