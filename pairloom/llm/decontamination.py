"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Words (``\\w+`` of the lower-cased text) are the letters of the edit distance. An item of L words is leaked by a text that
holds a stretch of words within d = floor((1 - similarity) * L) edits of it.

Probes. An item of up to ``PROBE`` words is one probe; a longer one is cut into m equal probes, of which a leak keeps at least
one within d / m edits.

Embedding and LSH. For each repetition a shared random function walks over a window and, at step j, writes the word it stands
on and moves on or not by a random bit of (j, word): edit distance becomes Hamming distance. A few sampled coordinates of
that walk form a key; windows as long as a probe and probes that meet in a key in any repetition are candidates. Samples and
repetitions are set by length: edits of each kind at the allowed distance are simulated, and repetitions added until at most
1 - ``recall`` of the simulated leaks are missed by the one window that begins where the leak does. Windows are embedded
only where the q-gram counting lemma leaves room for a leak: a stretch within d edits of a probe of L words holds at least
L - 1 - 2d of its word pairs.

Verification. A candidate item is compared exactly, by its best alignment within the text around the windows.

Edge cases: a null or wordless text leaks nothing; an item with fewer than ``min_words`` words cannot be told from ordinary
prose and is leaked only by a text that is nothing else (null and empty items by none); probes for which the lemma asks for
no pair are compared with whole texts; equal items are reported each by its id; repeated rows give repeated rows; empty
tables give empty results. The benchmark is sent out in chunks of bounded size, searched together up to ``PASS_WORDS``.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

HITS = "array<struct<item_id:long,first_word:int,distance:int>>"
CHUNK_WORDS, PASS_WORDS = 2_000_000, 16_000_000
MOST_PLACES = 4_000_000  # of pairs of items in texts that are searched together
PROBE = 64
CLASSES = 64  # word classes of the random function
LENGTHS = (8, 12, 16, 24, 32, 48, PROBE)  # lengths whose repetitions are simulated; others take the next
VERIFIED = 4_000  # alignments kept, for passages that many texts share
STEP_CELLS = 1 << 17  # windows times repetitions that are embedded together
_word = re.compile(r"\w+")
_indexes: dict[str, "Index"] = {}


def words(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


def best_alignment(item: tuple, region: list) -> tuple[int, int]:
    """Least edits between the item and any stretch of the region, and where that stretch begins (the first such)."""
    n = len(item)
    cost, start = list(range(n + 1)), [0] * (n + 1)
    best, at = n, 0
    for j, w in enumerate(region):
        above, above_start = 0, j
        cost[0], start[0] = 0, j + 1
        for i in range(1, n + 1):
            sub, sub_start = above + (item[i - 1] != w), above_start
            above, above_start = cost[i], start[i]
            if above + 1 < sub:
                sub, sub_start = above + 1, above_start
            if cost[i - 1] + 1 < sub:
                sub, sub_start = cost[i - 1] + 1, start[i - 1]
            cost[i], start[i] = sub, sub_start
        if cost[n] < best:
            best, at = cost[n], start[n]
    return best, at


def embed(text: np.ndarray, starts: np.ndarray, stops: np.ndarray, bits: np.ndarray, of_word: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Keys, by repetition and window, of the embedded windows text[start : stop], from the sampled steps of each walk.

    bits: by step, repetition and word class. A walk that has left its window writes nothing, so it need not be stopped.
    """
    length, reps, classes = bits.shape
    kind = np.r_[of_word[text], np.zeros(length + 1, np.int32)]
    text = np.r_[text, np.full(length + 1, -1)]
    at = np.repeat(starts[None, :].astype(np.int32 if len(text) < 1 << 31 else np.int64), reps, 0)
    row = (np.arange(reps, dtype=np.int32) * classes)[:, None]
    key = np.zeros(at.shape, np.uint64)
    asked: dict[int, list[int]] = {}
    for r, own in enumerate(steps.tolist()):
        for j in own:
            asked.setdefault(j, []).append(r)
    for j in range(max(asked, default=-1) + 1):
        if j in asked:
            for r in asked[j]:
                letter = np.where(at[r] < stops, text[at[r]] + 1, 0).astype(np.uint64)
                key[r] = (key[r] ^ letter) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j)
        at += bits[j].reshape(-1).take(kind.take(at) + row)
    return key


@lru_cache(maxsize=256)
def repetitions(length: int, edits: int, recall: float, trials: int = 300, most: int = 48, seed: int = 7) -> tuple[int, int]:
    """(samples, repetitions) that miss at most 1 - recall of simulated leaks, of dropped words only and of added words only.

    Replaced words keep the walks in step more than either.
    """
    rng = np.random.default_rng(seed)
    cut = max(1, round(trials * (1 - recall)))
    seen = {1: [], 2: []}
    for dropped in (True, False):
        items = rng.integers(0, 1 << 30, (trials, length))
        windows = []
        for item in items:
            places = np.sort(rng.choice(length, edits, replace=False))
            own = np.delete(item, places) if dropped else np.insert(item, places, rng.integers(0, 1 << 30, edits))
            windows.append(np.r_[own, rng.integers(0, 1 << 30, length)][:length])
        flat = np.concatenate([items.reshape(-1), np.concatenate(windows)])
        words_, flat = np.unique(flat, return_inverse=True)
        bits, of_word = rng.integers(0, 2, (2 * length, most, CLASSES), np.int8), rng.integers(0, CLASSES, len(words_), np.int32)
        starts = np.arange(2 * trials) * length
        for samples in seen:
            key = embed(flat, starts, starts + length, bits, of_word, rng.integers(0, 2 * length, (most, samples)))
            met = np.maximum.accumulate(key[:, :trials] == key[:, trials:], 0)
            seen[samples].append((~met).sum(1))
    for samples in (2, 1):
        enough = np.flatnonzero((np.stack(seen[samples]) <= cut - 1).all(0))
        if len(enough):
            return samples, int(enough[0]) + 1
    return 1, 2 * most


class Index:
    """Items of a benchmark, those that hold each word pair, and the LSH keys of their probes."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = 0.8, min_words: int = 5, recall: float = 0.99, seed: int = 7):
        every = [(i, tuple(words(t))) for i, t in items]
        self.items = [(i, w) for i, w in every if len(w) >= min_words]
        self.short: dict[tuple, list[int]] = {}
        for i, w in every:
            if 0 < len(w) < min_words:
                self.short.setdefault(w, []).append(i)
        self.code = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in self.items for w in ws))}
        self.size = len(self.code) + 1  # words of no item share the last code
        self.edits = [int((1 - similarity) * len(w) + 1e-9) for _, w in self.items]
        owner, offset, length, allowed, coded = [], [], [], [], []
        for k, (_, ws) in enumerate(self.items):
            c = np.array([self.code[w] for w in ws], np.int64)
            cuts = np.linspace(0, len(ws), -(-len(ws) // PROBE) + 1).astype(int)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                owner.append(k)
                offset.append(lo)
                length.append(hi - lo)
                allowed.append(self.edits[k] // (len(cuts) - 1))
                coded.append(c[lo:hi])
        self.owner, self.offset, self.length, self.allowed = (np.array(x, np.int64) for x in (owner, offset, length, allowed))
        self.need, self.reach = self.length - 1 - 2 * self.allowed, self.length - 1 + self.allowed  # pairs to be kept, places they can stand on
        own = [np.unique(c[:-1] * self.size + c[1:]) if need > 0 else c[:0] for c, need in zip(coded, self.need)]
        pairs, holder = np.concatenate([*own, np.zeros(0, np.int64)]), np.repeat(np.arange(len(own)), [len(p) for p in own])
        order = np.argsort(pairs, kind="stable")
        self.holders = holder[order]
        self.pairs, first = np.unique(pairs[order], return_index=True)
        self.first = np.r_[first, len(pairs)]
        self.anywhere = np.unique(self.owner[self.need <= 0]).tolist()
        self.verified: dict[tuple, tuple[int, int]] = {}
        rng = np.random.default_rng(seed)
        self.of_word = rng.integers(0, CLASSES, self.size, np.int32)  # the random function of (step, word), by word classes
        self.walks, self.keys, self.probes = {}, {}, {}
        for n in np.unique(self.length[self.need > 0]).tolist():
            own = np.flatnonzero((self.length == n) & (self.need > 0))
            at = next(x for x in LENGTHS if x >= n)
            samples, reps = repetitions(at, max(int((1 - similarity) * at + 1e-9), int(self.allowed[own].max())), recall)
            self.walks[n] = (rng.integers(0, 2, (2 * n, reps, CLASSES), np.int8), rng.integers(0, 2 * n, (reps, samples)))
            starts = np.arange(len(own)) * n
            key = self.stamps(np.concatenate([coded[k] for k in own]), starts, starts + n, n).reshape(-1)
            order = np.argsort(key, kind="stable")
            self.keys[n], self.probes[n] = key[order], np.tile(own, reps)[order]

    def stamps(self, text: np.ndarray, starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
        """LSH keys by repetition and window; a key tells its repetition."""
        bits, steps = self.walks[n]
        return embed(text, starts, stops, bits, self.of_word, steps) * np.uint64(2 * len(steps) + 1) + np.arange(len(steps), dtype=np.uint64)[:, None]

    def search(self, texts: list[str | None]) -> list[list[dict]]:
        found: list[list[dict]] = []
        for i in range(0, len(texts), 512):
            found += self._search([words(t) for t in texts[i : i + 512]])
        return found

    def _search(self, docs: list[list[str]]) -> list[list[dict]]:
        found: list[list[dict]] = [[{"item_id": i, "first_word": 0, "distance": 0} for i in self.short.get(tuple(ws), ())] if self.short and ws else [] for ws in docs]
        ends = np.cumsum([len(ws) for ws in docs])
        if not self.items or ends[-1] < 2:
            return found
        other = self.size - 1
        codes = np.fromiter(map(self.code.get, chain.from_iterable(docs), repeat(other)), np.int64, ends[-1])
        key = codes[:-1] * self.size + codes[1:]
        key[(codes[:-1] == other) | (codes[1:] == other)] = -1
        key[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < ends[-1])] - 1] = -1
        known = np.flatnonzero(key >= 0)
        at = np.searchsorted(self.pairs, key[known])
        hit = self.pairs[np.minimum(at, len(self.pairs) - 1)] == key[known] if len(self.pairs) else np.zeros(len(known), bool)
        known, at = known[hit], at[hit]
        held = self.first[at + 1] - self.first[at]
        if held.sum() > MOST_PLACES and len(docs) > 1:
            half = len(docs) // 2
            return self._search(docs[:half]) + self._search(docs[half:])
        spread = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
        probe, place = self.holders[np.repeat(self.first[at], held) + spread], np.repeat(known, held)
        order = np.argsort(probe, kind="stable")  # by probe, then place
        probe, place = probe[order], place[order]
        doc = np.searchsorted(ends, place, "right")
        final = np.arange(len(probe)) + self.need[probe] - 1
        ok = final < len(probe)
        begin, final = np.flatnonzero(ok), final[ok]
        ok = (probe[final] == probe[begin]) & (doc[final] == doc[begin]) & (place[final] - place[begin] < self.reach[probe[begin]])
        begin, final = begin[ok], final[ok]
        base = np.r_[0, ends[:-1]]
        probe, doc, first, last = probe[begin], doc[begin], place[begin], place[final]
        earliest = np.maximum(base[doc], last - self.reach[probe] + 1)  # where a leak of the probe can begin: earliest to first
        met = self.meet(codes, ends, probe, doc, earliest, first)
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {(d, k): [(0, len(ws))] for d, ws in enumerate(docs) if ws for k in self.anywhere}
        owner = self.owner[probe]
        slack = np.array(self.edits, np.int64)[owner] - self.allowed[probe]
        behind = np.array([len(w) for _, w in self.items], np.int64)[owner] - self.offset[probe] - self.length[probe]
        lo = np.maximum(0, last - self.reach[probe] + 1 - base[doc] - self.offset[probe] - slack)
        hi = np.minimum(first - base[doc] + self.reach[probe] + 1 + behind + slack, ends[doc] - base[doc])
        for d, k, p, a, b in zip(doc.tolist(), owner.tolist(), probe.tolist(), lo.tolist(), hi.tolist()):
            if (d, p) in met and k not in self.anywhere:
                spans.setdefault((d, k), []).append((a, b))
        for (d, k), own in sorted(spans.items()):
            best = self.verify(k, sorted(own), docs[d])
            if best is not None:
                found[d].append({"item_id": self.items[k][0], "first_word": best[1], "distance": best[0]})
        return found

    def meet(self, codes: np.ndarray, ends: np.ndarray, probe: np.ndarray, doc: np.ndarray, earliest: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(document, probe) that meet in an LSH key with a window that begins between ``earliest`` and ``first``."""
        met: set[tuple[int, int]] = set()
        for n in np.unique(self.length[probe]).tolist():
            own = self.length[probe] == n
            span = first[own] - earliest[own] + 1
            starts = np.unique(np.repeat(earliest[own] - (np.cumsum(span) - span), span) + np.arange(span.sum()))
            reps = len(self.walks[n][1])
            step = max(1, STEP_CELLS // reps)
            for c in range(0, len(starts), step):
                part = starts[c : c + step]
                own_doc = np.searchsorted(ends, part, "right")
                key = self.stamps(codes, part, np.minimum(part + n, ends[own_doc]), n).reshape(-1)
                window = np.tile(own_doc, reps)
                lo, hi = np.searchsorted(self.keys[n], key, "left"), np.searchsorted(self.keys[n], key, "right")
                some = np.flatnonzero(hi > lo)
                span = (hi - lo)[some]
                probes = self.probes[n][np.repeat(lo[some] - (np.cumsum(span) - span), span) + np.arange(span.sum())]
                both = np.unique(np.repeat(window[some], span) * len(self.owner) + probes)
                met.update(zip((both // len(self.owner)).tolist(), (both % len(self.owner)).tolist()))
        return met

    def verify(self, item: int, spans: list[tuple[int, int]], ws: list[str]) -> tuple[int, int] | None:
        own, d_max = self.items[item][1], int(self.edits[item])
        best = None
        regions: list[tuple[int, int]] = []
        for a, b in spans:  # those that overlap are aligned together
            if regions and a <= regions[-1][1] and b - regions[-1][0] <= 8 * len(own):
                regions[-1] = (regions[-1][0], max(b, regions[-1][1]))
            else:
                regions.append((a, b))
        for a, b in regions:
            key = (item, tuple(ws[a:b]))
            if key not in self.verified:
                if len(self.verified) > VERIFIED:
                    self.verified.clear()
                self.verified[key] = best_alignment(own, ws[a:b])
            dist, at = self.verified[key]
            if dist <= d_max and (best is None or dist < best[0]):
                best = (dist, a + at)
        return best


def _chunks(benchmark: DataFrame, id_col: str, text_col: str):
    chunk, n = [], 0
    for row in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).orderBy("i", "t").toLocalIterator():
        chunk.append((row.i, row.t))
        n += len(row.t or "") // 4 + 1
        if n >= CHUNK_WORDS:
            yield chunk
            chunk, n = [], 0
    if chunk:
        yield chunk


def _searcher(chunks: list, options: dict):
    """chunks: broadcast items that are searched together."""
    name = uuid.uuid4().hex

    def search(texts: pd.Series) -> pd.Series:
        if name not in _indexes:
            if len(_indexes) >= 4:
                _indexes.pop(next(iter(_indexes)))
            _indexes[name] = Index([item for sent in chunks for item in sent.value], **options)
        return pd.Series(_indexes[name].search(texts.tolist()))

    return F.pandas_udf(search, HITS).asNondeterministic()  # else the optimiser may run it for a filter and again for its value


def hits(text: Column, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", **options) -> Column:
    """Column of the items that a text leaks: (item_id, first_word, distance), by item."""
    context, columns, held = benchmark.sparkSession.sparkContext, [], []
    for chunk in _chunks(benchmark, id_col, text_col):
        held.append(context.broadcast(chunk))
        if len(held) * CHUNK_WORDS >= PASS_WORDS:
            columns.append(_searcher(held, options)(text))
            held = []
    if held:
        columns.append(_searcher(held, options)(text))
    return F.concat(*columns) if columns else F.array().cast(HITS)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document and item it leaks: id, item_id, first_word (of the best stretch), distance in words."""
    found = docs.select(F.col(id_col).alias(id_col), hits(F.col(text_col), benchmark, **options).alias("hit"))
    return found.select(id_col, F.explode("hit").alias("hit")).select(id_col, "hit.item_id", "hit.first_word", "hit.distance")


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak a benchmark item go.

    Null and wordless texts leak nothing and stay, as does everything if the benchmark is empty; repeated rows share their fate;
    other columns pass unchanged; no documents give none.
    """
    return docs.filter(F.size(hits(F.col("text"), table(spark, sf_dir, "benchmark"))) == 0)
