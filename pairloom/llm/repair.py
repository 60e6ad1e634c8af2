"""Re-Pair grammar compression of token-id streams, and the block file that holds it.

``compress`` repeats rounds until no pair comes ``min_count`` times: count adjacent pairs exactly, give those at least an
eighth as frequent as the most frequent one nonterminals, replace them, of overlapping ones the more frequent. Counts of a
pair only fall unless a neighbour is replaced, so a round looks only at places whose pair may still be frequent. While these are
half of all, symbols stand side by side and each round closes the gaps; afterwards they are linked. A pair never
spans the end of a document, so each document owns a run of symbols and can be decoded alone. ``rules`` holds the two symbols
of each nonterminal (smaller symbols only) and ``expansion`` the number of ids each one stands for, which lets ``Block.ids``
skip to a position without decoding what stands before it. A rule takes about 8 bytes and each use of it saves about 2.

Block file (little-endian): magic ``RPB2``; u32 terminals, rules, documents, symbols, bit planes; u64 ids; rules' symbols, both
in a row, as wide numbers; expansion as u32; document ids i64; document id present u8; first symbol u32, first id u64 per
document and one past the end; symbols as wide numbers. Wide numbers: u16 of the low bits, then one packed bit plane for
each further bit that the largest symbol needs.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

MAGIC = b"RPB2"
HEAD = struct.Struct("<4sIIIIIQ")
SHARE = 8  # a round takes the pairs with at least 1 / SHARE of the highest count
MIN_COUNT = 8
SIEVE_BITS = 20


def _every_second(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of the ascending places, ``after`` their next ones, are second, fourth and so on in a row of neighbours."""
    run = np.flatnonzero(np.r_[True, after[:-1] != at[1:]])
    return (np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 1


def _apart(at: np.ndarray, after: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Which of the ascending places, ``after`` their next ones, to replace: no two neighbours, the lower level first, and none that could still be."""
    kept = left = None
    while left is None or len(left):
        near, below = after[:-1] == at[1:], level[:-1] < level[1:]
        win = np.ones(len(at), bool)
        win[1:] &= ~(near & below)
        win[:-1] &= ~near | below
        done = win.copy()
        done[1:] |= near & win[:-1]
        done[:-1] |= near & win[1:]
        rest = np.flatnonzero(~done)
        if left is None:
            kept, left = win, rest
        else:
            kept[left[win]] = True
            left = left[rest]
        at, after, level = at[rest], after[rest], level[rest]
    return kept


def compress(ids: np.ndarray, ends: np.ndarray, terminals: int, rounds: int | None = None, min_count: int = MIN_COUNT):
    """ids: uint32; ends: index past each document's last id. Returns symbols, past-the-end symbol of each document, rules."""
    seq, filled = ids.astype(np.uint32), np.diff(np.r_[0, np.asarray(ends, np.int64)]) > 0
    last = np.zeros(len(seq), bool)  # symbols that end a document
    last[np.asarray(ends, np.int64)[filled] - 1] = True
    live, linked = ~last, False  # live: the pair that begins here may be frequent
    rules: list[np.ndarray] = []
    at_slot = np.zeros(1 << SIEVE_BITS, np.int32)
    known = done = 0
    while rounds is None or done < rounds:
        done += 1
        frequent = np.count_nonzero(live)
        if not frequent:
            break
        if not linked and 2 * frequent < len(seq):
            linked, place = True, np.int32 if len(seq) < 1 << 31 else np.int64
            after, before = np.arange(1, len(seq) + 1, dtype=place), np.arange(-1, len(seq) - 1, dtype=place)  # -1: none in the document
            before[np.r_[0, np.flatnonzero(last)[:-1] + 1]], after[last] = -1, -1
            there = np.ones(len(seq), bool)
        word, bits, mix = (np.uint32, 16, 0x9E3779B1) if terminals + known <= 1 << 16 else (np.uint64, 32, 0x9E3779B97F4A7C15)
        slot = lambda key: (key * word(mix)) >> word(2 * bits - SIEVE_BITS)
        if linked:
            at = np.flatnonzero(live)
            then = after[at]
            left, right = seq[at], seq[then]
        else:
            left, right, counted = seq[:-1], seq[1:], live[:-1]
        key = np.left_shift(left, word(bits), dtype=word)
        key |= right
        second = np.zeros(len(key), bool)  # in a run of one symbol every second pair overlaps the one before
        equal = np.flatnonzero(left == right if linked else (left == right) & counted)
        if len(equal):
            second[equal[_every_second(at[equal], then[equal]) if linked else _every_second(equal, equal + 1)]] = True
        if linked:
            ordered = np.sort(key[~second] if len(equal) else key)
        else:
            ordered = np.sort(key[counted & ~second if len(equal) else counted])
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        count = np.diff(np.r_[first, len(ordered)])
        top = int(count.max())
        if top < min_count:
            break
        first, count = first[count >= min_count], count[count >= min_count]
        sieve = np.zeros(1 << SIEVE_BITS, np.uint8)  # a sieve only; pairs are told apart by their keys
        sieve[slot(ordered[first])] = 1
        first, count = first[count * SHARE >= top], count[count * SHARE >= top]
        pair = ordered[first]
        sieve[slot(pair)] = 2
        found = sieve[slot(key)]
        if linked:
            live[at[found == 0]] = False  # rarer, until a neighbour changes
        else:
            found *= counted
            np.not_equal(found, 0, out=counted)
        own = np.flatnonzero(found == 2)
        own_key = key[own]
        at_slot[slot(pair)] = np.arange(len(pair), dtype=np.int32)
        which = at_slot[slot(own_key)]
        hit = pair[which] == own_key
        other = np.flatnonzero(~hit)  # of pairs that share a slot the last one is found so, the others by search
        which[other] = np.minimum(np.searchsorted(pair, own_key[other]), len(pair) - 1)
        hit[other] = pair[which[other]] == own_key[other]
        own, which = own[hit], which[hit]
        second = second[own]
        at, then = (at[own], then[own]) if linked else (own, own + 1)
        rank = np.zeros(len(pair), np.int32)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(pair), dtype=np.int32)
        level = 2 * rank[which] + second
        kept, near = np.ones(len(at), bool), then[:-1] == at[1:]
        kept[1:] &= ~near
        kept[:-1] &= ~near
        alone = np.bincount(which[kept], minlength=len(pair))
        part = np.flatnonzero(~kept)  # places that have a neighbour
        near = [part, which[part], at[part], then[part], level[part]]
        while True:  # without the pairs that others leave too rare; the most frequent one always stays
            won = _apart(*near[2:])
            uses = alone + np.bincount(near[1][won], minlength=len(pair))
            rare = uses < min_count
            stays = ~rare[near[1]]
            if stays.all() and not alone[rare].any():
                break
            alone[rare] = 0
            near = [x[stays] for x in near]
        kept &= uses[which] > 0
        kept[near[0][won]] = True
        chosen = np.flatnonzero(uses)
        symbol = np.zeros(len(pair), np.uint32)
        symbol[chosen] = terminals + known + np.arange(len(chosen), dtype=np.uint32)
        at, gone = at[kept], then[kept]
        seq[at] = symbol[which[kept]]
        if linked:
            then = after[gone]
            after[at] = then
            there[gone] = live[gone] = False
            live[at] = then >= 0
            before[then[then >= 0]] = at[then >= 0]
            behind = before[at]
            live[behind[behind >= 0]] = True
        else:
            last[at] = last[gone]
            live[at] = ~last[at]
            behind = at[1:] - 1 if at[0] == 0 else at - 1
            live[behind[~last[behind]]] = True
            state = live.view(np.uint8) | last.view(np.uint8) << 1
            state[gone] = 4
            seq = seq[np.flatnonzero(state < 4)]
            state = np.frombuffer(state.tobytes().translate(None, b"\4"), np.uint8)
            live, last = (state & 1).view(bool), (state >> 1).view(bool)
        made = pair[chosen]
        rules.append(np.stack([made >> word(bits), made & word((1 << bits) - 1)], 1).astype(np.uint32))
        known += len(chosen)
    made = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    stops = np.r_[0, np.flatnonzero(last) + 1]
    if linked:
        seq, stops = seq[there], np.r_[0, np.cumsum(np.add.reduceat(there, stops[:-1], dtype=np.int64))]
    return seq, stops[np.cumsum(filled)], made


def expansions(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Number of ids of each nonterminal."""
    size = np.ones(terminals + len(rules), np.int64)
    done = 0
    while done < len(rules):  # rules of a round only refer to earlier rounds
        top = terminals + done
        ok = (rules[done:] < top).all(1)
        step = int(np.argmin(ok)) if not ok.all() else len(ok)
        size[top : top + step] = size[rules[done : done + step]].sum(1)
        done += step
    return size[terminals:]


def _wide(numbers: np.ndarray, planes: int) -> bytes:
    low = (numbers & 0xFFFF).astype("<u2").tobytes()
    return low + b"".join(np.packbits((numbers >> (16 + i) & 1).astype(bool), bitorder="little").tobytes() for i in range(planes))


def pack(doc_ids, ids: np.ndarray, ends: np.ndarray, terminals: int, rounds: int | None = None) -> bytes:
    """doc_ids: ints or None."""
    seq, stops, rules = compress(ids, ends, terminals, rounds)
    planes = max(0, (terminals + len(rules) - 1).bit_length() - 16)
    head = HEAD.pack(MAGIC, terminals, len(rules), len(ends), len(seq), planes, len(ids))
    parts = [expansions(rules, terminals).astype("<u4"), np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is not None for d in doc_ids], "u1"), np.r_[0, stops].astype("<u4"), np.r_[0, ends].astype("<u8")]
    return head + _wide(rules.reshape(-1), planes) + b"".join(p.tobytes() for p in parts) + _wide(seq, planes)


class Block:
    def __init__(self, data: bytes):
        magic, self.terminals, n_rules, self.n_docs, n_symbols, planes, self.n_ids = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a Re-Pair block")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        def wide(n: int) -> np.ndarray:
            out = take("<u2", n).astype(np.uint32)
            for i in range(planes):
                out |= np.unpackbits(take("u1", -(-n // 8)), count=n, bitorder="little").astype(np.uint32) << np.uint32(16 + i)
            return out

        self.rules, self.expansion = wide(2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        doc_ids, present = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [int(d) if p else None for d, p in zip(doc_ids, present)]
        self.first_symbol, self.first_id = take("<u4", self.n_docs + 1), take("<u8", self.n_docs + 1)
        self.symbols = wide(n_symbols)
        if at != len(data):
            raise ValueError("a Re-Pair block of another length than its header says")
        size = np.r_[np.ones(self.terminals, np.int64), self.expansion]
        self._start = np.r_[0, np.cumsum(size)]
        self._flat = np.empty(int(self._start[-1]), np.uint32)  # ids of each terminal and rule, one after the other
        self._flat[: self.terminals] = np.arange(self.terminals, dtype=np.uint32)
        done = 0
        while done < n_rules:
            top = self.terminals + done
            ok = (self.rules[done:] < top).all(1)
            step = int(np.argmin(ok)) if not ok.all() else len(ok)
            part = self._expand(self.rules[done : done + step].reshape(-1), top)
            self._flat[self._start[top] : self._start[top] + len(part)] = part
            done += step

    def _expand(self, symbols: np.ndarray, known: int | None = None) -> np.ndarray:
        """Ids of the symbols in a row, which are all among the first ``known``."""
        known = self.terminals + len(self.rules) if known is None else known
        strings = pa.Array.from_buffers(pa.large_binary(), known, [None, pa.py_buffer(4 * self._start[: known + 1]), pa.py_buffer(self._flat)])
        return np.frombuffer(strings.take(pa.array(symbols)).buffers()[2] or b"", np.uint32)

    def all_ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def ids(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of document number ``doc`` of this block; only the symbols that cover them are decoded."""
        symbols = self.symbols[self.first_symbol[doc] : self.first_symbol[doc + 1]]
        bounds = np.cumsum(np.r_[np.ones(self.terminals, np.int64), self.expansion][symbols.astype(np.int64)])
        length = int(bounds[-1]) if len(bounds) else 0
        stop = length if stop is None else min(stop, length)
        if start >= stop:
            return np.zeros(0, np.uint32)
        lo, hi = int(np.searchsorted(bounds, start, "right")), int(np.searchsorted(bounds, stop, "left"))
        skipped = int(bounds[lo - 1]) if lo else 0
        return self._expand(symbols[lo : hi + 1])[start - skipped : stop - skipped]
