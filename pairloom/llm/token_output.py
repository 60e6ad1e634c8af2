"""Token-id output: encode texts, write Re-Pair blocks in ascending id order, read them back.

Texts are range-partitioned and sorted by id; a task encodes its texts, cuts the ids into blocks of about ``block_ids``
(a document is never cut) and writes each block to the shared folder under its final name at once, so a repeated task
leaves the same files. Offsets of documents come from the blocks' totals, never from one task over all rows.

Encoding: every pre-token of the vocabulary is free of white space. Texts are cut at white space, and into pre-tokens where
all characters up to the next white space need no normal form, by the classes of their bytes, many texts at once; other
chunks stay whole. Distinct pieces are told apart by Arrow, and each worker keeps the ids of those it has met; pre-tokens
not met yet are encoded together, chunks go to the tokenizer. The separators U+001C to U+001F, which Python and the
tokenizer class differently, make a chunk go to the tokenizer.

Edge cases: a null text is empty (only the end id); a null id sorts first and stays null; repeated rows stay, in text
order; an empty table writes no block and gives no row; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repair
from .common import fresh_path, keep, open_store, table, write_whole

END_ID = 2
PIECES = 600_000  # whose ids a worker keeps, and as many that it met before
SLICE_BYTES = 6 << 20
_encoders: dict[str, "Encoder"] = {}
#: Latin, Cyrillic and common punctuation: normal forms as they are, with the same lower case and classes everywhere.
RANGE = {*range(0x1C), *range(0x20, 0x300), *range(0x400, 0x483), *range(0x48A, 0x500), *range(0x2010, 0x2028)}
PLAIN = sorted(c for c in RANGE if RANGE.issuperset(map(ord, chr(c).lower())))
_plain = re.compile(f"(?!.*<\\|)[{''.join(re.escape(chr(c)) for c in PLAIN)}]*", re.S)
WHITE, LETTER, NUMBER, OTHER, ODD, END = range(6)  # classes of characters; END is the line feed behind a text
_class = np.full(1 << 16, ODD, np.uint8)
_class[PLAIN] = [WHITE if chr(c).isspace() else {"L": LETTER, "N": NUMBER}.get(category(chr(c))[0], OTHER) for c in PLAIN]
_lower = np.arange(1 << 11, dtype=np.uint16)  # of those of two bytes, which stay such
_lower[[c for c in PLAIN if c < 1 << 11]] = [ord(chr(c).lower()) for c in PLAIN if c < 1 << 11]
_byte_class = _class[:0x80].tobytes() + bytes([ODD]) * 0x80
_byte_lower = bytes(range(256)).lower()
#: What the vocabulary's own pattern takes behind an apostrophe at the start of a pre-token.
SHORT, LONG = np.isin(np.arange(256), list(b"stmd")), [tuple(x) for x in (b"re", b"ve", b"ll")]


def _pieces(texts: pa.Array) -> pa.Array:
    """Lower-case pre-tokens of the texts in a row, chunks with odd characters as they are, a line feed behind each text."""
    texts.validate(full=True)
    texts = pc.binary_join_element_wise(texts.cast(pa.large_string()), *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2])[bounds[0] : bounds[-1]].tobytes()
    last, data = bounds[1:] - bounds[0] - 1, np.frombuffer(raw, np.uint8)
    kind, low = np.frombuffer(bytearray(raw.translate(_byte_class)), np.uint8), np.frombuffer(bytearray(raw.translate(_byte_lower)), np.uint8)
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        first = data[lead]
        two, three = lead[first < 0xE0], lead[(first >= 0xE0) & (first < 0xF0)]
        code = (data[two] & np.uint16(0x1F)) << 6 | data[two + 1] & 0x3F
        kind[two] = kind[two + 1] = _class[code]
        code = _lower[code]
        low[two], low[two + 1] = code >> 6 | 0xC0, code & 0x3F | 0x80
        kind[three] = kind[three + 1] = kind[three + 2] = _class[(data[three] & np.uint16(0xF)) << 12 | (data[three + 1] & np.uint16(0x3F)) << 6 | data[three + 2] & 0x3F]
    kind[last] = END
    special = np.flatnonzero(data == ord("<"))
    odd = np.concatenate([np.flatnonzero(kind == ODD), special[data[special + 1] == ord("|")]])
    if len(odd):
        blank = (kind == WHITE) | (kind == END)
        edge = np.flatnonzero(np.diff(np.r_[True, blank].view(np.int8)))  # starts and ends of chunks in turn
        starts, stops = edge[::2], edge[1::2]
        which = np.zeros(len(starts), bool)
        which[np.searchsorted(starts, odd, "right") - 1] = True
        starts, size = starts[which], (stops - starts)[which]
        whole = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        kind[whole], low[whole] = ODD, data[whole]
    start = np.empty(len(kind), bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[last] = True
    number = np.flatnonzero(kind == NUMBER)
    start[number] = (data[number] & 0xC0) != 0x80
    mark = np.flatnonzero((data == ord("'")) & start & (kind == OTHER))  # a letter behind it is not the last byte
    mark = mark[kind[mark + 1] == LETTER]
    short = SHORT[low[mark + 1]]
    start[mark[short] + 1] = False
    ahead = mark[short] + 2
    start[ahead] = True
    mark = mark[~short]
    mark = mark[kind[mark + 2] == LETTER]
    a, b = low[mark + 1], low[mark + 2]
    long = np.any([(a == x) & (b == y) for x, y in LONG], axis=0)
    start[mark[long] + 1] = False
    start[mark[long] + 3] = True
    white = (kind == WHITE).view(np.uint8) * np.uint8(0xFF)  # a byte that UTF-8 does not have
    low = (low | white).tobytes().translate(None, b"\xff")
    offsets = np.flatnonzero(np.frombuffer((start.view(np.uint8) | white).tobytes().translate(None, b"\xff"), bool))
    return pa.Array.from_buffers(pa.large_string(), len(offsets), [None, pa.py_buffer(np.append(offsets, len(low))), pa.py_buffer(low)])


class Encoder:
    """Ids of texts as little-endian u32 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}  # ids of pieces
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
        others = {k: spec[k] for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if spec.get(k)}
        self.bare = Tokenizer(models.BPE(spec["vocab"], merges, cache_capacity=0, **others))  # the same model without a memory of its own, for pre-tokens that stand apart and need no normalising
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.terminals = self.tokenizer.get_vocab_size(with_added_tokens=True)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # pieces that end a word
        self.closes[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in _encoders:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            _encoders[path] = cls(path)
        return _encoders[path]

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pretokens(self, pretokens: list[str]) -> list[bytes]:
        """Ids of lower-case pre-tokens, many in one text: the last piece of each, and no other, bears the end mark."""
        out = []
        for i in range(0, len(pretokens), 512):
            part = pretokens[i : i + 512]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(stops) != len(part):
                out += self._direct(part)
                continue
            data = ids.tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip([0, *stops], stops)]
        return out

    def _learn(self, pieces: list[str]) -> None:
        plain = list(filter(_plain.fullmatch, pieces))
        self.known.update(zip(plain, self._pretokens(plain)))
        if len(plain) < len(pieces):
            others = list(set(pieces).difference(plain))
            self.known.update(zip(others, self._direct(others)))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, the end id behind each, and the number of ids of each text.

        Distinct pieces are told apart by Arrow; only they are looked up.
        """
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        pieces = _pieces(pc.fill_null(texts, "")).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > PIECES:
            self.older, self.known = self.known, {}
        self.known["\n"] = np.array([end_id], "<u4").tobytes()
        found = list(map(self.known.get, distinct))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            sought = [distinct[i] for i in missing]
            earlier = list(map(self.older.get, sought))
            self._learn([x for x, ids in zip(sought, earlier) if ids is None])
            for i, x, ids in zip(missing, sought, earlier):
                if ids is None:
                    ids = self.known[x]
                else:
                    self.known[x] = ids
                found[i] = ids
        row = pa.array(found, pa.large_binary()).take(pieces.indices)
        ids = np.frombuffer(row.buffers()[2], "<u4")
        last = np.flatnonzero(pieces.indices.to_numpy() == distinct.index("\n"))
        ends = np.frombuffer(row.buffers()[1], np.int64)[last + 1] // 4
        return ids[: ends[-1]], np.diff(np.r_[0, ends])


def _slices(batch: pa.RecordBatch):
    """Runs of rows of at most ``SLICE_BYTES`` of text, or one row."""
    at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, (at[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _writer(path: str, folder: str, end_id: int, block_ids: int, rounds: int | None):
    def run(batches):
        from pyspark import TaskContext

        encoder, shard = Encoder.of(path), TaskContext.get().partitionId()
        store, root = open_store(folder)
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        base = number = ready = 0

        def flush():
            nonlocal base, number, ready, doc_ids, held, counts
            ids, ends = np.concatenate(held), np.cumsum(np.concatenate(counts))
            name = f"{root}/{shard:06d}-{number:05d}.rpb"
            write_whole(store, name, repair.pack(doc_ids, ids, ends, max(encoder.terminals, end_id + 1), rounds))
            row = pa.RecordBatch.from_pydict({"shard": [shard], "block": [number], "file": [name], "base": [base], "n_ids": [len(ids)]}, _rows)
            base, number, ready, doc_ids, held, counts = base + len(ids), number + 1, 0, [], [], []
            return row

        for batch in batches:
            for part in _slices(batch):
                ids, n = encoder.encode(part.column(1), end_id)
                doc_ids += part.column(0).to_pylist()
                held.append(ids)
                counts.append(n)
                ready += len(ids)
                if ready >= block_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    return run


_rows = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("file", pa.string()), ("base", pa.int64()), ("n_ids", pa.int64())])


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block_ids: int = 1 << 21, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Writes the blocks; returns their folder and the written table of blocks (shard, block, file, base in the shard, n_ids)."""
    folder = fresh_path(docs.sparkSession, "token-blocks")
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    placed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    blocks = placed.mapInArrow(_writer(tokenizer, folder, end_id, block_ids, rounds), "shard int, block int, file string, base long, n_ids long")
    return folder, keep(blocks, "token-index")


def read_blocks(folder: str, blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the block files: id, start, n_tokens, ids_crc32."""
    spark = blocks.sparkSession
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row for each write task
    offsets, at = {}, 0
    for row in shards:
        offsets[row.shard] = at
        at += row.n

    def run(batches):
        store, _ = open_store(folder)
        for batch in batches:
            for shard, file, base in zip(*(batch.column(c).to_pylist() for c in ("shard", "file", "base"))):
                with store.open_input_file(file) as source:
                    block = repair.Block(source.read())
                first = block.first_id.astype(np.int64)
                data = memoryview(block.all_ids().astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_pydict({id_col: pa.array(block.doc_ids, pa.int64()), "start": offsets[shard] + base + first[:-1], "n_tokens": np.diff(first), "ids_crc32": pa.array(crc, pa.int64())})

    spread = blocks.select("shard", "file", "base").repartition(max(1, min(100_000, blocks.count())), "file")
    return spread.mapInArrow(run, f"{id_col} long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return read_blocks(*write_blocks(docs, tokenizer or str(public_tokenizers.path("word_bpe_49k.json"))))


def op10_token_output(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def output_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: token blocks of what the stages before have kept, in id order.

    A null text is empty; repeated rows are repeated; other columns are left out; no documents give no row.
    """
    return encode_documents(docs.select("doc_id", "text"))
