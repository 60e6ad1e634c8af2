"""Binary artifacts: 128-byte headed u32 files, and the older headless u16 files (read only).

The magic is a parameter. Headers are checked field by field in file order, then the payload's digest and records.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import ArtifactError
from ..functions.tokens import BASE, MAX_VOCAB
from ..operators.tokenizer import Tokenizer

MAGIC = b"PLOOM3\0\0"
HEADER = struct.Struct("<8sHHBBBBHH4sQQIIQ8s32s32s")
KINDS = {"vocab": (1, 0), "merges": (2, 12)}


@dataclass(frozen=True)
class Metadata:
    kind: str
    record_count: int
    payload_bytes: int
    vocab_size: int
    merge_count: int
    payload_sha256: str | None
    sequence_sha256: str | None
    file_bytes: int


def vocab_payload(tokenizer: Tokenizer) -> bytes:
    return b"".join(struct.pack("<I", len(t)) + t for t in tokenizer.vocab)


def build(tokenizer: Tokenizer, kind: str, magic: bytes = MAGIC) -> bytes:
    code, width = KINDS[kind]
    payload = vocab_payload(tokenizer) if kind == "vocab" else tokenizer.sequence_bytes()
    count = len(tokenizer.vocab) if kind == "vocab" else len(tokenizer.merges)
    head = HEADER.pack(magic, 3, 0, code, 1, 4, width, 128, 0, bytes(4), count, len(payload), BASE, len(tokenizer.vocab), len(tokenizer.merges), bytes(8), hashlib.sha256(payload).digest(), hashlib.sha256(tokenizer.sequence_bytes()).digest())
    return head + payload


def parse_header(data: bytes, kind: str, magic: bytes = MAGIC) -> Metadata:
    if len(data) < HEADER.size:
        raise ArtifactError("Truncated", f"{len(data)} bytes")
    code, width = KINDS[kind]
    got_magic, major, minor, got_code, endian, id_bytes, got_width, head, flags, pad0, count, size, base, vocab, merges, pad1, digest, sequence = HEADER.unpack_from(data)
    rules = (
        (got_magic == magic, "BadMagic"), ((major, minor) == (3, 0), "UnsupportedVersion"), (got_code == code, "WrongArtifactKind"), (endian == 1, "UnsupportedEndianness"),
        (id_bytes == 4, "UnsupportedTokenIdWidth"), (got_width == width, "RecordWidthMismatch"), (head == 128, "HeaderSizeMismatch"), (flags == 0, "UnknownFlags"),
        (pad0 == bytes(4) and pad1 == bytes(8), "ReservedNotZero"), (base == BASE, "BaseCountMismatch"), (BASE <= vocab <= MAX_VOCAB and vocab == BASE + merges, "CountMismatch"),
        (count == (vocab if kind == "vocab" else merges), "CountMismatch"), (kind != "merges" or size == 12 * count, "LengthMismatch"),
        (len(data) >= 128 + size, "Truncated"), (len(data) <= 128 + size, "TrailingData"),
    )
    for ok, name in rules:
        if not ok:
            raise ArtifactError(name)
    return Metadata(kind, count, size, vocab, merges, digest.hex().upper(), sequence.hex().upper(), len(data))


def inspect(data: bytes, kind: str, magic: bytes = MAGIC) -> Metadata:
    meta = parse_header(data, kind, magic)
    payload = data[128:]
    if hashlib.sha256(payload).hexdigest().upper() != meta.payload_sha256:
        raise ArtifactError("PayloadDigestMismatch")
    if kind == "merges" and meta.payload_sha256 != meta.sequence_sha256:
        raise ArtifactError("SequenceDigestMismatch")
    return meta


def vocab_records(payload: bytes, count: int) -> list[bytes]:
    out, at = [], 0
    for _ in range(count):
        if at + 4 > len(payload):
            raise ArtifactError("Truncated")
        (n,) = struct.unpack_from("<I", payload, at)
        if at + 4 + n > len(payload):
            raise ArtifactError("Truncated")
        out.append(payload[at + 4 : at + 4 + n])
        at += 4 + n
    if at != len(payload):
        raise ArtifactError("TrailingData")
    return out


def read_pair(vocab: bytes, merges: bytes, magic: bytes = MAGIC) -> Tokenizer:
    """A tokenizer from a vocabulary and a merge file that belong together."""
    v, m = inspect(vocab, "vocab", magic), inspect(merges, "merges", magic)
    if (v.vocab_size, v.merge_count, v.sequence_sha256) != (m.vocab_size, m.merge_count, m.sequence_sha256):
        raise ArtifactError("PairMismatch")
    return Tokenizer(tuple(vocab_records(vocab[128:], v.record_count)), tuple(struct.iter_unpack("<III", merges[128:])))


def read_pair_v2(vocab: bytes, merges: bytes) -> Tokenizer:
    """The older layout: a u32 count before the records, u16 ids, no digests."""
    if len(vocab) < 4 or len(merges) < 4:
        raise ArtifactError("Truncated")
    (n,), (k,) = struct.unpack_from("<I", vocab), struct.unpack_from("<I", merges)
    if n > 65_536 or k != n - BASE:
        raise ArtifactError("CountMismatch")
    if len(merges) != 4 + 6 * k:
        raise ArtifactError("Truncated" if len(merges) < 4 + 6 * k else "TrailingData")
    return Tokenizer(tuple(vocab_records(vocab[4:], n)), tuple(struct.iter_unpack("<HHH", merges[4:])))


def verify_file(data: bytes, sha256: str, sha512: str) -> None:
    if (hashlib.sha256(data).hexdigest().upper(), hashlib.sha512(data).hexdigest().upper()) != (sha256, sha512):
        raise ArtifactError("FileDigestMismatch")


def parse_records(data: bytes, kind: str, layout: str = "u32", magic: bytes = MAGIC):
    """Rows of one artifact: (id, bytes), or (ordinal, a, b, merged)."""
    if layout == "u32":
        meta = inspect(data, kind, magic)
        payload, count, record = data[128:], meta.record_count, "<III"
    elif layout == "v2u16":
        if len(data) < 4:
            raise ArtifactError("Truncated")
        payload, (count,), record = data[4:], struct.unpack_from("<I", data), "<HHH"
        if kind == "merges" and len(payload) != 6 * count:
            raise ArtifactError("Truncated" if len(payload) < 6 * count else "TrailingData")
    else:
        raise ArtifactError("UnknownLayout", layout)
    if kind == "vocab":
        return list(enumerate(vocab_records(payload, count)))
    return [(i, *m) for i, m in enumerate(struct.iter_unpack(record, payload))]


SCHEMAS = {"vocab": "id int, bytes binary", "merges": "ordinal int, a int, b int, merged int"}


def records(files: DataFrame, kind: str, layout: str = "u32", magic: bytes = MAGIC, content: str = "content") -> DataFrame:
    """Rows of the artifacts in a binary column, such as that of ``binaryFile``, from any store that Spark reads."""
    names = [c.split()[0] for c in SCHEMAS[kind].split(", ")]

    def run(frames):
        for frame in frames:
            for data in frame[content]:
                yield pd.DataFrame(parse_records(bytes(data), kind, layout, magic), columns=names)

    return files.select(content).mapInPandas(run, SCHEMAS[kind])


def fault_of(content: Column, kind: str, magic: bytes = MAGIC) -> Column:
    """The class of the first check that an artifact fails, or ``ok``."""

    def run(data: pd.Series) -> pd.Series:
        def one(x) -> str:
            try:
                parse_records(bytes(x), kind, magic=magic)
            except ArtifactError as e:
                return e.kind
            return "ok"

        return data.map(one)

    return F.pandas_udf(run, "string")(content)


class ArtifactSource(DataSource):
    """``spark.read.format("pair_artifact").option("kind", "vocab" | "merges").option("layout", "u32" | "v2u16").load(path)``."""

    @classmethod
    def name(cls):
        return "pair_artifact"

    def schema(self):
        return SCHEMAS[self.options.get("kind", "vocab")]

    def reader(self, schema):
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [InputPartition(0)]  # the records follow each other; at most 131,072 of them

    def read(self, partition):
        kind, layout = self.options.get("kind", "vocab"), self.options.get("layout", "u32")
        with open(self.options["path"].removeprefix("file://"), "rb") as f:
            data = f.read()
        yield from parse_records(data, kind, layout, self.options.get("magic", MAGIC.decode("latin-1")).encode("latin-1"))
