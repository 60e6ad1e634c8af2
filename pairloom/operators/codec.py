"""Encoding and decoding of documents.

``encode`` and ``decode`` are Arrow functions without a shuffle: each worker keeps the ids of the pieces it has met.
``encode_native`` is the same in DataFrame functions alone: the lowest merge first, leftmost first, equals replacing the
merges' pairs in rank order, because a merge only makes pairs of higher rank.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CodecError
from ..functions.tokens import byte_token, latin, symbol, to_symbols, token_of_column
from .presegment import pieces, special_spans
from .tokenizer import Tokenizer
from .written import written

SCHEMA = "pairloom_encoded_tokens_v1"
_piece = re.compile(rb"\n|\r(?=\n|\Z)|(?:(?!\r(?:\n|\Z))[\t\x0b\x0c\r ])*[^\t\n\x0b\x0c\r ]+|(?:(?!\r(?:\n|\Z))[\t\x0b\x0c\r ])+")
_coders: dict[str, "Coder"] = {}
KEEP_CODERS = 4
PART_BYTES = 1 << 20
SLICE = 1 << 16  # ids of a long document that ``decode_join`` looks up at once


@dataclass(frozen=True)
class Limits:
    input_bytes: int = 8 << 20
    tokens: int = 8_388_608
    decoded_bytes: int = 32 << 20
    json_bytes: int = 128 << 20


class Coder:
    """Byte-exact encoding on one machine, with the pieces met so far kept."""

    def __init__(self, tokenizer: Tokenizer, keep: int = 500_000):
        self.tokenizer, self.keep, self.known = tokenizer, keep, {}
        self.span = re.compile(b"(" + tokenizer.special.alternation().encode("latin-1") + b")")
        self.alias = {a.encode("latin-1"): i for a, i in tokenizer.special.aliases}

    def ordinary(self, data: bytes) -> list[int]:
        ids, ranks = [byte_token(b) for b in data], self.tokenizer.ranks
        while len(ids) > 1:
            best = min((ranks.get(p, 1 << 30) for p in zip(ids, ids[1:])))
            if best == 1 << 30:
                break
            a, b, _ = self.tokenizer.merges[best - 276]
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b:
                    out.append(best)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def piece(self, data: bytes) -> list[int]:
        got = self.known.get(data)
        if got is None:
            got = []
            for part in self.span.split(data):
                if part:
                    got += [self.alias[part]] if part in self.alias else self.ordinary(part)
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[data] = got
        return got

    def encode(self, data: bytes) -> list[int]:
        out: list[int] = []
        for piece in _piece.findall(data):
            out += self.piece(piece)
        return out

    def decode(self, ids) -> bytes:
        vocab = self.tokenizer.vocab
        for i in ids:
            if not 0 <= i < len(vocab):
                raise CodecError("InvalidTokenId", str(i))
        return b"".join(vocab[i] for i in ids)


def _coder(name: str, sent) -> Coder:
    """The worker's coder of a tokenizer, by its digest; encoders and decoders of one tokenizer share it."""
    if name not in _coders:
        if len(_coders) >= KEEP_CODERS:
            _coders.pop(next(iter(_coders)))
        _coders[name] = Coder(sent.value)
    return _coders[name]


def encoder(spark, tokenizer: Tokenizer, part_bytes: int | None = None):
    """Column function: binary -> array<int>. The tokenizer has at most 131,072 tokens.

    With ``part_bytes`` the ids leave the worker whenever so many bytes are encoded, not by Arrow batch of documents: that
    bounds what the worker and the JVM hold, and stands in a plan step of its own (no decoder is chained to it).
    """
    name, sent = tokenizer.digest, spark.sparkContext.broadcast(tokenizer)

    def run(data: pd.Series) -> pd.Series:
        coder = _coder(name, sent)
        return pd.Series([None if d is None else coder.encode(d) for d in data])

    def run_parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(name, sent)
        for data in batches:
            out, size = [], 0
            for d in data:
                out.append(None if d is None else np.array(coder.encode(d), np.int32))
                size += len(d or b"")
                if size >= part_bytes:
                    yield pd.Series(out)
                    out, size = [], 0
            if out:
                yield pd.Series(out)

    udf = F.pandas_udf(run if part_bytes is None else run_parts, "array<int>")
    return lambda text: udf(text.cast("binary"))


def decoder(spark, tokenizer: Tokenizer):
    name, sent = tokenizer.digest, spark.sparkContext.broadcast(tokenizer)

    def run(ids: pd.Series) -> pd.Series:
        coder = _coder(name, sent)
        return pd.Series([None if x is None else coder.decode([int(i) for i in x]) for x in ids])

    return F.pandas_udf(run, "binary")


def fold(sym: Column, tokenizer: Tokenizer) -> Column:
    """Merges applied to a string of token characters in rank order."""
    if len(tokenizer.merges) <= 50:
        for a, b, m in tokenizer.merges:
            sym = F.replace(sym, F.lit(symbol(a) + symbol(b)), F.lit(symbol(m)))
        return sym
    steps = F.array(*[F.struct(F.lit(symbol(a) + symbol(b)).alias("p"), F.lit(symbol(m)).alias("m")) for a, b, m in tokenizer.merges])
    return F.aggregate(steps, sym, lambda s, r: F.replace(s, r.p, r.m))


def encode_native(text: Column, tokenizer: Tokenizer) -> Column:
    """array<int> of a text or binary column, by DataFrame functions alone; for small numbers of merges."""
    special = tokenizer.special
    spans = F.flatten(F.transform(pieces(latin(text)), lambda p: special_spans(p, special)))
    named = F.create_map(*[F.lit(x) for a, i in special.aliases for x in (a, symbol(i))])
    chars = F.array_join(F.transform(spans, lambda s: F.coalesce(named[s], fold(to_symbols(s), tokenizer))), "")
    return F.when(chars == "", F.array().cast("array<int>")).otherwise(F.transform(F.filter(F.split(chars, ""), lambda c: c != ""), token_of_column))


def encode_distinct(docs: DataFrame, tokenizer: Tokenizer, key: str, text: str = "text") -> DataFrame:
    """key, token_ids by relational steps: pieces, each distinct piece encoded once, joined back and put in order.

    A check of the narrow encoder, and a way to encode where pieces repeat across many machines; a piece that is in more
    than 1 in 4,096 places is broadcast with its ids and not shuffled. An empty text has no ids.
    """
    rows = docs.select(F.col(key), F.posexplode_outer(pieces(latin(F.col(text)))).alias("pos", "piece"))
    counted = rows.filter("piece is not null").groupBy("piece").agg(F.count("*").alias("n"))
    coded = counted.select("piece", "n", encoder(docs.sparkSession, tokenizer)(F.encode("piece", "ISO-8859-1")).alias("ids"))
    kept, _ = written(coded, "pieces")
    total = kept.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(kept.filter(F.col("n") * 4096 > total).select(F.col("piece").alias("_often"), F.col("ids").alias("_often_ids")))
    seldom = kept.filter(F.col("n") * 4096 <= total).select(F.col("piece").alias("_seldom"), F.col("ids").alias("_seldom_ids"))
    rows = rows.join(often, F.col("piece") == F.col("_often"), "left")
    spread = F.when(F.col("_often").isNull(), F.col("piece")).otherwise(F.concat(F.lit("\u0100"), F.xxhash64(key, "pos").cast("string")))  # bytes end at U+00FF
    joined = rows.withColumn("_sought", spread).join(seldom, F.col("_sought") == F.col("_seldom"), "left").withColumn("ids", F.coalesce("_often_ids", "_seldom_ids"))
    grouped = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("pos", "ids")))).alias("r"))
    return grouped.select(key, F.flatten(F.transform("r", lambda r: r.ids)).alias("token_ids"))


def decode_join(encoded: DataFrame, tokenizer: Tokenizer, key: str, ids: str = "token_ids") -> DataFrame:
    """Decoding by a join with the vocabulary: key, decoded binary. Unknown ids raise.

    The vocabulary is folded into one row, its bytes in hex by id, and that row is broadcast and joined to every document:
    no id becomes a row, nothing is shuffled or grouped. Of a document over ``SLICE`` ids so many are looked up at once.
    """
    vocab = tokenizer.vocab_table(encoded.sparkSession).agg(F.array_sort(F.collect_list(F.struct("id", F.hex("bytes").alias("hex")))).alias("v"))  # ids from 0, without gaps
    rows = encoded.select(F.col(key), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_ids")).crossJoin(F.broadcast(vocab.select(F.col("v.hex").alias("_hex"))))
    last = F.size("_ids") - 1
    found = lambda i: F.coalesce(F.get("_hex", i), F.raise_error(F.lit("InvalidTokenId")).cast("string"))
    part = lambda lo: F.array_join(F.transform(F.sequence(lo, F.least(lo + (SLICE - 1), last)), lambda at: found(F.get("_ids", at))), "")
    parts = F.array_join(F.transform(F.sequence(F.lit(0), last, F.lit(SLICE)), part), "")
    return rows.select(key, F.unhex(F.when(last < SLICE, F.array_join(F.transform("_ids", found), "")).otherwise(parts)).alias("decoded"))


def evidence(decoded: Column) -> tuple[Column, Column]:
    """Byte count and upper-case SHA-256 of decoded bytes."""
    return F.octet_length(decoded).cast("long"), F.upper(F.sha2(decoded, 256))


#: The wire form of a bound document, in order.
WIRE = "schema string, token_id_width string, tokenizer struct<vocab_size:int, merge_count:bigint, sequence_sha256:string>, decoded_bytes bigint, decoded_sha256 string, token_count bigint, token_ids array<int>"


def bound_documents(docs: DataFrame, tokenizer: Tokenizer, key: str, text: str = "text") -> DataFrame:
    """key, line: each document's canonical JSON line, its ids bound to the tokenizer and to the bytes they stand for."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key), encoder(spark, tokenizer)(F.col(text)).alias("token_ids"))
    rows = rows.select(key, "token_ids", decoder(spark, tokenizer)("token_ids").alias("_decoded"))
    size, digest = evidence(F.col("_decoded"))
    binding = F.struct(F.lit(len(tokenizer.vocab)).alias("vocab_size"), F.lit(len(tokenizer.merges)).cast("long").alias("merge_count"), F.lit(tokenizer.sequence_sha256()).alias("sequence_sha256"))
    wire = F.struct(F.lit(SCHEMA).alias("schema"), F.lit("u32").alias("token_id_width"), binding.alias("tokenizer"), size.alias("decoded_bytes"), digest.alias("decoded_sha256"), F.size("token_ids").cast("long").alias("token_count"), "token_ids")
    return rows.select(key, F.concat(F.to_json(wire), F.lit("\n")).alias("line"))


def unbound_documents(lines: DataFrame, tokenizer: Tokenizer, key: str, line: str = "line") -> DataFrame:
    """key, decoded, fault: the bytes of each line, or the class of the first check it fails, in the order of ``EncodedDocument``."""
    w = F.from_json(F.rtrim(F.col(line), F.lit("\n")), WIRE, {"mode": "PERMISSIVE"})
    rows = lines.select(F.col(key), F.col(line).alias("_line"), w.alias("w"))
    missing = F.greatest(*[F.col(f"w.{name}").isNull() for name in ("schema", "token_id_width", "tokenizer", "decoded_bytes", "decoded_sha256", "token_count", "token_ids")])
    fault = F.when(F.col("w").isNull() | missing, "Json").when(F.col("w.schema") != SCHEMA, "SchemaMismatch").when(F.col("w.token_id_width") != "u32", "TokenIdWidthMismatch")
    fault = fault.when(F.col("w.token_count") != F.size("w.token_ids"), "TokenCountMismatch").when(~F.forall("w.token_ids", lambda i: F.coalesce((i >= 0) & (i < F.col("w.tokenizer.vocab_size")), F.lit(False))), "InvalidTokenId")
    fault = fault.when(~F.concat(F.to_json("w"), F.lit("\n")).eqNullSafe(F.col("_line")), "Json")
    own = F.struct(F.lit(len(tokenizer.vocab)), F.lit(len(tokenizer.merges)).cast("long"), F.lit(tokenizer.sequence_sha256()))
    fault = fault.when(~F.struct("w.tokenizer.vocab_size", "w.tokenizer.merge_count", "w.tokenizer.sequence_sha256").eqNullSafe(own), "TokenizerBindingMismatch")
    rows = rows.withColumn("_fault", fault).withColumn("_decoded", decoder(lines.sparkSession, tokenizer)(F.when(fault.isNull(), F.col("w.token_ids"))))
    size, digest = evidence(F.col("_decoded"))
    late = F.when(size != F.col("w.decoded_bytes"), "DecodedLengthMismatch").when(digest != F.col("w.decoded_sha256"), "DecodedDigestMismatch")
    rows = rows.select(key, "_decoded", F.coalesce("_fault", late).alias("fault"))
    return rows.select(key, F.when(F.col("fault").isNull(), F.col("_decoded")).alias("decoded"), "fault")


@dataclass(frozen=True)
class EncodedDocument:
    """A document's ids bound to their tokenizer and to the bytes they stand for."""

    vocab_size: int
    merge_count: int
    sequence_sha256: str
    decoded_bytes: int
    decoded_sha256: str
    token_ids: tuple[int, ...]

    @classmethod
    def encode(cls, tokenizer: Tokenizer, data: bytes, limits: Limits = Limits()) -> EncodedDocument:
        if len(data) > limits.input_bytes:
            raise CodecError("ResourceLimitExceeded", "input")
        coder = Coder(tokenizer)
        ids = coder.encode(data)
        if len(ids) > limits.tokens:
            raise CodecError("ResourceLimitExceeded", "tokens")
        back = coder.decode(ids)
        return cls(len(tokenizer.vocab), len(tokenizer.merges), tokenizer.sequence_sha256(), len(back), hashlib.sha256(back).hexdigest().upper(), tuple(ids))

    def to_json(self, limits: Limits = Limits()) -> bytes:
        binding = {"vocab_size": self.vocab_size, "merge_count": self.merge_count, "sequence_sha256": self.sequence_sha256}
        wire = {"schema": SCHEMA, "token_id_width": "u32", "tokenizer": binding, "decoded_bytes": self.decoded_bytes, "decoded_sha256": self.decoded_sha256, "token_count": len(self.token_ids), "token_ids": list(self.token_ids)}
        out = json.dumps(wire, separators=(",", ":")).encode() + b"\n"
        if len(out) > limits.json_bytes:
            raise CodecError("ResourceLimitExceeded", "json")
        return out

    @classmethod
    def parse(cls, data: bytes) -> EncodedDocument:
        try:
            wire = json.loads(data, object_pairs_hook=_closed)
            bound = wire["tokenizer"]
            out = cls(bound["vocab_size"], bound["merge_count"], bound["sequence_sha256"], wire["decoded_bytes"], wire["decoded_sha256"], tuple(wire["token_ids"]))
            schema, width, count = wire["schema"], wire["token_id_width"], wire["token_count"]
        except (ValueError, KeyError, TypeError) as e:
            raise CodecError("Json", str(e)) from e
        if schema != SCHEMA:
            raise CodecError("SchemaMismatch")
        if width != "u32":
            raise CodecError("TokenIdWidthMismatch")
        if count != len(out.token_ids):
            raise CodecError("TokenCountMismatch")
        if any(type(i) is not int or not 0 <= i < out.vocab_size for i in out.token_ids):
            raise CodecError("InvalidTokenId")
        if out.to_json() != data:
            raise CodecError("Json", "not in canonical form")
        return out

    def decode(self, tokenizer: Tokenizer, limits: Limits = Limits()) -> bytes:
        if (self.vocab_size, self.merge_count, self.sequence_sha256) != (len(tokenizer.vocab), len(tokenizer.merges), tokenizer.sequence_sha256()):
            raise CodecError("TokenizerBindingMismatch")
        back = Coder(tokenizer).decode(self.token_ids)
        if len(back) > limits.decoded_bytes:
            raise CodecError("ResourceLimitExceeded", "decoded")
        if len(back) != self.decoded_bytes:
            raise CodecError("DecodedLengthMismatch")
        if hashlib.sha256(back).hexdigest().upper() != self.decoded_sha256:
            raise CodecError("DecodedDigestMismatch")
        return back


def _closed(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a field stands twice")
    return out
