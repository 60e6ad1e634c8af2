"""The frozen tokenizer: vocabulary, merges, their checks and digests."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArtifactError
from ..functions.tokens import BASE, N_SPECIAL, SPECIAL, SpecialTokens, check_target


@dataclass(frozen=True)
class Tokenizer:
    vocab: tuple[bytes, ...]
    merges: tuple[tuple[int, int, int], ...]
    special: SpecialTokens = SPECIAL

    def __post_init__(self):
        check_target(len(self.vocab))
        if len(self.vocab) != BASE + len(self.merges):
            raise ArtifactError("CountMismatch", f"{len(self.vocab)} tokens, {len(self.merges)} merges")
        if self.vocab[:BASE] != base_vocab(self.special):
            raise ArtifactError("BaseVocabularyMismatch")
        seen = set()
        for i, (a, b, m) in enumerate(self.merges):
            if m != BASE + i:
                raise ArtifactError("NonSequentialMerge", str(i))
            if not (N_SPECIAL <= a < m and N_SPECIAL <= b < m):
                raise ArtifactError("MergeOperandOutOfRange", str(i))
            if (a, b) in seen:
                raise ArtifactError("DuplicateMerge", str(i))
            seen.add((a, b))
            if self.vocab[a] + self.vocab[b] != self.vocab[m]:
                raise ArtifactError("ReconstructionMismatch", str(i))

    @classmethod
    def from_merges(cls, pairs, special: SpecialTokens = SPECIAL) -> Tokenizer:
        vocab, merges = list(base_vocab(special)), []
        for a, b in pairs:
            merges.append((a, b, len(vocab)))
            vocab.append(vocab[a] + vocab[b])
        return cls(tuple(vocab), tuple(merges), special)

    @cached_property
    def ranks(self) -> dict[tuple[int, int], int]:
        return {(a, b): m for a, b, m in self.merges}

    def sequence_bytes(self) -> bytes:
        return b"".join(struct.pack("<III", *m) for m in self.merges)

    @cached_property
    def digest(self) -> str:
        """Of everything that decides ids and bytes; workers keep what they know of a tokenizer under it."""
        own = hashlib.sha256(self.sequence_bytes())
        own.update(repr((self.special.canonical, self.special.aliases)).encode())
        return own.hexdigest()

    def sequence_sha256(self) -> str:
        return hashlib.sha256(self.sequence_bytes()).hexdigest().upper()

    def hash_hex(self) -> str:
        """64-bit xor-multiply hash over the vocabulary, a zero after each token, and the merges."""
        data = b"".join(t + b"\0" for t in self.vocab) + self.sequence_bytes()
        value = 1469598103934665603  # fixed value: start
        for b in data:
            value = ((value ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF  # fixed value: prime
        return f"{value:016x}"

    def vocab_table(self, spark) -> DataFrame:
        kinds = ["special"] * N_SPECIAL + ["byte"] * 256 + ["learned"] * len(self.merges)
        return spark.createDataFrame([(i, bytearray(t), k) for i, (t, k) in enumerate(zip(self.vocab, kinds))], "id int, bytes binary, kind string")

    def merge_table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, *m) for i, m in enumerate(self.merges)], "ordinal int, a int, b int, merged int")


def base_vocab(special: SpecialTokens = SPECIAL) -> tuple[bytes, ...]:
    return tuple(t.encode("latin-1") for t in special.canonical) + tuple(bytes([b]) for b in range(256))


def merge_faults(merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows (ordinal, fault) of a merge table that break a rule; empty if it is sound. Three joins with the vocabulary (131,072 tokens at most)."""
    repeats = Window.partitionBy("a", "b").orderBy("ordinal")
    rows = merges.withColumn("again", F.row_number().over(repeats) > 1)
    for name in ("a", "b", "merged"):
        rows = rows.join(F.broadcast(vocab.select(F.col("id").alias(f"_{name}"), F.col("bytes").alias(f"{name}_bytes"))), F.col(name) == F.col(f"_{name}"), "left")
    fault = F.when(F.col("merged") != F.col("ordinal") + BASE, "NonSequentialMerge").when(~F.col("a").between(N_SPECIAL, F.col("merged") - 1) | ~F.col("b").between(N_SPECIAL, F.col("merged") - 1), "MergeOperandOutOfRange")
    fault = fault.when(F.col("again"), "DuplicateMerge").when(~F.concat("a_bytes", "b_bytes").eqNullSafe(F.col("merged_bytes")), "ReconstructionMismatch")
    return rows.select("ordinal", fault.alias("fault")).filter("fault is not null")
