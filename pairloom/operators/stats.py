"""Weighted segment and pair counts. Sums are taken before the shuffle; ANSI sums raise on overflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import to_symbols
from .presegment import segments

SCALE = 1000


def family_weight(family: Column, weights: dict[str, int], default: int = 0) -> Column:
    """Integer weight of a family, as a literal map (there are few families)."""
    if any(w <= 0 for w in weights.values()):
        raise ValueError("family weights must be positive")
    if not weights:
        return F.lit(default).cast("long")
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[family], F.lit(default)).cast("long")


def word_counts(docs: DataFrame, text: str = "text", weight: Column | int = SCALE) -> DataFrame:
    """(segment, freq): the weights of a segment's occurrences added up; only positive sums."""
    weighted = docs.withColumn("_weight", weight if isinstance(weight, Column) else F.lit(weight).cast("long"))
    found = segments(weighted, "_weight", text=text)
    return found.groupBy("segment").agg(F.sum("_weight").alias("freq")).filter("freq > 0 and segment <> ''")


def symbol_words(counts: DataFrame) -> DataFrame:
    return counts.select(to_symbols(F.col("segment")).alias("sym"), "freq")


def pairs_of(sym: Column) -> Column:
    """Neighbouring pairs, overlapping ones too."""
    return F.when(F.length(sym) > 1, F.transform(F.sequence(F.lit(1), F.length(sym) - 1), lambda i: F.substring(sym, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(pair, n) over (sym, freq)."""
    return words.select("freq", F.explode(pairs_of(F.col("sym"))).alias("pair")).groupBy("pair").agg(F.sum("freq").alias("n"))


def top_pairs(counts: DataFrame, k: int = 1) -> DataFrame:
    """Highest counts first, of equal ones the smaller pair key."""
    return counts.orderBy(F.desc("n"), "pair").limit(k)


def opportunity(docs: DataFrame, family: str, text: str = "text", rollup: bool = False) -> DataFrame:
    """Places for a pair by family (and in all with ``rollup``)."""
    found = segments(docs, family, text=text).withColumn("p", F.greatest(F.length("segment") - 1, F.lit(0)))
    grouped = found.rollup(family) if rollup else found.groupBy(family)
    return grouped.agg(F.sum("p").cast("long").alias("opportunities"), F.count("*").alias("segments"))
