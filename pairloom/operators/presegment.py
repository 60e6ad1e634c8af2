"""Lines and segments of byte texts, by DataFrame functions on one-character-per-byte text.

Training view: logical lines (by LF, one closing CR stripped), without empty lines and lines that are aliases only; a
segment is a run of white space and the run of other bytes behind it. Lossless view: every byte is in one piece, LF and CRs
before a line's end alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import SPECIAL, SpecialTokens, latin

SPACE = r"\t\n\x0B\f\r "
INNER = r"\t\x0B\f\r "
SEGMENT = rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
LOSSLESS = rf"\n|\r(?=\n|\z)|(?:(?!\r(?:\n|\z))[{INNER}])*[^{SPACE}]+|(?:(?!\r(?:\n|\z))[{INNER}])+"


def lines(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row a logical line: keys, line_no, raw (without LF), line (without one closing CR)."""
    out = docs.select(*keys, F.posexplode(F.split(latin(F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))), "\n", -1)).alias("line_no", "raw"))
    return out.withColumn("line", F.regexp_replace("raw", r"\r\z", ""))


def accepted(line: Column, special: SpecialTokens = SPECIAL) -> Column:
    return (line != "") & ~line.rlike(rf"\A(?:{special.alternation()})+\z")


def segment_list(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(SEGMENT), F.lit(0))


def segments(docs: DataFrame, *keys: str, text: str = "text", special: SpecialTokens = SPECIAL) -> DataFrame:
    """One row a training segment: keys, line_no, seg_no, segment (one character a byte)."""
    kept = lines(docs, *keys, text=text).filter(accepted(F.col("line"), special))
    return kept.select(*keys, "line_no", F.posexplode(segment_list(F.col("line"))).alias("seg_no", "segment"))


def pieces(data: Column) -> Column:
    """Array of the lossless pieces of a byte text given as ISO-8859-1 text."""
    return F.regexp_extract_all(data, F.lit(LOSSLESS), F.lit(0))


def lossless(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row a piece: keys, pos, piece, kind (``literal`` for LF and CRs before a line's end)."""
    out = docs.withColumn("_p", pieces(latin(F.col(text).cast("binary"))))
    out = out.select(*keys, F.size("_p").alias("_n"), F.posexplode("_p").alias("pos", "piece"), "_p")
    after = F.when(F.col("pos") + 1 < F.col("_n"), F.try_element_at("_p", F.col("pos") + 2))
    literal = (F.col("piece") == "\n") | ((F.col("piece") == "\r") & (after.isNull() | (after == "\n")))
    return out.select(*keys, "pos", "piece", F.when(literal, "literal").otherwise("mergeable").alias("kind"))


def special_spans(segment: Column, special: SpecialTokens = SPECIAL) -> Column:
    """A segment cut into aliases and what stands between them (possessive, so that a long segment takes no stack)."""
    alias = special.alternation()
    return F.regexp_extract_all(segment, F.lit(rf"(?s)(?:{alias})|(?:(?!{alias}).)++"), F.lit(0))


def statistics(docs: DataFrame, text: str = "text", special: SpecialTokens = SPECIAL) -> DataFrame:
    """One row of nine counters over all documents; one pass, no row is multiplied but for lines."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("binary"))), F.lit(0)).cast("long").alias("input_bytes"))
    rows = lines(docs, text=text).select("line", accepted(F.col("line"), special).alias("ok"))
    rows = rows.select("line", "ok", F.when(F.col("ok"), segment_list(F.col("line"))).otherwise(F.array().cast("array<string>")).alias("s"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    counted = rows.agg(
        F.count("*").alias("logical_lines"), count(F.col("ok")).alias("accepted_lines"), count(F.col("line") == "").alias("skipped_empty_lines"),
        count((F.col("line") != "") & ~F.col("ok")).alias("skipped_special_only_lines"), count(F.when(F.col("ok"), F.length("line"))).alias("accepted_line_bytes"),
        count(F.size("s")).alias("emitted_segments"), count(F.when(F.col("ok"), F.length("line"))).alias("emitted_segment_bytes"),
        count(F.length(F.array_join("s", "")) - F.size("s")).alias("pair_opportunities"),
    )
    return size.crossJoin(counted)  # one row each
