"""Sharding of texts of near equal bytes by sampled splitters (DataFrame functions only).

Key: the text's 64-bit hash, so equal texts lie together. A sample of keys is drawn with chance in proportion to size; its
quantiles are the bounds of ``ranges`` fine ranges, and a key that fills a range by itself gets one of its own. Bytes of
each range are then counted exactly and ranges are laid out: large ranges each to the emptiest shard, the others in
key order until a shard is full. A range that is larger than a shard's free room is overfull and divided by the
hash of the id, in parts that are laid out alike. Groups of equal texts stay together unless their range is divided.

Slots: rows are numbered by key within parts of about ``PART_ROWS`` rows, and parts by their place in the shard; a range of more
rows is cut by the hash of the row into as many parts as that takes, which stay in one shard unless the range is overfull.

Edge cases: a null text has no bytes (size 1) and checksum 0, as an empty one; null ids are kept; repeated rows are rows of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, table

SAMPLE = 32_768
PART_ROWS = 1 << 18
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def splitters(sample: list[tuple[int, int]], ranges: int) -> list[int]:
    """First keys of the ranges, from (key, weight): quantiles, and both ends of keys that weigh a range or more."""
    by_key: dict[int, int] = {}
    for key, weight in sample:
        by_key[key] = by_key.get(key, 0) + weight
    step = max(1, sum(by_key.values()) / ranges)
    bounds, run, goal = {LOW}, 0, step
    for key in sorted(by_key):
        if by_key[key] >= step:
            bounds.add(key)
            if key < HIGH:
                bounds.add(key + 1)
        run += by_key[key]
        if run >= goal:
            if key < HIGH:
                bounds.add(key + 1)
            goal = (run // step + 1) * step
    return sorted(bounds)


def lay_out(parts: list[tuple[int, int, int]], shards: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(range, part) -> (shard, place in the shard), from (range, part, bytes)."""
    total = sum(p[2] for p in parts)
    room = [total / shards] * shards
    big = sorted((p for p in parts if p[2] * shards * 32 > total), key=lambda p: (-p[2], p))
    at: dict[tuple[int, int], int] = {}
    for r, s, n in big:
        i = max(range(shards), key=lambda i: (room[i], -i))
        at[r, s], room[i] = i, room[i] - n
    filled, rest = [total / shards - x for x in room], sum(p[2] for p in parts if (p[0], p[1]) not in at)
    low = sorted(filled)
    level = next(x for k in range(shards, 0, -1) if (x := (rest + sum(low[:k])) / k) >= low[k - 1])  # what a shard holds that no large range has overfilled
    room = [max(0.0, level - x) for x in filled]
    i = 0
    for r, s, n in sorted(p for p in parts if (p[0], p[1]) not in at):
        while i < shards - 1 and room[i] < n / 2:
            i += 1
        at[r, s], room[i] = i, room[i] - n
    place, out = [0] * shards, {}
    for key in sorted(at):
        out[key] = (at[key], place[at[key]])
        place[at[key]] += 1
    return out


def _range_of(bounds: list[int]):
    """Index of the range that holds column ``key``: two steps over literal arrays, about the root of their number each."""
    width = max(1, int(len(bounds) ** 0.5))
    coarse = bounds[::width]
    fine = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    longs = lambda xs: f"array({', '.join(f'{x}L' if x > LOW else 'bigint(-9223372036854775808)' for x in xs)})"
    first = F.expr(f"size(filter({longs(coarse)}, b -> b <= key)) - 1")
    table_ = F.expr(f"array({', '.join(map(longs, fine))})")
    return lambda df: df.withColumn("_c", first).withColumn("range", F.col("_c") * width + F.size(F.filter(table_[F.col("_c")], lambda b: b <= F.col("key"))) - 1).drop("_c")


def shard(docs: DataFrame, shards: int = 8, ranges: int = 1024, part_rows: int = PART_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = keep(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    unit = max(1, total // SAMPLE)  # a row of this size or more is in the sample for certain, with its size as weight
    draw = F.pmod(F.xxhash64("doc_id", "key", F.lit(11)), F.lit(unit))
    sample = rows.filter(F.col("size") > draw).groupBy("key").agg(F.sum(F.greatest("size", F.lit(unit))).alias("weight"))
    bounds = splitters([(r.key, r.weight) for r in sample.collect()], ranges)  # about SAMPLE rows, twice that at most in the mean
    ranged = _range_of(bounds)(rows)
    share = max(1, total // ranges)
    counted = ranged.groupBy("range").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()  # a row a range
    sizes = {r["range"]: r["n"] for r in counted}
    divided = {r["range"]: max(2, -(-r["n"] // share) if r["n"] > 4 * share else 0, -(-r["rows"] // part_rows)) for r in counted if r["n"] > 4 * share or r["rows"] > part_rows}
    ways = F.create_map(*[F.lit(x) for kv in divided.items() for x in kv])[F.col("range")] if divided else F.lit(None).cast("int")
    cut = ranged.withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "size", "key", F.lit(5)), ways), F.lit(0)).cast("long"))
    parts = [(r["range"], r["part"], r["n"], r["rows"]) for r in cut.groupBy("range", "part").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()]  # about 2 x ranges, and one for each part_rows rows
    whole = {k for k in divided if sizes[k] * shards * 2 <= total}  # fits in a shard: its parts only bound the sort
    units = [(k, 0, sizes[k]) for k in whole] + [p[:3] for p in parts if p[0] not in whole]
    place = lay_out(units, shards)
    of = {(r, p): place[(r, 0) if r in whole else (r, p)][0] for r, p, _, _ in parts}
    base, filled = {}, [0] * shards
    for r, p, _, n in sorted(parts):
        base[r, p] = filled[of[r, p]]
        filled[of[r, p]] += n
    schema = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("part", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("base", T.LongType())])
    plan = spark.createDataFrame([(r, p, of[r, p], base[r, p]) for r, p, _, _ in parts], schema)
    within = Window.partitionBy("range", "part").orderBy("key", "doc_id", "size", "text_crc32")
    numbered = cut.withColumn("n", F.row_number().over(within) - 1).join(F.broadcast(plan), ["range", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("n")).cast("long").alias("slot"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def sharding_laws(spark, sf_dir: str) -> DataFrame:
    """One row about op6_sharding's result that SQL can tell: rows, bytes, shards used, bytes near equal, slots gapless."""
    by_shard = op6_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.sum("slot").alias("slots"))
    gapless = (F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("slots") * 2 == F.col("n") * (F.col("n") - 1))
    return by_shard.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("shards"),
        (F.max("bytes") - F.min("bytes") <= F.max("largest") + F.sum("bytes") / 400).alias("near_equal"), F.min(gapless).alias("gapless"),
    )


#: Near equal: shards differ by the largest text and a fiftieth of a shard at most.
LAWS_SQL = "SELECT count(*) AS rows, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes, CAST(8 AS BIGINT) AS shards, true AS near_equal, true AS gapless FROM documents"
