"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1, given as knots (time, weight) joined by lines. Its integral is
the source's weight; the share of the whole demand follows from it, no source gets more than ``max_epochs`` times its size,
and what a capped source leaves goes to the others by weight. A source's documents form a stream in the order of their ids' MD5, run through
up to ``max_epochs`` times; the token at offset o of the stream is needed at the time when the source's cumulative demand
(the schedule's integral) reaches o, so inverting that integral gives the training position. The takes of a document follow
one another by the source's size in the stream, and each has a position of its own. Output is range-sorted by position: of
each document's first take in ``mix``, of every take in ``mixing_stage``.

Running sums are taken within (source, leading bits of the MD5) and joined to the buckets' offsets, so a hot source is spread.

Edge cases: a null text has size 0; a null source is a source of its own and ranks last; a source without words has
target 0; a document whose source's stream ends within it is taken in part; documents not taken have a null position and
stand last; repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, table

#: By source rank, repeating. The integrals are the weights 5, 2 and 1.
SCHEDULES = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 2.0), (0.5, 2.5), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
WORD = r"[^\x20\x09-\x0D]+"
MANY_SOURCES = 100_000


def integral(knots) -> Fraction:
    return sum(((Fraction(b[0]) - Fraction(a[0])) * (Fraction(a[1]) + Fraction(b[1])) / 2 for a, b in zip(knots, knots[1:])), Fraction(0))


def targets(sizes: list[int], weights: list[Fraction], demand: Fraction, max_epochs: int) -> list[Fraction]:
    """Shares of ``demand`` by weight; a share above ``max_epochs`` sizes stops there and the excess goes to the rest by weight."""
    out, open_, left = [Fraction(0)] * len(sizes), list(range(len(sizes))), Fraction(demand)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] > max_epochs * sizes[i] * total]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = Fraction(max_epochs * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def _plan(totals: list, schedules, demand_ratio: Fraction, max_epochs: int) -> list[tuple]:
    """One row a source: source, source_size, target, want, knot times, weights and cumulated integrals."""
    ranked = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    of = [schedules[i % len(schedules)] for i in range(len(ranked))]
    sizes = [int(r["source_size"]) for r in ranked]
    goal = targets(sizes, [integral(k) for k in of], demand_ratio * sum(sizes), max_epochs)
    rows = []
    for r, knots, size, t in zip(ranked, of, sizes, goal):
        done = [float(integral(knots[: i + 1])) for i in range(len(knots))]
        rows.append((r["source"], size, float(t), int(t + Fraction(1, 2)), [float(k[0]) for k in knots], [float(k[1]) for k in knots], done))
    return rows


_schema = T.StructType([T.StructField("of_source", T.StringType())] + [T.StructField(n, T.LongType() if n != "target" else T.DoubleType()) for n in ("source_size", "target", "want")] + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("times", "weights", "done")])


def _sized(doc_id, text, source, *others) -> list:
    """Columns for :func:`_placed`; ``mark`` orders rows of one id and size, ``stream`` the ids of a source."""
    stream = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return [doc_id.alias("doc_id"), F.substring(stream, 1, 16).alias("stream"), source.alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("mark"), *others]


def _placed(sized: DataFrame, schedules=SCHEDULES, demand_ratio: Fraction = Fraction(3, 2), max_epochs: int = 2, bucket_rows: int = 1024) -> DataFrame:
    """The rows of ``sized`` with source_size, target, taken and positions (one for each time a row is taken, also in part)."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()  # a row a source
    rows = sum(r["n"] for r in totals)
    buckets = 8
    while buckets * bucket_rows < rows and buckets < 1 << 16:
        buckets *= 2
    plan = spark.createDataFrame(_plan(totals, schedules, Fraction(demand_ratio), max_epochs), _schema)
    if len(totals) <= MANY_SOURCES:
        plan = F.broadcast(plan)

    lead = F.conv(F.substring("stream", 1, 4), 16, 10).cast("int")  # 0 to 65,535
    keyed = sized.withColumn("bucket", F.floor(lead * buckets / (1 << 16)).cast("int"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    by_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("bucket").alias("k"), F.coalesce(F.sum("n").over(by_source), F.lit(0)).alias("offset"))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("stream", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.withColumn("before", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    run = run.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")))
    run = run.withColumn("start", F.col("before") + F.col("offset")).join(plan, F.col("source").eqNullSafe(F.col("of_source")))

    whole = F.expr("CASE WHEN source_size > 0 THEN want DIV source_size ELSE 0 END")
    run = run.withColumn("epochs", whole).withColumn("rest", F.expr("want - epochs * source_size"))
    run = run.withColumn("part", F.expr("greatest(0L, least(size, rest - start))")).withColumn("taken", F.expr("size * epochs + part"))
    needs = "transform(sequence(0L, epochs + IF(part > 0, 0, -1)), e -> least(1D, (e * source_size + start) / want) * done[size(done) - 1])"
    run = run.withColumn("needs", F.expr(f"CASE WHEN taken > 0 THEN {needs} ELSE CAST(array() AS array<double>) END"))
    run = run.withColumn("places", F.expr("transform(needs, n -> struct(n AS need, greatest(1, least(size(done) - 1, size(filter(done, d -> d <= n)))) AS i))"))
    run = run.withColumn("gaps", F.expr("transform(places, p -> struct(p.i AS i, p.need - done[p.i - 1] AS gap, (weights[p.i] - weights[p.i - 1]) / (times[p.i] - times[p.i - 1]) AS slope))"))
    step = "CASE WHEN g.gap <= 0 THEN 0D ELSE 2 * g.gap / (weights[g.i - 1] + sqrt(greatest(0D, weights[g.i - 1] * weights[g.i - 1] + 2 * g.slope * g.gap))) END"
    return run.select(*sized.columns, "source_size", "target", "taken", F.expr(f"transform(gaps, g -> times[g.i - 1] + {step})").alias("positions"))


def mix(docs: DataFrame, schedules=SCHEDULES, demand_ratio: Fraction = Fraction(3, 2), max_epochs: int = 2, bucket_rows: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: id, source, size, source_size, target, taken, position (0..1, null if not taken), positions; sorted by position.

    ``positions`` holds the place of each take, ``position`` that of the first.
    """
    sized = keep(docs.select(*_sized(F.col(id_col), F.col(text_col), F.col(source_col))), "mix-sizes")
    out = _placed(sized, schedules, demand_ratio, max_epochs, bucket_rows).withColumn("position", F.get("positions", F.lit(0)))
    spread = F.coalesce("position", 1 + F.pmod(F.xxhash64("doc_id", "size"), F.lit(1 << 30)) / (1 << 30))
    out = out.select("doc_id", "source", "size", "source_size", "target", "taken", "position", "positions", spread.alias("spread"))
    return out.repartitionByRange("spread", "doc_id").sortWithinPartitions("spread", "doc_id").drop("spread")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("takes"))


#: Targets: with sources ranked by size / weight, the first c of them stop at 2 sizes; c is the least that leaves none above.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ 	-]+')), 0) AS BIGINT) AS size, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS stream FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS own, [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS w FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY CAST(own AS DOUBLE) / w, source NULLS LAST) AS k, CAST(sum(own) OVER () AS BIGINT) AS total FROM s),
c AS (SELECT x.k - 1 AS capped, any_value(x.total) AS total, CAST(coalesce(sum(y.own) FILTER (y.k < x.k), 0) AS BIGINT) AS stopped, CAST(sum(y.w) FILTER (y.k >= x.k) AS BIGINT) AS weight, any_value(x.own) AS own, any_value(x.w) AS w
  FROM r x JOIN r y ON true GROUP BY x.k),
best AS (SELECT * FROM c WHERE w * (3 * total - 4 * stopped) <= 4 * own * weight ORDER BY capped LIMIT 1),
t AS (SELECT r.source, r.own, CASE WHEN best.capped IS NULL OR r.k <= best.capped THEN 4 * r.own * 1 ELSE r.w * (3 * r.total - 4 * best.stopped) END AS num,
  CASE WHEN best.capped IS NULL OR r.k <= best.capped THEN 2 ELSE 2 * best.weight END AS den FROM r LEFT JOIN best ON true),
g AS (SELECT *, (2 * num + den) // (2 * den) AS want FROM t),
p AS (SELECT d.*, own, num, den, CASE WHEN own > 0 THEN want // own ELSE 0 END AS whole, want, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY stream, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, greatest(0, least(size, want - whole * own - start)) AS part FROM p)
SELECT doc_id, size, own AS source_size, CAST(num AS DOUBLE) / CAST(den AS DOUBLE) AS target, CAST(size * whole + part AS BIGINT) AS taken,
  CAST(CASE WHEN size * whole + part > 0 THEN whole + CAST(part > 0 AS INTEGER) ELSE 0 END AS BIGINT) AS takes FROM q
"""


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document stands once for each time the mix takes it (also in part), each at its own place of the curriculum.

    A document without words (a null or empty text) is no part of the mix, which counts words; a null source is a source; repeated
    rows are taken each; other columns pass unchanged; no documents give none.
    """
    rows = keep(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("row_no")), "mix-rows")
    sized = keep(rows.select(*_sized(F.col("row.doc_id"), F.col("row.text"), F.col("row.source"), F.col("row_no"))), "mix-sizes")
    takes = _placed(sized).select(F.col("row_no").alias("of_row"), F.explode("positions").alias("position"))
    out = rows.join(takes, F.col("row_no") == F.col("of_row"))
    return out.repartitionByRange("position", "row.doc_id").sortWithinPartitions("position", "row.doc_id").select("row.*")
