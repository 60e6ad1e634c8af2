"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of (dimension, integer weight). Candidates are turned into postings by dimension, a block at a
time; for each dimension the weights of the queries that hold it are scattered, times the posting weights, into a
dense array of scores (queries x candidates of the block). Each task keeps the best k of its block and of its
partition by partition selection among the scores that reach the best so far; the partial lists are merged by a window over each query. Candidates are scanned in place
and never shuffled. Queries are sent out in blocks of at most ``query_block`` rows, one pass over the candidates each.

Score: integer inner product, over the dimensions that both hold. Weights beyond 9e18 stop
there; scores that 64 bits may not hold are added as Python integers and stop at +-(2^63 - 1). Ties go to the smaller id. A query's own row is every row with its id.

Edge cases: vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id; an
empty vector scores 0; of several rows with one query id the smallest vector asks; repeated candidates are listed each;
with fewer than k candidates all are listed; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, table

LIMIT = 1 << 63
STEP, TILE = 32, 4096  # queries and rows scored at once; their scores stay in a core's cache


def _matrix(rows: list, width: int):
    """Weights as a dense array, 0 where a row has no such dimension."""
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def accumulate(queries: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
    """Scores of dense query rows against a block: postings holds (rows, weights) for each dimension, rows None if it is about all."""
    wide = queries.dtype == object or any(w.dtype == object for _, w in postings)
    kind = np.int64
    if not wide and len(queries):
        top = sum(int(np.abs(queries[:, d]).max()) * int(np.abs(w).max()) for d, (_, w) in enumerate(postings) if len(w))
        wide, kind = top >= LIMIT, np.int32 if top < 1 << 31 else np.int64
    if wide:
        kind, queries = object, queries.astype(object)
    scores, part = np.zeros((len(queries), rows), kind), np.empty((len(queries), rows), kind)
    queries = queries.astype(kind)
    for d, (at, weights) in enumerate(postings):
        asking = np.flatnonzero(queries[:, d] != 0)
        if not len(asking) or not len(weights):
            continue
        if at is None and 2 * len(asking) >= len(queries):
            np.multiply(queries[:, d, None], weights.astype(kind)[None, :], out=part)
            scores += part
        else:
            some = np.s_[asking] if at is None else np.s_[asking[:, None], at[None, :]]
            scores[some] += queries[asking, d, None] * weights.astype(kind)[None, :]
    return np.clip(scores, 1 - LIMIT, LIMIT - 1).astype(np.int64) if wide else scores


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: list[int], k: int):
        self.ids, self.k = np.array(ids, np.int64), k
        self.score, self.id = np.full((len(ids), k), -LIMIT), np.zeros((len(ids), k), np.int64)

    def add(self, lo: int, scores: np.ndarray, own: np.ndarray) -> None:
        """Scores of the queries from ``lo`` on against the rows ``own`` (ids, ascending); a query's own rows are left out."""
        low, k = np.iinfo(scores.dtype).min, self.k  # no score is as low
        asked = self.ids[lo : lo + len(scores)]
        for i, (a, b) in enumerate(zip(np.searchsorted(own, asked, "left"), np.searchsorted(own, asked, "right"))):
            scores[i, a:b] = low
        least = np.maximum(self.score[lo : lo + len(scores), -1], low).astype(scores.dtype)[:, None]
        near = scores >= least
        if len(own) > k and near.sum() > 64 * len(scores):
            near &= scores >= np.partition(scores, len(own) - k, axis=1)[:, len(own) - k, None]
        at, row = np.nonzero(near & (scores > low))
        if not len(at):
            return
        some = np.unique(at)
        query = np.r_[np.repeat(some, k), at]
        score = np.r_[self.score[lo + some].reshape(-1), scores[at, row].astype(np.int64)]
        ids = np.r_[self.id[lo + some].reshape(-1), own[row]]
        order = np.lexsort((ids, ~score, query))  # ~score: the order of -score, for the lowest too
        query = query[order]
        first = np.searchsorted(query, some)
        kept = order[first[:, None] + np.arange(k)]
        self.score[lo + some], self.id[lo + some] = score[kept], ids[kept]

    def rows(self) -> pd.DataFrame:
        full = self.score > -LIMIT
        return pd.DataFrame({"query_id": np.repeat(self.ids, full.sum(1)), "vec_id": self.id[full], "score": self.score[full]})


def _scan(sent, k: int):
    def run(frames):
        ids, vectors = sent.value
        width = max((len(v) for v in vectors), default=0)
        queries, best = _matrix(vectors, width), Best(ids, k)
        for frame in frames:
            frame = frame.sort_values("id", kind="stable")
            every, held = frame["id"].to_numpy(), frame["w"].tolist()
            for c in range(0, len(held), TILE):
                own, rows = every[c : c + TILE], held[c : c + TILE]
                lengths = {len(v) for v in rows}
                if len(lengths) == 1:
                    weights = np.stack(rows).astype(np.int64)[:, :width]
                else:
                    weights = _matrix([[int(x) for x in v] for v in rows], max(lengths, default=0))[:, :width]
                postings = []
                for d in range(weights.shape[1]):
                    at = np.flatnonzero(weights[:, d] != 0)
                    postings.append((None, weights[:, d].copy()) if 2 * len(at) >= len(own) else (at, weights[at, d]))
                for lo in range(0, len(ids), STEP):
                    best.add(lo, accumulate(queries[lo : lo + STEP], postings, len(own)), own)
        yield best.rows()

    return run


def weights_of(vector: str, scale: float = 256.0):
    """floor(scale * x) of each component (held within 9e18 of 0); null where the vector takes no part."""
    ok = f"{vector} is not null and not exists({vector}, x -> x is null or isnan(x) or abs(cast(x as double)) = double('infinity'))"
    return F.expr(f"case when {ok} then transform({vector}, x -> cast(floor(greatest(-9e18D, least(9e18D, {scale}D * cast(x as double)))) as bigint)) end")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k best rows of ``vectors``."""
    spark = vectors.sparkSession

    def weighted(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), weights_of(vector_col).alias("w")).filter("id is not null and w is not null")

    rows, asked = weighted(vectors), keep(weighted(queries).groupBy("id").agg(F.min("w").alias("w")), "topk-queries")
    blocks = max(1, math.ceil(asked.count() / query_block))
    schema, partial = "query_id long, vec_id long, score long", []
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    for block in range(blocks):
        own = dealt.filter(F.col("block") == block).select("id", "w").collect()  # at most about query_block rows
        sent = spark.sparkContext.broadcast(([r.id for r in own], [list(r.w) for r in own]))
        found = rows.mapInPandas(_scan(sent, k), schema)
        partial.append(found if blocks == 1 else keep(found, "topk-part"))
    every = partial[0]
    for more in partial[1:]:
        every = every.unionByName(more)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
