"""SimHash near-duplicate groups with a Gray-order hierarchical index.

Fingerprints: ASCII-lower-cased words, 3-word shingles with repeats, XXH64 (seed 42), majority bits.
Two fingerprints link at ``radius`` (3) or fewer differing bits; groups are connected components.

Search. Distinct fingerprints are dealt out by the pigeonhole rule: of radius + 1 disjoint bit blocks, linked
fingerprints share one whole. Within a block value, fingerprints are sorted by Gray rank and indexed by a hierarchy:
each node keeps the bits on which all members agree, a child only those its parent has not fixed yet. A query
walks down with the differing bits accumulated so far and drops whole nodes once they exceed the radius. A block value
with more than ``group_rows`` fingerprints is dealt out again on its other bits by the same rule, so no link is lost.
A task returns a spanning star of each group it finds, never all pairs; groups meet by alternating large-star and
small-star rounds over written tables.

Edge cases: a null or wordless text has fingerprint zero and links like any other; rows with a null id take part but
give no component id (it is null if no member has an id); repeated rows are repeated in the result; an empty table gives
an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, keep, spread_join, table

FANOUT = 16
CELLS = 4_000_000  # index entries one search step looks at, at most


def fingerprint(text: str | None, width: int = 3) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only the six ASCII spaces
    if not words:
        return 0
    grams = [words[i:] for i in range(width)] if len(words) >= width else [[b" ".join(words)]]
    total, n = np.zeros(64, np.int64), len(grams[-1])
    shingles = map(b" ".join, zip(*grams)) if len(words) >= width else iter(grams[0])
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    for i in range(0, n, 65536):
        part = hashes[i : i + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def fingerprint_of(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in text], np.uint64).view(np.int64))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def gray_rank(x: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x


def link_stars(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the linked sets among fingerprints sorted by group and Gray rank. Links run within a group only."""
    n = len(fp)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, n])
    levels = []  # (and, or, first child, past the last child) from leaves to roots
    low, high, begins, counts = fp, fp, first, sizes
    while True:
        per = -(-counts // FANOUT)
        base = np.repeat(np.cumsum(per) - per, per)
        starts = np.repeat(begins, per) + (np.arange(per.sum()) - base) * FANOUT
        ends = np.minimum(starts + FANOUT, np.repeat(begins + counts, per))
        low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
        levels.append((low, high, starts, ends))
        begins, counts = np.cumsum(per) - per, per
        if (per == 1).all():
            break
    masks = [~(lo ^ hi) for lo, hi, _, _ in levels]
    owns = [np.full(n, ~np.uint64(0))] + masks  # by child level: records, then nodes
    owns = [m & ~np.repeat(masks[i], levels[i][3] - levels[i][2]) for i, m in enumerate(owns[:-1])]
    values = [fp] + [lv[0] for lv in levels]
    lasts = [np.arange(n)]  # the last record below each node
    for _, _, _, ends in levels:
        lasts.append(lasts[-1][ends - 1])

    label = np.arange(n)
    queries = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    weight = np.cumsum(np.repeat(sizes, sizes)[queries])
    of_group = np.repeat(np.arange(len(first)), sizes)
    at = 0
    while at < len(queries):
        to = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + CELLS)))
        q = queries[at:to]
        node, acc = of_group[q], np.zeros(len(q), np.uint8)
        for level in range(len(levels) - 1, -1, -1):
            _, _, starts, ends = levels[level]
            span = ends[node] - starts[node]
            child = np.repeat(starts[node] - (np.cumsum(span) - span), span) + np.arange(span.sum())
            q, acc = np.repeat(q, span), np.repeat(acc, span)
            acc = acc + np.bitwise_count((fp[q] ^ values[level][child]) & owns[level][child])
            ok = (acc <= radius) & (lasts[level][child] > q)
            q, node, acc = q[ok], child[ok], acc[ok]
        while len(q):  # union of what this step found
            a, b = label[q], label[node]
            apart = a != b
            if not apart.any():
                break
            q, node, a, b = q[apart], node[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
        at = to
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _search(radius: int):
    def run(frames):
        held: list[pd.DataFrame] = []
        rows = 0

        def flush(df: pd.DataFrame) -> pd.DataFrame:
            k1, k2, fp = (df[c].to_numpy() for c in ("k1", "k2", "fp"))
            group = np.cumsum(np.r_[False, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
            child, root = link_stars(fp.view(np.uint64), group, radius)
            return pd.DataFrame({"a": fp[child], "b": fp[root]}).drop_duplicates()

        for frame in frames:
            held.append(frame)
            rows += len(frame)
            if rows >= 500_000:
                df = pd.concat(held, ignore_index=True)
                same = (df["k1"] == df["k1"].iloc[-1]) & (df["k2"] == df["k2"].iloc[-1])
                cut = len(df) - int(same.sum())
                if cut:
                    yield flush(df.iloc[:cut])
                held, rows = [df.iloc[cut:]], len(df) - cut
        if rows:
            yield flush(pd.concat(held, ignore_index=True))

    return run


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(bits, parts)]


def _block_value(fp: Column, bits: list[int]) -> Column:
    """The bits of one block (consecutive runs) packed into an int."""
    out, runs = F.lit(0).cast("long"), []
    for b in bits:
        if runs and runs[-1][1] == b:
            runs[-1][1] += 1
        else:
            runs.append([b, b + 1])
    at = 0
    for lo, hi in runs:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)), at))
        at += hi - lo
    return out


def hamming_stars(fps: DataFrame, radius: int = 3, group_rows: int = 1 << 18) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints ``fp`` which links of ``radius`` bits connect."""
    parts = _blocks(list(range(64)), radius + 1)
    keyed = fps.select("fp", F.posexplode(F.array(*[_block_value(F.col("fp"), p) for p in parts])).alias("block", "value"))
    keyed = keyed.select("fp", "block", (F.shiftleft(F.col("block").cast("long"), 32) + F.col("value")).alias("k1"))
    heavy = keep(keyed.groupBy("k1").count().filter(F.col("count") > group_rows).select("k1"), "heavy")
    rows = keyed.withColumn("k2", F.lit(-1).cast("long"))
    if heavy.limit(1).count():
        light = rows.join(heavy, "k1", "left_anti")
        again = keyed.join(heavy, "k1", "left_semi")
        choice = None
        for b, own in enumerate(parts):
            rest = _blocks([x for p in parts if p is not own for x in p], radius + 1)
            values = F.array(*[F.shiftleft(F.lit(i).cast("long"), 24).bitwiseOR(_block_value(F.col("fp"), p)) for i, p in enumerate(rest)])
            choice = F.when(F.col("block") == b, values) if choice is None else choice.when(F.col("block") == b, values)
        rows = light.unionByName(again.withColumn("k2", F.explode(choice)))
    rows = rows.select("k1", "k2", "fp", gray_rank(F.col("fp")).alias("rank"))
    placed = rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "rank").select("k1", "k2", "fp")
    return placed.mapInPandas(_search(radius), "a long, b long")


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b) but the roots; root: the smallest node of the component.

    Alternates large-star and small-star steps until neither changes the edges.
    """
    spark = edges.sparkSession

    def star(pairs: DataFrame, large: bool, total: int) -> DataFrame:
        """total: edges, at least as many as there are."""
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", "n", F.least("a", "m").alias("m"))
        linked = spread_join(both, least, "a", total, F.col("b"))  # the root of a large component stands in all its edges
        if large:
            moved = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(linked.select("a", F.col("m").alias("b")))
        return moved.filter("a <> b").distinct()

    now = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    seen = None
    while True:
        row = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if not row.n or (row.n, row.x) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = (row.n, row.x)
        after = keep(star(star(now, True, 2 * row.n), False, row.n), tag)
        discard(spark, now)
        now = after


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, group_rows: int = 1 << 18) -> DataFrame:
    """One row per row of ``docs``: the id, ``fp`` (long) and ``component_id``, the smallest id reachable."""
    printed = keep(docs.select(F.col(id_col).alias(id_col), fingerprint_of(F.coalesce(F.col(text_col), F.lit(""))).alias("fp")), "fp")
    fps = printed.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n"))
    linked = components(hamming_stars(fps.select("fp"), radius, group_rows))
    member = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    named = member.join(fps, member.node == fps.fp).select("node", "root", "first")
    least = named.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n"))
    group = spread_join(named, least, "root", linked.count(), F.col("node")).select(F.col("node").alias("fp"), "least")
    whole = keep(fps.join(group, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id")), "fp-groups")
    total = whole.agg(F.sum("n")).first()[0] or 0
    return spread_join(printed, whole, "fp", total, F.col(id_col)).select(id_col, "fp", "component_id")


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document with the smallest id of each group stays.

    Rows without an id stay; of several rows with the id that stays one does; null and wordless texts are a group; other columns
    pass unchanged; no documents give none.
    """
    found = keep(near_duplicates(docs.select("doc_id", "text")), "groups")
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
    counts = kept.agg(F.count("*"), F.countDistinct("doc_id")).first()
    out = docs.filter("doc_id is not null").join(kept.distinct() if counts[0] != counts[1] else kept, "doc_id", "left_semi")
    if counts[0] != counts[1]:
        out = out.dropDuplicates(["doc_id"])
    return out.select(docs.columns).unionByName(docs.filter("doc_id is null"))
