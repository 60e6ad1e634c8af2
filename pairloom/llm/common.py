"""Shared helpers: table reading, the shared folder, written intermediate tables, shared files."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_made: list[str] = []  # folders made here and not deleted yet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); on a local master a temporary one where it is unset."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None or not os.path.isdir(_own_dir.removeprefix("file://")):
        _own_dir = "file://" + tempfile.mkdtemp(prefix="pairloom-")
    return _own_dir


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(spark: SparkSession, df_or_path) -> None:
    """Delete a table written by :func:`keep` once nothing reads it any more."""
    path = getattr(df_or_path, "_kept_at", df_or_path)
    if isinstance(path, str):
        if path in _made:
            _made.remove(path)
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settle(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """The result of ``make``, written; tables and files that it made on the way are deleted."""
    before = set(_made)
    out = keep(make(), tag)
    for path in [p for p in _made if p not in before and p != out._kept_at]:
        discard(spark, path)
    return out


def clean(spark: SparkSession) -> None:
    """Delete every table and file that operators have made and not deleted; results not yet written are lost."""
    for path in list(_made):
        discard(spark, path)


HEAVY = 4096


def spread_join(rows: DataFrame, groups: DataFrame, key: str, total: int, salt: Column, small: Column | None = None) -> DataFrame:
    """``rows`` with the values of ``groups`` (one row a key, ``n`` rows bear it), null where a key has none.

    A key of more than 1 in 4,096 of the ``total`` rows is hot. Values of hot keys, at most 4,096 rows, are broadcast and the
    rows that bear one are dealt out by ``salt``, so that no task gets all rows of a key. ``small`` tells which values are of
    bounded size; others are never broadcast.
    """
    hot = F.col("n") * HEAVY > total
    hot = hot & small if small is not None else hot
    values = F.struct(*[c for c in groups.columns if c not in (key, "n")])
    sent = groups.filter(hot).select(F.col(key).alias("_hot"), values.alias("_hot_values"))
    rest = groups.filter(~hot).select(F.col(key).alias("_cold"), F.pmod(F.xxhash64(key), F.lit(1)).alias("_part"), values.alias("_cold_values"))
    dealt = rows.join(F.broadcast(sent), F.col(key) == F.col("_hot"), "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(salt), F.lit(HEAVY))).cast("long"))
    joined = dealt.join(rest, (F.col(key) == F.col("_cold")) & (F.col("_salt") == F.col("_part")), "left")
    return joined.withColumn("_values", F.coalesce("_hot_values", "_cold_values")).select(*rows.columns, "_values.*")


def open_store(uri: str):
    """(filesystem, path) of a shared folder for Python code on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def write_whole(store, path: str, data: bytes) -> None:
    """Write a file under a name of its own and move it in place, so that a repeated task leaves one whole file."""
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)
