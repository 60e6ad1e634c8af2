"""Cut lineage through written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: list[str] = []
_made: list[str] = []  # tables written here and not removed yet


def shared_dir(spark) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="pairloom-"))
    return _own[0]


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def clean(spark) -> None:
    """Remove every table that operators have written and not removed; results that read one are lost."""
    for path in list(_made):
        remove(spark, path)


def remove(spark, path: str) -> None:
    if path in _made:
        _made.remove(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
