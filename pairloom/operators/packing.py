"""Packing of token ids into windows, and calibration weights: specified for the reference, built here on DataFrames."""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RunError
from .written import remove, written

EOS, PAD = 3, 0
RANGE_ROWS = 100_000


def offsets(encoded: DataFrame, key: str, ids: str = "token_ids") -> DataFrame:
    """key, tokens (with one EOS), start: running sum in key order, by sums of key ranges so that no task sees all rows.

    Ranges hold about ``RANGE_ROWS`` rows, whatever the size; equal keys are in one range.
    """
    sized = encoded.select(F.col(key), (F.size(ids) + 1).cast("long").alias("tokens"))
    ranges = max(1, -(-encoded.count() // RANGE_ROWS))
    parted, _ = written(sized.repartitionByRange(ranges, key).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parted.groupBy("_part").agg(F.sum("tokens").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # a row a range
    own = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = parted.withColumn("_own", F.coalesce(F.sum("tokens").over(own), F.lit(0))).join(F.broadcast(base), "_part")
    return summed.select(key, "tokens", (F.col("_own") + F.col("_base")).cast("long").alias("start"))


def repeated(encoded: DataFrame, key: str, weight: Column, order: Column | None = None) -> DataFrame:
    """Tiers one after the other, each ``weight`` times over: rows (key: long, token_ids) in that order of ``key``.

    order: the tier's place. Numbers are given by (tier, round, old key), so a tier's rounds follow each other whole.
    """
    tier = order if order is not None else F.lit(0)
    rows = encoded.select(tier.cast("long").alias("_tier"), F.explode(F.when(weight > 0, F.sequence(F.lit(1), weight.cast("int")))).alias("_round"), F.col(key).alias("_key"), "token_ids")
    most = rows.agg(F.max("_key"), F.min("_key"), F.max("_round")).first()
    span, rounds = (int(most[0]) - int(most[1]) + 1, int(most[2])) if most[0] is not None else (1, 1)
    low = int(most[1]) if most[1] is not None else 0
    return rows.select(((F.col("_tier") * (rounds + 1) + F.col("_round")) * F.lit(span) + F.col("_key") - F.lit(low)).alias(key), "token_ids")


def pack(encoded: DataFrame, key: str, ids: str = "token_ids", window: int = 256, min_fill: float = 0.25, pad: int = PAD, seed: int | None = None) -> DataFrame:
    """window_no, row: windows of ids in key order, an EOS behind each document; a tail below ``min_fill`` goes, else it is padded.

    A document is cut into the slices that fall into one window each, and slices are shuffled, not ids. ``seed`` orders windows
    by a hash of their number (the reference's own generator cannot be had here).
    """
    placed = encoded.select(key, F.concat(F.col(ids), F.array(F.lit(EOS))).alias("_ids")).join(offsets(encoded, key, ids), key)
    last = F.col("start") + F.size("_ids") - 1
    slices = placed.select("start", "_ids", F.explode(F.sequence(F.floor(F.col("start") / window), F.floor(last / window))).alias("window_no"))
    begin = F.greatest(F.lit(0), F.col("window_no") * window - F.col("start")).cast("int")
    slices = slices.select("window_no", (F.col("start") + begin).alias("at"), F.slice("_ids", begin + 1, F.lit(window) - ((F.col("start") + begin) % window).cast("int")).alias("ids"))
    rows = slices.groupBy("window_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda r: r.ids)).alias("row"))
    rows = rows.filter(F.size("row") >= min_fill * window).withColumn("row", F.concat("row", F.array_repeat(F.lit(pad), window - F.size("row"))))
    return rows if seed is None else rows.orderBy(F.xxhash64(F.lit(seed), "window_no"), "window_no")


def write_corpus(windows: DataFrame, folder: str, tokenizer, tiers: dict[str, int] | None = None, seed: int = 42, window: int = 256, min_fill: float = 0.25) -> dict:
    """``corpus.bin`` (little-endian u16 rows, u32 for a vocabulary beyond 65,536) and ``corpus_meta.json`` in a new folder.

    Windows in the order of a hash of (seed, window_no); they come to the driver one partition after the other and are written
    as they come. tiers: tokens by tier; sequences are told among them in proportion. No time stands in the file, so equal
    input gives equal bytes.
    """
    from ..sources import artifacts
    from ..sources.publish import publish_folder, write_new

    kind = "<u2" if len(tokenizer.vocab) <= 65_536 else "<u4"
    kept, path = written(windows.select("row", F.xxhash64(F.lit(seed), "window_no").alias("o"), "window_no").repartitionByRange("o", "window_no").sortWithinPartitions("o", "window_no"), "windows")
    meta: dict = {}

    def write(aside: str) -> None:
        digest, count = hashlib.sha256(), 0
        with open(os.path.join(aside, "corpus.bin"), "xb") as f:
            for row in kept.orderBy("o", "window_no").toLocalIterator():
                if len(row.row) != window:
                    raise RunError("WindowLengthMismatch", str(row.window_no))
                data = np.array(row.row, kind).tobytes()
                digest.update(data)
                f.write(data)
                count += 1
            f.flush()
            os.fsync(f.fileno())
        total = sum((tiers or {}).values())
        meta.update({
            "seq_count": count, "seq_len": window, "vocab_size": len(tokenizer.vocab), "token_id_bytes": int(kind[-1]), "seed": seed, "min_fill": min_fill,
            "sha256_corpus_bin": digest.hexdigest().upper(), "tier_breakdown": {name: int(count * n / total + 0.5) if total else 0 for name, n in (tiers or {}).items()},
            "vocab_bin_sha256": hashlib.sha256(artifacts.build(tokenizer, "vocab")).hexdigest().upper(), "merges_bin_sha256": hashlib.sha256(artifacts.build(tokenizer, "merges")).hexdigest().upper(),
        })
        write_new(os.path.join(aside, "corpus_meta.json"), json.dumps(meta, indent=2).encode() + b"\n")

    try:
        publish_folder(folder, write)
    finally:
        remove(windows.sparkSession, path)
    return meta


def read_corpus(folder: str) -> tuple[dict, np.ndarray]:
    """The meta file and the rows of a packed corpus, the digest checked."""
    with open(os.path.join(folder, "corpus_meta.json"), "rb") as f:
        meta = json.loads(f.read())
    with open(os.path.join(folder, "corpus.bin"), "rb") as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest().upper() != meta["sha256_corpus_bin"]:
        raise RunError("HashMismatch", "corpus.bin")
    return meta, np.frombuffer(data, f"<u{meta['token_id_bytes']}").reshape(-1, meta["seq_len"])


def calibrate(opportunities: dict[str, int], basis_points: dict[str, int], scale: int = 1000) -> dict[str, int]:
    """Integer family weights that bring the families' places for a pair to the given shares; the smallest is ``scale``."""
    if any(n <= 0 for n in opportunities.values()):
        raise ValueError("each family needs places for a pair")
    raw = {f: basis_points[f] * 10**12 // opportunities[f] for f in opportunities}
    least = min(raw.values())
    return {f: (v * scale + least // 2) // least for f, v in raw.items()}
