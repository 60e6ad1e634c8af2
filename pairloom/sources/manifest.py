"""Corpus admission: a manifest is checked, compared with what the roots hold, and each file verified.

Files are read and digested by tasks, at admission and again when their bytes are used; only the inventory, which must see
hidden files and links, is taken by the driver.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
import stat
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ManifestError, unwrapped

COMPOSITE, SINGLE = "pairloom_corpus_manifest_v1", "pairloom_single_family_manifest_v1"
FAMILIES = ("identity", "scripture", "wikitext", "bookcorpus")
SINGLE_LABEL = "demo_wikitext_only"
FIELDS = ("ordinal", "family", "root_id", "relative_path", "enabled", "bytes", "sha256", "sha512", "encoding_policy")
ENTRY = "ordinal int, family string, root_id string, relative_path string, enabled boolean, bytes bigint, sha256 string, sha512 string, encoding_policy string"


@dataclass(frozen=True)
class Admitted:
    profile: str
    manifest_sha256: str
    manifest_sha512: str
    manifest_bytes: int
    entries: tuple[dict, ...]
    files: DataFrame = field(compare=False)

    @property
    def total_bytes(self) -> int:
        return sum(e["bytes"] for e in self.entries)


def root_id_ok(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z0-9._-]{1,128}\z")


def path_ok(c: Column) -> Column:
    part = r"(?!\.{1,2}(?:/|\z))[^/\\:\x00]+"
    return c.rlike(rf"\A{part}(?:/{part})*\z") & (F.octet_length(c) <= 4096)


def relative_path_ok(path: str) -> bool:
    """The same rule for one path on the driver."""
    return 0 < len(path.encode()) <= 4096 and not re.search(r"[\\:\x00]", path) and all(p not in ("", ".", "..") for p in path.split("/"))


def parse(data: bytes, profile: str = COMPOSITE) -> dict:
    def closed(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ManifestError("Json", "a field stands twice")
        return dict(pairs)

    try:
        wire = json.loads(data, object_pairs_hook=closed)
    except ValueError as e:
        raise ManifestError("Json", str(e)) from e
    wanted = {"schema", "entries"} | ({"label"} if profile == SINGLE else set())
    if not isinstance(wire, dict) or set(wire) != wanted or any(tuple(e) != FIELDS for e in wire["entries"]):
        raise ManifestError("Json", "unknown or missing field")
    if json.dumps(wire, separators=(",", ":"), ensure_ascii=False).encode() + b"\n" != data:
        raise ManifestError("NonCanonicalManifest")
    if wire["schema"] != profile or (profile == SINGLE and wire["label"] != SINGLE_LABEL):
        raise ManifestError("InvalidField", "schema")
    return wire


def faults(entries: DataFrame, *others: str) -> DataFrame:
    """Rows (ordinal, fault and other columns) of the entries that break a rule; entries of one ordinal stand in order of the others."""
    order = Window.orderBy("ordinal", *others)  # the manifest is one document of bounded size
    rows = entries.withColumn("_n", F.row_number().over(order)).withColumn("_before", F.lag("relative_path").over(order))
    hex_ok = lambda c, n: F.col(c).rlike(rf"\A[0-9A-F]{{{n}}}\z")
    rules = (
        (F.col("ordinal") == F.col("_n"), "ordinal"), (F.col("family").isin(*FAMILIES), "family"), (root_id_ok(F.col("root_id")), "root_id"), (path_ok(F.col("relative_path")), "relative_path"),
        (F.col("_before").isNull() | (F.col("_before") < F.col("relative_path")), "path_order"), (F.col("bytes") >= 0, "bytes"),
        (hex_ok("sha256", 64), "sha256"), (hex_ok("sha512", 128), "sha512"), (F.col("encoding_policy").isin("utf8", "bytes"), "encoding_policy"),
    )
    fault = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules])
    return rows.select("ordinal", *others, fault.alias("fault")).filter("fault is not null")


def coverage(entries: DataFrame) -> DataFrame:
    """Enabled files and bytes by family."""
    return entries.filter("enabled").groupBy("family").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def inventory(roots: dict[str, str]) -> list[tuple[str, str, int]]:
    """(root_id, relative path, size) of every file below the roots: no links, one device a root, no two names of a file."""
    if not 0 < len(roots) <= 64:
        raise ManifestError("InvalidField", "roots")
    real = {k: os.path.abspath(p) for k, p in roots.items()}
    places = set()
    for root_id, root in real.items():
        if not re.fullmatch(r"[A-Za-z0-9._-]{1,128}", root_id):
            raise ManifestError("InvalidField", "root_id")
        if not os.path.exists(root):
            raise ManifestError("Io", root)
        if os.path.realpath(root) != root:  # a link, or below one
            raise ManifestError("PathRejected", root)
        info = os.lstat(root)
        if (info.st_dev, info.st_ino) in places:
            raise ManifestError("InvalidField", "two roots are one folder")
        places.add((info.st_dev, info.st_ino))
    for a in real:
        for b in real:
            if a != b and (real[a] + os.sep).startswith(real[b] + os.sep):
                raise ManifestError("InvalidField", "roots overlap")
    out, seen = [], set()
    for root_id, root in real.items():
        top = os.lstat(root)
        if not stat.S_ISDIR(top.st_mode):
            raise ManifestError("PathRejected", root)
        todo = [root]
        while todo:
            for e in os.scandir(todo.pop()):
                info = e.stat(follow_symlinks=False)
                if e.is_symlink() or info.st_dev != top.st_dev:
                    raise ManifestError("PathRejected", e.path)
                if e.is_dir(follow_symlinks=False):
                    todo.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    if (info.st_dev, info.st_ino) in seen:
                        raise ManifestError("PathRejected", f"a second name: {e.path}")
                    seen.add((info.st_dev, info.st_ino))
                    out.append((root_id, os.path.relpath(e.path, root).replace(os.sep, "/"), info.st_size))
                else:
                    raise ManifestError("PathRejected", e.path)
    return sorted(out, key=lambda x: (x[0], x[1].encode()))


def difference(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Declared files that are not there, and files that are not declared: root_id, relative_path, side."""
    keys = ["root_id", "relative_path"]
    missing = entries.select(*keys).join(found, keys, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(found.select(*keys).join(entries, keys, "left_anti").withColumn("side", F.lit("undeclared")))


PIECE = 64 << 20
_rows = pa.schema([("ordinal", pa.int32()), ("family", pa.string()), ("relative_path", pa.string()), ("part", pa.int32()), ("content", pa.binary()), ("fault", pa.string())])


def _read(path: str, entry: dict, piece: int):
    """Pieces of a declared file, each closing with a line feed but for the last, then the first check it fails or None.

    The bytes digested are the bytes handed out. A file that is no plain file, or changes while it is read, fails.
    """
    identity = lambda s: (s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns)
    try:
        before = os.lstat(path)
        if not stat.S_ISREG(before.st_mode):
            yield "PathRejected"
            return
        sha256, sha512, size, held = hashlib.sha256(), hashlib.sha512(), 0, b""
        utf8 = codecs.getincrementaldecoder("utf-8")() if entry["encoding_policy"] == "utf8" else None
        well_formed = True
        with open(os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0)), "rb") as f:
            opened = os.fstat(f.fileno())
            while size <= entry["bytes"] and (data := f.read(min(piece, 8 << 20))):
                sha256.update(data)
                sha512.update(data)
                size += len(data)
                if utf8 and well_formed:
                    try:
                        utf8.decode(data)
                    except UnicodeDecodeError:
                        well_formed = False
                held += data
                if len(held) >= piece and (cut := held.rfind(b"\n") + 1):
                    yield held[:cut]
                    held = held[cut:]
            after = os.fstat(f.fileno())
        yield held
        if utf8 and well_formed:
            try:
                utf8.decode(b"", final=True)
            except UnicodeDecodeError:
                well_formed = False
    except OSError:
        yield "Io"
        return
    if size != entry["bytes"] or not identity(before) == identity(opened) == identity(after):
        yield "FileMetadataMismatch"
    elif (sha256.hexdigest().upper(), sha512.hexdigest().upper()) != (entry["sha256"], entry["sha512"]):
        yield "HashMismatch"
    elif not well_formed:
        yield "EncodingMismatch"
    else:
        yield None


def _files(spark, entries: list[dict], roots: dict[str, str], content: bool, piece: int) -> DataFrame:
    rows = [(os.path.join(os.path.abspath(roots[e["root_id"]]), e["relative_path"]), *(e[f] for f in FIELDS)) for e in entries]
    declared = spark.createDataFrame(rows, "path string, " + ENTRY)
    tasks = max(1, min(len(rows), spark.sparkContext.defaultParallelism * 4))

    def run(batches):
        for batch in batches:
            for entry in batch.to_pylist():
                row = lambda part, data, fault, e=entry: pa.RecordBatch.from_pylist([{"ordinal": e["ordinal"], "family": e["family"], "relative_path": e["relative_path"], "part": part, "content": data, "fault": fault}], _rows)
                for part, got in enumerate(_read(entry["path"], entry, piece)):
                    if isinstance(got, bytes):
                        if content:
                            yield row(part, got, None)
                    elif not content:
                        yield row(0, None, got)
                    elif got is not None:
                        raise ManifestError(got, entry["relative_path"])

    spread = declared.repartition(tasks, "ordinal")
    return spread.mapInArrow(run, "ordinal int, family string, relative_path string, part int, content binary, fault string")


def verified(spark, entries: list[dict], roots: dict[str, str]) -> DataFrame:
    """ordinal, family, relative_path and fault of each file; fault names the first check it fails, null if none.

    Files are read by plain paths, so roots must be mounted on every executor; hidden names and names with ``[`` are read too.
    """
    return _files(spark, entries, roots, False, PIECE).select("ordinal", "family", "relative_path", "fault")


def contents(spark, entries: list[dict], roots: dict[str, str], piece: int = PIECE) -> DataFrame:
    """ordinal, family, relative_path, part, content: the bytes of the files, verified again as they are read.

    A large file comes in parts that end with a line feed, which no segment spans. Reading a file that no longer is what the
    manifest declares raises ``ManifestError``, so nothing that follows can complete with its bytes.
    """
    return _files(spark, entries, roots, True, piece).drop("fault")


def admit(spark, manifest_path: str, roots: dict[str, str], profile: str = COMPOSITE, max_bytes: int = 32 << 20) -> Admitted:
    if os.path.getsize(manifest_path) > max_bytes:
        raise ManifestError("ResourceLimitExceeded")
    with open(manifest_path, "rb") as f:
        data = f.read(max_bytes + 1)
    wire = parse(data, profile)
    entries = wire["entries"]
    if not entries:
        raise ManifestError("InvalidField", "entries")
    table = spark.createDataFrame([tuple(e[f] for f in FIELDS) for e in entries], ENTRY)
    first = faults(table).orderBy("ordinal").first()
    if first:
        raise ManifestError("InvalidField", f"{first.fault} of entry {first.ordinal}")
    enabled = [e for e in entries if e["enabled"]]
    if profile == SINGLE and (len(enabled) != 1 or enabled[0]["family"] != "wikitext"):
        raise ManifestError("InvalidField", "entries")
    if profile == COMPOSITE and {e["family"] for e in enabled if e["bytes"]} != set(FAMILIES):
        raise ManifestError("InvalidField", "family coverage")
    if {e["root_id"] for e in entries} != set(roots):
        raise ManifestError("FileSetMismatch", "roots")
    found = inventory(roots)
    if sorted((r, p) for r, p, _ in found) != sorted((e["root_id"], e["relative_path"]) for e in entries):
        raise ManifestError("FileSetMismatch")
    with unwrapped():
        bad = verified(spark, entries, roots).filter("fault is not null").orderBy("ordinal").select("relative_path", "fault").first()
    if bad:
        raise ManifestError(bad.fault, bad.relative_path)
    return Admitted(profile, hashlib.sha256(data).hexdigest().upper(), hashlib.sha512(data).hexdigest().upper(), len(data), tuple(enabled), contents(spark, enabled, roots))


#: Fixed values of the audit scan: what is left out, what is kept all the same, and the tier a name means (first match).
SKIP = ("bookcorpus/", "bookcorpus\\", "/wikitext/", "\\wikitext\\", ".parquet", ".json", "_degradation.txt", "_stats.json", "corpus_manifest", "wikitext_manifest")
ALLOW = ("wikitext_extracted", "bookcorpus_sampled")
TIERS = (
    ("_annotated.md", "identity"), ("blu.txt", "identity"), ("echo.txt", "identity"), ("resonance.txt", "identity"), ("anchors.txt", "identity"), ("_anchors.txt", "identity"),
    ("_ctxon.txt", "identity"), ("_ctxoff.txt", "identity"), ("wikitext_extracted", "foundation"), ("bookcorpus_sampled", "foundation"),
    ("Scripture of", "scripture"), ("CAIROS_chat", "scripture"), ("Iteration_", "scripture"),
)
TIER_WEIGHT = {"foundation": 1000, "scripture": 3000, "identity": 5000}


#: Files left out by name, but for annotated ones of the first.
UNLESS_ANNOTATED, LEFT_OUT = "Dylan_chat", "Opus_node_09_the_dylan.md"


def scan(paths: DataFrame, path: str = "path", everything: bool = False) -> DataFrame:
    """Audit scan of a table of paths (never an authority to train): path, tier, weight and the table's other columns.

    Markdown and text files only; with ``everything`` those that are left out stand there too, with a null tier.
    """
    c = F.col(path)
    any_of = lambda names: F.greatest(*[c.contains(n) for n in names])
    name = F.regexp_extract(c, r"[^/]*\z", 0)
    tier = F.coalesce(*[F.when(c.contains(p), F.lit(t)) for p, t in TIERS])
    kept = (any_of(ALLOW) | ~any_of(SKIP)) & ~(name.contains(UNLESS_ANNOTATED) & ~name.contains("_annotated")) & (name != LEFT_OUT)
    found = paths.filter(c.rlike(r"(?i)\.(?:md|txt)\z")).withColumn("tier", F.when(kept, tier))
    found = found.withColumn("weight", F.create_map(*[F.lit(x) for kv in TIER_WEIGHT.items() for x in kv])[F.col("tier")])
    return found if everything else found.filter("tier is not null")


def summary(scanned: DataFrame, size: str = "bytes") -> DataFrame:
    """One row of a scan of everything: total_files, skipped_files, total_bytes, and files by tier."""
    kept = F.col("tier").isNotNull()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    tiers = [count(F.col("tier").eqNullSafe(t)).alias(t) for t in TIER_WEIGHT]
    return scanned.agg(count(kept).alias("total_files"), count(~kept).alias("skipped_files"), count(F.when(kept, F.col(size))).alias("total_bytes"), *tiers)


def scan_directory(spark, folder: str) -> tuple[DataFrame, dict]:
    """The audit scan of a folder, files by path, and its summary."""
    if not os.path.isdir(folder):
        raise ManifestError("Io", folder)
    rows = [(p, os.path.getsize(p)) for d, _, names in os.walk(folder, followlinks=True) for n in names if os.path.isfile(p := os.path.join(d, n))]
    found = scan(spark.createDataFrame(rows, "path string, bytes long"), everything=True)
    return found.filter("tier is not null").orderBy("path"), summary(found).first().asDict()
