"""Train, publish and prove in one run folder of 11 files; compare two runs byte for byte."""

from __future__ import annotations

import hashlib
import json
import os
import re
import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArtifactError, RunError, SourceError
from ..operators.codec import EncodedDocument
from ..operators.stats import family_weight
from ..operators.train import TrainConfig, train_with_stats
from ..sources import artifacts
from ..sources.manifest import COMPOSITE, FAMILIES, SINGLE, SINGLE_LABEL, Admitted, admit
from ..sources.publish import MANIFEST, Context, canonical, load_package, publish_folder, read_manifest, write_new, write_package

FILES = (
    "calibration_assertion.json", "decoded.bin", "encoded.json", "final_validation.json", "input.bin", "probe_assertion.json",
    "run_manifest.json", "train_config.json", "package/merges.bin", "package/package_manifest.json", "package/vocab.bin",
)
MAX_TARGET, CORE_TAG = 4096, b"pairloom_run_core_v1\0"


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest().upper()


def run_tree(spark: SparkSession, root: str) -> DataFrame:
    """relative, length, sha256 of a run's files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    start = len(os.path.abspath(root)) + 1
    return rows.select(F.expr(f"substring(regexp_replace(path, '^file:/+', '/'), {start + 1})").alias("relative"), "length", F.sha2("content", 256).alias("sha256"))


def tree_digest(tree: DataFrame) -> DataFrame:
    """One row: SHA-256 over the lines ``sha256  length  relative`` in path order. A tree has few files."""
    line = F.format_string("%s  %d  %s\n", "sha256", "length", "relative")
    return tree.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("relative", line.alias("line")))), lambda r: r.line), "").alias("text")).select(F.sha2("text", 256).alias("digest"))


RUN, CONFIG, GATE, FINAL = "pairloom_run_manifest_v1", "pairloom_train_config_v1", "pairloom_gate_assertion_v1", "pairloom_final_validation_v1"
WRITER, BACKEND, SCALE = "pairloom 1", "spark", 1000
GATES = {"calibration": "calibration_assertion.json", "probe": "probe_assertion.json"}
REASON = {SINGLE: "single_family_run", COMPOSITE: "not_part_of_this_run"}
CHECKED = {"writer_strict_readback": True, "manifest_bound_load_before_publication": True, "canonical_encoded_json_reparse": True, "byte_round_trip": True, "final_package_reload_attestation": "final_validation.json", "file_sync_all": True, "directory_sync": True, "publication_visibility": "renamed_whole_without_replacing"}


@dataclass(frozen=True)
class Source:
    """Where the code comes from: as ``source_authority`` finds it, or as the caller vouches for it."""

    commit: str
    tree: str
    tracked_sha256: str
    toolchain: str = "pyspark"


def source_authority(repo: str, max_files: int = 10_000, max_bytes: int = 1 << 30) -> Source:
    """Commit, tree and digest of the tracked files of a clean git checkout; a dirty one raises."""
    import pyspark

    from ..sources.manifest import relative_path_ok

    def git(*args: str) -> bytes:
        try:
            done = subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True)
        except (OSError, subprocess.CalledProcessError) as e:
            raise SourceError("Git", " ".join(args)) from e
        return done.stdout

    if git("status", "--porcelain=v1", "--untracked-files=all"):
        raise SourceError("DirtyWorktree", repo)
    paths = sorted(p for p in git("ls-files", "-z").split(b"\0") if p)
    if not 0 < len(paths) <= max_files or len(set(paths)) != len(paths):
        raise SourceError("TrackedFiles", str(len(paths)))
    tree, total = hashlib.sha256(), 0
    for raw in paths:
        try:
            name = raw.decode()
        except UnicodeDecodeError as e:
            raise SourceError("TrackedFiles", repr(raw)) from e
        path = os.path.join(os.path.realpath(repo), name)
        if not relative_path_ok(name) or os.path.realpath(path) != path or not os.path.isfile(path):
            raise SourceError("PathRejected", name)
        with open(path, "rb") as f:
            data = f.read(max_bytes + 1)
        total += len(data)
        if total > max_bytes:
            raise SourceError("ResourceLimitExceeded", name)
        tree.update(f"{hashlib.sha256(data).hexdigest()}  {len(data)}  {name}\n".encode())
    return Source(git("rev-parse", "HEAD").decode().strip(), git("rev-parse", "HEAD^{tree}").decode().strip(), tree.hexdigest().upper(), f"pyspark {pyspark.__version__}")


def _evidence(name: str, data: bytes) -> dict:
    return {"file": name, "bytes": len(data), "sha256": _sha(data)}


def _artifact(data: bytes, kind: str) -> dict:
    meta = artifacts.inspect(data, kind)
    return {"file_bytes": len(data), "payload_bytes": meta.payload_bytes, "record_count": meta.record_count, "file_sha256": _sha(data), "file_sha512": hashlib.sha512(data).hexdigest().upper(), "payload_sha256": meta.payload_sha256, "sequence_sha256": meta.sequence_sha256}


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def run_pipeline(spark: SparkSession, manifest: str, roots: dict[str, str], run_root: str, vocab_size: int, source: Source | tuple[str, str, str], probe: bytes, profile: str = SINGLE, min_frequency: int = 2, weights: dict[str, int] | None = None, repo: str | None = None) -> dict:
    """source: of the code; with ``repo`` it is looked up there, and again before anything is published.

    weights: of the families, for a composite corpus; a single family weighs ``SCALE``. The probe must come back as it is from
    encoding and decoding.
    """
    if os.path.lexists(run_root):
        raise RunError("DestinationExists", run_root)
    if not 276 <= vocab_size <= MAX_TARGET:
        raise RunError("VocabTargetOutOfRange", str(vocab_size))
    source = source_authority(repo) if repo else source if isinstance(source, Source) else Source(*source)
    corpus: Admitted = admit(spark, manifest, roots, profile)
    weights = {f: SCALE for f in FAMILIES} | (weights or {})
    label = SINGLE_LABEL if profile == SINGLE else "composite"
    config = canonical({"schema": CONFIG, "manifest_schema": profile, "manifest_label": label, "vocab_size": vocab_size, "min_frequency": min_frequency, "deterministic": True, "family_weights_scaled": weights, "effective_backend": BACKEND, "input_sha256": _sha(probe)})
    gates = {n: canonical({"schema": GATE, "gate": n, "status": "not_applicable", "reason": REASON[profile]}) for n in GATES}
    tokenizer, _, stats = train_with_stats(corpus.files, TrainConfig(vocab_size, min_frequency), text="content", weight=family_weight(F.col("family"), weights))
    if repo and source_authority(repo) != source:
        raise SourceError("ChangedDuringRun", repo)
    context = Context("run", "checkpoint", None, _sha(config), corpus.manifest_sha256, _sha(gates["calibration"]), _sha(gates["probe"]), source.commit, source.tree, source.tracked_sha256, WRITER, source.toolchain, "readback", "prefix", BACKEND)

    def write(aside: str) -> None:
        folder = os.path.join(aside, "package")
        write_package(tokenizer, folder, context)
        loaded = load_package(folder)
        encoded = EncodedDocument.encode(loaded, probe)
        line = encoded.to_json()
        decoded = EncodedDocument.parse(line).decode(loaded)
        if decoded != probe:  # an alias that is not canonical
            raise RunError("RoundTripMismatch")
        package = _read(os.path.join(folder, MANIFEST))
        report = canonical({
            "schema": RUN, "status": "PREPUBLICATION_VALIDATED",
            "authority": {"profile": profile, "label": label, "balanced_composite_claimed": False, "final_training_authority_claimed": False},
            "source": {"commit": source.commit, "tree": source.tree, "tracked_sha256": source.tracked_sha256, "writer_version": WRITER, "toolchain_identity": source.toolchain, "effective_backend": BACKEND},
            "corpus": {"manifest_schema": profile, "manifest_label": label, "manifest_bytes": corpus.manifest_bytes, "manifest_sha256": corpus.manifest_sha256, "manifest_sha512": corpus.manifest_sha512, "admitted_files": len(corpus.entries), "admitted_bytes": corpus.total_bytes},
            "config": _evidence("train_config.json", config),
            "training": {"input_files": len(corpus.entries), "loaded_sequences": stats.loaded_sequences, "skipped_lines": stats.skipped_lines, "loaded_tokens": stats.loaded_tokens, "learned_merges": len(loaded.merges), "final_vocab": len(loaded.vocab), "tokenizer_hash": tokenizer.hash_hex()},
            "package": {"directory": "package", "vocab_size": len(loaded.vocab), "merge_count": len(loaded.merges), "vocab": _artifact(_read(os.path.join(folder, "vocab.bin")), "vocab"), "merges": _artifact(_read(os.path.join(folder, "merges.bin")), "merges"), "manifest_bytes": len(package), "manifest_sha256": _sha(package), "manifest_sha512": hashlib.sha512(package).hexdigest().upper()},
            "round_trip": {"input": _evidence("input.bin", probe), "encoded": _evidence("encoded.json", line), "token_count": len(encoded.token_ids), "decoded": _evidence("decoded.bin", decoded), "byte_equal": True},
            "assertions": {n: {"file": GATES[n], "sha256": _sha(gates[n])} for n in GATES},
            "validation": CHECKED,
        })
        trip = _sha(canonical(json.loads(report)["round_trip"]))
        final = canonical({"schema": FINAL, "status": "PASS", "run_manifest_sha256": _sha(report), "package_manifest_sha256": _sha(package), "round_trip_sha256": trip, "final_package_reload": True, "final_report_readback": True, "final_run_files_readback": True})
        for name, data in ((GATES["calibration"], gates["calibration"]), (GATES["probe"], gates["probe"]), ("train_config.json", config), ("input.bin", probe), ("encoded.json", line), ("decoded.bin", decoded), ("run_manifest.json", report), ("final_validation.json", final)):
            write_new(os.path.join(aside, name), data)
        validate_run(spark, aside)

    try:
        publish_folder(run_root, write)
    except ArtifactError as e:
        raise (RunError("DestinationExists", run_root) if e.kind == "DestinationExists" else e) from e
    return validate_run(spark, run_root)


#: Fields of a run's documents, in order.
FIELDS_OF = {
    "train_config.json": ("schema", "manifest_schema", "manifest_label", "vocab_size", "min_frequency", "deterministic", "family_weights_scaled", "effective_backend", "input_sha256"),
    "run_manifest.json": ("schema", "status", "authority", "source", "corpus", "config", "training", "package", "round_trip", "assertions", "validation"),
    "final_validation.json": ("schema", "status", "run_manifest_sha256", "package_manifest_sha256", "round_trip_sha256", "final_package_reload", "final_report_readback", "final_run_files_readback"),
    "calibration_assertion.json": ("schema", "gate", "status", "reason"), "probe_assertion.json": ("schema", "gate", "status", "reason"),
}
#: What the package manifest's provenance and the run's documents must say alike.
POINTERS = (
    ("deterministic_config_sha256", ("config", "sha256")), ("corpus_manifest_sha256", ("corpus", "manifest_sha256")), ("calibration_report_sha256", ("assertions", "calibration", "sha256")),
    ("probe_selection_sha256", ("assertions", "probe", "sha256")), ("source_commit", ("source", "commit")), ("source_tree", ("source", "tree")), ("source_tracked_files_sha256", ("source", "tracked_sha256")),
    ("writer_version", ("source", "writer_version")), ("toolchain_identity", ("source", "toolchain_identity")), ("effective_backend", ("source", "effective_backend")),
)


def _at(document, path: tuple):
    for name in path:
        document = document.get(name) if isinstance(document, dict) else None
    return document


def validate_run(spark: SparkSession, root: str, strict: bool = False) -> dict:
    """Every document of a run against its files and against the others; the first rule that fails is named."""
    if os.path.realpath(root) != os.path.abspath(root) or not os.path.isdir(root):
        raise RunError("PathRejected", root)
    found = sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)
    if found != sorted(FILES):
        raise RunError("TopologyMismatch", ", ".join(sorted(set(found) ^ set(FILES))))
    if any(os.path.islink(os.path.join(root, name)) for name in FILES):
        raise RunError("PathRejected", root)
    data = {name: _read(os.path.join(root, name)) for name in FILES}
    docs = {}
    for name, fields in FIELDS_OF.items():
        try:
            docs[name] = json.loads(data[name])
        except ValueError as e:
            raise RunError("Json", name) from e
        if canonical(docs[name]) != data[name]:
            raise RunError("NonCanonical", name)
        if not isinstance(docs[name], dict) or tuple(docs[name]) != fields:
            raise RunError("UnknownField", name)
    report, config, final = docs["run_manifest.json"], docs["train_config.json"], docs["final_validation.json"]
    package = read_manifest(os.path.join(root, "package"))
    tokenizer = load_package(os.path.join(root, "package"))
    encoded = EncodedDocument.parse(data["encoded.json"])
    size, merges = len(tokenizer.vocab), len(tokenizer.merges)
    raw, get = data["package/package_manifest.json"], lambda *path: _at(report, path)
    hexed = lambda value, n, kind="0-9A-F": isinstance(value, str) and bool(re.fullmatch(f"[{kind}]{{{n}}}", value))
    positive = lambda value: type(value) is int and value > 0
    profile = get("authority", "profile")
    label = {SINGLE: SINGLE_LABEL, COMPOSITE: "composite"}.get(profile)
    target = config["vocab_size"]
    rules = {
        "schemas": (report["schema"], config["schema"], final["schema"], final["status"], report["status"]) == (RUN, CONFIG, FINAL, "PASS", "PREPUBLICATION_VALIDATED"),
        "authority": label is not None and report["authority"] == {"profile": profile, "label": label, "balanced_composite_claimed": False, "final_training_authority_claimed": False},
        "source": hexed(get("source", "commit"), "40,64", "0-9a-f") and hexed(get("source", "tree"), "40,64", "0-9a-f") and hexed(get("source", "tracked_sha256"), 64) and bool(get("source", "toolchain_identity")) and (get("source", "writer_version"), get("source", "effective_backend")) == (WRITER, BACKEND),
        "corpus": (get("corpus", "manifest_schema"), get("corpus", "manifest_label")) == (profile, label) and all(positive(get("corpus", f)) for f in ("manifest_bytes", "admitted_files", "admitted_bytes")) and hexed(get("corpus", "manifest_sha256"), 64) and hexed(get("corpus", "manifest_sha512"), 128) and (profile == COMPOSITE or get("corpus", "admitted_files") == 1),
        "config": report["config"] == _evidence("train_config.json", data["train_config.json"]) and (config["manifest_schema"], config["manifest_label"], config["deterministic"], config["effective_backend"]) == (profile, label, True, BACKEND) and positive(config["min_frequency"]) and set(config["family_weights_scaled"]) == set(FAMILIES) and all(map(positive, config["family_weights_scaled"].values())) and config["input_sha256"] == _sha(data["input.bin"]),
        "gates": all(docs[GATES[n]] == {"schema": GATE, "gate": n, "status": "not_applicable", "reason": REASON.get(profile)} and get("assertions", n) == {"file": GATES[n], "sha256": _sha(data[GATES[n]])} for n in GATES),
        "training": get("training", "input_files") == get("corpus", "admitted_files") and positive(get("training", "loaded_sequences")) and positive(get("training", "loaded_tokens")) and (get("training", "learned_merges"), get("training", "final_vocab"), get("training", "tokenizer_hash")) == (merges, size, tokenizer.hash_hex()),
        "size": type(target) is int and (size == target if strict else size <= target <= MAX_TARGET),
        "package": (get("package", "directory"), get("package", "vocab_size"), get("package", "merge_count"), get("package", "manifest_bytes"), get("package", "manifest_sha256"), get("package", "manifest_sha512")) == ("package", size, merges, len(raw), _sha(raw), hashlib.sha512(raw).hexdigest().upper()),
        "artifacts": all(get("package", k) == _artifact(data[f"package/{k}.bin"], k) for k in ("vocab", "merges")),
        "provenance": all(isinstance(get(*path), str) and package["provenance"].get(name) == get(*path) for name, path in POINTERS),
        "round_trip": report["round_trip"] == {"input": _evidence("input.bin", data["input.bin"]), "encoded": _evidence("encoded.json", data["encoded.json"]), "token_count": len(encoded.token_ids), "decoded": _evidence("decoded.bin", data["decoded.bin"]), "byte_equal": True} and data["decoded.bin"] == data["input.bin"],
        "encoded": EncodedDocument.encode(tokenizer, data["input.bin"]) == encoded,
        "decoded": encoded.decode(tokenizer) == data["decoded.bin"],
        "validation": report["validation"] == CHECKED,
        "final": (final["run_manifest_sha256"], final["package_manifest_sha256"], final["round_trip_sha256"]) == (_sha(data["run_manifest.json"]), _sha(raw), _sha(canonical(report["round_trip"]))) and all(final[f] is True for f in FIELDS_OF["final_validation.json"][5:]),
    }
    for name, ok in rules.items():
        if not ok:
            raise RunError("RunMismatch", name)
    core = _sha(CORE_TAG + data["run_manifest.json"] + data["final_validation.json"])
    return {"vocab_size": size, "token_count": len(encoded.token_ids), "core_sha256": core, "tree_sha256": tree_digest(run_tree(spark, root)).first().digest}


def compare_runs(spark: SparkSession, a: str, b: str) -> dict:
    if os.path.realpath(a) == os.path.realpath(b):
        raise RunError("SameRun", a)
    one, two = validate_run(spark, a), validate_run(spark, b)
    left, right = run_tree(spark, a), run_tree(spark, b).select("relative", F.col("length").alias("length2"), F.col("sha256").alias("sha2"))
    apart = [r.relative for r in left.join(right, "relative", "full_outer").filter("not (sha256 <=> sha2 and length <=> length2)").select("relative").orderBy("relative").collect()]
    if apart or one != two:
        raise RunError("RunsDiffer", ", ".join(apart))
    return one
