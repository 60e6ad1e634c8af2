"""Packages: two artifacts and a manifest, published whole or not at all and never over another."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import uuid
from dataclasses import asdict, dataclass

from ..errors import ArtifactError
from ..functions.tokens import BASE, MAX_VOCAB
from ..operators.tokenizer import Tokenizer
from . import artifacts

SCHEMA, MANIFEST, CAP = "pairloom_package_manifest_v1", "package_manifest.json", 32 << 10
_id = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:-]{0,127}")


@dataclass(frozen=True)
class Context:
    run_id: str
    checkpoint_id: str
    parent_checkpoint_id: str | None
    deterministic_config_sha256: str
    corpus_manifest_sha256: str
    calibration_report_sha256: str
    probe_selection_sha256: str
    source_commit: str
    source_tree: str
    source_tracked_files_sha256: str
    writer_version: str
    toolchain_identity: str
    readback_evidence_id: str
    prefix_proof_evidence_id: str
    effective_backend: str

    def __post_init__(self):
        for name, value in asdict(self).items():
            if name == "parent_checkpoint_id" and value is None:
                continue
            rule = r"[0-9A-F]{64}" if name.endswith("sha256") else r"[0-9a-f]{40}|[0-9a-f]{64}" if name in ("source_commit", "source_tree") else r"[\x20-\x7e]{1,256}" if name in ("writer_version", "toolchain_identity") else _id.pattern
            if not isinstance(value, str) or not re.fullmatch(rule, value):
                raise ArtifactError("InvalidContext", name)
        if self.parent_checkpoint_id == self.checkpoint_id:
            raise ArtifactError("InvalidContext", "parent_checkpoint_id")


def canonical(obj) -> bytes:
    return json.dumps(obj, separators=(",", ":"), ensure_ascii=False).encode() + b"\n"


def _digest(data: bytes, kind: str = "sha256") -> str:
    return hashlib.new(kind, data).hexdigest().upper()


def manifest_of(tokenizer: Tokenizer, context: Context, files: dict[str, bytes]) -> dict:
    rows = []
    for name, data in files.items():
        meta = artifacts.inspect(data, name.removesuffix(".bin"))
        rows.append({"relative_filename": name, "artifact_kind": meta.kind, "file_bytes": len(data), "payload_bytes": meta.payload_bytes, "record_count": meta.record_count, "file_sha256": _digest(data), "file_sha512": _digest(data, "sha512"), "payload_sha256": meta.payload_sha256, "sequence_sha256": meta.sequence_sha256})
    return {
        "schema": SCHEMA, "format": FORMAT,
        "provenance": {k: v for k, v in asdict(context).items() if v is not None},
        "counts": {"base_vocab_count": BASE, "vocab_size": len(tokenizer.vocab), "merge_count": len(tokenizer.merges)},
        "artifacts": rows, "readback": READBACK,
    }


def _sync(path: str, flags: int = os.O_RDONLY) -> None:
    fd = os.open(path, flags)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def write_new(path: str, data: bytes) -> None:
    """Whole file under a name that must not exist yet: written aside, then linked in place."""
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with open(part, "xb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(part, path)
    except FileExistsError as e:
        raise ArtifactError("DestinationExists", path) from e
    finally:
        os.unlink(part)
    _sync(os.path.dirname(os.path.abspath(path)))


def _rename_new(source: str, destination: str) -> None:
    """Rename a folder to a name that must not exist, in one step where the system can."""
    import ctypes
    import errno

    renameat2 = getattr(ctypes.CDLL(None, use_errno=True), "renameat2", None)
    if renameat2 is not None:
        at_cwd, no_replace = -100, 1  # fixed values: of the system call
        if renameat2(at_cwd, os.fsencode(source), at_cwd, os.fsencode(destination), no_replace) == 0:
            return
        code = ctypes.get_errno()
        if code == errno.EEXIST:
            raise ArtifactError("DestinationExists", destination)
        if code not in (errno.ENOSYS, errno.EINVAL):
            raise OSError(code, os.strerror(code), destination)
    try:
        os.mkdir(destination)  # takes the name; renaming onto an empty folder replaces just that
    except FileExistsError as e:
        raise ArtifactError("DestinationExists", destination) from e
    os.rename(source, destination)


def publish_folder(destination: str, write) -> None:
    """``write`` fills a folder beside the destination, which then takes its name: whole, or not at all, and never over another."""
    destination = os.path.abspath(destination)
    if os.path.lexists(destination):
        raise ArtifactError("DestinationExists", destination)
    aside = f"{destination}.{uuid.uuid4().hex[:8]}.part"
    os.mkdir(aside)
    try:
        write(aside)
        _sync(aside)
        _rename_new(aside, destination)
    finally:
        shutil.rmtree(aside, ignore_errors=True)
    _sync(os.path.dirname(destination))


def write_package(tokenizer: Tokenizer, destination: str, context: Context) -> dict:
    """Written, read back and compared in a folder beside, which then takes the final name; the manifest comes last."""
    files = {"vocab.bin": artifacts.build(tokenizer, "vocab"), "merges.bin": artifacts.build(tokenizer, "merges")}
    wire = manifest_of(tokenizer, context, files)
    if len(canonical(wire)) > CAP:
        raise ArtifactError("ResourceLimitExceeded", MANIFEST)

    def write(folder: str) -> None:
        for name, data in files.items():
            write_new(os.path.join(folder, name), data)
        read = [_bytes(os.path.join(folder, name)) for name in files]
        if artifacts.read_pair(*read) != tokenizer:
            raise ArtifactError("ReadbackMismatch")
        write_new(os.path.join(folder, MANIFEST), canonical(wire))
        if load_package(folder) != tokenizer:
            raise ArtifactError("ReadbackMismatch")

    publish_folder(destination, write)
    return wire


def _bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _plain(path: str) -> str:
    """The path itself, if it is no link and lies below none."""
    path = os.path.abspath(path)
    if os.path.lexists(path) and os.path.realpath(path) != path:
        raise ArtifactError("InvalidPublicationPath", path)
    return path


#: Fields of a package manifest, in order.
ROW = ("relative_filename", "artifact_kind", "file_bytes", "payload_bytes", "record_count", "file_sha256", "file_sha512", "payload_sha256", "sequence_sha256")
FORMAT = {"name": "u32", "major": 3, "minor": 0, "header_bytes": 128}
READBACK = {"explicit_format": "u32", "paired_validation": True, "source_tokenizer_equal": True}


def check_manifest(wire: dict) -> dict:
    """Each part of a package manifest in order; the first that is wrong raises."""
    natural = lambda x: type(x) is int and x >= 0
    digest = lambda x, n: isinstance(x, str) and re.fullmatch(rf"[0-9A-F]{{{n}}}", x) and set(x) != {"0"}
    if not isinstance(wire, dict) or tuple(wire) != ("schema", "format", "provenance", "counts", "artifacts", "readback"):
        raise ArtifactError("InvalidManifest", "fields")
    if wire["schema"] != SCHEMA:
        raise ArtifactError("InvalidManifest", "schema")
    if wire["format"] != FORMAT:
        raise ArtifactError("InvalidManifest", "format")
    try:
        Context(**({"parent_checkpoint_id": None} | wire["provenance"]))
    except TypeError as e:
        raise ArtifactError("InvalidManifest", "provenance") from e
    counts = wire["counts"]
    if not isinstance(counts, dict) or tuple(counts) != ("base_vocab_count", "vocab_size", "merge_count") or not all(map(natural, counts.values())):
        raise ArtifactError("InvalidManifest", "counts")
    if counts["base_vocab_count"] != BASE or not BASE <= counts["vocab_size"] <= MAX_VOCAB or counts["merge_count"] != counts["vocab_size"] - BASE:
        raise ArtifactError("InvalidManifest", "counts")
    if not isinstance(wire["artifacts"], list) or len(wire["artifacts"]) != 2:
        raise ArtifactError("InvalidManifest", "artifacts")
    for row, kind, records in zip(wire["artifacts"], ("vocab", "merges"), (counts["vocab_size"], counts["merge_count"])):
        ok = isinstance(row, dict) and tuple(row) == ROW and (row["relative_filename"], row["artifact_kind"], row["record_count"]) == (f"{kind}.bin", kind, records)
        ok = ok and natural(row["file_bytes"]) and natural(row["payload_bytes"]) and row["file_bytes"] == FORMAT["header_bytes"] + row["payload_bytes"]
        ok = ok and (row["payload_bytes"] >= 4 * records if kind == "vocab" else row["payload_bytes"] == 12 * records)
        if not ok or not all(digest(row[f], 128 if f.endswith("512") else 64) for f in ROW[5:]):
            raise ArtifactError("InvalidManifest", f"artifacts {kind}")
    vocab, merges = wire["artifacts"]
    if not vocab["sequence_sha256"] == merges["sequence_sha256"] == merges["payload_sha256"]:
        raise ArtifactError("InvalidManifest", "sequence_sha256")
    if wire["readback"] != READBACK:
        raise ArtifactError("InvalidManifest", "readback")
    return wire


def read_manifest(path: str) -> dict:
    """Of a package folder, or of exactly its manifest file; neither may be a link or lie below one."""
    path = _plain(path)
    if os.path.isdir(path):
        path = _plain(os.path.join(path, MANIFEST))
    elif os.path.basename(path) != MANIFEST:
        raise ArtifactError("ManifestNotFound", path)
    if not os.path.isfile(path):
        raise ArtifactError("ManifestNotFound", path)
    with open(path, "rb") as f:
        data = f.read(CAP + 1)
    try:
        wire = json.loads(data)
    except ValueError as e:
        raise ArtifactError("Json", str(e)) from e
    if len(data) > CAP or canonical(wire) != data:
        raise ArtifactError("NonCanonicalManifest")
    return check_manifest(wire)


def measure(tokenizer: Tokenizer) -> dict:
    """Counts, payload sizes and digests of the two artifacts, and the longest token, without keeping a whole file."""
    vocab, size = hashlib.sha256(), 0
    for token in tokenizer.vocab:
        vocab.update(len(token).to_bytes(4, "little") + token)
        size += 4 + len(token)
    return {
        "vocab_records": len(tokenizer.vocab), "vocab_payload_bytes": size, "vocab_payload_sha256": vocab.hexdigest().upper(),
        "merge_records": len(tokenizer.merges), "merge_payload_bytes": 12 * len(tokenizer.merges), "sequence_sha256": tokenizer.sequence_sha256(),
        "max_token_bytes": max(map(len, tokenizer.vocab)),
    }


def load_package(path: str) -> Tokenizer:
    wire = read_manifest(path)
    folder = path if os.path.isdir(path) else os.path.dirname(path)
    data = []
    for row in wire["artifacts"]:
        data.append(_bytes(_plain(os.path.join(folder, row["relative_filename"]))))
        artifacts.verify_file(data[-1], row["file_sha256"], row["file_sha512"])
        meta = artifacts.inspect(data[-1], row["artifact_kind"])
        if (meta.file_bytes, meta.payload_bytes, meta.record_count) != (row["file_bytes"], row["payload_bytes"], row["record_count"]):
            raise ArtifactError("LengthMismatch")
        if (meta.payload_sha256, meta.sequence_sha256) != (row["payload_sha256"], row["sequence_sha256"]):
            raise ArtifactError("PayloadDigestMismatch")
    tokenizer = artifacts.read_pair(*data)
    if wire["counts"] != {"base_vocab_count": BASE, "vocab_size": len(tokenizer.vocab), "merge_count": len(tokenizer.merges)}:
        raise ArtifactError("CountMismatch")
    return tokenizer
