"""Commands: encode, decode, pipeline, compare. Exit codes: 0, 2 usage, 3 input, 4 codec, 5 output.

pipeline takes its roots as id=folder, joined by commas; the source either as --repo, a clean git checkout, or as --commit, --tree
and --tracked-sha256; with --profile composite the corpus has several families, weighed by --weights (family=weight, joined by
commas). On a cluster spark.checkpoint.dir must be set, as with spark-submit --conf.
"""

from __future__ import annotations

import os
import sys

from .errors import ArtifactError, CodecError, EngineError, ManifestError
from .operators.codec import EncodedDocument, Limits
from .sources.publish import load_package, write_new

#: Options of each command: needed, and allowed.
COMMANDS = {
    "encode": (("--package", "--text-file", "--out"), ()), "decode": (("--package", "--encoded", "--out"), ()), "compare": (("--run-a", "--run-b"), ()),
    "pipeline": (("--manifest", "--roots", "--run-root", "--vocab-size", "--input"), ("--repo", "--commit", "--tree", "--tracked-sha256", "--profile", "--weights")),
}
VOUCHED = ("--commit", "--tree", "--tracked-sha256")


class Usage(Exception):
    pass


def options(args: list[str]) -> tuple[str, dict[str, str]]:
    """Each option of the command once, with a value."""
    if not args or args[0] not in COMMANDS:
        raise Usage("a command is needed: " + ", ".join(COMMANDS))
    needed, allowed = COMMANDS[args[0]]
    got: dict[str, str] = {}
    for name, value in zip(args[1::2], [*args[2::2], ""]):
        if name not in needed + allowed or name in got or not value:
            raise Usage(f"bad option {name}")
        got[name] = value
    if set(needed) - set(got):
        raise Usage("missing: " + ", ".join(sorted(set(needed) - set(got))))
    if "--vocab-size" in got and not (got["--vocab-size"].isascii() and got["--vocab-size"].isdigit()):
        raise Usage("--vocab-size takes decimal digits")
    if args[0] == "pipeline":
        vouched = [name in got for name in VOUCHED]
        if ("--repo" in got) == all(vouched) or ("--repo" in got and any(vouched)):
            raise Usage("the source is either --repo or all of " + ", ".join(VOUCHED))
        if got.get("--profile", "single") not in ("single", "composite"):
            raise Usage("--profile is single or composite")
        pairs(got["--roots"])
        if any(not (v.isascii() and v.isdigit() and int(v)) for v in pairs(got.get("--weights", "")).values()):
            raise Usage("--weights takes positive decimal digits")
    return args[0], got


def pairs(text: str) -> dict[str, str]:
    """name=value, joined by commas, each name once."""
    out: dict[str, str] = {}
    for part in text.split(",") if text else ():
        name, sign, value = part.partition("=")
        if not (name and sign and value) or name in out:
            raise Usage(f"bad pair {part}")
        out[name] = value
    return out


def read_bounded(path: str, cap: int) -> bytes:
    before = os.lstat(path)
    if not os.path.isfile(path) or os.path.islink(path) or before.st_size > cap:
        raise ManifestError("PathRejected", path)
    with open(path, "rb") as f:
        data = f.read(cap + 1)
        after = os.fstat(f.fileno())
    if (before.st_ino, before.st_size) != (after.st_ino, len(data)):
        raise ManifestError("FileMetadataMismatch", path)
    return data


def main(args: list[str]) -> int:
    if args == ["--help"]:
        print(__doc__)
        return 0
    try:
        command, got = options(args)
    except Usage as e:
        print(e, file=sys.stderr)
        return 2
    limits = Limits()
    try:
        if "--out" in got and os.path.lexists(got["--out"]):
            print("the output exists", file=sys.stderr)
            return 5
        if command in ("encode", "decode"):
            tokenizer = load_package(got["--package"])
            if command == "encode":
                out = EncodedDocument.encode(tokenizer, read_bounded(got["--text-file"], limits.input_bytes)).to_json()
            else:
                out = EncodedDocument.parse(read_bounded(got["--encoded"], limits.json_bytes)).decode(tokenizer)
            try:
                write_new(got["--out"], out)
            except (OSError, ArtifactError) as e:
                print(e, file=sys.stderr)
                return 5
        else:
            from pyspark.sql import SparkSession

            from .plans.runs import compare_runs, run_pipeline
            from .sources.manifest import COMPOSITE, SINGLE

            spark = SparkSession.builder.getOrCreate()
            if command == "compare":
                print(compare_runs(spark, got["--run-a"], got["--run-b"]))
            else:
                source = None if "--repo" in got else tuple(got[name] for name in VOUCHED)
                profile = COMPOSITE if got.get("--profile") == "composite" else SINGLE
                weights = {f: int(w) for f, w in pairs(got.get("--weights", "")).items()}
                print(run_pipeline(spark, got["--manifest"], pairs(got["--roots"]), got["--run-root"], int(got["--vocab-size"]), source, read_bounded(got["--input"], limits.input_bytes), profile, weights=weights, repo=got.get("--repo")))
    except CodecError as e:
        print(e, file=sys.stderr)
        return 4
    except (EngineError, OSError) as e:
        print(e, file=sys.stderr)
        return 3
    print("PASS")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
