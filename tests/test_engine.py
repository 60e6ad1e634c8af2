"""Golden vectors, a naive trainer and encoder as oracle, and error cases."""

import hashlib
import json
import os
import random
import struct
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.errors import ArtifactError, CodecError, ManifestError, RunError, TokenError
from pairloom.functions import tokens as T
from pairloom.operators import codec, packing, presegment
from pairloom.operators import train as train_module
from pairloom.operators.codec import Coder, EncodedDocument, Limits, decode_join, decoder, encode_distinct, encode_native, encoder
from pairloom.operators.stats import symbol_words, word_counts
from pairloom.operators.tokenizer import Tokenizer
from pairloom.operators.train import TrainConfig, TrainingStats, train, train_rounds, train_with_stats, train_words
from pairloom.sources import artifacts, manifest, publish


def docs(spark, *texts):
    return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "doc_id int, text binary")


def seg(spark, data):
    return [r.segment.encode("latin-1") for r in presegment.segments(docs(spark, data), "doc_id").orderBy("line_no", "seg_no").collect()]


def naive(words, target, threshold):
    """One merge at a time over everything."""
    words, out = [([ord(c) for c in w], f) for w, f in words], []
    while 276 + len(out) < target:
        counts = {}
        for w, f in words:
            for p in zip(w, w[1:]):
                counts[p] = counts.get(p, 0) + f
        best = min(counts.items(), key=lambda x: (-x[1], x[0]), default=(None, 0))
        if best[1] < threshold or not best[0]:
            break
        new = ord(T.symbol(276 + len(out)))
        out.append((T.token_of(chr(best[0][0])), T.token_of(chr(best[0][1])), best[1]))
        for k, (w, f) in enumerate(words):
            i, v = 0, []
            while i < len(w):
                if tuple(w[i : i + 2]) == best[0]:
                    v.append(new)
                    i += 2
                else:
                    v.append(w[i])
                    i += 1
            words[k] = (v, f)
    return out


def test_segments(spark):
    assert seg(spark, b"a\nb\r\nc\r\r\nlast") == [b"a", b"b", b"c", b"\r", b"last"]
    assert seg(spark, b"\n<KAREEM>\n<KAREEM></KAREEM>\n[[ANCHOR]][[/ANCHOR]]\n<KAREEM> \n") == [b"<KAREEM>", b" "]
    assert seg(spark, b" \t\n\xff\xfe a") == [b" \t", b"\xff\xfe", b" a"]
    s = presegment.statistics(docs(spark, b"\t\x0b\x0c\r lead  two \t")).first()
    assert (s.emitted_segments, s.input_bytes, s.pair_opportunities) == (3, 16, 13)
    s = presegment.statistics(docs(spark, b"\n<KAREEM>\n<KAREEM></KAREEM>\n[[ANCHOR]][[/ANCHOR]]\n<KAREEM> \n")).first()
    assert (s.logical_lines, s.skipped_empty_lines, s.skipped_special_only_lines, s.accepted_lines) == (6, 2, 3, 1)
    s = presegment.statistics(docs(spark, b"x" * 16385)).first()
    assert (s.emitted_segments, s.pair_opportunities) == (1, 16384)
    assert presegment.statistics(docs(spark, b"a\n")).first().logical_lines == 2
    assert presegment.statistics(docs(spark).limit(0)).first().logical_lines == 0


def test_codec_vectors(spark):
    ranked = Tokenizer.from_merges([(117, 118), (118, 119), (276, 119)])
    assert Coder(ranked).encode(b"abcabc") == [278, 278] and Coder(ranked).encode(b"abab") == [276, 276]
    one = Tokenizer.from_merges([(117, 118)])
    assert Coder(one).encode(b"ab\r\nab\n\n\xff") == [276, 33, 30, 276, 30, 30, 275]
    assert Coder(one).encode(b"<KAREEM></KAREEM><kareem_narration>") == [4, 4, 4]
    assert Coder(one).decode([4, 19]) == b"<kareem_narration>"
    with pytest.raises(CodecError):
        Coder(one).decode([9999])
    wide = Tokenizer.from_merges([(20 + i // 256, 20 + i % 256) for i in range(65261)])
    assert Coder(wide).encode(b"\xfe\xec") == [65536]
    assert Tokenizer.from_merges([]).sequence_sha256()[:8] == "E3B0C442"
    assert Tokenizer.from_merges([(52, 136)]).sequence_sha256()[:8] == "53887809"
    assert [Coder(one).encode(b"x"), Coder(one).encode(b"")] == [[140], []]


def test_round_trip_and_native(spark):
    rng = random.Random(3)
    tokenizer = Tokenizer.from_merges([(117, 118), (118, 119), (276, 119), (52, 117), (117, 117)])
    alphabet = [b"a", b"b", b"c", b" ", b"\n", b"\r", b"\t", b"\xff", b"<AI>", b"</AI>"]
    texts = [b"".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(60)] + [b"", b"alpha\r\n\xffbeta\n<kareem_narration>\r"]
    d = docs(spark, *texts)
    rows = d.select("text", encoder(spark, tokenizer)(F.col("text")).alias("a"), encode_native(F.col("text"), tokenizer).alias("b"), "doc_id")
    back = rows.select("*", decoder(spark, tokenizer)("a").alias("d"))
    joined = {r.doc_id: bytes(r.decoded) for r in decode_join(rows.withColumnRenamed("a", "token_ids"), tokenizer, "doc_id").collect()}
    for r in back.collect():
        assert list(r.a) == list(r.b) == Coder(tokenizer).encode(bytes(r.text))
        assert bytes(r.d) == joined[r.doc_id] == bytes(r.text).replace(b"</AI>", b"<AI>")


def test_trainers_agree(spark, monkeypatch):
    rng = random.Random(5)
    symbols = [T.symbol(117 + i) for i in range(14)]
    for trial in range(60):
        own = symbols[: rng.randrange(1, 15)]
        words = {"".join(rng.choice(own) * rng.randrange(1, 7) for _ in range(rng.randrange(1, 4))): rng.choice((1, 2, 3, 5, 8)) * 1000 for _ in range(12)}
        expected = naive(list(words.items()), 306, 1000)
        assert [(m.a, m.b, m.count) for m in train_words(list(words.items()), 306, 1000)] == expected
        if trial < 4:
            table = spark.createDataFrame(list(words.items()), "sym string, freq long")
            for held in (train_module.HELD_PAIRS, 3):  # counts on the driver, and in a table
                with monkeypatch.context() as m:
                    m.setattr(train_module, "HELD_PAIRS", held)
                    assert [(m.a, m.b, m.count) for m in train_rounds(table, 290, 1000)] == expected[:14]
    a, c, d = symbols[0], symbols[2], symbols[3]
    fixed = [(a * 3, 10_000), (c + d, 5_000)]
    assert [(m.a, m.b) for m in train_rounds(spark.createDataFrame(fixed, "sym string, freq long"), 279, 1000)] == [(x, y) for x, y, _ in naive(fixed, 279, 1000)]


def test_collected_training_holds_little(spark, monkeypatch):
    """Of words that take many chunks the driver holds less than their symbols' ids."""
    rng = np.random.default_rng(7)
    lengths, freq = rng.integers(2, 12, 150_000), rng.integers(1, 9, 150_000) * 1000
    ids = (117 + rng.integers(0, 6, lengths.sum())).astype(np.uint32)
    ends = np.cumsum(lengths)
    words = ["".join(map(T.symbol, ids[e - n : e].tolist())) for e, n in zip(ends, lengths)]
    expected = [(m.a, m.b, m.count) for m in train_rounds(spark.createDataFrame(list(zip(words, freq.tolist())), "sym string, freq long"), 286, 2000)]
    table = spark.createDataFrame(list(zip([*words, T.symbol(117)], [*freq.tolist(), 5000])), "sym string, freq long")
    monkeypatch.setattr(train_module, "CHUNK", 1 << 12, raising=False)
    tracemalloc.start()
    try:
        got = train_module.train_collected(table, 286, 2000)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [(m.a, m.b, m.count) for m in got] == expected and len(expected) == 10
    assert peak < 16 * len(ids)
    assert train_module.train_collected(table.limit(0), 286, 2000) == []


def test_train_edges(spark):
    assert train(docs(spark, b"aa"), TrainConfig(276))[1] == []
    with pytest.raises(TokenError):
        train(docs(spark, b"\n\n"), TrainConfig(280))
    with pytest.raises(TokenError):
        train(docs(spark, b"aa"), TrainConfig(5))
    weighted = docs(spark, b"aa\n", b"aa\n", b"aa\n", b"aa\n").withColumn("w", F.element_at(F.array(*map(F.lit, (5000, 3000, 4000, 4000))), F.col("doc_id") + 1).cast("long"))
    tokenizer, merges = train(weighted, TrainConfig(277, 1), weight=F.col("w"))
    assert tokenizer.vocab[276] == b"aa" and (merges[0].a, merges[0].b, merges[0].count) == (117, 117, 16000)
    few = [Tokenizer.from_merges([(m.a, m.b) for m in train_rounds(symbol_words(word_counts(docs(spark, *[b"the then them"] * 3).repartition(n))), 280, 2000)]).hash_hex() for n in (1, 5)]
    assert few[0] == few[1]


def test_artifacts(spark, tmp_path):
    t = Tokenizer.from_merges([(52, 136)])
    vocab, merges = artifacts.build(t, "vocab"), artifacts.build(t, "merges")
    assert (len(vocab), len(merges)) == (1663, 140) and artifacts.read_pair(vocab, merges) == t
    base = Tokenizer.from_merges([])
    assert (len(artifacts.build(base, "vocab")), len(artifacts.build(base, "merges"))) == (1657, 128)
    wrong = {0: "BadMagic", 8: "UnsupportedVersion", 12: "WrongArtifactKind", 13: "UnsupportedEndianness", 14: "UnsupportedTokenIdWidth", 15: "RecordWidthMismatch", 16: "HeaderSizeMismatch", 18: "UnknownFlags", 20: "ReservedNotZero", 40: "BaseCountMismatch", 64: "PayloadDigestMismatch", 128: "PayloadDigestMismatch"}
    for at, kind in wrong.items():
        bad = bytearray(merges)
        bad[at] ^= 0x55
        with pytest.raises(ArtifactError) as e:
            artifacts.inspect(bytes(bad), "merges")
        assert e.value.kind == kind
    for cut in (0, 5, 127, 130, 139):
        with pytest.raises(ArtifactError, match="Truncated"):
            artifacts.inspect(merges[:cut], "merges")
    with pytest.raises(ArtifactError, match="TrailingData"):
        artifacts.inspect(merges + b"x", "merges")
    with pytest.raises(ArtifactError, match="PairMismatch"):
        artifacts.read_pair(vocab, artifacts.build(base, "merges"))
    v2 = struct.pack("<I", len(t.vocab)) + artifacts.vocab_payload(t), struct.pack("<IHHH", 1, 52, 136, 276)
    assert artifacts.read_pair_v2(*v2) == t
    for merge in ((52, 136, 277), (52, 276, 276), (5, 136, 276)):
        with pytest.raises(ArtifactError):
            Tokenizer(t.vocab, (merge,))
    (tmp_path / "m.bin").write_bytes(merges)
    spark.dataSource.register(artifacts.ArtifactSource)
    row = spark.read.format("pair_artifact").option("kind", "merges").load(str(tmp_path / "m.bin")).first()
    assert tuple(row) == (0, 52, 136, 276)


CONTEXT = publish.Context("r", "c", None, *["A" * 64] * 4, "a" * 40, "b" * 40, "C" * 64, "w 1", "t", "e", "p", "spark")


def test_publication(tmp_path):
    t = Tokenizer.from_merges([(52, 136)])
    at = str(tmp_path / "p")
    publish.write_package(t, at, CONTEXT)
    assert publish.load_package(at) == publish.load_package(at + "/package_manifest.json") == t
    with pytest.raises(ArtifactError, match="DestinationExists"):
        publish.write_package(t, at, CONTEXT)
    data = (tmp_path / "p" / "vocab.bin").read_bytes()
    (tmp_path / "p" / "vocab.bin").write_bytes(data[:-1] + b"!")
    with pytest.raises(ArtifactError, match="FileDigestMismatch"):
        publish.load_package(at)
    with pytest.raises(ArtifactError, match="InvalidContext"):
        publish.Context("r", "c", "c", *["A" * 64] * 4, "a" * 40, "b" * 40, "C" * 64, "w 1", "t", "e", "p", "spark")


def test_encoded_json():
    t = Tokenizer.from_merges([])
    e = EncodedDocument.encode(t, b"x")
    data = e.to_json()
    assert EncodedDocument.parse(data) == e and e.decode(t) == b"x" and json.loads(data)["token_ids"] == [140]
    for old, new, kind in ((b'"u32"', b'"u16"', "TokenIdWidthMismatch"), (b'_v1"', b'_v2"', "SchemaMismatch"), (b'"token_count":1', b'"token_count":2', "TokenCountMismatch"), (b"[140]", b"[131072]", "InvalidTokenId"), (b"{", b'{"z":1,', "Json"), (b"[140]", b"[140 ]", "Json")):
        with pytest.raises(CodecError, match=kind):
            EncodedDocument.parse(data.replace(old, new, 1))
    with pytest.raises(CodecError, match="TokenizerBindingMismatch"):
        e.decode(Tokenizer.from_merges([(52, 136)]))
    with pytest.raises(CodecError, match="DecodedDigestMismatch"):
        EncodedDocument.parse(data.replace(b"[140]", b"[141]")).decode(t)
    with pytest.raises(CodecError, match="ResourceLimitExceeded"):
        EncodedDocument.encode(t, b"xx", Limits(input_bytes=1))


def corpus(tmp_path, profile, files):
    root = tmp_path / "root"
    root.mkdir()
    entries = []
    for i, (name, family, data) in enumerate(files, 1):
        (root / name).write_bytes(data)
        entries.append(dict(zip(manifest.FIELDS, (i, family, "r", name, True, len(data), hashlib.sha256(data).hexdigest().upper(), hashlib.sha512(data).hexdigest().upper(), "utf8"))))
    wire = {"schema": profile} | ({"label": manifest.SINGLE_LABEL} if profile == manifest.SINGLE else {}) | {"entries": entries}
    return root, entries, wire


def put(tmp_path, wire):
    path = tmp_path / "manifest.json"
    path.write_bytes(json.dumps(wire, separators=(",", ":")).encode() + b"\n")
    return str(path)


def test_admission(spark, tmp_path):
    files = [("a.txt", "identity", b"aa\n"), ("b.txt", "scripture", b"aa\n"), ("c.txt", "wikitext", b"aa\n"), ("d.txt", "bookcorpus", b"aa\n")]
    root, entries, wire = corpus(tmp_path, manifest.COMPOSITE, files)
    got = manifest.admit(spark, put(tmp_path, wire), {"r": str(root)})
    assert got.total_bytes == 12 and got.files.count() == 4

    def fails(kind, **change):
        bad = wire | {"entries": [entries[0] | change, *entries[1:]]}
        with pytest.raises(ManifestError) as e:
            manifest.admit(spark, put(tmp_path, bad), {"r": str(root)})
        assert e.value.kind == kind

    fails("InvalidField", ordinal=2)
    fails("InvalidField", family="other")
    fails("InvalidField", relative_path="../a.txt")
    fails("InvalidField", relative_path="z.txt")
    fails("InvalidField", sha256="0" * 63)
    fails("InvalidField", enabled=False)
    fails("HashMismatch", sha256="0" * 64)
    fails("FileMetadataMismatch", bytes=4)
    tokenizer, _ = train(got.files, TrainConfig(277), text="content")
    assert tokenizer.vocab[276] == b"aa"
    (root / "b.txt").write_bytes(b"zz\n")  # changed after it was admitted
    with pytest.raises(ManifestError) as e:
        train(got.files, TrainConfig(278), text="content")
    assert e.value.kind == "HashMismatch"
    (root / "b.txt").write_bytes(b"aa\nzz\n")
    with pytest.raises(ManifestError) as e:
        train(got.files, TrainConfig(278, strategy="rounds"), text="content")
    assert e.value.kind == "FileMetadataMismatch"
    (root / "b.txt").unlink()
    with pytest.raises(ManifestError) as e:
        train(got.files, TrainConfig(278), text="content")
    assert e.value.kind == "Io"
    (root / "b.txt").write_bytes(b"aa\n")
    os.symlink(root, tmp_path / "way")
    for roots, kind in (({"r": str(tmp_path / "way")}, "PathRejected"), ({"r": str(tmp_path / "none")}, "Io")):
        with pytest.raises(ManifestError) as e:
            manifest.admit(spark, put(tmp_path, wire), roots)
        assert e.value.kind == kind
    (root / ".hidden").write_bytes(b"x")
    with pytest.raises(ManifestError, match="FileSetMismatch"):
        manifest.admit(spark, put(tmp_path, wire), {"r": str(root)})
    (root / ".hidden").unlink()
    os.symlink(root / "a.txt", root / "link")
    with pytest.raises(ManifestError, match="PathRejected"):
        manifest.admit(spark, put(tmp_path, wire), {"r": str(root)})
    (root / "link").unlink()
    (tmp_path / "manifest.json").write_bytes(json.dumps(wire).encode())
    with pytest.raises(ManifestError, match="NonCanonicalManifest"):
        manifest.admit(spark, str(tmp_path / "manifest.json"), {"r": str(root)})


def test_admission_of_odd_names_and_parts(spark, tmp_path):
    texts = {".h.txt": b"one\ntwo\n", "_a.txt": b"", "b[1].txt": b"x" * 50 + b"\n" + b"last", "c*.txt": "é\n".encode() * 40}
    root, entries, wire = corpus(tmp_path, manifest.COMPOSITE, [(n, f, texts[n]) for n, f in zip(sorted(texts), manifest.FAMILIES)])
    wire["entries"].append(dict(entries[-1], ordinal=5, relative_path="d.txt", family="scripture"))
    (root / "d.txt").write_bytes(texts["c*.txt"])
    got = manifest.admit(spark, put(tmp_path, wire), {"r": str(root)})
    assert {r.relative_path: bytes(r.content) for r in got.files.collect()} == texts | {"d.txt": texts["c*.txt"]}
    parts = manifest.contents(spark, list(got.entries), {"r": str(root)}, piece=16).orderBy("ordinal", "part").collect()
    assert len(parts) > 10 and all(bytes(r.content).endswith(b"\n") for r, s in zip(parts, parts[1:]) if r.ordinal == s.ordinal)
    whole = {}
    for r in parts:
        whole[r.relative_path] = whole.get(r.relative_path, b"") + bytes(r.content)
    assert whole == texts | {"d.txt": texts["c*.txt"]}
    (root / "c*.txt").write_bytes(texts["c*.txt"][:-2] + b"\xff\n")
    bad = {r.relative_path: r.fault for r in manifest.verified(spark, list(got.entries), {"r": str(root)}).collect()}
    assert bad == {n: None for n in texts} | {"d.txt": None, "c*.txt": "HashMismatch"}


def test_runs_are_equal_and_tampering_shows(spark, tmp_path):
    from pairloom.plans.runs import compare_runs, run_pipeline, validate_run

    root, _, wire = corpus(tmp_path, manifest.SINGLE, [("wikitext.txt", "wikitext", b"aa aa aa\ndeterministic demo words words\n")])
    at = put(tmp_path, wire)
    source = ("a" * 40, "b" * 40, "C" * 64)
    runs = [run_pipeline(spark, at, {"r": str(root)}, str(tmp_path / n), 300, source, b"alpha\r\n\xffbeta\n") for n in ("x", "y")]
    assert runs[0] == runs[1] == compare_runs(spark, str(tmp_path / "x"), str(tmp_path / "y"))
    with pytest.raises(RunError):
        run_pipeline(spark, at, {"r": str(root)}, str(tmp_path / "x"), 300, source, b"")
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".part")]
    with pytest.raises(RunError, match="SameRun"):
        compare_runs(spark, str(tmp_path / "x"), str(tmp_path / "x"))
    with pytest.raises(RunError, match="RoundTripMismatch"):
        run_pipeline(spark, at, {"r": str(root)}, str(tmp_path / "z"), 300, source, b"</AI>")
    assert not (tmp_path / "z").exists()

    def rewritten(name, change):
        path = tmp_path / "y" / name
        held = path.read_bytes()
        document = json.loads(held)
        change(document)
        path.write_bytes(publish.canonical(document))
        with pytest.raises(RunError) as e:
            validate_run(spark, str(tmp_path / "y"))
        path.write_bytes(held)
        return str(e.value)

    assert rewritten("run_manifest.json", lambda d: d["training"].update(loaded_tokens=0)) == "RunMismatch: training"
    assert rewritten("run_manifest.json", lambda d: d["source"].update(commit="x")) == "RunMismatch: source"
    assert rewritten("run_manifest.json", lambda d: d["source"].update(commit="c" * 40)) == "RunMismatch: provenance"
    assert rewritten("run_manifest.json", lambda d: d["package"]["vocab"].update(payload_bytes=1)) == "RunMismatch: artifacts"
    assert rewritten("run_manifest.json", lambda d: d["round_trip"].update(token_count=1)) == "RunMismatch: round_trip"
    assert rewritten("run_manifest.json", lambda d: d["corpus"].update(admitted_files=2)) == "RunMismatch: corpus"
    assert rewritten("run_manifest.json", lambda d: d.update(more=1)) == "UnknownField: run_manifest.json"
    assert rewritten("train_config.json", lambda d: d.update(min_frequency=3)) == "RunMismatch: config"
    assert rewritten("probe_assertion.json", lambda d: d.update(status="passed")) == "RunMismatch: gates"
    assert rewritten("final_validation.json", lambda d: d.update(round_trip_sha256="A" * 64)) == "RunMismatch: final"
    (tmp_path / "y" / "more").write_bytes(b"")
    with pytest.raises(RunError, match="TopologyMismatch"):
        validate_run(spark, str(tmp_path / "y"))
    (tmp_path / "y" / "more").unlink()
    (tmp_path / "y" / "input.bin").write_bytes(b"other")
    with pytest.raises(RunError):
        compare_runs(spark, str(tmp_path / "x"), str(tmp_path / "y"))


def test_source_authority_and_composite_run(spark, tmp_path, capsys):
    import subprocess

    from pairloom.cli import main
    from pairloom.plans.runs import source_authority

    repo = tmp_path / "repo"
    repo.mkdir()
    git = lambda *args: subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)
    git("init", "-q")
    (repo / "f.txt").write_bytes(b"code\n")
    git("add", "-A")
    git("commit", "-qm", "x")
    found = source_authority(str(repo))
    line = f"{hashlib.sha256(b'code' + chr(10).encode()).hexdigest()}  5  f.txt\n"
    assert found.tracked_sha256 == hashlib.sha256(line.encode()).hexdigest().upper() and len(found.commit) == len(found.tree) == 40
    files = [("a.txt", "identity", b"aa\n"), ("b.txt", "scripture", b"bb\n"), ("c.txt", "wikitext", b"aa\n"), ("d.txt", "bookcorpus", b"cc\n")]
    root, _, wire = corpus(tmp_path, manifest.COMPOSITE, files)
    (tmp_path / "probe").write_bytes(b"aabb")
    args = ["pipeline", "--manifest", put(tmp_path, wire), "--roots", f"r={root}", "--vocab-size", "277", "--input", str(tmp_path / "probe"), "--repo", str(repo), "--profile", "composite", "--weights", "scripture=9000"]
    assert main([*args, "--run-root", str(tmp_path / "run")]) == 0 and "PASS" in capsys.readouterr().out
    assert publish.load_package(str(tmp_path / "run" / "package")).vocab[276] == b"bb"
    (repo / "g.txt").write_bytes(b"new")
    assert main([*args, "--run-root", str(tmp_path / "other")]) == 3 and not (tmp_path / "other").exists()
    assert main([*args, "--run-root", str(tmp_path / "other"), "--commit", "x"]) == 2 and main([*args[:-1], "scripture=0", "--run-root", "x"]) == 2


def test_package_manifest_faults(tmp_path):
    publish.write_package(Tokenizer.from_merges([(52, 136)]), str(tmp_path / "p"), CONTEXT)
    path = tmp_path / "p" / "package_manifest.json"
    held = path.read_bytes()

    def fails(change):
        wire = json.loads(held)
        change(wire)
        path.write_bytes(publish.canonical(wire))
        with pytest.raises(ArtifactError) as e:
            publish.load_package(str(tmp_path / "p"))
        return str(e.value)

    assert fails(lambda w: w["format"].update(minor=1)) == "InvalidManifest: format"
    assert fails(lambda w: w["readback"].update(paired_validation=False)) == "InvalidManifest: readback"
    assert fails(lambda w: w["counts"].update(merge_count=2)) == "InvalidManifest: counts"
    assert fails(lambda w: w["artifacts"][0].update(file_bytes=1)) == "InvalidManifest: artifacts vocab"
    assert fails(lambda w: w["artifacts"][1].update(payload_bytes=13, file_bytes=141)) == "InvalidManifest: artifacts merges"
    assert fails(lambda w: w["artifacts"][1].update(file_sha256="0" * 64)) == "InvalidManifest: artifacts merges"
    assert fails(lambda w: w["artifacts"][0].update(sequence_sha256="A" * 64)) == "InvalidManifest: sequence_sha256"
    assert fails(lambda w: w["artifacts"][0].update(payload_sha256="A" * 64)) == "PayloadDigestMismatch"
    assert fails(lambda w: w["provenance"].update(extra="x")) == "InvalidManifest: provenance"
    assert fails(lambda w: w.update(extra=1)) == "InvalidManifest: fields"
    path.write_bytes(held)
    os.symlink(tmp_path / "p", tmp_path / "link")
    with pytest.raises(ArtifactError, match="InvalidPublicationPath"):
        publish.load_package(str(tmp_path / "link"))
    m = publish.measure(publish.load_package(str(tmp_path / "p")))
    assert (m["vocab_records"], m["merge_payload_bytes"], m["max_token_bytes"]) == (277, 12, 19)


def test_publication_leaves_nothing_half_done(tmp_path, monkeypatch):
    t = Tokenizer.from_merges([(52, 136)])
    for step in ("read_pair", "inspect"):
        with monkeypatch.context() as m:
            m.setattr(publish.artifacts, step, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")))
            with pytest.raises(RuntimeError):
                publish.write_package(t, str(tmp_path / "p"), CONTEXT)
        assert os.listdir(tmp_path) == []
    real = publish._rename_new
    monkeypatch.setattr(publish, "_rename_new", lambda a, b: (os.mkdir(b), real(a, b)))  # another takes the name meanwhile
    with pytest.raises(ArtifactError, match="DestinationExists"):
        publish.write_package(t, str(tmp_path / "p"), CONTEXT)
    assert os.listdir(tmp_path) == ["p"] and os.listdir(tmp_path / "p") == []


def test_stats_of_training(spark):
    stats = train_with_stats(docs(spark, b"aa aa\n\n<AI>\nbb"), TrainConfig(278, 1))[2]
    assert stats == TrainingStats(loaded_sequences=2, skipped_lines=2, loaded_tokens=7, unique_words=3, learned_merges=2, final_vocab=278)


def test_cluster_needs_a_shared_folder():
    from pairloom.operators import written

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        written.shared_dir(Session)


def test_queries_against_sql(spark, tmp_path_factory):
    """Every query with SQL, on a small folder with empty texts, odd bytes and no row for some documents."""
    import duckdb

    from pairloom.plans.queries import ORACLES, QUERIES

    rng, folder = random.Random(9), tmp_path_factory.mktemp("tables")
    words = ["the", "a", "word", "  two", "é", "x\tq", "\n", "ab"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", "fr", "es"]), f"src{i % 3}", 0) for i in range(130)]
    rows += [(130, "", "en", "src1", 0), (131, None, "de", "src0", 0), (132, "\n\n", "fr", "src2", 0), (133, "w" * 3000, "es", "src1", 0)]
    tables = {
        "documents": (rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, 1, 0) for i in range(3, 140)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(i, f"item {i} " + " ".join(rng.choice(words) for _ in range(20))) for i in range(16)], "item_id long, text string"),
        "lineitem": ([(i % 7, i) for i in range(50)], "l_linenumber int, l_suppkey int"),
    }
    con = duckdb.connect()
    for name, (own, schema) in tables.items():
        spark.createDataFrame(own, schema).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    assert set(ORACLES) == set(QUERIES)
    for name, sql in ORACLES.items():
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        got = QUERIES[name](spark, str(folder))
        assert sorted(got.columns) == sorted(names), name
        assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == sorted(map(str, found.fetchall())), name


def test_cli(tmp_path):
    from pairloom.cli import main

    publish.write_package(Tokenizer.from_merges([(117, 118)]), str(tmp_path / "p"), CONTEXT)
    (tmp_path / "in").write_bytes(b"abab\r\n\xff<AI>")
    base = ["encode", "--package", str(tmp_path / "p"), "--text-file", str(tmp_path / "in"), "--out", str(tmp_path / "e")]
    assert main(base) == 0 and main(base) == 5
    assert main(["decode", "--package", str(tmp_path / "p"), "--encoded", str(tmp_path / "e"), "--out", str(tmp_path / "d")]) == 0
    assert (tmp_path / "d").read_bytes() == b"abab\r\n\xff<AI>"
    assert main(["--help"]) == 0 and main(base + ["--out", "x"]) == 2 and main(["encode"]) == 2 and main([]) == 2
    assert main(["decode", "--package", str(tmp_path / "p"), "--encoded", str(tmp_path / "in"), "--out", str(tmp_path / "z")]) == 4
    assert main(["encode", "--package", str(tmp_path / "none"), "--text-file", str(tmp_path / "in"), "--out", str(tmp_path / "q")]) == 3


def test_sql_functions_and_packing(spark):
    from pairloom.functions.sql import register

    t = Tokenizer.from_merges([(117, 118)])
    register(spark, t)
    assert list(spark.sql("SELECT bpe_encode('abab') AS x").first().x) == [276, 276]
    assert bytes(spark.sql("SELECT bpe_decode(array(276)) AS x").first().x) == b"ab"
    assert [r.segment for r in spark.sql("SELECT * FROM bpe_presegments('a  b ') ORDER BY seg_no").collect()] == ["a", "  b", " "]
    t.merge_table(spark).createOrReplaceTempView("m")
    assert spark.sql("SELECT bpe_sequence_digest(ordinal, a, b, merged) AS x FROM m").first().x == t.sequence_sha256()
    e = spark.createDataFrame([(i, [20 + i] * i) for i in range(6)], "k int, token_ids array<int>")
    whole, packing.RANGE_ROWS = packing.RANGE_ROWS, 2
    try:
        starts = {r.k: r.start for r in packing.offsets(e, "k").collect()}
    finally:
        packing.RANGE_ROWS = whole
    assert starts == {0: 0, 1: 1, 2: 3, 3: 6, 4: 10, 5: 15}
    rows = [list(r.row) for r in packing.pack(e, "k", window=8).orderBy("window_no").collect()]
    flat = [x for i in range(6) for x in [20 + i] * i + [3]]
    assert sum(rows, [])[: len(flat)] == flat and all(len(r) == 8 for r in rows)
    long = spark.createDataFrame([(0, [7]), (1, list(range(100, 130))), (2, []), (3, [8, 9])], "k int, token_ids array<int>")
    flat = [7, 3, *range(100, 130), 3, 3, 8, 9, 3]
    got = {r.window_no: list(r.row) for r in packing.pack(long, "k", window=8).collect()}
    assert got == {i // 8: (flat[i : i + 8] + [0] * 8)[:8] for i in range(0, len(flat), 8) if len(flat[i : i + 8]) >= 2}
    twice = packing.repeated(long.withColumn("n", F.col("k") % 2 + 1), "k", F.col("n"), F.col("n")).orderBy("k").collect()
    assert [list(r.token_ids) for r in twice] == [[7], [], list(range(100, 130)), [8, 9], list(range(100, 130)), [8, 9]]
    assert packing.repeated(long, "k", F.lit(0)).count() == 0 and packing.pack(long.limit(0), "k").count() == 0
    assert packing.calibrate({"a": 10, "b": 20}, {"a": 5000, "b": 5000}) == {"a": 2000, "b": 1000}


def test_documents_are_packed_and_decoded_by_join(spark, tmp_path):
    from pairloom.plans import queries

    texts = [None, "", *(f"{'some words of a document ' * (i * 7 % 23)}é{i}" for i in range(40))]
    spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = queries._tokenizer(spark, str(tmp_path))
    coder, stream = Coder(tokenizer), []
    for t in texts:
        stream += [*coder.encode(t.encode()), packing.EOS] if t is not None else []
    windows = [stream[i : i + 256] for i in range(0, len(stream), 256)]
    expected = {i: [*w, *[0] * (256 - len(w))] for i, w in enumerate(windows) if len(w) >= 64}
    assert len(windows) > 20 and {r.window_no: [int(i) for i in r.ids.split()] for r in queries.QUERIES["pack_windows"](spark, str(tmp_path)).collect()} == expected
    back = {r.doc_id: r.text for r in queries.QUERIES["decode_documents_by_join"](spark, str(tmp_path)).collect()}
    assert back == {i: t for i, t in enumerate(texts) if t is not None}


def test_decoding_by_join_makes_no_row_of_an_id(spark, monkeypatch):
    t = Tokenizer.from_merges([(117, 118), (52, 117)])
    ids = [[], None, [20, 117, 276, 277, 19], [*range(278)] * 3, [30], [30] * 8, [31] * 9]
    encoded = spark.createDataFrame(list(enumerate(ids)), "k int, token_ids array<int>")
    for cut in (8, codec.SLICE):
        monkeypatch.setattr(codec, "SLICE", cut)
        back = decode_join(encoded, t, "k")
        assert {r.k: bytes(r.decoded) for r in back.collect()} == {i: Coder(t).decode(x or []) for i, x in enumerate(ids)}
        plan = back._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Join" in plan and plan.count("Aggregate") == 1  # of the vocabulary
        for wrong in ([30] * 20 + [278], [-1], [30, None]):
            with pytest.raises(Exception, match="InvalidTokenId"):
                decode_join(spark.createDataFrame([(0, wrong)], "k int, token_ids array<int>"), t, "k").collect()


def test_ids_leave_the_worker_in_parts(spark):
    t = Tokenizer.from_merges([(117, 118), (52, 117)])
    texts = [b"ab ab" * i for i in range(30)] + [b"", b"\xff" * 500]
    d = docs(spark, *texts).unionByName(spark.createDataFrame([(32, None)], "doc_id int, text binary")).coalesce(1)
    for size in (1, 60, 1 << 20):
        rows = d.select("doc_id", encoder(spark, t, size)(F.col("text")).alias("a")).collect()
        assert {r.doc_id: r.a and list(r.a) for r in rows} == {i: Coder(t).encode(x) for i, x in enumerate(texts)} | {32: None}
    assert d.limit(0).select(encoder(spark, t, 1)(F.col("text"))).collect() == []


def test_packed_corpus_file(spark, tmp_path):
    t = Tokenizer.from_merges([(117, 118)])
    e = spark.createDataFrame([(i, [20 + i % 200] * (i % 40)) for i in range(90)], "k long, token_ids array<int>")
    windows = packing.pack(e, "k", window=16)
    metas = [packing.write_corpus(windows.repartition(n), str(tmp_path / str(n)), t, {"a": 3, "b": 1}, seed=5, window=16) for n in (1, 4)]
    assert metas[0] == metas[1] and (tmp_path / "1" / "corpus.bin").read_bytes() == (tmp_path / "4" / "corpus.bin").read_bytes()
    meta, rows = packing.read_corpus(str(tmp_path / "1"))
    assert rows.dtype == "<u2" and sorted(map(tuple, rows.tolist())) == sorted(tuple(r.row) for r in windows.collect())
    assert meta["seq_count"] == len(rows) and meta["tier_breakdown"] == {"a": 80, "b": 27}  # each rounded
    with pytest.raises(ArtifactError, match="DestinationExists"):
        packing.write_corpus(windows, str(tmp_path / "1"), t, window=16)
    (tmp_path / "1" / "corpus.bin").write_bytes(b"xx")
    with pytest.raises(RunError, match="HashMismatch"):
        packing.read_corpus(str(tmp_path / "1"))


def test_distinct_encoding_and_long_segments(spark):
    rng = random.Random(4)
    t = Tokenizer.from_merges([(117, 118), (52, 117)])
    texts = [b" ".join(rng.choice([b"ab", b"abab", b"c", b"<AI>x", b"\xff"]) for _ in range(rng.randrange(40))) for _ in range(50)] + [b"", b"\r\n\n", b"q" * 40_000 + b"<AI>"]
    rows = encode_distinct(docs(spark, *texts), t, "doc_id").collect()
    assert {r.doc_id: list(r.token_ids) for r in rows} == {i: Coder(t).encode(x) for i, x in enumerate(texts)}
    assert list(docs(spark, texts[-1]).select(encode_native(F.col("text"), t).alias("x")).first().x) == Coder(t).encode(texts[-1])


def test_directory_scan(spark, tmp_path):
    names = {"x_annotated.md": 3, "z.json": 1, "notes.txt": 4, "Iteration_1.TXT": 2, "Dylan_chat.md": 5, "wikitext_extracted/p.txt": 6, "blu.txt": 7}
    for name, size in names.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    files, found = manifest.scan_directory(spark, str(tmp_path))
    assert [(os.path.basename(r.path), r.tier, r.weight) for r in files.collect()] == [("Iteration_1.TXT", "scripture", 3000), ("blu.txt", "identity", 5000), ("p.txt", "foundation", 1000), ("x_annotated.md", "identity", 5000)]
    assert found == {"total_files": 4, "skipped_files": 2, "total_bytes": 18, "foundation": 1, "scripture": 1, "identity": 2}
    with pytest.raises(ManifestError):
        manifest.scan_directory(spark, str(tmp_path / "none"))


def test_exports():
    import pairloom

    assert all(getattr(pairloom, name) is not None for name in pairloom.__all__) and callable(pairloom.encode) and callable(pairloom.decode)
    with pytest.raises(AttributeError):
        pairloom.nothing


def test_streaming(spark, tmp_path):
    from pairloom.streaming.encode import encode_stream

    spark.createDataFrame([("abab",), ("x",)], "text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    q = encode_stream(stream, Tokenizer.from_merges([(117, 118)])).writeStream.format("memory").queryName("enc").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.text: list(r.token_ids) for r in spark.table("enc").collect()} == {"abab": [276, 276], "x": [140]}


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 10
