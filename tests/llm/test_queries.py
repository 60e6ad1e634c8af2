"""Every registered query on one small set of tables with edge rows, on empty tables, and the pipeline against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import common, decontamination, mixing, queries, toxicity, warc

from test_llm import brute_fingerprint, by_brute_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, stream string, position string, shard string, score string"
SCHEMAS = {
    "documents": DOCS, "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string",
    "embeddings": "vec_id long, embedding array<float>", "pages": "page_id long, url string, html string",
}


def tables(rng):
    pool = [f"w{i}" for i in range(400)] + ["the", "of", "You", "É", "x-1"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, text(rng.randrange(15, 60))) for i in range(30)] + [(90, None), (91, ""), (92, "the of"), (None, text(20))]
    docs, labels = [], []
    for i in range(420):
        body = text(rng.randrange(20, 120))
        if i % 3 == 0:
            words = body.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["slurly", "badword", "b4dword", "nastyish"]))
            body = " ".join(words)
        elif i % 17 == 1:
            at = rng.randrange(30)
            own = items[at][1].split()
            own[rng.randrange(len(own))] = "other"
            body = f"{text(10)} {' '.join(own)} {text(10)}"
        docs.append((i, body, rng.choice("abcd")))
        labels.append((i, 1, int(i % 3 == 0)))
    docs += [(1000 + i, docs[4 + 3 * (i % 5)][1], "b") for i in range(60)]  # copies
    docs += [(2000, None, "a"), (2001, "", None), (2002, " \n\t", "b"), (2003, "the of", "c"), (2004, text(40_000), "a"), (None, text(9), "a"), (None, None, None), docs[7], docs[7]]
    docs += [(2010 + i, docs[2][1] + f" tail{i}", "d") for i in range(3)]
    vectors = [(i, [rng.choice([-0.5, 0.25, 0.0, 1.0]) for _ in range(6)]) for i in range(160)] + [(500, None), (501, [None] * 6), (550, [float("nan")] * 6), (600, [])]
    pages = [(i, f"http://{rng.choice('ab')}.org/{i}", f"<nav>menu</nav><p>{i % 40}</p>\n<p>{rng.random()}</p>" if i % 3 else f"<p>{i % 40}</p>") for i in range(200)]
    pages += [(900, None, None), (901, "http://x/" + "y" * 20_000, "long url"), (902, "http://z/", "long url"), (903, "http://z/", "long url"), pages[3], (None, None, None)]
    pages += [(1000 + i, "http://h/" + "y" * 9_000, "hot") for i in range(120)]
    return {"documents": [(i, t, "en", s, len(t or ""), "x", "y", "z", "u", "v") for i, t, s in docs], "labels": [*labels, (None, 1, 1), (3, None, None)], "benchmark": items, "embeddings": vectors, "pages": pages}


def put(spark, folder, rows):
    for name, own in rows.items():
        spark.createDataFrame(own, SCHEMAS[name]).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def rows():
    return tables(random.Random(21))


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    return put(spark, tmp_path_factory.mktemp("rows"), rows)


def test_empty_tables(spark, tmp_path):
    folder = put(spark, tmp_path, {name: [] for name in SCHEMAS})
    for name, query in queries.QUERIES.items():
        assert query(spark, folder).count() == (name == "sharding_laws"), name


def by_sql(sf_dir, sql):
    import duckdb

    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet/*.parquet')")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, name):
    names, expected = by_sql(sf_dir, queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf_dir).select(*names).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, expected)) and got


def test_op3(spark, rows, sf_dir):
    got = queries.QUERIES["op3_toxicity"](spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows["documents"])
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 420]
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.95


def test_op4(spark, rows, sf_dir):
    import public_tokenizers

    from pairloom.llm.token_counts import Counter as Tokens, pieces_of

    counter = Tokens(pieces_of(str(public_tokenizers.path("piece_bpe_32k.model"))))
    got = queries.QUERIES["op4_token_counts"](spark, sf_dir).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((r[0], counter.count(r[1]))) for r in rows["documents"])


def leaked(text, items):
    """(item, least distance) of the items that some stretch of the text is near enough to, by looking at all of them."""
    ws = decontamination.words(text)
    for i, t in items:
        own = decontamination.words(t)
        if 0 < len(own) < 5 and ws == own:
            yield i, 0
        elif len(own) >= 5 and len(set(own) & set(ws)) > len(set(own)) // 2:
            best = decontamination.best_alignment(tuple(own), ws)[0]
            if best <= int(0.2 * len(own) + 1e-9):
                yield i, best


def test_op5(spark, rows, sf_dir):
    got = queries.QUERIES["op5_benchmark_decontamination"](spark, sf_dir).collect()
    expected = [str((r[0], i, d)) for r in rows["documents"] if len(r[1] or "") < 20_000 for i, d in leaked(r[1], rows["benchmark"])]
    assert sorted(str((r.doc_id, r.item_id, r.distance)) for r in got if r.doc_id != 2004) == sorted(expected) and len(expected) > 15


def test_op6(spark, rows, sf_dir):
    got = queries.QUERIES["op6_sharding"](spark, sf_dir).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in got) == sorted(str((r[0], size(r[1]), zlib.crc32((r[1] or "").encode()))) for r in rows["documents"])
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def groups(docs):
    fps = [brute_fingerprint(r[1]) for r in docs]
    group = by_brute_components(fps)
    least = {g: min((r[0] for r, h in zip(docs, group) if h == g and r[0] is not None), default=None) for g in set(group)}
    return fps, [least[g] for g in group]


def test_op7(spark, rows, sf_dir):
    got = queries.QUERIES["op7_simhash_near_dedup"](spark, sf_dir).collect()
    fps, least = groups(rows["documents"])
    assert sorted(str(tuple(r)) for r in got) == sorted(str((r[0], f"{f:016x}", g)) for r, f, g in zip(rows["documents"], fps, least))


def test_op8_reads_in_many_tasks(spark, rows, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder, shards = warc.write_archives(pages, block_entries=8)
    read = warc.read_archives(folder, shards)
    assert read.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 8
    top = {}
    for i, _, h in rows["pages"]:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    to = lambda i, h: None if i == top[h or ""] or top[h or ""] < 0 else top[h or ""]
    expected = [str((i, len((h or "").encode()), digest(h), "response" if to(i, h) is None else "revisit", to(i, h))) for i, _, h in rows["pages"]]
    assert sorted(str(tuple(r)) for r in read.collect()) == sorted(expected)
    number = next(i for i, u, h in rows["pages"] if h == "long url" and i == 901)
    headers, _ = warc.Reader(folder, [(r.first, r.shard) for r in shards.collect()]).lookup(warc.key_text(rows["pages"][201][1], number))
    assert headers["x-capture-number"] == "901" and headers["warc-type"] == "revisit" and headers["x-refers-to-number"] == "903"


def test_op10(spark, rows, sf_dir):
    got = queries.QUERIES["op10_token_output"](spark, sf_dir).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(tokens([r[:2] for r in rows["documents"]]))


def tokens(docs):
    """(doc_id, start, n_tokens, ids_crc32) of (doc_id, text), by the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library, at = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), 0
    for i, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        yield str((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)


def takes(docs):
    """How often each row (doc_id, text, source) is taken, by adding up one row after the other."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r[2] for r in docs}, key=lambda s: (s is None, s or ""))
    own = [sum(size(r[1]) for r in docs if r[2] == s) for s in names]
    goal = mixing.targets(own, [Fraction((5, 2, 1)[i % 3]) for i in range(len(names))], Fraction(3, 2) * sum(own), 2)
    out = []
    for s, g, n in zip(names, goal, own):
        mine = sorted((r for r in docs if r[2] == s), key=lambda r: (hashlib.md5(b"" if r[0] is None else str(r[0]).encode()).hexdigest()[:16], -1 if r[0] is None else r[0], size(r[1])))
        want, at = int(g + Fraction(1, 2)), 0
        for r in mine:
            k = size(r[1])
            taken = want // n * k + max(0, min(k, want % n - at)) if n else 0
            at += k
            out += [r] * (-(-taken // k) if taken else 0)
    return out


def test_pipeline_against_brute_force(spark, rows, sf_dir):
    import corpus_pipeline

    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    model = toxicity.fit(table("documents"), table("labels"))
    docs = rows["documents"]
    docs = [r for r, s in zip(docs, model.score([r[1] for r in docs])) if s < 0.5]
    assert 200 < len(docs) < len(rows["documents"]) - 120
    _, least = groups(docs)
    kept, seen = [], set()
    for r, g in zip(docs, least):
        if r[0] is None or (r[0] == g and r[0] not in seen):
            kept.append(r)
            seen.add(r[0])
    clean = [r for r in kept if not any(True for _ in leaked(r[1], rows["benchmark"]))]
    assert len(clean) < len(kept) < len(docs)
    chosen = takes([(r[0], r[1], r[3]) for r in clean])
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(tokens([r[:2] for r in chosen]))


def test_kept_tables_are_deleted(spark, sf_dir):
    import corpus_pipeline

    common.clean(spark)
    corpus_pipeline.run(spark, sf_dir)
    assert len(common._made) == 1
    common.clean(spark)
    assert common._made == []


def test_shared_folder_is_needed_on_a_cluster():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        conf = Conf
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
