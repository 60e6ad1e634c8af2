"""Operators against brute force on small tables, edge cases, and round trips."""

import base64
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pairloom.llm.common import spread_join
from pairloom.llm import decontamination, line_dedup, mixing, repair, sharding, simhash, token_counts, token_output, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, fp int, taken int, component_id int, position string, shard string"


def docs(spark, rows):
    """rows: (doc_id, text, source); with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", 1, 2, 3, "z", "w") for i, t, s in rows], DOCS).repartition(3)


def edge_rows(rng, n=60):
    pool = ["the", "of", "And", "idiot", "x1", "ÀB", "don't", "a.b", "you", "long"]
    text = lambda k: " ".join(rng.choice(pool) for _ in range(k))
    rows = [(i, text(rng.randrange(1, 60)), rng.choice(["a", "b", "c", None])) for i in range(n)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, " \t\n", None), (None, "lost id", "a"), (None, None, None), (1003, text(30_000), "a")]
    rows += [rows[0], rows[0], (1004, rows[1][1], "b"), (1005, rows[1][1], "zz")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return edge_rows(random.Random(1))


def by_brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(h >> i & 1 for h in hashes) > len(hashes)) << i for i in range(64))


def test_simhash(spark, rows):
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    group = by_brute_components(fps)
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    expected = sorted((str(r[0]), f, str(least[g])) for r, f, g in zip(rows, fps, group))
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in got) == expected
    kept = [r.doc_id for r in simhash.dedup_stage(spark, docs(spark, rows), "").collect()]
    assert sorted(k for k in kept if k is not None) == sorted({v for v in least.values() if v is not None}) and kept.count(None) == 2


@pytest.mark.parametrize("group_rows", [1 << 18, 40])
def test_hamming_links_are_complete(spark, group_rows):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(25)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(12)}
    fps |= {centres[0] ^ (1 << a) for a in range(64)} | {0, (1 << 64) - 1}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    stars = simhash.hamming_stars(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, group_rows)
    root = {r.node: r.root for r in simhash.components(stars).collect()}
    group = by_brute_components(fps)
    ours = [root.get(s, s) for s in signed]
    assert len(set(zip(group, ours))) == len(set(group)) == len(set(ours))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (5, 5)]
    root = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert root == {i: 0 for i in range(1, 61)} | {200: 100, 300: 100}


def test_components_of_a_star(spark):
    """All edges share a node, the smallest or the largest: it is dealt out by its neighbours."""
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for centre in (0, 10**6):
            edges = spark.createDataFrame([(i, centre) for i in range(1, 20_001)], "a long, b long")
            root = {r.node: r.root for r in simhash.components(edges).collect()}
            assert root == {i: min(centre, 1) for i in range(min(centre, 1), 20_001) if i != min(centre, 1)} | ({centre: 1} if centre else {})
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        both = spark.createDataFrame([(0, i) for i in range(1, 20_001)] + [(i, 0) for i in range(1, 20_001)], "a long, b long")
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        spread = spread_join(both, least, "a", 40_000, F.col("b")).select("m", F.spark_partition_id().alias("task")).collect()
        counts = sorted(np.unique([r.task for r in spread], return_counts=True)[1])
        assert len(counts) == 32 and counts[-1] < 4 * counts[16]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(rng.choice([4, 4, 4, 3]))]) for i in range(120)]
    rows += [(200, None), (201, [None, 1.0]), (202, [float("nan")]), (203, [float("inf")]), (204, []), (None, [1.0]), (7, [0.5] * 4), (300, [1e17, -1e17])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("id", F.lit("x"))
    used = [(i, [int(max(-9e18, min(9e18, np.floor(256 * x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for block in (8192, 4):
        got = {}
        for r in topk.top_k(table, table.filter("vec_id % 5 = 0"), query_block=block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
        for q in {i for i, _ in used if i % 5 == 0}:
            w = min(v for i, v in used if i == q)
            top = (1 << 63) - 1
            best = sorted((-max(-top, min(top, sum(a * b for a, b in zip(w, v)))), i) for i, v in used if i != q)[:5]
            assert sorted(got[q]) == [(k + 1, -s, i) for k, (s, i) in enumerate(best)]
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_mixing(spark, rows):
    got = mixing.mix(docs(spark, rows)).collect()
    again = mixing.mix(docs(spark, rows).repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(size(t) for _, t, _ in rows)
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), Fraction(3, 2) * total
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * own[s]}
        if not over:
            goal |= share
            break
        goal |= {s: Fraction(2 * own[s]) for s in over}
        left -= sum(goal[s] for s in over)
        open_ -= over
    for s in names:
        mine = [r for r in got if r.source == s]
        assert mine[0].target == float(goal[s]) and mine[0].source_size == own[s] and abs(sum(r.taken for r in mine) - goal[s]) <= 1
    assert all(0 <= r.taken <= 2 * r["size"] and (r.position is None) == (r.taken == 0) for r in got)
    assert [mixing.integral(k) for k in mixing.SCHEDULES] == [5, 2, 1]
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and 0 <= min(places) and max(places) < 1
    assert mixing.mix(docs(spark, rows).limit(0)).count() == 0
    staged = mixing.mixing_stage(spark, docs(spark, rows), "")
    assert staged.columns == docs(spark, rows).columns and {r.doc_id for r in staged.collect()} <= {r[0] for r in rows}


def test_mixing_places_every_take(spark, rows):
    rows = [(i, t, s) for i, t, s in rows if i != 1003] + [(2000 + i, "w " * (i % 7 + 1), "c") for i in range(40)]
    got = mixing.mix(docs(spark, rows)).collect()
    names = sorted({r.source for r in got}, key=lambda s: (s is None, s or ""))
    repeated = 0
    for i, s in enumerate(names):
        knots = mixing.SCHEDULES[i % 3]
        mine = [r for r in got if r.source == s]
        want = sum(r.taken for r in mine)
        assert all(len(r.positions) == -(-r.taken // max(1, r["size"])) and r.position == (r.positions or [None])[0] for r in mine)
        repeated += sum(len(r.positions) > 1 for r in mine)
        before = 0
        for at, last, r in sorted(((p, p == r.positions[-1], r) for r in mine for p in r.positions), key=lambda x: x[0]):
            cut = [k for k in knots if k[0] < at]
            part = [*cut, (at, np.interp(at, *zip(*knots)))] if cut else []
            assert abs(float(mixing.integral(part)) / float(mixing.integral(knots)) * want - before) < 1e-6 * want
            before += r.taken - r["size"] * (len(r.positions) - 1) if last else r["size"]
        assert before == want
    assert repeated > 20
    staged = [r.doc_id for r in mixing.mixing_stage(spark, docs(spark, rows), "").collect()]
    assert staged == [i for _, i in sorted(((p, r.doc_id) for r in got for p in r.positions), key=lambda x: (x[0], x[1] or 0))]


def test_toxicity(spark):
    rng = random.Random(4)
    clean = ["the", "of", "house", "tree", "walk", "green", "you", "fine", "day"]
    data, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.2
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 80))]
        if bad:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["slurly", "slurish", "badword", "b4dword"]))
        data.append((i, " ".join(words), "a"))
        labels.append((i, int(bad)))
    table, flags = docs(spark, data), spark.createDataFrame([*labels, (5000, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(table, flags)
    score = toxicity.scorer(spark, model)
    held = table.select("doc_id", toxicity.held_out().alias("h"), score("text").alias("s")).filter("h").collect()
    truth = dict(labels)
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert np.mean([(r.s >= 0.5) == bool(truth[r.doc_id]) for r in held]) > 0.95 and all(0 <= r.s <= 1 for r in held)
    assert np.allclose(model.score(["the badword", None, ""]), toxicity.fit(table.repartition(5), flags).score(["the badword", None, ""]))
    none = toxicity.fit(table, flags.limit(0))
    assert none.score(["x", None]).tolist() == [0.0, 0.0] and toxicity.fit(table.limit(0), flags).score([""]).tolist() == [0.0]
    knots = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(knots[1]) >= 0).all()


def test_toxicity_limit_of_fitting(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    data = docs(spark, [(i, f"house tree {'badword' if i in ids[:20] else 'walk'} {i}", "a") for i in ids])
    for toxic, fitted in ((toxicity.MIN_KIND - 1, False), (toxicity.MIN_KIND, True)):
        model = toxicity.fit(data, spark.createDataFrame([(i, int(i in ids[:toxic])) for i in ids], "doc_id long, toxic int"))
        assert (model.trees is not None) == fitted and (model.score(["a badword"])[0] == toxic / len(ids)) != fitted


def test_toxicity_learns_from_a_row_an_id(spark):
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    data = docs(spark, [(i, f"house {'badword' if i % 2 else 'tree'} {i} {k}", "a") for i in ids for k in range(20)])
    flags = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    fitted, trees = [], toxicity.Trees
    toxicity.Trees = lambda x, y: fitted.append(len(y)) or trees(x, y)
    try:
        toxicity.fit(data, flags, sample_rows=50)
    finally:
        toxicity.Trees = trees
    assert max(fitted) == 50


def test_toxicity_features_beyond_ascii():
    lexicon = toxicity.Lexicon({"bad": 3.0})
    capitals, marks = lexicon.features("ÀÉ é Ж а bad «oui» — ¡no!")[10:12]
    raw = len("ÀÉ é Ж а bad «oui» — ¡no!".encode())
    assert (round(capitals * raw), round(marks * raw)) == (3, 5)
    assert lexicon.features("word " * 200_000)[9] == np.log1p(200_000)


def test_token_counts(spark, rows):
    from tokenizers import Tokenizer, models, normalizers

    rng = random.Random(5)
    pieces = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), ("▁", -3.0), ("▁▁", -4.0)]
    pieces += [(c, -float(rng.randrange(1, 6))) for c in "abcx\t"] + [(p, -float(rng.randrange(1, 6))) for p in ("ab", "bc", "abc", "▁a", "▁ab", "cc", "aaa", "aa", "é")]
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    counter = token_counts.Counter(pieces)
    texts = ["".join(rng.choice("abcxé \nzé\t") for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    assert [counter.count(t) for t in texts] == [len(library.encode(t).ids) for t in texts]
    count = token_counts.counter(spark, pieces)
    got = {str(r.doc_id): r.n for r in docs(spark, rows).select("doc_id", count("text").alias("n")).collect()}
    assert got["1000"] == got["1001"] == 0 and got["1003"] == counter.count(next(t for i, t, _ in rows if i == 1003))


def test_decontamination(spark):
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(300)]
    item = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, item(rng.randrange(14, 50))) for i in range(40)] + [(90, None), (91, ""), (92, "too short here"), (93, None)]
    items.append((94, items[0][1]))
    data, truth = [], set()
    for i in range(200):
        words = item(rng.randrange(30, 90)).split()
        if i % 3 == 0:
            k = rng.randrange(40)
            own = items[k][1].split()
            for _ in range(rng.randrange(0, len(own) // 8 + 1)):
                own[rng.randrange(len(own))] = rng.choice(["new", "word"])
            at = rng.randrange(len(words))
            words[at:at] = [own[0].upper(), *own[1:]]
            truth.add((i, k))
        data.append((i, ", ".join(words), "a"))
    data += [(500, None, None), (501, "", "a"), (502, "w1", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.leaks(docs(spark, data), bench).collect()}
    found = {k for k in got if k[1] < 90}
    assert {d for d, k in got if k == 94} == {d for d, k in got if k == 0}
    assert len(found & truth) >= 0.95 * len(truth)
    for d, k in list(got)[:60]:
        own = decontamination.words(dict(items)[k])
        best = decontamination.best_alignment(tuple(own), decontamination.words(data[d][1]))[0]
        assert best == got[d, k] <= int(0.2 * len(own))
    assert decontamination.leaks(docs(spark, data), bench.limit(0)).count() == 0
    assert decontamination.leaks(docs(spark, data).limit(0), bench).count() == 0
    bench.write.mode("overwrite").parquet((folder := str(spark.conf.get("spark.checkpoint.dir")) + "/decon") + "/benchmark.parquet")
    stay = decontamination.decontamination_stage(spark, docs(spark, data), folder)
    assert {r.doc_id for r in stay.collect()} == {d for d, _, _ in data} - {d for d, _ in got} and stay.columns == docs(spark, data).columns


def test_decontamination_finds_every_kind_of_edit():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range((5, 12, 20, 40, 58, 80)[i % 6]))) for i in range(36)]
    texts, truth = [], set()
    for i, t in items:
        for kind in ("delete", "insert", "substitute", "mixed"):
            for _ in range(3):
                own = t.split()
                at = sorted(rng.sample(range(len(own)), len(own) // 5), reverse=True)
                for k in at:
                    edit = rng.choice(["delete", "insert", "substitute"]) if kind == "mixed" else kind
                    own[k : k + (edit != "insert")] = [] if edit == "delete" else ["other"]
                truth.add((len(texts), i))
                texts.append(" ".join([word() for _ in range(rng.randrange(30))] + own + [word() for _ in range(rng.randrange(30))]))
    texts += [None, "", "w1", *(" ".join(word() for _ in range(60)) for _ in range(20))]
    got = {(d, h["item_id"]): h["distance"] for d, hs in enumerate(decontamination.Index(items).search(texts)) for h in hs}
    assert len(truth & set(got)) >= 0.98 * len(truth)
    some, loose = items[:6], decontamination.Index(items[:6], similarity=0.4)
    for index, similarity in ((decontamination.Index(some), 0.8), (loose, 0.4)):
        got = {(d, h["item_id"]): h["distance"] for d, hs in enumerate(index.search(texts[:100:3])) for h in hs}
        best = {(d, i): decontamination.best_alignment(tuple(t.split()), decontamination.words(x))[0] for d, x in enumerate(texts[:100:3]) for i, t in some}
        assert got == {k: v for k, v in best.items() if v <= int((1 - similarity) * len(dict(items)[k[1]].split()) + 1e-9)}


@pytest.mark.parametrize("kind", ["delete", "insert", "substitute", "mixed"])
def test_decontamination_recall_at_the_threshold(kind):
    rng = random.Random(kind)
    pool = [f"w{i}" for i in range(600)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(n))) for i, n in enumerate([5, 9, 15, 22, 30, 40, 50, 59, 64, 65, 130, 300])]
    index, missed, trials = decontamination.Index(items), 0, 504
    texts, truth = [], []
    for t in range(trials):
        i, own = items[t % 12][0], items[t % 12][1].split()
        for k in sorted(rng.sample(range(len(own)), int(0.2 * len(own) + 1e-9)), reverse=True):
            edit = rng.choice(["delete", "insert", "substitute"]) if kind == "mixed" else kind
            own[k : k + (edit != "insert")] = [] if edit == "delete" else [rng.choice(pool)]
        texts.append(" ".join([rng.choice(pool) for _ in range(40)] + own + [rng.choice(pool) for _ in range(40)]))
        truth.append(i)
    missed = sum(i not in {h["item_id"] for h in hs} for i, hs in zip(truth, index.search(texts)))
    assert missed <= 0.01 * trials


def test_decontamination_of_short_items_and_in_passes(spark):
    items = [(1, "alpha beta"), (2, "Gamma"), (3, " ".join(f"w{i}" for i in range(200))), (4, "one two three four five six")]
    data = [(0, "ALPHA, beta!", "a"), (1, "alpha beta gamma", "a"), (2, "gamma", "a"), (3, "x " + " ".join(f"w{i}" for i in range(200) if i % 6), "a"), (4, "zero one two three five six", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = {(0, 1, 0), (2, 2, 0), (3, 3, 34), (4, 4, 1)}
    chunk, whole = decontamination.CHUNK_WORDS, decontamination.PASS_WORDS
    try:
        for size, most in ((chunk, whole), (1, whole), (1, 1)):
            decontamination.CHUNK_WORDS, decontamination.PASS_WORDS = size, most
            assert {(r.doc_id, r.item_id, r.distance) for r in decontamination.leaks(docs(spark, data), bench).collect()} == expected
    finally:
        decontamination.CHUNK_WORDS, decontamination.PASS_WORDS = chunk, whole


def test_alignment_by_brute_force():
    rng = random.Random(7)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    for _ in range(60):
        item = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        region = [rng.choice("abc") for _ in range(rng.randrange(0, 10))]
        least = min(distance(item, region[i:j]) for i in range(len(region) + 1) for j in range(i, len(region) + 1))
        got, at = decontamination.best_alignment(tuple(item), region)
        assert got == least and any(distance(item, region[at:j]) == least for j in range(at, len(region) + 1))


def test_sharding(spark, rows):
    rng = random.Random(8)
    many = rows[:-1] + [(2000 + i, f"t {rng.random()}" * rng.randrange(1, 40), "a") for i in range(3000)] + [(9000 + i, "hot copy " * 40, "b") for i in range(1500)]
    many = [r for r in many if r[0] != 1003]
    cut = sharding.shard(docs(spark, many), part_rows=100).collect()
    got = sharding.shard(docs(spark, many)).collect()
    assert sorted(str((r.doc_id, r["size"], r.shard)) for r in cut) == sorted(str((r.doc_id, r["size"], r.shard)) for r in got)
    assert all(sorted(r.slot for r in cut if r.shard == s) == list(range(sum(r.shard == s for r in cut))) for s in range(8))
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t, _ in many)
    held = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
    assert max(held) - min(held) <= 0.02 * sum(held) / 8 + max(size(t) for _, t, _ in many)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    of = {i: t for i, t, _ in many}
    shards = {}
    for r in (r for r in got if r.doc_id is not None):
        shards.setdefault(of[r.doc_id], set()).add(r.shard)
    assert all(len(v) == 1 for t, v in shards.items() if t != "hot copy " * 40)
    assert sorted(map(str, sharding.shard(docs(spark, many).repartition(5)).collect())) == sorted(map(str, got))
    long = sharding.shard(docs(spark, [*rows, *((20 + i, "w " * 9_000, "a") for i in range(9))])).collect()
    assert len(long) == len(rows) + 9 and max(r["size"] for r in long) > 100_000
    assert sharding.shard(docs(spark, rows).limit(0)).count() == 0


def test_warc(spark):
    rng = random.Random(9)
    pages = [(i, f"http://{rng.choice('abc')}.Example.org/p?{i % 7}", f"<p>body {rng.randrange(60)} é</p>" * rng.randrange(1, 4)) for i in range(300)]
    pages += [(900, None, None), (901, "http://x y/\r\n", ""), (None, "http://n/", "<p>only here</p>"), (None, "http://n/", pages[0][2]), (902, "no url", "a\r\n\r\nb")]
    pages += [(-5, "http://neg/", "same"), (3000, "http://m/", "same"), (3000, "http://m/", "same")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("first", F.lit(2)).repartition(3)
    folder, shards = warc.write_archives(table, block_entries=16)
    got = warc.read_archives(folder, shards).collect()
    top = {}
    for i, _, h in pages:
        top[h or ""] = max(top.get(h or "", -(10**9)), -(10**9) if i is None else i)
    expected = []
    for i, _, h in pages:
        data, best = (h or "").encode(), top[h or ""]
        kind = "response" if i == best or best == -(10**9) else "revisit"
        expected.append(str((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, best if kind == "revisit" else None)))
    assert sorted(str(tuple(r)) for r in got) == sorted(expected)
    reader = warc.Reader(folder, [(r.first, r.shard) for r in shards.collect()])
    headers, payload = reader.lookup(warc.key_text(pages[5][1], 5))
    assert headers["x-capture-number"] == "5" and payload == (pages[5][2].encode() if headers["warc-type"] == "response" else b"")
    assert reader.lookup(warc.key_text("http://nowhere/", 1)) is None and reader.lookup("") is None and reader.lookup("~") is None
    assert warc.read_archives(*warc.write_archives(table.limit(0))).count() == 0


def test_line_dedup(spark):
    rng = random.Random(10)
    pages = [(i, f"https://{'hot' if i % 3 else 'cold'}.org/{i}", f"<html><script>var x='<p>';</script><nav>menu</nav><p>{rng.random()}</p><p>own {i % 9}</p>\n<footer> foot </footer></html>") for i in range(80)]
    pages += [(100, None, None), (101, "odd", ""), (102, "https://one.org/", "<p>menu</p>"), pages[3]]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("often", F.lit(2))

    def brute():
        seen, total, lines = {}, {}, []
        for i, u, h in pages:
            found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", u or "")
            host = found[1].lower() if found else ""
            text = re.sub(line_dedup.HIDDEN, "\n", h or "")
            own = [x.strip(" \t\r") for x in re.split(line_dedup.BREAK, text)]
            own = [x for x in own if x]
            total[host] = total.get(host, 0) + 1
            for x in set(own):
                seen[host, x] = seen.get((host, x), 0) + 1
            lines.append((i, host, own))
        for i, host, own in lines:
            stay = [x for x in own if not (seen[host, x] >= 3 and seen[host, x] > 0.3 * total[host])]
            yield str((i, host, len(own), len(own) - len(stay), "\n".join(stay)))

    expected = sorted(brute())
    assert sorted(str(tuple(r)) for r in line_dedup.drop_boilerplate(table).collect()) == expected
    small, line_dedup.SMALL = line_dedup.SMALL, 0
    try:
        assert sorted(str(tuple(r)) for r in line_dedup.drop_boilerplate(table).collect()) == expected
    finally:
        line_dedup.SMALL = small
    assert line_dedup.drop_boilerplate(table.limit(0)).count() == 0


def test_re_pair_round_trip():
    rng = np.random.default_rng(11)
    for terminals, high in ((300, 300), (70_000, 70_000), (5, 3)):
        lengths = rng.integers(0, 60, 200)
        ids = np.minimum(rng.zipf(1.3, lengths.sum()), high - 1).astype(np.uint32)
        ids[:200] = np.tile([1, 2], 100)
        ends = np.cumsum(lengths)
        doc_ids = [None if i % 50 == 0 else int(i) - 3 for i in range(200)]
        block = repair.Block(repair.pack(doc_ids, ids, ends, terminals))
        assert (block.all_ids() == ids).all() and block.doc_ids == doc_ids and len(block.symbols) < len(ids)
        for d in range(0, 200, 7):
            own = ids[ends[d] - lengths[d] : ends[d]]
            assert (block.ids(d) == own).all() and (block.ids(d, 3, 11) == own[3:11]).all()
    assert repair.Block(repair.pack([], np.zeros(0, np.uint32), np.zeros(0, np.int64), 10)).n_ids == 0
    with pytest.raises(ValueError):
        repair.Block(repair.pack([1], ids[:5], np.array([5]), 5) + b"x")


def test_re_pair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(12)
    passage = rng.integers(0, 40_000, 64)
    parts = [x for _ in range(60) for x in (rng.integers(0, 40_000, 50), passage)] + [np.minimum(rng.zipf(1.1, 200_000), 39_999), np.full(999, 7)]
    ids, ends = np.concatenate(parts).astype(np.uint32), np.cumsum([len(p) for p in parts])
    for terminals in (40_000, 70_000):
        seq, stops, rules = repair.compress(ids, ends, terminals)
        assert max(repair.expansions(rules, terminals)) >= 64 and len(rules) < 65536 - 40_000
        counts = {}
        for a, b in zip([0, *stops.tolist()], stops.tolist()):
            before = None
            for pair in zip(seq[a:b].tolist(), seq[a + 1 : b].tolist()):
                before = None if pair == before else pair  # of a run of one symbol every second pair counts
                if before:
                    counts[pair] = counts.get(pair, 0) + 1
        assert max(counts.values()) < 8
        uses = np.bincount(np.r_[seq, rules.reshape(-1)], minlength=terminals + len(rules))[terminals:]
        assert len({tuple(r) for r in rules.tolist()}) == len(rules) and uses.min() > 0
        block = repair.Block(repair.pack(range(len(ends)), ids, ends, terminals))
        assert (block.all_ids() == ids).all() and (block.ids(1, 5, 60) == passage[5:60]).all()


def test_token_output(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    extra = [(5000, "<|endoftext|> I'll don't É.. x\x1cy 1st 'S ÀB,C;; ́z. İ. Straße! Σς.", "a")]
    many = [*rows, *extra]
    folder, blocks = token_output.write_blocks(docs(spark, many), path, block_ids=2000)
    got = token_output.read_blocks(folder, blocks).collect()
    library, at, expected = Tokenizer.from_file(path), 0, []
    for i, t, _ in sorted(many, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append(str((i, at, len(ids), zlib.crc32(ids.tobytes()))))
        at += len(ids)
    assert sorted(str(tuple(r)) for r in got) == sorted(expected)
    assert token_output.read_blocks(*token_output.write_blocks(docs(spark, rows).limit(0), path)).count() == 0


def test_encoder_keeps_each_pretoken_once():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    encoder, library = token_output.Encoder(path), Tokenizer.from_file(path)
    words = [f"{a}{b}{c}" for a in ("sta", "Thä", "re") for b in "aeiouöж" for c in ("nd", "ST", "'s", "'Ve")]
    texts = [f"{w}{x} ({w}){x}\t{w.upper()}{x}{w}12" for w in words for x in (".", ",", "!?", ":")]
    texts += ["", None, " ", "''s 're's 'l 'lls l'l '\x85s'\xa0t\u2028'd", "a'", "'", "É E\u0301'S x\x1cY <|endoftext|>'s <|ENDOFTEXT|> <| ½²3 İS'M", "\u4e2d'S A\u4e2dB '\u4e2d"]
    ids, counts = encoder.encode(pa.array(texts), 2)
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2]
    assert len(encoder.known) < 100  # of 350 chunks
    alone = [x for t in texts for x in encoder.encode(pa.array([t], pa.string()), 7)[0].tolist()]
    assert alone == [7 if last else i for i, last in zip(ids.tolist(), np.isin(np.arange(len(ids)), np.cumsum(counts) - 1))]


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    sf_dir = "/root/testdata/sf0.001"
    at = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for (name, stage), before in zip(corpus_pipeline.STAGES[:4], (None,) * 4):
        out = stage(spark, at, sf_dir)
        assert out.columns == at.columns, name
        if name != "mixing":
            assert out.count() <= at.count() and out.exceptAll(at).count() == 0
        at = out
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_spread_join(spark):
    keys = [1] * 4000 + [2] * 3000 + list(range(10, 900)) + [5]
    data = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k long").repartition(4)
    groups = spark.createDataFrame([(k, keys.count(k), f"v{k}", "x" * (k == 2)) for k in sorted({*keys} - {5})], "k long, n long, v string, long string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for small in (None, F.col("long") == ""):
            out = spread_join(data, groups, "k", len(keys), F.col("id"), small)
            assert sorted((r.id, r.k, r.v) for r in out.collect()) == [(i, k, None if k == 5 else f"v{k}") for i, k in enumerate(keys)]
            assert "hashpartitioning(k" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "_salt" in plan.split("hashpartitioning(k")[1].split(")")[0]
        assert spread_join(data.limit(0), groups.limit(0), "k", 0, F.col("id")).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
