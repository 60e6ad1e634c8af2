"""Queries over the driver's tables, one or more for each operator, with SQL that computes the same."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from dataclasses import astuple, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sql import register
from ..functions.tokens import BASE, SPECIAL, pair_key_column
from ..operators import packing
from ..operators.codec import PART_BYTES, bound_documents, decode_join, decoder, encode_distinct, encode_native, encoder, evidence, unbound_documents
from ..operators.presegment import accepted, lines, lossless, pieces, segments, special_spans, statistics
from ..operators.stats import family_weight, opportunity, pair_counts, symbol_words, top_pairs, word_counts
from ..operators.tokenizer import Tokenizer, merge_faults
from ..operators.train import Merge, TrainConfig, train_collected, train_rounds, train_with_stats
from ..operators.written import remove, written
from ..sources import artifacts, publish
from ..sources.manifest import ALLOW, FAMILIES, FIELDS, SINGLE, SINGLE_LABEL, SKIP, TIERS, coverage, difference, faults, scan, summary, verified
from .runs import FILES, Source, compare_runs, run_pipeline, run_tree, tree_digest

LANG_WEIGHTS = {"en": 5000, "de": 3000, "fr": 4000, "es": 4000}
N_MERGES = 10
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("text",)))


ALIAS = SPECIAL.alternation()
#: Texts with aliases, alias-only lines and carriage returns, of which the tables have none; the same words in Spark and in SQL.
PLANTED = """CASE doc_id % 6 WHEN 0 THEN '<KAREEM> ' || text WHEN 1 THEN '<AI><PHIL>' || chr(10) || text WHEN 2 THEN text || '[[ANCHOR]]x[[/ANCHOR]]'
  WHEN 3 THEN '<ai>' || text || chr(10) || '<KAREEM></KAREEM>' || chr(13) WHEN 4 THEN replace(text, chr(10), chr(13) || chr(10)) || chr(13) || chr(13) ELSE text END"""


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "doc_id", "text").filter("text is not null").select("doc_id", F.expr(PLANTED).alias("text"))


SQL_LINES = r"""
raws AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
lines AS (SELECT *, regexp_replace(raw, '\r\z', '') AS line FROM raws),
kept AS (SELECT * FROM lines WHERE line <> '' AND NOT regexp_full_match(line, '(?:@ALIAS@)+')),
segs AS (SELECT doc_id, lang, source, line_no, unnest(l) AS segment, generate_subscripts(l, 1) - 1 AS seg_no
  FROM (SELECT *, regexp_extract_all(line, '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+') AS l FROM kept))""".replace("@ALIAS@", ALIAS)
SQL_PLANTED = SQL_LINES.replace("FROM documents WHERE text IS NOT NULL", f"FROM (SELECT doc_id, lang, source, {PLANTED} AS text FROM documents WHERE text IS NOT NULL)")
SQL_SYM = "array_to_string(list_transform(range(1, octet_length(encode(segment)) + 1), lambda k: chr(276 + CAST('0x' || substr(hex(encode(segment)), CAST(2 * k - 1 AS INTEGER), 2) AS INTEGER))), '')"
SQL_TRAIN = """
words AS (SELECT @SYM@ AS w, f FROM (SELECT segment, CAST(sum(@WEIGHT@) AS BIGINT) AS f FROM segs GROUP BY segment)),
t(i, w, f, p, c) AS (
  SELECT 0, w, f, '', CAST(0 AS BIGINT) FROM words
  UNION ALL
  SELECT i + 1, replace(w, b.p, chr(532 + i)), f, b.p, b.c
  FROM t, (SELECT p, CAST(sum(f) AS BIGINT) AS c FROM (SELECT f, unnest(list_transform(range(1, length(w)), lambda j: substr(w, CAST(j AS INTEGER), 2))) AS p FROM t) GROUP BY p ORDER BY c DESC, p LIMIT 1) b
  WHERE i < 10),
merges AS (SELECT DISTINCT i - 1 AS ordinal, ord(p[1]) - 256 AS a, ord(p[2]) - 256 AS b, 275 + i AS merged, c AS weighted_count, p FROM t WHERE i > 0)""".replace("@SYM@", SQL_SYM)
SQL_WEIGHT = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANG_WEIGHTS.items()) + " ELSE 1000 END"
SQL_MERGES = SQL_LINES + "," + SQL_TRAIN.replace("@WEIGHT@", "1000")
SQL_PIECES = SQL_MERGES + r""",
pieces AS (SELECT doc_id, lang, unnest(l) AS segment, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, lang, regexp_extract_all(text, '\n|[\t\x0B\f ]*[^ \t\n\x0B\f]+|[\t\x0B\f ]+') AS l FROM documents)),
uniq AS (SELECT segment, @SYM@ AS w FROM (SELECT DISTINCT segment FROM pieces)),
ordered AS (SELECT list({'p': p, 'm': chr(532 + ordinal)} ORDER BY ordinal) AS l FROM merges),
coded AS (SELECT segment, list_reduce(list_prepend(w, list_transform(l, lambda r: r.p || r.m)), lambda s, r: replace(s, r[1:2], r[3])) AS s FROM uniq, ordered),
joined AS (SELECT doc_id, string_agg(s, '' ORDER BY pos) AS s FROM pieces JOIN coded USING (segment) GROUP BY doc_id),
tokens AS (SELECT d.doc_id, d.lang, coalesce(j.s, '') AS s FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id WHERE d.text IS NOT NULL)""".replace("@SYM@", SQL_SYM)


def _words(spark, sf_dir, weighted: bool = False) -> DataFrame:
    d = docs(spark, sf_dir, "text", "lang")
    return symbol_words(word_counts(d, weight=family_weight(F.col("lang"), LANG_WEIGHTS, 1000) if weighted else 1000))


def _merge_rows(spark, merges: list[Merge]) -> DataFrame:
    return spark.createDataFrame([(i, m.a, m.b, m.merged, m.count) for i, m in enumerate(merges)], "ordinal int, a int, b int, merged int, weighted_count long")


_trained: dict[tuple[str, str], Tokenizer] = {}


def _tokenizer(spark, sf_dir) -> Tokenizer:
    """Trained once a session and folder; queries that encode share it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _trained:
        _trained[key] = Tokenizer.from_merges([(m.a, m.b) for m in train_rounds(_words(spark, sf_dir), BASE + N_MERGES, 2000)])
    return _trained[key]


@query(f"WITH {SQL_PLANTED} SELECT count(*) AS logical_lines, count(*) FILTER (line = '') AS empty_lines, count(*) FILTER (line <> '') - (SELECT count(*) FROM kept) AS special_lines, (SELECT CAST(sum(octet_length(encode(line))) AS BIGINT) FROM kept) AS accepted_bytes FROM lines")
def line_stats(spark, sf_dir):
    s = statistics(planted(spark, sf_dir))
    return s.select("logical_lines", F.col("skipped_empty_lines").alias("empty_lines"), F.col("skipped_special_only_lines").alias("special_lines"), F.col("accepted_line_bytes").alias("accepted_bytes"))


@query(f"WITH {SQL_LINES} SELECT doc_id, line_no, seg_no, hex(encode(segment)) AS segment FROM segs")
def segment_explode(spark, sf_dir):
    return segments(docs(spark, sf_dir, "doc_id", "text"), "doc_id").select("doc_id", F.col("line_no").cast("long"), F.col("seg_no").cast("long"), F.hex(F.encode("segment", "ISO-8859-1")).alias("segment"))


@query(f"WITH {SQL_LINES} SELECT count(*) AS segments, CAST(sum(octet_length(encode(segment))) AS BIGINT) AS segment_bytes, CAST(sum(greatest(octet_length(encode(segment)) - 1, 0)) AS BIGINT) AS pair_opportunities FROM segs")
def segment_stats(spark, sf_dir):
    return statistics(docs(spark, sf_dir).filter("text is not null")).select(F.col("emitted_segments").alias("segments"), F.col("emitted_segment_bytes").alias("segment_bytes"), "pair_opportunities")


@query(f"WITH {SQL_LINES} SELECT hex(encode(segment)) AS segment, count(*) * 1000 AS freq FROM segs GROUP BY ALL")
def segment_freq(spark, sf_dir):
    return word_counts(docs(spark, sf_dir)).select(F.hex(F.encode("segment", "ISO-8859-1")).alias("segment"), "freq")


@query(f"WITH {SQL_LINES} SELECT hex(encode(segment)) AS segment, CAST(sum({SQL_WEIGHT}) AS BIGINT) AS freq FROM segs GROUP BY ALL")
def weighted_segment_freq(spark, sf_dir):
    return word_counts(docs(spark, sf_dir, "text", "lang"), weight=family_weight(F.col("lang"), LANG_WEIGHTS, 1000)).select(F.hex(F.encode("segment", "ISO-8859-1")).alias("segment"), "freq")


@query(f"WITH {SQL_LINES} SELECT hex(encode(segment)) AS segment, count(*) AS n FROM segs GROUP BY ALL ORDER BY n DESC, segment LIMIT 20")
def top_segments(spark, sf_dir):
    counted = word_counts(docs(spark, sf_dir), weight=1).select(F.hex(F.encode("segment", "ISO-8859-1")).alias("segment"), F.col("freq").alias("n"))
    return counted.orderBy(F.desc("n"), "segment").limit(20)


@query(f"WITH {SQL_LINES} SELECT lang, CAST(sum(greatest(octet_length(encode(segment)) - 1, 0)) AS BIGINT) AS opportunities, count(*) AS segments FROM segs GROUP BY lang")
def family_opportunity(spark, sf_dir):
    return opportunity(docs(spark, sf_dir, "text", "lang"), "lang")


@query(f"WITH {SQL_LINES} SELECT lang, CAST(sum(greatest(octet_length(encode(segment)) - 1, 0)) AS BIGINT) AS opportunities, count(*) AS segments FROM segs GROUP BY ROLLUP (lang)")
def family_rollup(spark, sf_dir):
    return opportunity(docs(spark, sf_dir, "text", "lang"), "lang", rollup=True)


SQL_PAIRS = f"WITH {SQL_LINES}, w AS (SELECT {SQL_SYM} AS w, f FROM (SELECT segment, count(*) * 1000 AS f FROM segs GROUP BY segment)), p AS (SELECT f, unnest(list_transform(range(1, length(w)), lambda j: substr(w, CAST(j AS INTEGER), 2))) AS p FROM w) SELECT ord(p[1]) - 256 AS a, ord(p[2]) - 256 AS b, CAST(sum(f) AS BIGINT) AS n FROM p GROUP BY p"


def _pair_rows(counts: DataFrame) -> DataFrame:
    return counts.select((F.ascii("pair") - 256).alias("a"), (F.ascii(F.substring("pair", 2, 1)) - 256).alias("b"), "n")


@query(SQL_PAIRS)
def initial_pair_counts(spark, sf_dir):
    return _pair_rows(pair_counts(_words(spark, sf_dir)))


@query(SQL_PAIRS + " ORDER BY n DESC, p LIMIT 1")
def best_pair(spark, sf_dir):
    return _pair_rows(top_pairs(pair_counts(_words(spark, sf_dir))))


@query("WITH RECURSIVE " + SQL_MERGES + " SELECT ordinal, a, b, merged, weighted_count FROM merges")
def train_10_merges(spark, sf_dir):
    return _merge_rows(spark, train_rounds(_words(spark, sf_dir), BASE + N_MERGES, 2000))


@query("WITH RECURSIVE " + SQL_LINES + "," + SQL_TRAIN.replace("@WEIGHT@", SQL_WEIGHT) + " SELECT ordinal, a, b, merged, weighted_count FROM merges")
def train_weighted_10(spark, sf_dir):
    return _merge_rows(spark, train_rounds(_words(spark, sf_dir, True), BASE + N_MERGES, 2000))


@query("WITH RECURSIVE " + SQL_MERGES + " SELECT ordinal, a, b, merged, weighted_count FROM merges")
def train_collect_10(spark, sf_dir):
    kept, path = written(_words(spark, sf_dir), "words")
    merges = train_collected(kept, BASE + N_MERGES, 2000)
    remove(spark, path)
    return _merge_rows(spark, merges)


@query("SELECT CAST(b AS INTEGER) AS id, printf('%02X', CAST(b - 20 AS INTEGER)) AS bytes FROM range(20, 276) t(b)")
def vocab_bytes(spark, sf_dir):
    return SPECIAL.vocabulary(spark).filter("kind = 'byte'").select("id", F.hex("bytes").alias("bytes"))


SQL_SPECIALS = "(VALUES " + ", ".join(f"({i}, '{t.encode().hex().upper()}')" for i, t in enumerate(SPECIAL.canonical)) + ") AS s(id, bytes)"
#: A learned token is undone from the last merge to the first, which leaves its bytes' symbols.
SQL_VOCAB = f""",
undo AS (SELECT list({{'p': p, 'm': chr(532 + ordinal)}} ORDER BY ordinal DESC) AS l FROM merges),
learned AS (SELECT merged AS id, list_reduce(list_prepend(chr(532 + ordinal), list_transform(l, lambda r: r.m || r.p)), lambda s, r: replace(s, r[1:1], r[2:3])) AS s FROM merges, undo),
vocab AS (SELECT id, bytes, 'special' AS kind FROM {SQL_SPECIALS} UNION ALL SELECT CAST(b AS INTEGER), printf('%02X', CAST(b - 20 AS INTEGER)), 'byte' FROM range(20, 276) t(b)
  UNION ALL SELECT CAST(id AS INTEGER), array_to_string(list_transform(list_filter(string_split(s, ''), lambda c: c <> ''), lambda c: printf('%02X', ord(c) - 276)), ''), 'learned' FROM learned)"""


@query("WITH RECURSIVE " + SQL_MERGES + SQL_VOCAB + " SELECT id, bytes, kind FROM vocab")
def vocab_after_10(spark, sf_dir):
    return _tokenizer(spark, sf_dir).vocab_table(spark).select("id", F.hex("bytes").alias("bytes"), "kind")


def _published(spark, sf_dir) -> tuple[dict, Tokenizer, dict[str, bytes]]:
    """The trained tokenizer published as a package and loaded again: manifest, tokenizer, files."""
    folder = os.path.join(tempfile.mkdtemp(prefix="pairloom-"), "package")
    try:
        wire = publish.write_package(_tokenizer(spark, sf_dir), folder, publish.Context("run", "checkpoint", None, *["A" * 64] * 4, "a" * 40, "b" * 40, "C" * 64, "queries", "pyspark", "readback", "prefix", "spark"))
        loaded = publish.load_package(folder)
        files = {}
        for name in ("vocab.bin", "merges.bin"):
            with open(os.path.join(folder, name), "rb") as f:
                files[name] = f.read()
        return wire, loaded, files
    finally:
        shutil.rmtree(os.path.dirname(folder), ignore_errors=True)


@query("WITH RECURSIVE " + SQL_MERGES + SQL_VOCAB + " SELECT id, bytes FROM vocab")
def artifact_vocab(spark, sf_dir):
    data = spark.createDataFrame([(bytearray(_published(spark, sf_dir)[2]["vocab.bin"]),)], "content binary")
    return artifacts.records(data, "vocab").select("id", F.hex("bytes").alias("bytes"))


@query("WITH RECURSIVE " + SQL_MERGES + " SELECT CAST(ordinal AS INTEGER) AS ordinal, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(merged AS INTEGER) AS merged FROM merges")
def artifact_merges(spark, sf_dir):
    data = spark.createDataFrame([(bytearray(_published(spark, sf_dir)[2]["merges.bin"]),)], "content binary")
    return artifacts.records(data, "merges")


LE = lambda x: f"printf('%02X%02X%02X%02X', CAST({x} & 255 AS INTEGER), CAST(({x} >> 8) & 255 AS INTEGER), CAST(({x} >> 16) & 255 AS INTEGER), CAST(({x} >> 24) & 255 AS INTEGER))"
SQL_SEQUENCE = f"(SELECT upper(sha256(unhex(string_agg({LE('CAST(a AS BIGINT)')} || {LE('CAST(b AS BIGINT)')} || {LE('CAST(merged AS BIGINT)')}, '' ORDER BY ordinal)))) FROM merges)"
SQL_PAYLOAD = f"(SELECT upper(sha256(unhex(string_agg({LE('CAST(length(bytes) // 2 AS BIGINT)')} || bytes, '' ORDER BY id)))) FROM vocab)"


@query(f"WITH RECURSIVE {SQL_MERGES}{SQL_VOCAB} SELECT count(*) AS vocab_records, CAST(sum(4 + length(bytes) // 2) AS BIGINT) AS vocab_payload_bytes, {SQL_PAYLOAD} AS vocab_payload_sha256, CAST(max(length(bytes) // 2) AS BIGINT) AS max_token_bytes, (SELECT count(*) FROM merges) AS merge_records, (SELECT 12 * count(*) FROM merges) AS merge_payload_bytes, {SQL_SEQUENCE} AS sequence_sha256 FROM vocab")
def artifact_measure(spark, sf_dir):
    wire, tokenizer, _ = _published(spark, sf_dir)
    got, (vocab, merges) = publish.measure(tokenizer), wire["artifacts"]
    assert (got["vocab_payload_sha256"], got["sequence_sha256"], got["merge_payload_bytes"]) == (vocab["payload_sha256"], merges["payload_sha256"], merges["payload_bytes"])
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in got.items()))


@query(f"WITH RECURSIVE {SQL_MERGES} SELECT {SQL_SEQUENCE} AS digest")
def sequence_digest(spark, sf_dir):
    register(spark, tokenizer := _tokenizer(spark, sf_dir))
    return tokenizer.merge_table(spark).selectExpr("bpe_sequence_digest(ordinal, a, b, merged) AS digest")


#: Where one byte of a merge file is changed, or where it is cut (-n) or lengthened (0), and the class that must be named.
MUTATIONS = {
    (0, "flip"): "BadMagic", (8, "flip"): "UnsupportedVersion", (12, "flip"): "WrongArtifactKind", (13, "flip"): "UnsupportedEndianness", (14, "flip"): "UnsupportedTokenIdWidth",
    (15, "flip"): "RecordWidthMismatch", (16, "flip"): "HeaderSizeMismatch", (18, "flip"): "UnknownFlags", (20, "flip"): "ReservedNotZero", (24, "flip"): "CountMismatch", (32, "flip"): "LengthMismatch",
    (40, "flip"): "BaseCountMismatch", (44, "flip"): "CountMismatch", (56, "flip"): "ReservedNotZero", (64, "flip"): "PayloadDigestMismatch", (96, "flip"): "SequenceDigestMismatch", (128, "flip"): "PayloadDigestMismatch",
    (0, "cut"): "Truncated", (127, "cut"): "Truncated", (200, "cut"): "Truncated", (0, "lengthen"): "TrailingData", (0, "none"): "ok",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"({at}, '{how}', '{kind}')" for (at, how), kind in MUTATIONS.items()) + ") AS v(place, change, kind)")
def artifact_faults(spark, sf_dir):
    data = _published(spark, sf_dir)[2]["merges.bin"]
    change = {"flip": lambda at: data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :], "cut": lambda at: data[:at], "lengthen": lambda at: data + b"x", "none": lambda at: data}
    rows = [(at, how, bytearray(change[how](at))) for at, how in MUTATIONS]
    return spark.createDataFrame(rows, "place int, change string, content binary").select("place", "change", artifacts.fault_of(F.col("content"), "merges").alias("kind"))


@query(f"WITH {SQL_PLANTED} SELECT (SELECT count(*) FROM kept) AS loaded_sequences, (SELECT count(*) FROM lines) - (SELECT count(*) FROM kept) AS skipped_lines, (SELECT CAST(sum(octet_length(encode(line))) AS BIGINT) FROM kept) AS loaded_tokens, (SELECT count(DISTINCT segment) FROM segs) AS unique_words, CAST(10 AS BIGINT) AS learned_merges, CAST(286 AS BIGINT) AS final_vocab")
def training_stats(spark, sf_dir):
    _, _, stats = train_with_stats(planted(spark, sf_dir), TrainConfig(BASE + N_MERGES))
    return spark.createDataFrame([astuple(stats)], ", ".join(f"{f.name} long" for f in fields(stats)))


@query("WITH RECURSIVE " + SQL_PIECES + " SELECT doc_id, length(s) AS n_tokens FROM tokens")
def encode_token_counts(spark, sf_dir):
    encode = encoder(spark, _tokenizer(spark, sf_dir))
    return docs(spark, sf_dir, "doc_id", "text").filter("text is not null").select("doc_id", F.size(encode(F.col("text"))).cast("long").alias("n_tokens"))


@query("WITH RECURSIVE " + SQL_PIECES + " SELECT ord(c) - 256 AS id, count(*) AS n FROM (SELECT unnest(string_split(s, '')) AS c FROM tokens) WHERE c <> '' GROUP BY c")
def encode_token_freq(spark, sf_dir):
    encode = encoder(spark, _tokenizer(spark, sf_dir))
    return docs(spark, sf_dir).select(F.explode(encode(F.col("text"))).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE " + SQL_PIECES + " SELECT doc_id, array_to_string(list_transform(list_filter(string_split(s, ''), lambda c: c <> ''), lambda c: ord(c) - 256), ' ') AS ids FROM tokens")
def encode_ids(spark, sf_dir):
    tokenizer = _tokenizer(spark, sf_dir)
    return docs(spark, sf_dir, "doc_id", "text").filter("text is not null").select("doc_id", F.array_join(encode_native(F.col("text"), tokenizer).cast("array<string>"), " ").alias("ids"))


@query("WITH RECURSIVE " + SQL_PIECES + " SELECT doc_id, array_to_string(list_transform(list_filter(string_split(s, ''), lambda c: c <> ''), lambda c: ord(c) - 256), ' ') AS ids FROM tokens")
def encode_distinct_ids(spark, sf_dir):
    encoded = encode_distinct(docs(spark, sf_dir, "doc_id", "text").filter("text is not null"), _tokenizer(spark, sf_dir), "doc_id")
    return encoded.select("doc_id", F.array_join(F.col("token_ids").cast("array<string>"), " ").alias("ids"))


@query("SELECT doc_id, text, octet_length(encode(text)) AS decoded_bytes FROM documents WHERE text IS NOT NULL")
def decode_roundtrip(spark, sf_dir):
    tokenizer = _tokenizer(spark, sf_dir)
    encoded = docs(spark, sf_dir, "doc_id", "text").filter("text is not null").select("doc_id", encoder(spark, tokenizer)(F.col("text")).alias("token_ids"))
    decoded = encoded.select("doc_id", decoder(spark, tokenizer)("token_ids").alias("d"))
    return decoded.select("doc_id", F.decode("d", "UTF-8").alias("text"), F.octet_length("d").cast("long").alias("decoded_bytes"))


@query("SELECT item_id, text FROM benchmark WHERE text IS NOT NULL")
def decode_by_join(spark, sf_dir):
    tokenizer = _tokenizer(spark, sf_dir)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("text is not null")
    encoded = items.select("item_id", encoder(spark, tokenizer)(F.col("text")).alias("token_ids"))
    return decode_join(encoded, tokenizer, "item_id").select("item_id", F.decode("decoded", "UTF-8").alias("text"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def decode_documents_by_join(spark, sf_dir):
    tokenizer = _tokenizer(spark, sf_dir)
    encoded = docs(spark, sf_dir, "doc_id", "text").filter("text is not null").select("doc_id", encoder(spark, tokenizer, PART_BYTES)(F.col("text")).alias("token_ids"))
    return decode_join(encoded, tokenizer, "doc_id").select("doc_id", F.decode("decoded", "UTF-8").alias("text"))


@query("SELECT doc_id, octet_length(encode(text)) AS decoded_bytes, upper(sha256(text)) AS decoded_sha256 FROM documents WHERE text IS NOT NULL")
def doc_evidence(spark, sf_dir):
    tokenizer = _tokenizer(spark, sf_dir)
    d = docs(spark, sf_dir, "doc_id", "text").filter("text is not null")
    decoded = d.select("doc_id", decoder(spark, tokenizer)(encoder(spark, tokenizer)(F.col("text"))).alias("d"))
    size, digest = evidence(F.col("d"))
    return decoded.select("doc_id", size.alias("decoded_bytes"), digest.alias("decoded_sha256"))


SQL_BOUND = """,
bound AS (SELECT d.doc_id, '{"schema":"pairloom_encoded_tokens_v1","token_id_width":"u32","tokenizer":{"vocab_size":286,"merge_count":10,"sequence_sha256":"' || @SEQUENCE@ || '"},"decoded_bytes":' || octet_length(encode(d.text))
  || ',"decoded_sha256":"' || upper(sha256(d.text)) || '","token_count":' || length(t.s) || ',"token_ids":[' || array_to_string(list_transform(list_filter(string_split(t.s, ''), lambda c: c <> ''), lambda c: ord(c) - 256), ',') || ']}' || chr(10) AS line
  FROM documents d JOIN tokens t ON d.doc_id = t.doc_id)""".replace("@SEQUENCE@", SQL_SEQUENCE)


@query("WITH RECURSIVE " + SQL_PIECES + SQL_BOUND + " SELECT doc_id, line FROM bound")
def bound_lines(spark, sf_dir):
    return bound_documents(docs(spark, sf_dir, "doc_id", "text").filter("text is not null"), _tokenizer(spark, sf_dir), "doc_id")


@query("""SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN 'TokenIdWidthMismatch' WHEN 2 THEN 'SchemaMismatch' WHEN 3 THEN 'TokenCountMismatch' WHEN 4 THEN 'TokenizerBindingMismatch' WHEN 5 THEN 'DecodedLengthMismatch'
  WHEN 6 THEN 'DecodedDigestMismatch' WHEN 7 THEN 'Json' WHEN 8 THEN 'Json' END AS fault, CASE WHEN doc_id % 9 = 0 THEN text END AS text FROM documents WHERE text IS NOT NULL""")
def bound_faults(spark, sf_dir):
    """Bound lines, most of them changed: width, schema, count, tokenizer, length, digest, form, another field."""
    tokenizer = _tokenizer(spark, sf_dir)
    line, at = F.col("line"), F.col("doc_id") % 9
    changes = (
        ('"u32"', '"u16"'), ("_v1", "_v2"), ('"token_count":', '"token_count":9'), ('"vocab_size":286', '"vocab_size":287'), ('"decoded_bytes":', '"decoded_bytes":9'),
        ('"decoded_sha256":"', '"decoded_sha256":"0'), ('"token_ids":[', '"token_ids": ['), ('{"schema"', '{"z":1,"schema"'),
    )
    changed = line
    for i, (old, new) in enumerate(changes, 1):
        changed = F.when(at == i, F.replace(line, F.lit(old), F.lit(new))).otherwise(changed)
    bound = bound_documents(docs(spark, sf_dir, "doc_id", "text").filter("text is not null"), tokenizer, "doc_id")
    return unbound_documents(bound.withColumn("line", changed), tokenizer, "doc_id").select("doc_id", "fault", F.decode("decoded", "UTF-8").alias("text"))


@query("WITH RECURSIVE " + SQL_PIECES + " SELECT t.lang, CAST(sum(octet_length(encode(d.text))) AS BIGINT) AS bytes, CAST(sum(length(s)) AS BIGINT) AS tokens FROM tokens t JOIN documents d USING (doc_id) GROUP BY t.lang")
def compression_by_lang(spark, sf_dir):
    encode = encoder(spark, _tokenizer(spark, sf_dir))
    d = docs(spark, sf_dir, "text", "lang").filter("text is not null").select("lang", F.octet_length("text").alias("b"), F.size(encode(F.col("text"))).alias("n"))
    return d.groupBy("lang").agg(F.sum("b").cast("long").alias("bytes"), F.sum("n").cast("long").alias("tokens"))


@query(f"SELECT doc_id, alias, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({PLANTED}, '{ALIAS}')) AS alias FROM documents WHERE text IS NOT NULL) GROUP BY ALL")
def alias_match(spark, sf_dir):
    spans = planted(spark, sf_dir).select("doc_id", F.explode(pieces(F.col("text"))).alias("piece")).select("doc_id", F.explode(special_spans(F.col("piece"))).alias("alias"))
    return spans.join(F.broadcast(SPECIAL.alias_table(spark)), "alias").groupBy("doc_id", "alias").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_PLANTED} SELECT doc_id, line_no, line FROM lines WHERE regexp_full_match(line, '(?:{ALIAS})+')")
def special_only_lines(spark, sf_dir):
    found = lines(planted(spark, sf_dir), "doc_id")
    return found.filter((F.col("line") != "") & ~accepted(F.col("line"))).select("doc_id", F.col("line_no").cast("long"), "line")


@query(rf"""
WITH d AS (SELECT doc_id, string_split({PLANTED}, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, len(l) AS n, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM d),
b AS (SELECT *, ends_with(raw, chr(13)) AS cr, CASE WHEN ends_with(raw, chr(13)) THEN left(raw, length(raw) - 1) ELSE raw END AS body FROM r),
p AS (SELECT doc_id, i, list_concat(list_concat(list_transform(regexp_extract_all(body, '[\t\x0B\f\r ]*[^ \t\n\x0B\f\r]+|[\t\x0B\f\r ]+'), lambda x: 'm' || x),
  CASE WHEN cr THEN ['l' || chr(13)] ELSE [] END), CASE WHEN i < n THEN ['l' || chr(10)] ELSE [] END) AS l FROM b),
e AS (SELECT doc_id, i, unnest(l) AS x, generate_subscripts(l, 1) AS j FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS pos, hex(encode(substr(x, 2))) AS piece, CASE WHEN x[1] = 'l' THEN 'literal' ELSE 'mergeable' END AS kind FROM e""")
def lossless_pieces(spark, sf_dir):
    found = lossless(planted(spark, sf_dir), "doc_id")
    return found.select("doc_id", F.col("pos").cast("long"), F.hex(F.encode("piece", "ISO-8859-1")).alias("piece"), "kind")


@query("SELECT l_linenumber AS a, l_suppkey AS b, (CAST(l_linenumber AS BIGINT) << 32) | CAST(l_suppkey AS BIGINT) AS key FROM lineitem")
def pair_pack(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.col("l_linenumber").alias("a"), F.col("l_suppkey").alias("b"), pair_key_column(F.col("l_linenumber"), F.col("l_suppkey")).alias("key"))


#: The most frequent pairs as merges, some with faults: another id, an operand to come, the pair before again, other bytes.
SQL_PLANT = """SELECT i AS ordinal, CASE WHEN i % 13 = 5 THEN 281 + i WHEN i % 17 = 7 THEN before_a ELSE a END AS a, CASE WHEN i % 17 = 7 AND i % 13 <> 5 THEN before_b ELSE b END AS b,
  CASE WHEN i % 11 = 3 THEN 1276 + i ELSE 276 + i END AS merged, CASE WHEN i % 19 = 9 THEN 'FF' ELSE hex_a || hex_b END AS bytes FROM ranked"""


@query(SQL_PAIRS.replace("SELECT ord(p[1])", ", c AS (SELECT ord(p[1])", 1).replace("GROUP BY p", "GROUP BY p)") + f""",
ranked AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, a, b) - 1 AS INTEGER) AS i, a, b, lag(a, 1, 20) OVER (ORDER BY n DESC, a, b) AS before_a, lag(b, 1, 20) OVER (ORDER BY n DESC, a, b) AS before_b,
  printf('%02X', CAST(a - 20 AS INTEGER)) AS hex_a, printf('%02X', CAST(b - 20 AS INTEGER)) AS hex_b FROM c QUALIFY i < 500),
m AS ({SQL_PLANT}),
v AS (SELECT CAST(x AS INTEGER) AS id, printf('%02X', CAST(x - 20 AS INTEGER)) AS bytes FROM range(20, 276) t(x) UNION ALL SELECT 276 + ordinal, bytes FROM m),
f AS (SELECT m.ordinal, CASE WHEN merged <> 276 + m.ordinal THEN 'NonSequentialMerge' WHEN a < 20 OR b < 20 OR a >= merged OR b >= merged THEN 'MergeOperandOutOfRange'
  WHEN row_number() OVER (PARTITION BY a, b ORDER BY m.ordinal) > 1 THEN 'DuplicateMerge' WHEN va.bytes || vb.bytes IS DISTINCT FROM vm.bytes THEN 'ReconstructionMismatch' END AS fault
  FROM m LEFT JOIN v va ON va.id = a LEFT JOIN v vb ON vb.id = b LEFT JOIN v vm ON vm.id = merged)
SELECT ordinal, fault FROM f WHERE fault IS NOT NULL""")
def merge_validate(spark, sf_dir):
    best = _pair_rows(top_pairs(pair_counts(_words(spark, sf_dir)), 500))
    order = Window.orderBy(F.desc("n"), "a", "b")  # 500 rows
    ranked = best.select((F.row_number().over(order) - 1).alias("i"), "a", "b", F.lag("a", 1, 20).over(order).alias("before_a"), F.lag("b", 1, 20).over(order).alias("before_b"), F.lpad(F.hex(F.col("a") - 20), 2, "0").alias("hex_a"), F.lpad(F.hex(F.col("b") - 20), 2, "0").alias("hex_b"))
    rows = ranked.selectExpr(*_plant())
    rows, _ = written(rows, "merges")
    vocab = SPECIAL.vocabulary(spark).select("id", "bytes").filter(f"id >= {20}").unionByName(rows.select((F.col("ordinal") + 276).alias("id"), F.unhex("bytes").alias("bytes")))
    return merge_faults(rows.select("ordinal", "a", "b", "merged"), vocab)


def _plant() -> list[str]:
    """The columns of SQL_PLANT, for Spark."""
    return [
        "i AS ordinal", "CASE WHEN i % 13 = 5 THEN 281 + i WHEN i % 17 = 7 THEN before_a ELSE a END AS a", "CASE WHEN i % 17 = 7 AND i % 13 <> 5 THEN before_b ELSE b END AS b",
        "CASE WHEN i % 11 = 3 THEN 1276 + i ELSE 276 + i END AS merged", "CASE WHEN i % 19 = 9 THEN 'FF' ELSE hex_a || hex_b END AS bytes",
    ]


FAMILY_OF = dict(zip(("en", "de", "fr", "es"), FAMILIES))


def _entries(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    family = F.create_map(*[F.lit(x) for kv in FAMILY_OF.items() for x in kv])[F.col("lang")]
    return d.select(F.lit("corpus").alias("root_id"), F.format_string("d/%09d.txt", "doc_id").alias("relative_path"), family.alias("family"), (F.col("source") != "src0").alias("enabled"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT 'corpus' AS root_id, printf('d/%09d.txt', doc_id) AS relative_path, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'corpus', printf('d/%09d.txt', doc_id), 'undeclared' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def manifest_diff(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.lit("corpus").alias("root_id"), F.format_string("d/%09d.txt", "doc_id").alias("relative_path"))
    return difference(_entries(spark, sf_dir), found)


@query("SELECT doc_id FROM (SELECT doc_id, source, lag(source) OVER (ORDER BY doc_id) AS before FROM documents) WHERE NOT (before < source)")
def manifest_order_check(spark, sf_dir):
    order = Window.partitionBy("part").orderBy("doc_id")  # parts of ids with the last row of the part before, so that no task sees all rows
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.floor(F.col("doc_id") / 10_000).alias("part"))
    ends = d.groupBy("part").agg(F.max_by("source", "doc_id").alias("end"))
    ends = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("end"))
    rows = d.withColumn("before", F.lag("source").over(order)).withColumn("n", F.row_number().over(order)).join(ends, "part")
    return rows.withColumn("before", F.when(F.col("n") == 1, F.col("end")).otherwise(F.col("before"))).filter("not (before < source)").select("doc_id")


@query("SELECT CASE lang WHEN 'en' THEN 'identity' WHEN 'de' THEN 'scripture' WHEN 'fr' THEN 'wikitext' WHEN 'es' THEN 'bookcorpus' END AS family, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents WHERE source <> 'src0' GROUP BY ALL")
def family_coverage(spark, sf_dir):
    return coverage(_entries(spark, sf_dir))


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, upper(sha256(text)) AS sha256, true AS utf8 FROM documents WHERE text IS NOT NULL")
def doc_digests(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text").filter("text is not null")
    return d.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.upper(F.sha2("text", 256)).alias("sha256"), F.is_valid_utf8("text").alias("utf8"))


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def dup_documents(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return d.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("SELECT sha256(string_agg(sha256(text) || '  ' || octet_length(encode(text)) || '  ' || printf('%09d', item_id) || chr(10), '' ORDER BY item_id)) AS digest FROM benchmark")
def run_tree_digest(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return tree_digest(rows.select(F.format_string("%09d", "item_id").alias("relative"), F.octet_length("text").cast("long").alias("length"), F.sha2("text", 256).alias("sha256")))


@query("WITH RECURSIVE " + SQL_PIECES + " SELECT doc_id, length(s) + 1 AS tokens, CAST(coalesce(sum(length(s) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM tokens")
def pack_offsets(spark, sf_dir):
    encode = encoder(spark, _tokenizer(spark, sf_dir))
    encoded, _ = written(docs(spark, sf_dir, "doc_id", "text").filter("text is not null").select("doc_id", encode(F.col("text")).alias("token_ids")), "encoded")
    return packing.offsets(encoded, "doc_id")


#: Windows of 256 ids; the last is padded, or goes if less than a quarter is filled.
SQL_WINDOWS = """,
stream AS (SELECT ord(c) - 256 AS id, row_number() OVER (ORDER BY doc_id, pos) - 1 AS place FROM (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, list_filter(string_split(s || chr(259), ''), lambda c: c <> '') AS l FROM @TOKENS@)) WHERE c <> ''),
windows AS (SELECT place // 256 AS window_no, list(id ORDER BY place) AS row FROM stream GROUP BY place // 256)
SELECT window_no, array_to_string(list_resize(row, 256, 0), ' ') AS ids FROM windows WHERE len(row) >= 64"""


@query("WITH RECURSIVE " + SQL_PIECES + SQL_WINDOWS.replace("@TOKENS@", "tokens"))
def pack_windows(spark, sf_dir):
    encode = encoder(spark, _tokenizer(spark, sf_dir))
    encoded, _ = written(docs(spark, sf_dir, "doc_id", "text").filter("text is not null").select("doc_id", encode(F.col("text")).alias("token_ids")), "encoded")
    return packing.pack(encoded, "doc_id").select("window_no", F.array_join(F.col("row").cast("array<string>"), " ").alias("ids"))


#: Languages in the order of their weights, each so many times over.
TIER_OF = {"es": 1, "de": 1, "fr": 2, "en": 3}
SQL_TIERS = "(SELECT row_number() OVER (ORDER BY tier, round, doc_id) AS doc_id, s FROM (SELECT doc_id, s, tier, unnest(range(n)) AS round FROM (SELECT *, CASE lang " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(TIER_OF)) + f" ELSE {len(TIER_OF)} END AS tier, CASE lang " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in TIER_OF.items()) + " ELSE 0 END AS n FROM tokens)))"


@query("WITH RECURSIVE " + SQL_PIECES + SQL_WINDOWS.replace("@TOKENS@", SQL_TIERS))
def pack_tiers(spark, sf_dir):
    encode = encoder(spark, _tokenizer(spark, sf_dir))
    d = docs(spark, sf_dir, "doc_id", "text", "lang").filter("text is not null")
    encoded, _ = written(d.select("doc_id", "lang", encode(F.col("text")).alias("token_ids")), "encoded")
    lookup = lambda values, default: F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("lang")], F.lit(default))
    rows, _ = written(packing.repeated(encoded, "doc_id", lookup(TIER_OF, 0), lookup({k: i for i, k in enumerate(TIER_OF)}, len(TIER_OF))), "tiers")
    return packing.pack(rows, "doc_id").select("window_no", F.array_join(F.col("row").cast("array<string>"), " ").alias("ids"))


@query(r"""
WITH e AS (SELECT doc_id, CAST(doc_id AS INTEGER) + CASE WHEN doc_id % 97 = 1 THEN 2 ELSE 1 END AS ordinal, @FAMILY@ AS family, CASE WHEN doc_id % 61 = 7 THEN 'bad id' ELSE 'corpus' END AS root_id,
  CASE WHEN doc_id % 89 = 1 THEN 'd/../x' WHEN doc_id % 83 = 2 THEN 'd/000000000.txt' WHEN doc_id % 59 = 3 THEN 'd//' || doc_id ELSE printf('d/%09d.txt', doc_id) END AS relative_path,
  CASE WHEN doc_id % 67 = 6 THEN -1 ELSE octet_length(encode(text)) END AS bytes, CASE WHEN doc_id % 73 = 4 THEN sha256(text) ELSE upper(sha256(text)) END AS sha256, CASE WHEN doc_id % 71 = 5 THEN 'latin1' ELSE 'utf8' END AS encoding_policy
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, row_number() OVER (ORDER BY ordinal, doc_id) AS n, lag(relative_path) OVER (ORDER BY ordinal, doc_id) AS before FROM e),
f AS (SELECT doc_id, CASE WHEN ordinal <> n THEN 'ordinal' WHEN family IS NULL OR family NOT IN ('identity', 'scripture', 'wikitext', 'bookcorpus') THEN 'family' WHEN NOT regexp_full_match(root_id, '[A-Za-z0-9._-]{1,128}') THEN 'root_id'
  WHEN NOT regexp_full_match(relative_path, '[^/\\:]+(?:/[^/\\:]+)*') OR regexp_matches(relative_path, '(?:^|/)\.{1,2}(?:/|$)') THEN 'relative_path' WHEN NOT (before IS NULL OR before < relative_path) THEN 'path_order'
  WHEN bytes < 0 THEN 'bytes' WHEN NOT regexp_full_match(sha256, '[0-9A-F]{64}') THEN 'sha256' WHEN encoding_policy NOT IN ('utf8', 'bytes') THEN 'encoding_policy' END AS fault FROM w)
SELECT doc_id, fault FROM f WHERE fault IS NOT NULL""".replace("@FAMILY@", "CASE WHEN doc_id % 79 = 3 THEN 'other' ELSE CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILY_OF.items()) + " END END"))
def manifest_faults(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text", "lang").filter("text is not null")
    family = F.create_map(*[F.lit(x) for kv in FAMILY_OF.items() for x in kv])[F.col("lang")]
    when = lambda n, k, value, other: F.when(F.col("doc_id") % n == k, value).otherwise(other)
    path = when(89, 1, F.lit("d/../x"), when(83, 2, F.lit("d/000000000.txt"), when(59, 3, F.concat(F.lit("d//"), F.col("doc_id").cast("string")), F.format_string("d/%09d.txt", "doc_id"))))
    digest = F.sha2("text", 256)
    entries = d.select(
        "doc_id", (F.col("doc_id").cast("int") + when(97, 1, F.lit(2), F.lit(1))).alias("ordinal"), when(79, 3, F.lit("other"), family).alias("family"), when(61, 7, F.lit("bad id"), F.lit("corpus")).alias("root_id"), path.alias("relative_path"),
        F.lit(True).alias("enabled"), when(67, 6, F.lit(-1), F.octet_length("text")).cast("long").alias("bytes"), when(73, 4, digest, F.upper(digest)).alias("sha256"), F.upper(F.sha2("text", 512)).alias("sha512"), when(71, 5, F.lit("latin1"), F.lit("utf8")).alias("encoding_policy"),
    )
    return faults(entries, "doc_id").select("doc_id", "fault")


#: Names of files as a corpus folder may hold them, one for each document in turn.
SCAN_NAMES = ("x_annotated.md", "Scripture of y.txt", "z.json", "wikitext/q.txt", "wikitext_extracted/q.txt", "plain.txt", "blu.txt", "Dylan_chat 1.md", "Dylan_chat_annotated.md", "Opus_node_09_the_dylan.md", "Iteration_3.TXT", "bookcorpus/a.txt", "bookcorpus_sampled.txt")
_any = lambda names: "(" + " OR ".join(f"contains(path, '{n}')" for n in names) + ")"
SQL_SCAN = f"""
WITH p AS (SELECT doc_id, 'r/' || source || '/' || [{', '.join(f"'{n}'" for n in SCAN_NAMES)}][CAST(1 + doc_id % {len(SCAN_NAMES)} AS INTEGER)] AS path, octet_length(encode(coalesce(text, ''))) AS bytes FROM documents WHERE source IS NOT NULL),
q AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM p WHERE regexp_matches(lower(path), '\\.(md|txt)$')),
t AS (SELECT doc_id, path, bytes, CASE WHEN ({_any(SKIP)} AND NOT {_any(ALLOW)}) OR (contains(name, 'Dylan_chat') AND NOT contains(name, '_annotated')) OR name = 'Opus_node_09_the_dylan.md' THEN NULL {' '.join(f"WHEN contains(path, '{n}') THEN '{t}'" for n, t in TIERS)} END AS tier FROM q)"""


def _scan_paths(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text", "source").filter("source is not null")
    name = F.element_at(F.array(*map(F.lit, SCAN_NAMES)), (F.col("doc_id") % len(SCAN_NAMES) + 1).cast("int"))
    return d.select("doc_id", F.concat(F.lit("r/"), F.col("source"), F.lit("/"), name).alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))


@query(SQL_SCAN + " SELECT doc_id, path, tier, CASE tier WHEN 'foundation' THEN 1000 WHEN 'scripture' THEN 3000 ELSE 5000 END AS weight FROM t WHERE tier IS NOT NULL")
def audit_scan(spark, sf_dir):
    return scan(_scan_paths(spark, sf_dir)).select("doc_id", "path", "tier", "weight")


@query(SQL_SCAN + " SELECT count(tier) AS total_files, count(*) - count(tier) AS skipped_files, CAST(coalesce(sum(bytes) FILTER (tier IS NOT NULL), 0) AS BIGINT) AS total_bytes, count(*) FILTER (tier = 'foundation') AS foundation, count(*) FILTER (tier = 'scripture') AS scripture, count(*) FILTER (tier = 'identity') AS identity FROM t")
def scan_summary(spark, sf_dir):
    return summary(scan(_scan_paths(spark, sf_dir), everything=True))


#: Files of the benchmark's items, of names that Spark's own listing passes over too, some changed after they were declared.
SQL_ITEM_FILES = "CASE item_id % 4 WHEN 0 THEN '.h' WHEN 1 THEN '_a' WHEN 2 THEN 'b[1]' ELSE 'c' END || printf('%06d', item_id) || '.txt'"


@query(f"SELECT {SQL_ITEM_FILES} AS relative_path, CASE WHEN item_id % 7 = 1 THEN 'HashMismatch' WHEN item_id % 7 = 2 THEN 'FileMetadataMismatch' WHEN item_id % 7 = 3 THEN 'Io' WHEN item_id % 7 = 4 THEN 'EncodingMismatch' END AS fault FROM benchmark WHERE text IS NOT NULL AND text <> ''")
def admission_faults(spark, sf_dir):
    """Reads of declared files, on a small table: the driver writes them as a corpus folder."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("text <> ''").select(F.expr(SQL_ITEM_FILES.replace("printf", "format_string")).alias("path"), "item_id", "text").orderBy("path").collect()
    root = tempfile.mkdtemp(prefix="pairloom-")
    try:
        entries = []
        for i, r in enumerate(items):
            declared = r.text.encode() + (b"\xff" if r.item_id % 7 == 4 else b"")
            found = {1: b"?" + declared[1:], 2: declared + b"?"}.get(r.item_id % 7, declared)
            if r.item_id % 7 != 3:
                with open(os.path.join(root, r.path), "wb") as f:
                    f.write(found)
            entries.append(dict(zip(FIELDS, (i + 1, "wikitext", "r", r.path, True, len(declared), hashlib.sha256(declared).hexdigest().upper(), hashlib.sha512(declared).hexdigest().upper(), "utf8"))))
        rows = verified(spark, entries, {"r": root}).select("relative_path", "fault").collect()  # a row a file
    finally:
        shutil.rmtree(root, ignore_errors=True)
    return spark.createDataFrame([tuple(r) for r in rows], "relative_path string, fault string")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', true)" for n in sorted(FILES)) + ") AS v(relative, equal)")
def run_comparison(spark, sf_dir):
    """Two runs over the benchmark's text as a single-family corpus, compared file by file."""
    text = "\n".join(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("text is not null").select("text").orderBy("item_id").collect()).encode()
    root = tempfile.mkdtemp(prefix="pairloom-")
    try:
        os.mkdir(os.path.join(root, "corpus"))
        with open(os.path.join(root, "corpus", "wikitext.txt"), "wb") as f:
            f.write(text)
        entry = dict(zip(FIELDS, (1, "wikitext", "r", "wikitext.txt", True, len(text), hashlib.sha256(text).hexdigest().upper(), hashlib.sha512(text).hexdigest().upper(), "utf8")))
        manifest = os.path.join(root, "manifest.json")
        with open(manifest, "wb") as f:
            f.write(publish.canonical({"schema": SINGLE, "label": SINGLE_LABEL, "entries": [entry]}))
        for name in ("a", "b"):
            run_pipeline(spark, manifest, {"r": os.path.join(root, "corpus")}, os.path.join(root, name), BASE + N_MERGES, Source("a" * 40, "b" * 40, "C" * 64), text[:1000])
        compare_runs(spark, os.path.join(root, "a"), os.path.join(root, "b"))
        left, right = ({r.relative: (r.length, r.sha256) for r in run_tree(spark, os.path.join(root, name)).collect()} for name in ("a", "b"))
    finally:
        shutil.rmtree(root, ignore_errors=True)
    return spark.createDataFrame([(n, left.get(n) == right.get(n)) for n in sorted({*left, *right})], "relative string, equal boolean")
