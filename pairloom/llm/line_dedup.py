"""Line deduplication by site-relative frequency (DataFrame functions only).

A page's lines are its visible text between tags and line feeds, trimmed, without scripts, styles and comments. Pages are
grouped by host; a line that stands on more than ``ratio`` of a host's pages, and on ``min_pages`` of them at least, is
boilerplate and goes. Counts are taken per (host, line hash) before the shuffle, each page counting once for a line. A
host's boilerplate is at most lines-per-page / ratio lines, so it is carried to the pages as one bounded list a host.

Lines are counted by two hashes (64 and 32 bits) together. Edge cases: a null or empty page has no lines and an empty text;
a page without a host (null or odd URL) belongs to the host ""; repeated rows are pages of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, spread_join, table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BREAK = r"<[^>]*>|\n"
RATIO, MIN_PAGES = 0.3, 3
SMALL, SALTS = 1_000_000, 64  # boilerplate lines of all hosts that are sent out whole (about 20 bytes each); else salts of a host


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, n_lines, n_dropped, text (lines that stay, by line feeds)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    lines = F.split(F.regexp_replace(html, HIDDEN, "\n"), BREAK, -1)
    lines = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")), lambda x: x != "")
    read = pages.select(F.col(id_col).alias("page_id"), F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1)).alias("host"), lines.alias("lines"))
    mark = lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"))
    marks = read.select("host", F.explode(F.array_distinct(F.transform("lines", mark))).alias("mark"))
    seen = marks.groupBy("host", "mark").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    hosts = pages.select(F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1)).alias("host")).groupBy("host").agg(F.count("*").alias("n"))
    hosts = hosts.select("host", "n", F.col("n").alias("pages"))
    often = spread_join(seen, hosts, "host", pages.count(), F.col("mark")).filter(F.col("n") > ratio * F.col("pages"))
    listed = often.groupBy(F.col("host").alias("_host")).agg(F.collect_list("mark").alias("often"))
    listed = keep(listed, "boilerplate")
    if (listed.agg(F.sum(F.size("often"))).first()[0] or 0) <= SMALL:
        out = read.join(F.broadcast(listed), F.col("host") == F.col("_host"), "left")
    else:  # a hot host's pages go to as many tasks as there are salts
        dealt = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = read.withColumn("_salt", F.pmod(F.xxhash64("page_id", "lines"), F.lit(SALTS)).cast("int"))
        out = salted.join(dealt, (F.col("host") == F.col("_host")) & (salted["_salt"] == dealt["_salt"]), "left")
    stay = F.when(F.col("often").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("often"), mark(x))))
    out = out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), stay.alias("stay"))
    return out.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("stay")).cast("long").alias("n_dropped"), F.array_join("stay", "\n").alias("text"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


OP9_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
    list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', chr(10), 'g'), '<[^>]*>|\n'),
      lambda x: regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM pages
), l AS (SELECT r, page_id, host, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM p),
c AS (SELECT host, line, count(DISTINCT r) AS n FROM l GROUP BY host, line),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (SELECT c.host, c.line FROM c JOIN h USING (host) WHERE n >= 3 AND n > 0.3 * pages),
k AS (SELECT l.r, string_agg(l.line, chr(10) ORDER BY i) AS text, count(*) AS n FROM l LEFT JOIN b ON l.host = b.host AND l.line = b.line WHERE b.line IS NULL GROUP BY l.r)
SELECT p.page_id, p.host, CAST(len(p.lines) AS BIGINT) AS n_lines, CAST(len(p.lines) - coalesce(k.n, 0) AS BIGINT) AS n_dropped, coalesce(k.text, '') AS text
FROM p LEFT JOIN k USING (r)
"""
