"""WARC output with a two-level capture index, and reading back through it.

Captures are range-partitioned and sorted by key (reversed host, then path, then capture number); each task writes one shard: an
archive of separately compressed records, and an index file. Index level one: entries (key, offset, length and the like) of
``block_entries`` captures in a row, compressed as a block; level two: a sparse directory of the blocks' first keys at
the end of the file. A lookup finds the shard by its first key, searches the directory, reads and searches one block, and
reads the record's bytes, all by range reads.

Captures with equal payloads of at least ``min_payload`` bytes: the one with the largest number is the response, the others
are revisits that name its key and hold no payload; what a revisit's payload is comes from a lookup of that key.

Edge cases: a null payload is empty; a null number is the smallest, and a group with null numbers only is all responses; a null
URL has the key of the empty URL; keys of over ``KEY_CHARS`` characters end in a digest instead, and a revisit of a URL of over
``URL_BYTES`` does not repeat it, so that what is known of a response is of bounded size; repeated rows of the largest number
are responses each; an empty table writes no shard and gives no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, keep, open_store, spread_join, table

TAIL = struct.Struct("<QQ4s")
MAGIC = b"CDX2"
KEY_CHARS, URL_BYTES, READ_TASKS = 2048, 8192, 100_000
_url = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/:?#]*)(:\d+)?(.*)$", re.S)


def url_key(url: Column) -> Column:
    """Reversed host, ``)``, and the rest of the URL in lower case: sites and their subdomains lie together."""
    url = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    rest = F.regexp_replace(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?[^/:?#]*(?::\d+)?", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.when(F.length(key) > KEY_CHARS, F.concat(F.substring(key, 1, KEY_CHARS), F.lit("~"), F.sha1(key.cast("binary")))).otherwise(key)


def sortable(number: Column) -> Column:
    """Longs as text that sorts as they do; nulls first."""
    return F.coalesce(F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit("-"))


def digest32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(url: str, number: int | None, kind: str, digest: str, refers_to: int | None, refers_url: str | None, refers_key: str | None, payload: bytes) -> bytes:
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{number}\n{url}\n{digest}")
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Capture-Number: {'' if number is None else number}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Number: {refers_to}", f"X-Refers-To-Key: {json.dumps(refers_key)}"]
        if refers_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {refers_url.replace(chr(13), '%0D').replace(chr(10), '%0A').replace(' ', '%20')}")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = head + (payload if kind == "response" else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of a decompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(headers["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than its header says")
    return headers, rest[:length].partition(b"\r\n\r\n")[2]


def _compress(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)  # one gzip member
    return packer.compress(data) + packer.flush()


class _Shard:
    """One task's archive and index, written under names of their own and then moved in place."""

    def __init__(self, store, root: str, number: int, block_entries: int):
        self.store, self.number, self.block_entries = store, number, block_entries
        self.names = [f"{root}/{number:06d}.warc.gz", f"{root}/{number:06d}.idx"]
        self.parts = [f"{n}.{uuid.uuid4().hex[:8]}.part" for n in self.names]
        self.archive, self.index = (store.open_output_stream(p) for p in self.parts)
        self.at = self.index_at = self.entries = 0
        self.block: list[list] = []
        self.directory: list[list] = []
        self.first: str | None = None

    def add(self, key: str, data: bytes) -> None:
        packed = _compress(data)
        self.archive.write(packed)
        self.block.append([key, self.at, len(packed)])
        self.at += len(packed)
        self.entries += 1
        self.first = key if self.first is None else self.first
        if len(self.block) >= self.block_entries:
            self._close_block()

    def _close_block(self) -> None:
        if self.block:
            packed = zlib.compress(json.dumps(self.block).encode("ascii"))
            self.directory.append([self.block[0][0], self.index_at, len(packed)])
            self.index.write(packed)
            self.index_at += len(packed)
            self.block = []

    def close(self) -> dict:
        self._close_block()
        packed = zlib.compress(json.dumps(self.directory).encode("ascii"))
        self.index.write(packed + TAIL.pack(self.index_at, len(packed), MAGIC))
        for f, part, name in zip((self.archive, self.index), self.parts, self.names):
            f.close()
            self.store.move(part, name)
        return {"shard": self.number, "first": self.first, "blocks": len(self.directory), "entries": self.entries}


class Reader:
    """Lookups in one folder of shards; firsts: (first key, shard) of each shard in key order."""

    def __init__(self, folder: str, firsts: list[tuple[str, int]]):
        self.store, self.root = open_store(folder)
        self.firsts = sorted(firsts)
        self.keys = [k for k, _ in self.firsts]
        self.open: dict[int, tuple] = {}
        self.blocks: dict[tuple[int, int], list] = {}

    def shard(self, number: int):
        if number not in self.open:
            if len(self.open) >= 4:
                self.open.pop(next(iter(self.open)))
            archive, index = (self.store.open_input_file(f"{self.root}/{number:06d}{x}") for x in (".warc.gz", ".idx"))
            size = index.size()
            at, n, magic = TAIL.unpack(index.read_at(TAIL.size, size - TAIL.size))
            if magic != MAGIC:
                raise ValueError("not a capture index")
            directory = json.loads(zlib.decompress(index.read_at(n, at)))
            self.open[number] = (archive, index, directory, [d[0] for d in directory])
        return self.open[number]

    def block(self, shard: int, number: int) -> list:
        if (shard, number) not in self.blocks:
            if len(self.blocks) >= 64:
                self.blocks.pop(next(iter(self.blocks)))
            _, index, directory, _ = self.shard(shard)
            _, at, n = directory[number]
            self.blocks[shard, number] = json.loads(zlib.decompress(index.read_at(n, at)))
        return self.blocks[shard, number]

    def read(self, shard: int, entry: list) -> tuple[dict[str, str], bytes]:
        return parse(zlib.decompress(self.shard(shard)[0].read_at(entry[2], entry[1]), 31))

    def lookup(self, key: str) -> tuple[dict[str, str], bytes] | None:
        """The first capture with this key, by two binary searches."""
        for at in range(max(0, bisect.bisect_left(self.keys, key) - 1), bisect.bisect_right(self.keys, key)):
            shard = self.firsts[at][1]
            keys = self.shard(shard)[3]
            for number in range(max(0, bisect.bisect_left(keys, key) - 1), bisect.bisect_right(keys, key)):
                entries = self.block(shard, number)
                i = bisect.bisect_left(entries, key, key=lambda e: e[0])
                if i < len(entries) and entries[i][0] == key:
                    return self.read(shard, entries[i])
        return None


_shards = "shard int, first string, blocks int, entries long"


def write_archives(pages: DataFrame, min_payload: int = 0, block_entries: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, DataFrame]:
    """Writes archives and indexes; returns their folder and the written table of shards (shard, first key, blocks, entries)."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("number"), F.col(url_col).alias("url"), html.alias("payload"), F.sha1(html).alias("sha1"), F.concat(url_key(F.col(url_col)), F.lit(" "), sortable(F.col(id_col))).alias("key"))
    same = rows.filter(F.octet_length("payload") >= min_payload).groupBy(F.col("sha1").alias("_sha1")).agg(F.max(F.struct("number", "key", F.when(F.octet_length("url") <= URL_BYTES, F.col("url")).alias("url"))).alias("first"), F.count("*").alias("n")).filter("n > 1 and first.number is not null")
    same = keep(same.select(F.col("_sha1").alias("sha1"), "n", "first"), "warc-payloads")
    rows = spread_join(rows, same, "sha1", pages.count(), F.col("number")).withColumn("revisit", F.col("first").isNotNull() & ~F.col("number").eqNullSafe(F.col("first.number")))
    rows = rows.select("key", "number", "url", "sha1", "revisit", F.when(F.col("revisit"), F.col("first.number")).alias("to"), F.when(F.col("revisit"), F.col("first.url")).alias("to_url"), F.when(F.col("revisit"), F.col("first.key")).alias("to_key"), F.when(~F.col("revisit"), F.col("payload")).alias("payload"))

    def write(batches):
        from pyspark import TaskContext

        shard = None
        for batch in batches:
            for row in (r for i in range(0, batch.num_rows, 256) for r in batch.slice(i, 256).to_pylist()):
                shard = shard or _Shard(open_store(folder)[0], root, TaskContext.get().partitionId(), block_entries)
                kind = "revisit" if row["revisit"] else "response"
                shard.add(row["key"], record(row["url"] or "", row["number"], kind, digest32(row["sha1"]), row["to"], row["to_url"], row["to_key"], row["payload"] or b""))
        if shard:
            yield pa.RecordBatch.from_pylist([shard.close()], pa.schema([("shard", pa.int32()), ("first", pa.string()), ("blocks", pa.int32()), ("entries", pa.int64())]))

    placed = rows.repartitionByRange("key", "sha1").sortWithinPartitions("key", "sha1")
    return folder, keep(placed.mapInArrow(write, _shards), "warc-shards")


def key_text(url: str | None, number: int | None) -> str:
    """The index key of a capture, as the DataFrame expressions above make it."""
    found = _url.match((url or "").lower())
    host, rest = (found[2], found[4]) if found else ("", (url or "").lower())
    key = f"{','.join(reversed(host.split('.')))}){rest}"
    if len(key) > KEY_CHARS:
        key = f"{key[:KEY_CHARS]}~{hashlib.sha1(key.encode('utf-8', 'surrogatepass')).hexdigest()}"
    return f"{key} " + ("-" if number is None else f"{(number + (1 << 63)):016X}")


def read_archives(folder: str, shards: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row a record: number, payload bytes and digest of the whole payload, record type, the response it refers to."""
    held = shards.select("first", "shard", "blocks").collect()  # a row for each write task
    firsts, tasks = [(r.first, r.shard) for r in held], max(1, min(READ_TASKS, sum(r.blocks for r in held)))

    def read(batches):
        reader, sizes = Reader(folder, firsts), {}

        def row(headers: dict[str, str], payload: bytes) -> dict:
            number, kind = headers["x-capture-number"], headers["warc-type"]
            digest, to = headers["warc-payload-digest"].removeprefix("sha1:"), None
            size = len(payload)
            if kind == "revisit":
                to = int(headers["x-refers-to-number"])
                if digest not in sizes:
                    if len(sizes) > 100_000:
                        sizes.clear()
                    found = reader.lookup(json.loads(headers["x-refers-to-key"]))
                    if found is None:
                        raise ValueError(f"the response {to} of a revisit is in no archive")
                    sizes[digest] = (len(found[1]), base64.b32encode(hashlib.sha1(found[1]).digest()).decode())
                size, digest = sizes[digest]
            else:
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            return {id_col: int(number) if number else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": to}

        for batch in batches:
            for shard, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [row(*reader.read(shard, entry)) for entry in reader.block(shard, block)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([(id_col, pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    blocks = shards.select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    spread = blocks.repartition(tasks, "shard", "block")  # a count of its own, else so few bytes are read in one task
    return spread.mapInArrow(read, f"{id_col} long, payload_bytes long, payload_digest string, record_type string, refers_to long")


#: payload_digest: the SHA-1 as 32 base32 digits, 5 bits of its hex digits each.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS s, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(s || '0', CAST((5 * i) // 4 + 1 AS INTEGER), 2) AS INTEGER) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top IS NULL OR page_id = top THEN NULL ELSE top END AS refers_to
FROM h
"""


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return read_archives(*write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
