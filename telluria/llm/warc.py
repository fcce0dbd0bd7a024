"""Web archives with a two-level capture index.

Archives are WARC 1.1 files with one gzip member per record, written by Spark's
own writer: a record travels as the bytes of a string, and the line separator is
an empty gzip member, so that the files are plain multi-member archives which any
tool can read and any store can hold.  A payload that several pages share is
written once, with its largest page id; the others are revisit records.

The index sorts captures by reversed-host key (``com,example,www)/path``) over
the cluster and packs them into compressed blocks of ``BLOCK`` lines, stored in
Parquet.  A directory holds the first key of each block.  Looking up a key finds
its index parts by bisection of their first keys (at most ``parts`` of them),
its blocks by bisection of the part's directory, and its lines by bisection in
the block; only then is the record's byte range read from its archive.

* A null payload is empty, a null url is written as ``about:blank``; control
  characters and blanks in urls are percent-encoded.  Payloads of less than
  ``least`` bytes are never shared.  A null page id counts below all others;
  rows equal in id and payload are written once each and stay apart.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telluria.session import materialize

NOTHING = gzip.compress(b"", mtime=0)
BLOCK = 1000
RECORDS_PER_FILE = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> str:
    """Reversed host, then path and query."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url.lower()
    path = parts.path or "/"
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){path}{query}".lower()


def record(page: int | None, url: str | None, payload: bytes, sha1: str, leader: int | None, date: str) -> bytes:
    name = lambda n: f"<urn:page:{'none' if n is None else n}>"
    uri = quote(url, safe="".join(map(chr, range(33, 127)))) if url else "about:blank"
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = leader is not None and leader != page
    block = http if again else http + payload
    head = [f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if again:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(leader)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress(("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n", 5, mtime=0)


def members(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member that holds something."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        got, box, begin = zlib.decompressobj(31), [], at
        while not got.eof and at < len(raw):
            part = view[at:at + 65536]
            box.append(got.decompress(part))
            at += len(part) - len(got.unused_data)
        content = b"".join(box)
        if content:
            yield begin, at - begin, content


def parse(content: bytes) -> dict:
    """Fields of a record; ``payload_bytes`` is that of the full payload."""
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = block[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    told = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    number = lambda v: None if v in (None, "<urn:page:none>") else int(v[10:-1])
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"],
            "record_type": fields["WARC-Type"], "payload_digest": fields["WARC-Payload-Digest"][5:],
            "refers_to": number(fields.get("WARC-Refers-To")), "payload_bytes": int(told["Content-Length"]),
            "payload": payload}


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        payload.alias("html")).withColumn("sha1", F.sha1("html"))
    shared = (rows.where(F.octet_length("html") >= least).groupBy("sha1")
              .agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                columns = [batch.slice(at, 500).column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "leader")]
                made = [record(p, u, h.encode(), s, n, date) for p, u, h, s, n in zip(*columns)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    made = rows.join(shared, "sha1", "left").mapInArrow(run, "value binary")
    (made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", NOTHING.decode("latin-1"))
     .option("encoding", "ISO-8859-1").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


CAPTURE = "key string, page_id long, record_type string, payload_digest string, file string, offset long, length long"


def captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                found = []
                for offset, length, content in members(raw):
                    r = parse(content)
                    found.append((url_key(r["url"]), r["page_id"], r["record_type"], r["payload_digest"], file, offset, length))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x), t) for x, t in zip(zip(*found) if found else ((),) * 7, (
                        pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))],
                    names=[c.split()[0] for c in CAPTURE.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CAPTURE)


def build_index(found: DataFrame, path: str, parts: int = 64) -> None:
    """Write the blocks and the directory of captures below ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        no = 0

        def block(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal no
            lines = "\n".join("\t".join("" if v is None else str(v) for v in r) for r in rows)
            no += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([no - 1], pa.int32()), pa.array([rows[0][0]]), pa.array([zlib.compress(lines.encode(), 6)])],
                names=["block", "first_key", "body"])

        for batch in batches:
            held += zip(*[c.to_pylist() for c in batch.columns])
            while len(held) >= BLOCK:
                yield block(held[:BLOCK])
                del held[:BLOCK]
        if held:
            yield block(held)

    # Captures of one url are dealt by page as well: a hot url fills several parts.
    by = (found.repartitionByRange(parts, "key", "page_id", "file", "offset")
          .sortWithinPartitions("key", "page_id", "file", "offset"))
    blocks = by.mapInArrow(run, "block int, first_key string, body binary").withColumn("part", F.spark_partition_id())
    blocks.write.parquet(f"{path}/blocks")
    stored = found.sparkSession.read.parquet(f"{path}/blocks")
    stored.select("part", "block", "first_key").write.parquet(f"{path}/directory")


def _lines(body: bytes) -> tuple[list[str], list[list[str]]]:
    rows = [x.split("\t") for x in zlib.decompress(body).decode().split("\n")]
    return [r[0] for r in rows], rows


def _spans(firsts: list[str], key: str) -> range:
    """Numbers of the ordered stretches that may hold a key, by their first keys."""
    return range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key))


def find_captures(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Captures of the distinct ``key`` rows, by the two-level index at ``path``."""
    tops = sorted(((r["first_key"], r["part"]) for r in spark.read.parquet(f"{path}/directory")
                   .groupBy("part").agg(F.min("first_key").alias("first_key")).collect()))
    firsts, numbers = [t[0] for t in tops], [t[1] for t in tops]

    def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(numbers[i], k) for k in batch.column("key").to_pylist() for i in _spans(firsts, k)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()),
                                              pa.array([x[1] for x in out], pa.string())], names=["part", "key"])

    def look(wanted: pa.Table, blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("block")
        begin, bodies, out, opened = blocks.column("first_key").to_pylist(), blocks.column("body"), [], (-1, None)
        for key in sorted(set(wanted.column("key").to_pylist())):
            for i in _spans(begin, key):
                if opened[0] != i:
                    opened = i, _lines(bodies[i].as_py())
                names, rows = opened[1]
                out += rows[bisect.bisect_left(names, key):bisect.bisect_right(names, key)]
        columns = list(zip(*out)) if out else [()] * 7
        number = lambda x: pa.array([int(v) if v else None for v in x], pa.int64())
        made = [pa.array(list(c), pa.string()) for c in columns]
        for i in (1, 5, 6):
            made[i] = number(columns[i])
        return pa.Table.from_arrays(made, names=[c.split()[0] for c in CAPTURE.split(", ")])

    asked = keys.select("key").distinct().mapInArrow(part_of, "part int, key string")
    blocks = spark.read.parquet(f"{path}/blocks")
    return asked.groupBy("part").cogroup(blocks.groupBy("part")).applyInArrow(look, CAPTURE)


def read_records(spark: SparkSession, archives: str, found: DataFrame) -> DataFrame:
    """The records of captures, read by their byte ranges."""
    ranges = found.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges"))
    files = spark.read.format("binaryFile").load(archives).select(F.col("path").alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
                 "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        for batch in batches:
            for raw, ranges in zip(batch.column("content").to_pylist(), batch.column("ranges").to_pylist()):
                for at in range(0, len(ranges), 500):
                    rows = [parse(gzip.decompress(raw[r["offset"]:r["offset"] + r["length"]])) for r in ranges[at:at + 500]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()],
                                                     names=list(kinds))

    return files.join(ranges, "file").select("content", "ranges").mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
             "payload binary")


def keys_of(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Index keys of the urls of pages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("url").to_pylist()
            made = [url_key(quote(u, safe="".join(map(chr, range(33, 127)))) if u else "about:blank") for u in urls]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["key"])

    return pages.select(F.col(f"`{url_col}`").cast("string").alias("url")).mapInArrow(run, "key string").distinct()


def archive_and_index(pages: DataFrame, path: str, parts: int = 64) -> tuple[str, str]:
    """Write the archives of pages and their index below ``path``; both folders."""
    write_archives(pages, f"{path}/archives")
    build_index(materialize(captures(pages.sparkSession, f"{path}/archives")), f"{path}/index", parts)
    return f"{path}/archives", f"{path}/index"
