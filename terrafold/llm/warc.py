"""WARC archives with a two-level capture index.

Archives hold one gzip member per record. Of records with equal payloads of at
least ``least_bytes`` bytes, that of the smallest page id is a ``response``, the
others are ``revisit`` records, which carry no payload but name the response
they refer to; smaller payloads are always responses.

The index has two levels. Captures are sorted by reversed-host URL key
(``com,example,www)/path``) and written in blocks of ``BLOCK_LINES`` lines, one
gzip member each; a sparse directory keeps the first key and the place of every
block. Both ways back to the records go through it: ``read_back`` deals the
directory's blocks over tasks, reads the range of each block and then the range
of every record; ``lookup`` finds the blocks of a URL key by bisection of the
directory and reads the ranges of that key's captures.

Pages are shuffled once: what says that a payload repeats travels with them to
the partition that writes their archive, by id and digest.

Defined cases: a null html is an empty payload; a null url has the empty key and
no target line; rows with equal ids and payloads are all responses if theirs is
the smallest id; null ids come after all others; an empty table gives no files
and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, cut, join_counted, new_folder, partitions, slices
from .storage import create, open_for_ranges

BLOCK_LINES = 3000
#: Fixed date of records: tables have none.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 1
#: Bytes of an archive that one task reads records from, and those it reads at once.
STRETCH, AHEAD = 64 << 20, 1 << 20
#: Stretches of one archive go to tasks that lie so far apart.
PRIME = 7919
CAPTURES = "page_id long, url_key string, path string, offset long, length long, type string, digest string"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``com,example,www)/a?b``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.strip().lower()
    if host.startswith("www."):
        host = host[4:]
    standard = {"http": 80, "https": 443}.get(parts.scheme)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != standard else "")
    return key + ")" + (parts.path.lower() or "/") + ("?" + parts.query.lower() if parts.query else "")


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(urn: str | None) -> int | None:
    found = re.search(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_record_id(refers_to)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and the payload of one unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:]), payload


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def repeats(digests: DataFrame) -> DataFrame:
    """``page_id, sha, first``: pages whose payload, if ``counted``, has a response of a smaller id."""
    counted = digests.filter("counted").select("page_id", "sha")
    shared = cut(counted.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null"))
    again = join_counted(counted, shared, "sha", "n").filter("page_id is null or page_id > first")
    return again.select("page_id", "sha", "first").distinct()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html); returns a row per capture (``CAPTURES``)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    base = base.withColumn("sha", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    digests = cut(base.select("page_id", "sha", (F.octet_length("html") >= least_bytes).alias("counted")))
    # Rows equal in id and payload that are more than 1/HOT of all, fewer than HOT groups, are dealt to eight places a task.
    tasks, nothing = partitions(pages.sparkSession), F.lit(None)
    often = digests.groupBy(F.col("page_id").alias("id"), F.col("sha").alias("digest")).agg(F.count("*").alias("n"))
    often = F.broadcast(often.filter(F.col("n") * HOT > digests.count()).select("id", "digest", F.lit(8 * tasks).alias("places")))
    same = lambda df: (df["page_id"].eqNullSafe(often["id"])) & (df["sha"] == often["digest"])
    known = repeats(digests)
    known = known.join(often, same(known), "left").select(
        "page_id", "sha", F.explode(F.sequence(F.lit(0), F.coalesce("places", F.lit(1)) - 1)).alias("salt"), nothing.cast("string").alias("url"), nothing.cast("string").alias("html"), "first"
    )
    own = base.join(often, same(base), "left").select(
        "page_id", "sha", F.pmod(F.monotonically_increasing_id(), F.coalesce("places", F.lit(1))).cast("int").alias("salt"), "url", "html", nothing.cast("long").alias("first")
    )
    # What is known of a page comes before it.
    placed = (
        known.unionByName(own)
        .repartition(tasks, "page_id", "sha", "salt")
        .sortWithinPartitions("page_id", "sha", "salt", F.col("first").desc_nulls_last(), "url")
        .select("page_id", "sha", "url", "html", "first", F.spark_partition_id().alias("part"))
    )
    schema = pa.schema(
        [("page_id", pa.int64()), ("url_key", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("digest", pa.string())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = slices(batches)
        batch = next(batches, None)
        if batch is None:
            return
        path = f"{folder}/part-{batch.column(5)[0].as_py():06d}.warc.gz"
        rows, at, told = [], 0, (None, None, None)
        with create(path) as out:
            while batch is not None:
                for page, sha, url, html, first in zip(*[c.to_pylist() for c in batch.columns[:5]]):
                    if first is not None:
                        told = page, sha, first
                        continue
                    payload = html.encode("utf-8", "surrogatepass")
                    digest = base64.b32encode(sha).decode()
                    refers_to = told[2] if told[:2] == (page, sha) else None
                    packed = _member(record(page, url, payload, digest, refers_to))
                    out.write(packed)
                    rows.append((page, url_key(url), path, at, len(packed), "response" if refers_to is None else "revisit", digest))
                    at += len(packed)
                    if len(rows) == 10_000:
                        yield _batches(rows, schema)
                        rows = []
                batch = next(batches, None)
        if rows:
            yield _batches(rows, schema)

    return cut(placed.mapInArrow(work, CAPTURES))


class Ranges:
    """Ranges of files read in order: what comes next is often already there."""

    def __init__(self, ahead: int = AHEAD):
        self.ahead, self.path, self.file, self.at, self.data = ahead, None, None, 0, b""

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            self.close()
            self.path, self.file, self.data = path, open_for_ranges(path), b""
        skip = offset - self.at
        if skip < 0 or skip + length > len(self.data):
            self.file.seek(offset)
            self.at, self.data, skip = offset, self.file.read(max(length, self.ahead)), 0
        return self.data[skip : skip + length]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def read_blocks(directory: DataFrame) -> DataFrame:
    """The captures in the index blocks of ``directory``; a range read per block."""
    schema = pa.schema([("page_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(0)
        for batch in batches:
            for path, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                lines = zlib.decompress(ranges.read(path, offset, length), 31).decode("utf-8", "surrogatepass").split("\n")
                rows = [tuple(c[f] for f in schema.names) for c in map(json.loads, lines)]
                yield _batches(rows, schema)
        ranges.close()

    dealt = directory.select("path", "offset", "length").repartition(partitions(directory.sparkSession), "path", "offset")
    return dealt.mapInArrow(work, "page_id long, path string, offset long, length long")


def read_records(captures: DataFrame) -> DataFrame:
    """Read the record of every capture (path, offset, length), by range.

    Stretches of archives are dealt over tasks and read in order of their offsets.
    """
    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in slices(batches, 4096):
            rows = []
            for path, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                fields, http, payload = parse(zlib.decompress(ranges.read(path, offset, length), 31))
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                if kind == "response" and _digest(payload) != digest:
                    raise ValueError(f"{path}: {fields['WARC-Record-ID']} has another payload than its digest says")
                rows.append((_page_id(fields["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, _page_id(fields.get("WARC-Refers-To"))))
            if rows:
                yield _batches(rows, schema)
        ranges.close()

    # Archives are numbered; stretches go round the tasks by number, so that no two of an archive meet before all tasks have one.
    tasks = partitions(captures.sparkSession)
    archive = F.regexp_extract("path", r"part-(\d+)\.warc\.gz$", 1).cast("int")
    stretch = F.floor(F.col("offset") / STRETCH)
    dealt = captures.select("path", "offset", "length").repartitionById(tasks, F.pmod(archive + stretch * PRIME, F.lit(tasks)).cast("int"))
    return dealt.sortWithinPartitions("path", "offset").mapInArrow(
        work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def read_back(directory: DataFrame) -> DataFrame:
    """Every record that the index knows: directory, ranges of blocks, ranges of records."""
    return read_records(read_blocks(directory))


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted, blocked index; returns its sparse directory.

    Directory: ``first_key, last_key, path, offset, length``, a row per block; it
    is also written as Parquet to ``folder/directory``.
    """
    order = ["url_key", "page_id", "path", "offset"]
    placed = (
        captures.repartitionByRange(partitions(captures.sparkSession), *order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
    )
    schema = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        if batch is None:
            return
        path = f"{folder}/index-{batch.column('part')[0].as_py():06d}.cdx.gz"
        rows, at, lines = [], 0, []

        def end(out) -> None:
            nonlocal at
            packed = _member("\n".join(x for _, x in lines).encode("utf-8", "surrogatepass"))
            out.write(packed)
            rows.append((lines[0][0], lines[-1][0], path, at, len(packed)))
            at += len(packed)
            lines.clear()

        with create(path) as out:
            while batch is not None:
                for row in batch.to_pylist():
                    row.pop("part")
                    lines.append((row["url_key"], json.dumps(row)))
                    if len(lines) == block_lines:
                        end(out)
                batch = next(batches, None)
            if lines:
                end(out)
        yield _batches(rows, schema)

    directory = cut(placed.mapInArrow(work, "first_key string, last_key string, path string, offset long, length long"))
    directory.write.mode("overwrite").parquet(f"{folder}/directory")
    return directory


class CaptureIndex:
    """Look captures up by URL: ``blocks`` is (a part of) the sparse directory."""

    def __init__(self, blocks: list[tuple[str, str, str, int, int]]):
        self.blocks = sorted(blocks)
        self.first, self.last = [b[0] for b in self.blocks], [b[1] for b in self.blocks]
        self.ranges = Ranges(0)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> CaptureIndex:
        """The whole directory: one row per ``BLOCK_LINES`` captures is read."""
        return cls([tuple(r) for r in spark.read.parquet(f"{folder}/directory").select("first_key", "last_key", "path", "offset", "length").collect()])

    def captures(self, url: str | None) -> list[dict]:
        """Bisect the directory, then read the blocks that can hold the key."""
        key, found = url_key(url), []
        for _, _, path, offset, length in self.blocks[bisect_left(self.last, key) : bisect_right(self.first, key)]:
            block = zlib.decompress(self.ranges.read(path, offset, length), 31).decode("utf-8", "surrogatepass").split("\n")
            # Lines are sorted by key, too.
            lines = [json.loads(x) for x in block]
            keys = [c["url_key"] for c in lines]
            found.extend(lines[bisect_left(keys, key) : bisect_right(keys, key)])
        return found

    def read(self, capture: dict) -> tuple[dict[str, str], dict[str, str], bytes]:
        with open_for_ranges(capture["path"]) as file:
            file.seek(capture["offset"])
            return parse(zlib.decompress(file.read(capture["length"]), 31))


def lookup(urls: DataFrame, directory: DataFrame) -> DataFrame:
    """Captures of every distinct URL in ``urls`` (url): ``url, page_id, path, offset, length``.

    URLs are sorted by key over tasks, as blocks are; a task keeps of the
    directory only the blocks between its first and last key.
    """
    spark = urls.sparkSession
    keyed = urls.select("url").distinct().mapInArrow(_keys, "url string, url_key string")
    placed = cut(
        keyed.repartitionByRange(partitions(spark), "url_key", "url").sortWithinPartitions("url_key", "url").withColumn("part", F.spark_partition_id())
    )
    spans = placed.groupBy("part").agg(F.min("url_key").alias("low"), F.max("url_key").alias("high"))
    nothing = F.lit(None).cast("string")
    # A row per task, against a row per block: each task's blocks, before its URLs.
    near = directory.join(F.broadcast(spans), (F.col("last_key") >= F.col("low")) & (F.col("first_key") <= F.col("high")))
    blocks = near.select("part", F.lit(0).alias("side"), "first_key", "last_key", "path", "offset", "length", nothing.alias("url"))
    asked = placed.select(
        "part", F.lit(1).alias("side"), F.col("url_key").alias("first_key"), nothing.alias("last_key"), nothing.alias("path"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"), "url"
    )
    both = blocks.unionByName(asked).repartition(partitions(spark), "part").sortWithinPartitions("part", "side", "first_key", "offset")
    schema = pa.schema([("url", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in slices(batches):
            rows = []
            for part, side, first, last, path, offset, length, url in zip(*[c.to_pylist() for c in batch.columns]):
                if part != now:
                    now, held, index = part, [], None
                if side == 0:
                    held.append((first, last, path, offset, length))
                    continue
                index = index or CaptureIndex(held)
                rows.extend((url, c["page_id"], c["path"], c["offset"], c["length"]) for c in index.captures(url))
            if rows:
                yield _batches(rows, schema)

    return both.mapInArrow(work, "url string, page_id long, path string, offset long, length long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        urls = batch.column(0)
        yield pa.RecordBatch.from_arrays([urls, pa.array([url_key(u) for u in urls.to_pylist()], pa.string())], names=["url", "url_key"])


def archive_table(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write archives and index for ``pages`` and return what is found through the index."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    return read_back(write_index(write_archives(pages, folder, least_bytes), folder))
