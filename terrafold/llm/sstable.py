"""Token ids in sorted-string-table shards, and lookups in them.

Shards follow each other in ascending document id; each holds its documents in
that order too. A shard is one file:

    blocks         zstd; entries (shared key bytes, own key bytes, value bytes,
                   key rest, value), keys prefix-compressed against the last
    block index    per block: last key, place, packed size, first token's place
    Bloom filter   ``BLOOM_BITS`` bits a key, ``BLOOM_HASHES`` probes
    footer         places of the two, documents, tokens, id width, magic

A key is the document id as 8 big-endian bytes with the sign bit turned, so
that bytes sort as numbers do; a null id has the empty key and sorts first. A
value is the ids as unsigned 16-bit or, for larger vocabularies, 32-bit ints.
A lookup asks the Bloom filter, searches the block index by bisection and
unpacks one block.

Rows are dealt to shards in ranges of (id, hash of the text, row), so that an
id, or no id, of many rows is spread over shards that follow each other. A
lookup of many ids sorts them as shards are; a task keeps the key ranges of the
shards that its ids can be in, and opens those that hold one.

Defined cases: a null text is an empty one; rows with equal ids are all kept,
one after the other (by a hash of the text); an empty table gives no shards and
no rows. A lookup of an id that occurs several times finds all its documents,
of one that does not occur none; null is looked up as the rows without an id.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, new_folder, partitions, slices
from .storage import create, open_for_ranges
from .tokens import encoder

BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"TFSST001"
FOOTER = struct.Struct("<QQQQQB8s")
STATS = "shard int, path string, docs long, tokens long, first_key binary, last_key binary"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + 2**63) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - 2**63 if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Write entries, given in key order, to an open binary file."""

    def __init__(self, out, id_bytes: int):
        self.out, self.id_bytes, self.at = out, id_bytes, 0
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.block, self.keys, self.index = bytearray(), [], []
        self.last, self.docs, self.tokens, self.block_tokens = b"", 0, 0, 0

    def add(self, key: bytes, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit."""
        value = np.frombuffer(ids, "<u4").astype(f"<u{self.id_bytes}").tobytes()
        shared = 0
        if self.block:
            top = min(len(key), len(self.last))
            while shared < top and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.block_tokens = self.tokens
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.tokens += len(ids) // 4
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        packed = self.pack(bytes(self.block))
        self.out.write(packed)
        self.index.append((self.last, self.at, len(packed), self.block_tokens))
        self.at += len(packed)
        self.block.clear()

    def close(self) -> None:
        if self.block:
            self._end_block()
        index = bytearray()
        for key, at, size, before in self.index:
            index += _varint(len(key)) + key + _varint(at) + _varint(size) + _varint(before)
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, dtype=bool)
        for key in self.keys:
            bloom[_probes(key, bits)] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(bytes(index) + packed)
        self.out.write(
            FOOTER.pack(self.at, len(index), len(packed), self.docs, self.tokens, self.id_bytes, MAGIC)
        )


class ShardReader:
    """Read a shard: ``get`` looks a document up, ``scan`` goes through all."""

    def __init__(self, address: str):
        self.file = open_for_ranges(address)
        size = self.file.size()
        blocks, index, bloom, self.docs, self.tokens, self.id_bytes, magic = FOOTER.unpack(
            self._range(size - FOOTER.size, FOOTER.size)
        )
        if magic != MAGIC:
            raise ValueError(f"{address} is no shard of this format")
        data = self._range(blocks, index + bloom)
        self.bloom, self.index, at = data[index:], [], 0
        while at < index:
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            place, at = _read_varint(data, at)
            packed, at = _read_varint(data, at)
            before, at = _read_varint(data, at)
            self.index.append((key, place, packed, before))
        self.last_keys = [x[0] for x in self.index]
        self.unpack = zstandard.ZstdDecompressor().decompress

    def _range(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def may_hold(self, key: bytes) -> bool:
        bits = 8 * len(self.bloom)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, bits))

    def _block(self, number: int) -> Iterator[tuple[bytes, bytes]]:
        _, place, size, _ = self.index[number]
        data, at, key = self.unpack(self._range(place, size)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + size]
            at += size

    def _ids(self, value: bytes) -> bytes:
        return np.frombuffer(value, f"<u{self.id_bytes}").astype("<u4").tobytes()

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of every document with this id (none: an empty list)."""
        key = key_of(doc_id)
        if not self.docs or not self.may_hold(key):
            return []
        found = []
        for number in range(bisect_left(self.last_keys, key), len(self.index)):
            for k, value in self._block(number):
                if k == key:
                    found.append(self._ids(value))
                elif k > key:
                    return found
        return found

    def scan(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, tokens before it in the shard, ids) in key order."""
        before = 0
        for number in range(len(self.index)):
            for key, value in self._block(number):
                ids = self._ids(value)
                yield id_of(key), before, ids
                before += len(ids) // 4

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_bytes: int = 2) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them to ``folder``.

    Returns a row per shard (columns of ``STATS``). Texts are range-partitioned
    and sorted before they are encoded, so ids themselves are never shuffled.
    ``id_bytes`` is 1, 2, 4 or 8; a vocabulary whose ids do not fit is an error.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()
    sorted_docs = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        .withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), "hash", "row")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "hash", "row")
        .select("doc_id", "text")
        .withColumn("shard", F.spark_partition_id())
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = slices(batches)
        first = next(batches, None)
        if first is None:
            return
        shard = first.column(2)[0].as_py()
        path = f"{folder}/shard-{shard:06d}.sst"
        own = encoder(tokenizer, "byte")
        if max(own.top, end_id) >= 256**id_bytes:
            raise ValueError(f"ids up to {max(own.top, end_id)} do not fit in {id_bytes} bytes")
        encode_all = own.encode_all
        with create(path) as out:
            writer = ShardWriter(out, id_bytes)
            while first is not None:
                coded = encode_all(first.column(1).to_pylist())
                for doc, ids in zip(first.column(0).to_pylist(), coded):
                    writer.add(key_of(doc), ids + end)
                first = next(batches, None)
            writer.close()
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "path": path, "docs": writer.docs, "tokens": writer.tokens, "first_key": writer.keys[0], "last_key": writer.keys[-1]}],
            pa.schema([("shard", pa.int32()), ("path", pa.string()), *[(n, pa.int64()) for n in ("docs", "tokens")], *[(n, pa.binary()) for n in ("first_key", "last_key")]]),
        )

    written = sorted_docs.mapInArrow(work, STATS).collect()  # a row per shard; no more shards than partitions
    return docs.sparkSession.createDataFrame(written, STATS)


def read_shards(shards: DataFrame) -> DataFrame:
    """Read all documents of ``shards`` (columns of ``STATS``) back.

    Per document: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids_crc32``. Memory holds one block at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader, rows = ShardReader(path), []
                for doc, before, ids in reader.scan():
                    rows.append((doc, base + before, len(ids) // 4, zlib.crc32(ids)))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
                reader.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    # A row per shard, summed before it: as many rows as files.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    tasks = partitions(shards.sparkSession)
    based = shards.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), F.pmod("shard", F.lit(tasks)).alias("task"))
    return based.repartitionById(tasks, "task").select("path", "base").mapInArrow(work, ROWS)


def lookup(ids: DataFrame, shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents of every distinct id in ``ids``: ``doc_id, n_tokens, ids_crc32``.

    Per id and shard whose key range holds it: Bloom filter, bisection of the
    block index, one block (more only where an id's rows go on in the next).
    """
    spark = ids.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(key_of, batch.column(0).to_pylist()), pa.binary())], ["key"])

    keys = ids.select(F.col(id_col).cast("long").alias("id")).distinct().mapInArrow(keyed, "key binary")
    placed = cut(keys.repartitionByRange(partitions(spark), "key").withColumn("part", F.spark_partition_id()))
    spans = placed.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    # A row per task, against a row per shard.
    near = shards.join(F.broadcast(spans), (F.col("last_key") >= F.col("low")) & (F.col("first_key") <= F.col("high")))
    held = near.select("part", F.lit(0).alias("side"), F.col("first_key").alias("key"), "last_key", "path")
    asked = placed.select("part", F.lit(1).alias("side"), "key", F.lit(None).cast("binary").alias("last_key"), F.lit(None).cast("string").alias("path"))
    both = held.unionByName(asked).repartition(partitions(spark), "part").sortWithinPartitions("part", "side", "key", "last_key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranges, at, readers = None, [], 0, {}
        for batch in slices(batches):
            rows = []
            for r in batch.to_pylist():
                if r["part"] != part:
                    part, ranges, at = r["part"], [], 0
                if r["side"] == 0:
                    ranges.append((r["key"], r["last_key"], r["path"]))
                    continue
                while at < len(ranges) and ranges[at][1] < r["key"]:  # ids ascend, as ranges do
                    if (reader := readers.pop(ranges[at][2], None)) is not None:
                        reader.close()
                    at += 1
                for first, _, path in ranges[at:]:
                    if first > r["key"]:
                        break
                    if path not in readers:
                        readers[path] = ShardReader(path)
                    number = id_of(r["key"])
                    rows.extend((number, len(found) // 4, zlib.crc32(found)) for found in readers[path].get(number))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "n_tokens", "ids_crc32"])
        for reader in readers.values():
            reader.close()

    return both.mapInArrow(search, "doc_id long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_bytes: int = 2, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as shards and return what they hold, read back."""
    folder = folder or new_folder(docs.sparkSession, "sstable")
    return read_shards(write_shards(docs, folder, tokenizer, end_id, id_bytes))
