"""Best-fit packing of token pieces into sequences by exact-complement hashing.

Documents are tokenized, ended with an end id and cut into pieces of at most
``capacity`` tokens. Only the histogram of piece lengths (at most ``capacity``
rows, whatever the input) decides how pieces combine: an index of single, pair
and triple length sums finds combinations that fill a gap exactly, each used as
often as the counts allow; what is left goes best fit, longest first. A plan
says how often each combination occurs; pieces then take their places in it by
their rank among pieces of equal length. The ranks come from windows over
(length, salt), so a length that a third of all pieces has is no single group.

Defined cases: a null text is an empty one, which has the end id alone; rows
with equal ids are packed one by one; null ids stay null; an empty table gives
no rows; columns that the input has besides are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices
from .tokens import encoder

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) and cut each into pieces.

    One row per piece; ``with_ids`` adds the ids as an array of ints.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()
    width = 4 * capacity

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer, "word").encode_all
        for batch in slices(batches):
            rows = []
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, coded in zip(ids, encode_all(texts)):
                coded += end
                for k, at in enumerate(range(0, len(coded), width)):
                    part = coded[at : at + width]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            doc, piece, start, length, crc, part = zip(*rows) if rows else [[]] * 6
            columns = [
                pa.array(doc, pa.int64()),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(
                    pa.array([np.frombuffer(p, "<u4").astype("i4") for p in part], pa.list_(pa.int32()))
                )
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


class Plan:
    """How many sequences hold which lengths: ``groups`` of (times, lengths)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
            self.left[length] = n
        self.groups: list[tuple[int, list[int]]] = []
        self._exact()
        self._best_fit()

    def _use(self, lengths: list[int]) -> bool:
        """Take a combination as often as all its lengths are there."""
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(int(self.left[x]) // n for x, n in need.items())
        if times:
            self.groups.append((times, lengths))
            for x, n in need.items():
                self.left[x] -= times * n
        return times > 0

    def _pair(self, total: int) -> list[int] | None:
        """Two lengths with this sum that are both there, the most even ones last."""
        low = np.arange(1, total // 2 + 1)
        here = (self.left[low] > 0) & (self.left[total - low] > 0)
        if total % 2 == 0 and total:
            here[-1] = self.left[total // 2] > 1
        at = np.flatnonzero(here)
        return [int(total - low[at[0]]), int(low[at[0]])] if len(at) else None

    def _exact(self) -> None:
        cap = self.capacity
        if self.left[cap]:
            self._use([cap])
        there = (self.left > 0).astype(np.float64)
        size = 2 * (cap + 1)
        spectrum = np.fft.rfft(there, size)
        #: Sums that some pair has; kept too large, never too small.
        pairs = np.fft.irfft(spectrum * spectrum, size)[: cap + 1] > 0.5
        for length in range(cap - 1, 0, -1):
            gap = cap - length
            while self.left[length]:
                if gap <= length and self.left[gap] and self._use([length, gap]):
                    continue
                pair = self._pair(gap) if pairs[gap] else None
                if pair:
                    if self._use([length, *pair]):
                        continue
                else:
                    pairs[gap] = False
                if not self._triple(length, gap, pairs):
                    break

    def _triple(self, length: int, gap: int, pairs: np.ndarray) -> bool:
        third = np.arange(1, gap)
        for c in third[(self.left[third] > 0) & pairs[gap - third]][::-1]:
            pair = self._pair(int(gap - c))
            if pair is None:
                pairs[gap - c] = False
            elif self._use([length, int(c), *pair]):
                return True
        return False

    def _best_fit(self) -> None:
        """Longest first into the open sequences with the smallest gap that holds it."""
        open_by_gap: dict[int, list[list]] = {}
        gaps = np.zeros(self.capacity + 1, dtype=np.int64)

        def put(gap: int, times: int, lengths: list[int]) -> None:
            open_by_gap.setdefault(gap, []).append([times, lengths])
            gaps[gap] += times

        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                fits = np.flatnonzero(gaps[length:])
                if len(fits):
                    gap = int(fits[0]) + length
                    group = open_by_gap[gap][-1]
                    times, lengths = group
                    each = min(gap // length, max(1, int(self.left[length]) // times))
                    take = min(times, int(self.left[length]) // each)
                    gaps[gap] -= take
                    group[0] -= take
                    if not group[0]:
                        open_by_gap[gap].pop()
                    put(gap - each * length, take, lengths + [length] * each)
                else:
                    each = min(self.capacity // length, int(self.left[length]))
                    take = int(self.left[length]) // each
                    put(self.capacity - each * length, take, [length] * each)
                self.left[length] -= take * each
        for groups in open_by_gap.values():
            self.groups.extend((times, lengths) for times, lengths in groups)

    def slots(self) -> dict[str, np.ndarray]:
        """Runs of slots for pieces of one length, sorted by (length, first rank).

        Pieces of ranks ``first .. first + times * each - 1`` go ``each`` to a
        sequence, from sequence ``sequence`` and place ``offset`` on.
        """
        runs, used, sequence = [], {}, 0
        for times, lengths in self.groups:
            offset = 0
            at = 0
            while at < len(lengths):
                length, each = lengths[at], 1
                while at + each < len(lengths) and lengths[at + each] == length:
                    each += 1
                first = used.get(length, 0)
                runs.append((length, first, sequence, offset, each))
                used[length] = first + times * each
                offset += length * each
                at += each
            sequence += times
        table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
        self.sequences = sequence
        return dict(zip(("length", "first", "sequence", "offset", "each"), table.T))


def ranked(pieces: DataFrame) -> DataFrame:
    """Add ``rank``, from 0, among pieces of equal length, without a hot window.

    The pieces of a length are numbered per partition of ``pieces``, also where
    they are equal in all columns.
    """
    salted = pieces.withColumn("salt", F.spark_partition_id())
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        salted.groupBy("length", "salt")
        .count()
        .select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    )
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return (
        salted.withColumn("own", F.row_number().over(own) - 1)
        .join(bases, ["length", "salt"])
        .withColumn("rank", F.col("base") + F.col("own"))
        .drop("salt", "own", "base")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece (columns of ``PIECES``) a sequence and its place there.

    Adds ``sequence_id`` (from 0) and ``offset``. ``pieces`` is read several
    times, so pass a written or checkpointed table.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # <= capacity rows
    runs = spark.sparkContext.broadcast(Plan(counts, capacity).slots())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = runs.value
        # Ranks lie below the number of pieces, so one sorted key finds a run.
        wide = np.int64(2**44)
        keys = run["length"] * wide + run["first"]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            into, each = rank - run["first"][at], run["each"][at]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(run["sequence"][at] + into // each), pa.array(run["offset"][at] + into % each * length)],
                names=[*names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    order = [f.name for f in pieces.schema]
    return ranked(pieces).select(*order, F.col("rank").cast("long")).mapInArrow(
        place, schema + ", sequence_id long, offset long"
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Tokenize and pack: one row per piece with its sequence and place.

    With ``with_ids`` each row carries its token ids, so that sequences can be
    put together by ``sequence_id`` and ``offset``.
    """
    return pack(cut(token_pieces(docs, tokenizer, end_id, capacity, with_ids)), capacity)
