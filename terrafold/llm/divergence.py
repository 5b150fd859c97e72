"""How the sources of a language differ in their words: a tournament of count vectors.

A *group* is a (lang, source). Words of a text are counted per task and added
up; words in at least ``LEAST_DOCS`` documents of a language are its *kept*
terms. Every group, and each language, gives each kept term the share

    p = 1 + floor(SCALE * (count + ADD) / (N + ADD * V))

in whole numbers, N being its count over all V kept terms. Groups are compared
by the sum of abs(p - q) over the kept terms, and the terms by which a group
lies furthest above its language are listed.

The vocabulary of a language is cut into slices by a hash of the term, so that
no vector grows beyond a bounded piece. Per slice, the groups of a language
form blocks, at most ``TEAMS`` of them, and each block stays in one partition.
The blocks hold a round-robin tournament (circle method): in every round each
block meets one other, and the vectors of one of the two, compressed (sorted
places as gaps, shares as 32-bit numbers, deflated), travel to the other's
partition. Guests come in the order of the rounds, one at a time, and each
meeting gives the values of both directions. A task holds its own block and one
guest. Who is host alternates, so every block receives about half the others.
What is absent from both vectors is the same for a whole slice and enters by
its number. Slices of a pair are added up afterwards.

The best terms of a group are kept by a heap per slice, with at most ``top``
entries, and merged.

Shares are divided in three steps of 1000, exact up to 9 * 10^15 words.

Defined cases: null text, lang and source are empty strings. Repeated rows and
rows with equal or null ids are documents of their own; ids are not read.
Further columns are not read. Groups without terms take part, with counts of 0.
A language without kept terms has pairs of value 0 and no term rows. A
language with one source has no pairs. An empty table gives no rows. Equal
values are ordered by the item's UTF-8.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, slices

#: Fixed by the contract.
LEAST_DOCS, ADD, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Blocks per language and slice; rounds are one fewer.
TEAMS = 32
#: (term, group) entries of a slice of a language, on average.
SLICE_ENTRIES = 1 << 16
#: Entries that a counting task gathers before it hands them on.
TABLE = 500_000
#: Bytes of UTF-8 as words have them: A to Z as a to z, a to z and those beyond ASCII as they are, others as a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and documents per (lang, source, term); a row without a term for every group met."""
    table: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def drained() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in table.items():
            terms = [None, *n]
            group = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
            counts = [pa.array(x, pa.int64()) for x in ([0, *n.values()], [0, *map(docs.__getitem__, n)])]
            yield pa.RecordBatch.from_arrays([*group, pa.array(terms, pa.binary()).cast(pa.string()), *counts], ["lang", "source", "term", "n", "docs"])
        table.clear()

    for batch in slices(batches):
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            n, docs = table.setdefault((lang, source), (Counter(), Counter()))
            words = text.translate(WORDS).split()
            held -= len(n)
            n.update(words)
            docs.update(set(words))
            held += len(n)
        if held > TABLE:
            held = 0
            yield from drained()
    yield from drained()


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, total) of the kept terms, and a row with a null term for every group.

    What tasks have counted is shuffled once, by language and term, on which
    both the counts of groups and those of the language are added up.
    """
    text, lang, source = (F.coalesce(F.col(c), F.lit("")) for c in (text_col, lang_col, source_col))
    counted = docs.select(lang.alias("lang"), source.alias("source"), text.alias("text")).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    dealt = counted.repartition(partitions(docs.sparkSession), "lang", "term")
    groups = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    both = groups.withColumns({"total": F.sum("n").over(term), "in_docs": F.sum("docs").over(term)})
    return both.filter(F.col("term").isNull() | (F.col("in_docs") >= least_docs)).select("lang", "source", "term", "n", "total")


def placed_terms(counts: DataFrame, slice_entries: int = SLICE_ENTRIES) -> tuple[DataFrame, int]:
    """(lang, source, term, n, total, slice, place) of the kept terms, written; and the number of slices."""
    entries = counts.filter("term is not null")
    most = entries.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    n_slices = max(1, -(-most // slice_entries))
    sliced = entries.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(n_slices)).cast("int"))
    place = F.dense_rank().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1
    return cut(sliced.withColumn("place", place)), n_slices


def _shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    whole, rest = np.int64(total + ADD * terms), counts.astype(np.int64) + ADD
    digits, rest = rest // whole, rest % whole
    for _ in range(3):
        digits, rest = digits * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return digits + 1


def pack(places: np.ndarray, shares: np.ndarray) -> bytes:
    """A sparse vector: gaps between sorted places, then shares, deflated."""
    gaps = np.diff(places, prepend=0).astype("<u4")
    return zlib.compress(gaps.tobytes() + shares.astype("<u4").tobytes(), 1)


def unpack(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(vector), dtype="<u4").reshape(2, -1).astype(np.int64)
    return np.cumsum(both[0]), both[1]


def _units(top: int):
    """Build a group's vector of one slice, and its best terms there."""

    def build(marker: pa.Table, entries: pa.Table) -> pa.Table:
        m = marker.to_pylist()[0]
        order = np.argsort(entries["place"].to_numpy(), kind="stable")
        places, n, total = (entries[c].to_numpy()[order] for c in ("place", "n", "total"))
        base, vector, best = 0, pack(np.zeros(0, np.int64), np.zeros(0, np.int64)), []
        if m["terms"]:
            base = int(_shares(np.zeros(1, np.int64), m["group_total"], m["terms"])[0])
        if len(places):
            p, q = _shares(n, m["group_total"], m["terms"]), _shares(total, m["lang_total"], m["terms"])
            vector = pack(places, p)
            above = np.flatnonzero(p > q)
            words, lead = entries["term"].take(order[above]).to_pylist(), (p - q)[above].tolist()
            chosen = heapq.nsmallest(top, zip([-x for x in lead], [w.encode() for w in words], strict=True))
            best = [{"term": w.decode(), "value": -x} for x, w in chosen]
        row = {k: m[k] for k in ("lang", "slice", "source", "block", "blocks", "size")} | {"base": base, "vector": vector, "best": best}
        return pa.Table.from_pylist([row], schema=_UNIT_SCHEMA)

    return build


_UNIT_SCHEMA = pa.schema(
    [("lang", pa.string()), ("slice", pa.int32()), ("source", pa.string()), ("block", pa.int32()), ("blocks", pa.int32()), ("size", pa.int32()), ("base", pa.int64())]
    + [("vector", pa.binary()), ("best", pa.list_(pa.struct([("term", pa.string()), ("value", pa.int64())])))]
)
_UNITS = "lang string, slice int, source string, block int, blocks int, size int, base long, vector binary, best array<struct<term:string,value:long>>"


def group_vectors(counts: DataFrame, entries: DataFrame, n_slices: int, top: int = TOP, teams: int = TEAMS) -> DataFrame:
    """A row per group and slice: its block, its compressed vector, the share of absent terms, its best terms."""
    sizes = entries.groupBy("lang", "slice").agg((F.max("place") + 1).cast("int").alias("size"))
    langs = sizes.groupBy("lang").agg(F.sum("size").alias("terms"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    lang_totals = totals.groupBy("lang").agg(F.sum("group_total").alias("lang_total"))
    groups = counts.filter("term is null").select("lang", "source")
    rank, number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1, F.count("*").over(Window.partitionBy("lang"))
    per_block = F.ceil(F.col("number") / teams)
    placed = groups.select("*", rank.alias("rank"), number.alias("number"))
    placed = placed.select(
        "lang", "source", F.floor(F.col("rank") / per_block).cast("int").alias("block"), F.ceil(F.col("number") / per_block).cast("int").alias("blocks")
    )
    markers = placed.join(langs, "lang", "left").join(lang_totals, "lang", "left").join(totals, ["lang", "source"], "left")
    markers = markers.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice")).join(sizes, ["lang", "slice"], "left")
    markers = markers.fillna(0, ["terms", "lang_total", "group_total", "size"])
    markers = markers.select([F.col(c).alias(c) for c in markers.columns])  # both sides come from the same counts
    key = ["lang", "source", "slice"]
    return markers.groupBy(*key).cogroup(entries.groupBy(*key)).applyInArrow(_units(top), _UNITS)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's own meetings, then those with its guests, in the order of the rounds.

    The rows of a (lang, slice, host) come together, its own block first.
    """
    key, home, out = None, [], []
    names, kinds = ["lang", "source", "item", "value"], [pa.string()] * 3 + [pa.int64()]

    def drained() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * 4
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        out.clear()
        return batch

    for batch in slices(batches, 64):
        for r in batch.to_pylist():
            if (at := (r["lang"], r["slice"], r["host"])) != key:
                key, home = at, []
            places, shares = unpack(r["vector"])
            dense = np.full(r["size"], r["base"], dtype=np.int64)
            dense[places] = shares
            for other, base, theirs, p in home:
                there = dense[theirs]
                value = int(np.abs(dense - base).sum() + np.abs(there - p).sum() - np.abs(there - base).sum())
                out += [(r["lang"], r["source"], other, value), (r["lang"], other, r["source"], value)]
            if r["round"] < 0:
                home.append((r["source"], r["base"], places, shares))
            if len(out) > 10_000:
                yield drained()
    yield drained()


def tournament(units: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of every two groups of a language, in both directions."""
    block, blocks = F.col("block"), F.col("blocks")
    even = blocks + blocks % 2  # an odd number of blocks has a bye in every round
    turn = even - 1
    facing = F.pmod(F.col("round") - block, turn)
    # The last of an even number stays in its place while the others rotate.
    partner = F.when(block == even - 1, F.pmod(F.col("round") * (even / 2).cast("int"), turn)).when(facing == block, even - 1).otherwise(facing)
    low, high = F.least("block", "host"), F.greatest("block", "host")
    slim = units.filter("blocks > 1 or block = 0").drop("best")
    home = slim.withColumn("round", F.lit(-1)).withColumn("host", block)
    guests = slim.select("*", F.explode(F.sequence(F.lit(0), turn - 1)).alias("round")).withColumn("host", partner.cast("int"))
    guests = guests.filter((F.col("host") < blocks) & (F.col("host") == F.when((low + high) % 2 == 1, low).otherwise(high)))
    dealt = home.unionByName(guests).repartition(partitions(units.sparkSession), "lang", "slice", "host")
    met = dealt.sortWithinPartitions("lang", "slice", "host", "round", "source").mapInArrow(_meetings, "lang string, source string, item string, value long")
    return met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, top: int = TOP, least_docs: int = LEAST_DOCS, slice_entries: int = SLICE_ENTRIES, teams: int = TEAMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks all other sources of a language, ``term`` the ``top`` terms."""
    counts = cut(kept_counts(docs, least_docs))
    entries, n_slices = placed_terms(counts, slice_entries)
    units = cut(group_vectors(counts, entries, n_slices, top, teams))
    best = units.select("lang", "source", F.inline("best")).withColumnRenamed("term", "item")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked(tournament(units), "pair").unionByName(ranked(best, "term").filter(F.col("rank") <= top))
