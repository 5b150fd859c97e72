"""Every text against a register of entries: aliases inside it, the nearest name.

A register (aliases, known names) is small as a rule, but nothing promises it,
so its letters are counted first. Up to ``BOUND`` letters it is broadcast and
texts stay where they are. A larger one is cut by a hash into parts of about
half that size; every text goes to every part, in one shuffle, and a task holds
one part at a time. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import Nearest

BOUND = 4_000_000

#: From the entries of (a part of) a register to what finds rows for texts: (number of the text, values...).
Matcher = Callable[[list[str]], Callable[[list[str]], Iterable[tuple]]]


def against(texts: DataFrame, entries: DataFrame, matcher: Matcher, columns: str, bound: int = BOUND) -> DataFrame:
    """(id, ``columns``...) that ``matcher`` finds for ``texts`` (id, text), in each part of ``entries`` (entry).

    Null texts and null or empty entries find nothing; equal entries are one.
    """
    spark = texts.sparkSession
    texts = texts.select(F.col("id").cast("string").alias("id"), "text").filter("text is not null")
    names = entries.select("entry").filter("entry <> ''").distinct()
    schema = f"id string, {columns}"
    kinds = spark.createDataFrame([], schema).toArrow().schema
    letters = names.agg(F.sum(F.length("entry"))).first()[0] or 0

    def rows(batch: pa.RecordBatch, match) -> Iterator[pa.RecordBatch]:
        ids, found = batch.column(0).to_pylist(), []
        for k, *values in match(batch.column(1).to_pylist()):
            found.append((ids[k], *values))
            if len(found) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds.types)], schema=kinds)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds.types)], schema=kinds)

    if letters <= bound:
        held = spark.sparkContext.broadcast([r[0] for r in names.collect()])  # at most ``bound`` letters

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = matcher(held.value)
            for batch in batches:
                yield from rows(batch, match)

        return texts.mapInArrow(whole, schema)

    parts = -(-2 * letters // bound)
    buckets = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // parts))
    place = lambda part, bucket: (part * buckets + bucket).cast("int").alias("place")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part, bucket = F.pmod(F.xxhash64("entry"), F.lit(parts)), F.pmod(F.xxhash64("id"), F.lit(buckets))
    register = names.select("entry", numbers(buckets).alias("bucket")).select(place(part, F.col("bucket")), F.lit(None).cast("string").alias("id"), F.col("entry").alias("text"), F.lit(0).alias("side"))
    asked = texts.select("id", "text", numbers(parts).alias("part")).select(place(F.col("part"), bucket), "id", "text", F.lit(1).alias("side"))
    dealt = register.unionByName(asked).repartitionById(parts * buckets, "place").sortWithinPartitions("place", "side").select("id", "text", "side")

    def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, match = [], None  # a partition is one place
        for batch in batches:
            sides = batch.column(2).to_pylist()
            split = sides.index(1) if 1 in sides else len(sides)
            names += batch.column(1).slice(0, split).to_pylist()
            if split < len(sides):
                match = match or matcher(names)
                yield from rows(batch.slice(split), match)

    return dealt.mapInArrow(in_parts, schema)


def sized(register: DataFrame, column: str, bound: int = BOUND) -> DataFrame:
    """``register`` to be broadcast if its measured letters are no more than ``bound``."""
    letters = register.agg(F.sum(F.length(column))).first()[0] or 0
    return F.broadcast(register) if letters <= bound else register


def contained(entries: list[str]) -> Callable[[list[str]], Iterator[tuple]]:
    """All entries inside a text, by one automaton in one pass over its letters."""
    automaton = ahocorasick.Automaton()
    for entry in entries:
        automaton.add_word(entry, entry)
    automaton.make_automaton()

    def match(texts: list[str]) -> Iterator[tuple]:
        for k, text in enumerate(texts):
            for entry in {e for _, e in automaton.iter(text)} if len(automaton) else ():
                yield k, entry

    return match


def substring_hits(texts: DataFrame, text: str, aliases: DataFrame, alias: str = "alias", key: Column | None = None, bound: int = BOUND) -> DataFrame:
    """Distinct (``text``, ``alias``) with the alias anywhere inside the text.

    ``key`` may stand for long texts in the result, such as a hash of them.
    """
    own = texts.select((F.col(text) if key is None else key).alias("id"), F.col(text).alias("text")).distinct()
    found = against(own, aliases.select(F.col(alias).alias("entry")), contained, "alias string", bound)
    return found.select(F.col("id").alias(text), F.col("alias").alias(alias))


def nearest_names(left: DataFrame, name: str, right: DataFrame, candidate: str, least: float, scorer: str = "wratio", bound: int = BOUND) -> DataFrame:
    """Best candidate per distinct name with score >= ``least`` (J18), the least on ties: (name, candidate, score)."""

    def matcher(entries: list[str]) -> Callable[[list[str]], Iterator[tuple]]:
        nearest = Nearest(entries, scorer)

        def match(texts: list[str]) -> Iterator[tuple]:
            for k, text in enumerate(texts):
                best = nearest.best(text, least)
                if best:
                    yield k, *best

        return match

    # Names are few bytes but much work, so they are dealt out whatever their bytes.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = left.select(F.col(name).alias("id"), F.col(name).alias("text")).repartition(tasks, "id").distinct()
    found = against(own, right.select(F.col(candidate).alias("entry")), matcher, "candidate string, score double", bound)
    best = F.min(F.struct((-F.col("score")).alias("less"), "candidate")).alias("b")
    return found.groupBy(F.col("id").alias(name)).agg(best).select(name, F.col("b.candidate").alias(candidate), (-F.col("b.less")).alias("score"))
