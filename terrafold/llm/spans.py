"""Substring dedup by sliding sentence spans.

A text is cut into sentences at ``.``, ``!`` or ``?`` before white space and at
line ends. A run is made of consecutive sentences, at least ``sentences`` of them
with ``words`` words. From every sentence on the shortest run is hashed, and so
is the shortest one to the end of every sentence: any run is the union of those
within it, so that what repeats as a longer run is removed as wholly as if all
runs were hashed. White space and case are made equal; runs are joined on a
128-bit hash across the whole table. The first occurrence, by (document id, hash
of the text, place), stays; every sentence that some later occurrence covers is
removed, and the text closes over it. Places go back to their rows by id and
hash of the text, so rows that share an id or have none do not lose each other's
sentences.

Two parameters bound what counts as a run. ``words`` keeps pairs of short
sentences, which meet by chance in unrelated texts, whole; 0 hashes every run.
``enough`` words make a run of one sentence: a passage of that length that is
written without a full stop is no run of several sentences, yet a repeat.

The least occurrence of each hash comes from a groupBy, combined before the
shuffle; it is then joined back to the runs, so that a passage in a third of
all documents is a skewed join, which Spark splits.

Defined cases: null texts stay null; empty texts, and texts too short for a run,
stay as they are; a text that is removed wholly becomes empty; a
run that repeats within its own text is removed there too; rows equal in id and
text count as one place, so that none of them is a later copy of the other;
rows with equal ids and other texts are ordered by the hash of the text; null
ids come after all others, in that order too; an empty table gives no rows;
other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, slices

SENTENCES, WORDS, ENOUGH = 2, 20, 50
BREAK = re.compile(r"[.!?]\s+|\n\s*")
LAST = 2**63 - 1


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence with the white space after it, gapless."""
    spans, start = [], 0
    for m in BREAK.finditer(text):
        if text[start : m.end()].strip():
            spans.append((start, m.end()))
            start = m.end()
    if start < len(text):
        spans.append((start, len(text)))
    return spans


def runs(text: str, words: int = WORDS, enough: int = ENOUGH, least: int = SENTENCES) -> list[tuple[int, int, str]]:
    """(first sentence, sentence after the last, its words) of each run, in order."""
    keys = [" ".join(text[a:b].split()).lower() for a, b in sentences(text)]
    total = [0, *accumulate(k.count(" ") + 1 for k in keys)]

    def is_run(at: int, end: int) -> bool:
        n = total[end] - total[at]
        return n >= enough or end - at >= least and n >= words

    # A run stays one when it grows, so both borders only move forward.
    found, at = set(), 0
    for end in range(1, len(keys) + 1):
        while at < end and is_run(at, end):
            # The shortest run from ``at``: none that ends earlier was one.
            found.add((at, end))
            at += 1
        if at:
            # The shortest run to ``end``.
            found.add((at - 1, end))
    return [(at, end, "\n".join(keys[at:end])) for at, end in sorted(found)]


def occurrences(docs: DataFrame, **bounds: int) -> DataFrame:
    """All runs of ``docs`` (id, text, key): ``id, key, at, end`` and the hash in ``high, low``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, own, ats, ends, hashes = [], [], [], [], []
            for doc, text, key in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                for at, end, said in runs(text, **bounds):
                    ids.append(doc)
                    own.append(key)
                    ats.append(at)
                    ends.append(end)
                    hashes.append(xxhash.xxh3_128_digest(said))
            both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(own, pa.int64()),
                    pa.array(ats, pa.int32()),
                    pa.array(ends, pa.int32()),
                    pa.array(both[:, 0]),
                    pa.array(both[:, 1]),
                ],
                names=["id", "key", "at", "end", "high", "low"],
            )

    return docs.filter("text is not null").mapInArrow(work, "id long, key long, at int, end int, high long, low long")


def repeated(docs: DataFrame, **bounds: int) -> DataFrame:
    """Per document with later occurrences: ``id``, ``key`` and their ``runs``, of at and end."""
    found = occurrences(docs, **bounds)
    place = F.struct("id", "key", "at")
    first = (
        found.groupBy("high", "low")
        .agg(F.min(place).alias("least"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("high", "low", "least")
    )
    # Written first, so that both sides of the join are dealt out for it and
    # Spark can split a hash that a third of all runs have.
    later = found.join(cut(first), ["high", "low"]).filter(place > F.col("least"))
    return later.groupBy("id", "key").agg(F.collect_set(F.struct("at", "end")).alias("runs"))


def cut_out(text: str, found: list[dict]) -> str:
    """The text without the runs ``found``."""
    gone = {k for run in found for k in range(run["at"], run["end"])}
    return "".join(text[a:b] for k, (a, b) in enumerate(sentences(text)) if k not in gone)


def dedup_spans(docs: DataFrame, id_column="doc_id", text_column="text", **bounds: int) -> DataFrame:
    """``docs`` with later occurrences of repeated runs removed from the text.

    ``bounds``: words, enough and least (sentences), see ``runs``.
    A text from which something was removed also loses white space at its end.
    """
    own, key, found = free_name(docs, "_id", "_key", "_runs")
    place = F.coalesce(F.col(id_column).cast("long"), F.lit(LAST))
    text = F.col(text_column).cast("string")
    slim = docs.select(place.alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))
    gone = repeated(slim, **bounds).select(F.col("id").alias(own), F.col("key").alias(key), F.col("runs").alias(found))
    joined = docs.join(gone, (place == F.col(own)) & (F.xxhash64(text) == F.col(key)), "left")

    names = [f.name for f in docs.schema]
    at_text = names.index(text_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = batch.columns
            texts = columns[at_text].to_pylist()
            places = columns[-1].to_pylist()
            done = [t if not p else cut_out(t, p).rstrip() for t, p in zip(texts, places)]
            columns[at_text] = pa.array(done, pa.string())
            yield pa.RecordBatch.from_arrays(columns[:-1], names=names)

    schema = docs.withColumn(text_column, F.col(text_column).cast("string")).schema
    return joined.select(*[F.col(f"`{c}`") for c in names], found).mapInArrow(work, schema)
