"""Repeated queries, rows without ids, lookups: what is equal stays right and is spread over tasks."""

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

pytest.importorskip("terrafold.llm")
from tokenizers import Tokenizer  # noqa: E402

from terrafold.llm import kmtree, sstable, warc  # noqa: E402
from terrafold.llm import queries as Q  # noqa: E402

BYTE, D = public_tokenizers.path("byte_bpe_50k.json"), "/root/testdata/sf0.001"


def test_repeated_queries_and_candidates(spark):
    """Query row 20 three times, candidate 21 five times: each counts once."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [rows[20]] * 2 + [rows[21]] * 4 + [(40, rng.normal(size=8).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = kmtree.nearest(table, F.col("vec_id") % 20 == 0, recall=1.0).toPandas()
    own = found[found.query_id == 20].sort_values("rank")
    assert own["rank"].tolist() == list(range(1, 21)) and own.vec_id.nunique() == 20
    score = lambda i, v: -float(np.dot(v, rows[20][1]))
    want = sorted((score(i, v), i) for i, v in {(i, tuple(v)) for i, v in rows} if i != 20)[:20]
    assert own.vec_id.tolist() == [i for _, i in want]
    # An id with two vectors asks twice; each answer has ranks of its own.
    assert sorted(found[found.query_id == 40]["rank"]) == sorted([*range(1, 21)] * 2)


@pytest.fixture(scope="module")
def shards(spark, tmp_path_factory):
    rows = [(i if i % 2 else None, f"text {i % 150}" if i % 4 else "hot") for i in range(600)] + [(1, "x<|endoftext|>y"), (-5, None), (7, "text 7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return rows, sstable.write_shards(docs, f"file://{tmp_path_factory.mktemp('sst')}", BYTE, 2)


def ids_of(library, text):
    return np.append(library.encode(text or "", add_special_tokens=False).ids, [2]).astype("<u4")


def test_rows_without_id_are_spread_over_shards(shards):
    _, written = shards
    docs = [r["docs"] for r in written.collect()]
    assert len(docs) == 4 and max(docs) < 300 and sum(docs) == 603  # 300 rows have no id


def test_lookup_in_shards(spark, shards):
    rows, written = shards
    library = Tokenizer.from_file(BYTE)
    asked = spark.createDataFrame([(i,) for i in (1, 1, 7, -5, 8, 599, 10**12, -(10**12), None)], "doc_id long")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in sstable.lookup(asked, written).collect())
    wanted = {1, 7, -5, 599, None}
    assert got == sorted((str(i), len(x := ids_of(library, t)), zlib.crc32(x.tobytes())) for i, t in rows if i in wanted)
    assert sstable.lookup(asked.limit(0), written).count() == 0 == sstable.lookup(asked, written.limit(0)).count()


def test_lookup_reads_one_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 64)
    with open(tmp_path / "s", "wb") as out:
        writer = sstable.ShardWriter(out, 2)
        for i in range(200):
            writer.add(sstable.key_of(i * 3), np.arange(10, dtype="<u4").tobytes())
        writer.close()
    reader, read = sstable.ShardReader(f"file://{tmp_path}/s"), []
    assert len(reader.index) > 20
    plain = reader._block
    reader._block = lambda number: read.append(number) or plain(number)
    assert len(reader.get(300)) == 1 and len(read) <= 2
    del read[:]
    assert not any(reader.get(i) for i in range(1, 300, 3)) and len(read) <= 15  # the filter answers nearly all


def test_lookup_query(spark):
    docs, library = pd.read_parquet(f"{D}/documents.parquet"), Tokenizer.from_file(BYTE)
    got = sorted(map(tuple, Q.op7_sorted_string_table_lookup(spark, D).collect()))
    assert got and got == sorted((i, len(x := ids_of(library, t)), zlib.crc32(x.tobytes())) for i, t in zip(docs.doc_id, docs.text) if i % 100 == 0)


def test_pages_without_id_are_spread_over_archives(spark, tmp_path):
    """A third of all pages has no id and one payload, another payload is shared by ids."""
    rows = [(None, "http://a.example/x", "<p>same</p>")] * 400 + [(i, f"http://b.example/{i}", "<p>shared</p>" if i % 2 else f"<p>{i}</p>") for i in range(800)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    captures = warc.write_archives(pages, f"file://{tmp_path}/w")
    per = captures.filter("page_id is null").groupBy("path").count().collect()
    assert len(per) == 4 and max(r["count"] for r in per) <= 220
    found = warc.read_back(warc.write_index(captures, f"file://{tmp_path}/w"))
    rows = found.groupBy("page_id", "record_type", "refers_to").count().collect()
    kinds = {(r["page_id"] is None, r["record_type"], r["refers_to"]): r["count"] for r in rows}
    assert kinds[(True, "response", None)] == 400 and kinds[(False, "revisit", 1)] == 1
    assert found.filter("record_type = 'revisit'").count() == 399 and found.count() == 1200


def test_equal_pieces_are_numbered_per_partition(spark):
    """A third of all rows without id and with one text: ranks are a numbering, and no window holds them all."""
    from terrafold.llm import packing

    docs = spark.createDataFrame([(None, "same words here")] * 400 + [(i, f"word {i}") for i in range(800)], "doc_id long, text string").repartition(6)
    pieces = packing.cut(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 4096, False))
    ranks = packing.ranked(pieces).toPandas()
    for _, own in ranks.groupby("length"):
        assert sorted(own["rank"]) == list(range(len(own)))
    assert pieces.filter("doc_id is null").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 200
