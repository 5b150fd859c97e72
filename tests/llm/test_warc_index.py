"""Records come back through directory, block and range, in many tasks."""

import pytest

pytest.importorskip("terrafold.llm")

from pyspark.sql import functions as F  # noqa: E402

from terrafold.llm import warc  # noqa: E402

SHAPE = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rows = [(i, f"http://{'www.' if i % 2 else ''}b{i % 5}.example.com/p{i % 120}", f"<p>{i % 90}</p>" * 50) for i in range(400)]
    rows += [(7, "http://b2.example.com/p7", "<p>7</p>" * 50)] * 3 + [(None, None, "<p>7</p>" * 50), (None, "http://b2.example.com/p7", None)]
    pages = spark.createDataFrame(rows, SHAPE).repartition(5)
    folder = f"file://{tmp_path_factory.mktemp('w')}/w"
    captures = warc.write_archives(pages, folder)
    return rows, captures, warc.write_index(captures, folder, block_lines=20)


def test_every_record_comes_through_the_index(spark, written):
    rows, captures, directory = written
    blocks = directory.count()
    assert blocks >= 20 and captures.count() == len(rows)
    read = warc.read_back(directory)
    assert read.rdd.getNumPartitions() == 4 and read.select(F.spark_partition_id()).distinct().count() > 1
    got = read.collect()
    assert len(got) == len(rows) and sum(r["record_type"] == "response" for r in got if r["page_id"] == 7) == 4
    assert {r["refers_to"] for r in got if r["page_id"] == 97} == {7}
    one = directory.orderBy("first_key").limit(1).collect()[0]
    some = directory.filter((F.col("path") != one["path"]) | (F.col("offset") != one["offset"]))
    # What the directory does not list is not found: there is no other way to the records.
    assert warc.read_back(some).count() == len(rows) - 20


def test_lookup_bisects_to_the_captures_of_a_key(spark, written):
    rows, _, directory = written
    asked = ["http://b2.example.com/p7", "https://WWW.b2.example.com/P7#x", "http://nowhere.example/", None]
    found = warc.lookup(spark.createDataFrame([(u,) for u in asked] * 2, "url string"), directory).collect()
    want = sorted(str(p) for p, u, _ in rows if warc.url_key(u) == "com,example,b2)/p7")
    for url in asked[:2]:
        assert sorted(str(r["page_id"]) for r in found if r["url"] == url) == want
    assert [r["page_id"] for r in found if r["url"] is None] == [None] and not [r for r in found if r["url"] == asked[2]]


def test_a_task_reads_few_blocks(written):
    _, _, directory = written
    blocks = [tuple(r) for r in directory.select("first_key", "last_key", "path", "offset", "length").collect()]
    index, reads = warc.CaptureIndex(blocks), []
    plain = index.ranges.read
    index.ranges.read = lambda *where: reads.append(where) or plain(*where)
    assert index.captures("http://b4.example.com/p9") and len(reads) <= 2 < len(blocks)
    assert not index.captures("http://zzz.example/") and len(reads) <= 3
