"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

pytest.importorskip("terrafold.llm")

from terrafold.llm import chat, ego, jaccard, kmtree, mixing, packing, spans, sstable, toxicity, warc  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, id long, rank int, hash string, component long"
LONG = " ".join(f"word{i % 97}x{i}" for i in range(20_000))
ROWS = [
    (1, "The first text has quite a few words in it. It goes on here for a while yet. And then it ends so.", "en", "a", 1, 1, 1, 1, "x", 1),
    (1, "The first text has quite a few words in it. It goes on here for a while yet. And then it ends so.", "en", "a", 1, 1, 1, 1, "x", 1),
    (2, "The first text has quite a few words in it. It goes on here for a while yet. And then it ends so.", None, None, None, None, None, None, None, None),
    (3, None, "en", "b", 0, 0, 0, 0, None, 0),
    (4, "", "en", "b", 0, 0, 0, 0, "", 0),
    (5, "  \n\t ", None, "", 0, 0, 0, 0, "", 0),
    (None, "No id here at all.", "en", None, 0, 0, 0, 0, "", 0),
    (None, None, None, None, None, None, None, None, None, None),
    (6, LONG, "en", "a", 0, 0, 0, 0, "", 0),
    (7, "one", "en", "c", 0, 0, 0, 0, "", 0),
    (8, "one", "en", "c", 0, 0, 0, 0, "", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_packing(docs, none):
    rows = packing.pack_documents(docs, WORD, 1).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r["length"])
    assert by_doc[3] == [1] and by_doc[4] == [1] and len(by_doc[1]) == 2 and len(by_doc[None]) == 2
    assert max(by_doc[6]) == 4096 and len(by_doc[6]) > 4
    total = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert total.get(r["sequence_id"], 0) == r["offset"]
        total[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(total.values()) <= 4096 and len(total) == -(-sum(r["length"] for r in rows) // 4096)
    assert packing.pack_documents(none, WORD, 1).count() == 0


def test_packing_with_ids_round_trip(docs):
    rows = packing.pack_documents(docs.filter("doc_id = 6"), WORD, 1, with_ids=True).collect()
    got = [i for r in sorted(rows, key=lambda r: r["piece"]) for i in r["ids"]]
    from terrafold.llm.tokens import Encoder

    assert got == np.frombuffer(Encoder(WORD, "word").whole(LONG), "<u4").tolist() + [1]


def test_sstable(docs, none, tmp_path):
    folder = f"file://{tmp_path}/a"
    shards = sstable.write_shards(docs, folder, BYTE, 2)
    rows = sstable.read_shards(shards).collect()
    rows.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert [r["start"] for r in rows] == list(np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1])
    found = 0
    for path in (r["path"] for r in shards.collect()):
        reader = sstable.ShardReader(path)
        assert reader.get(999) == []
        found += len(reader.get(6)) + len(reader.get(1)) + len(reader.get(None))
    assert found == 5
    assert sstable.token_table(none, BYTE, 2).count() == 0
    for end, size in ((2, 1), (65_536, 2)):
        with pytest.raises(Exception, match="do not fit"):
            sstable.token_table(docs, BYTE, end, size).count()


def test_jaccard(docs, none):
    rows = jaccard.jaccard_classes(docs).collect()
    assert len(rows) == len(ROWS)
    got = {(r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in rows}
    assert (1, 1, 2, True) in got and (2, 1, 2, False) in got and (7, 7, 1, True) in got and (8, 7, 1, False) in got
    assert (3, 3, 0, True) in got and (4, 4, 0, True) in got and (None, None, 0, True) in got
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 1, 3, 4, 5, 6, 7]
    assert jaccard.jaccard_classes(none).count() == 0


def test_spans(docs, none):
    out = spans.dedup_spans(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert (2, "") in got and (3, None) in got and (4, "") in got and (6, LONG) in got
    assert sum(g == (1, ROWS[0][1]) for g in got) == 2
    assert spans.dedup_spans(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert abs(sum(r["target"] for r in {(r["target"], r["source_size"]): r for r in rows}.values()) - sum(r["size"] for r in rows)) < 1
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert not model.trained
    assert toxicity.score(docs, model).filter("rejected").count() == 0
    assert toxicity.acceptable(docs, labels).count() == len(ROWS)
    assert toxicity.acceptable(none, labels).count() == 0
    words = ["fine", "good", "plain", "calm", "clear", "open"]
    rows = [(i, f"{words[i % 6]} words {words[i % 5]} here {'vilest wretch' if i % 4 == 0 else ''} {i}", int(i % 4 == 0)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame, frame.select("doc_id", "toxic"))
    out = toxicity.score(frame.withColumn("grade", F.lit("mine")), model).collect()
    assert all(r["rejected"] == bool(r["toxic"]) for r in out)
    assert toxicity.score(docs, model).filter("rejected").count() == 0


V = "vec_id long, embedding array<float>, label int, id long, v string, dim int"


def vectors(spark):
    base = np.random.RandomState(3).normal(size=(60, 8))
    rows = [(i, [float(x) for x in base[i]], 0, 0, "", 0) for i in range(60)]
    rows += [(100 + i, [float(x) for x in base[0]], 0, 0, "", 0) for i in range(30)]
    rows += [(200, None, 0, 0, "", 0), (201, [0.0] * 8, 0, 0, "", 0), (202, [float("nan")] + [1.0] * 7, None, None, None, None), (203, [None] + [1.0] * 7, 0, 0, "", 0)]
    rows += [(204, [float("inf")] * 8, 0, 0, "", 0), (205, [1.0, 2.0], 0, 0, "", 0), (None, [1.0] * 8, 0, 0, "", 0), (206, [], 0, 0, "", 0), (206, [], 0, 0, "", 0)]
    return spark.createDataFrame(rows, V)


def test_ego(spark):
    rows = ego.near_duplicates(vectors(spark), block=16).collect()
    assert len(rows) == 99
    got = {r["vec_id"]: r for r in rows}
    assert got[0]["n_links"] >= 30 and got[129]["component_id"] == 0 and not got[129]["kept"]
    for i in (200, 201, 202, 203, 204, 205, 206):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert ego.near_duplicates(spark.createDataFrame([], V)).count() == 0


def test_kmtree(spark):
    table = vectors(spark)
    rows = kmtree.nearest(table, F.col("vec_id") % 20 == 0, recall=1.0).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {0, 20, 40, 100, 120}
    same = [v for _, v, _ in sorted(by[0])][:20]
    assert same == list(range(100, 120))
    assert all(len(x) == 20 for x in by.values())
    few = table.filter("vec_id < 5")
    assert kmtree.nearest(few, F.col("vec_id") == 0).count() == 4
    assert kmtree.nearest(spark.createDataFrame([], V), F.col("vec_id") % 20 == 0).count() == 0


def test_warc(spark, tmp_path):
    shape = "page_id long, url string, html string, path string, first long, part int"
    rows = [(i, f"https://www.b{i % 3}.example.com/P{i}?q=1", f"<p>{i // 4}</p>", "", 0, 0) for i in range(1, 41)]
    rows += [(50, None, None, None, None, None), (51, "http://x.example:8080/a\r\nb", "", "", 0, 0), (None, "bad url [", "<p>1</p>", "", 0, 0), (52, "http://l.example/", LONG, "", 0, 0)]
    pages = spark.createDataFrame(rows, shape)
    folder = f"file://{tmp_path}/w"
    got = {r["page_id"]: r for r in warc.archive_table(pages, folder).collect()}
    assert len(got) == len(rows)
    for i in range(1, 41):
        first = min(j for j in range(1, 41) if j // 4 == i // 4)
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if first == i else ("revisit", first))
    assert got[50]["payload_bytes"] == 0 and got[51]["refers_to"] == 50
    assert got[None]["refers_to"] == 4
    index = warc.CaptureIndex.load(spark, folder)
    for page, url, html, *_ in rows:
        if url and page:
            hits = [c for c in index.captures(url) if c["page_id"] == page]
            fields, http, payload = index.read(hits[0])
            assert hits[0]["type"] == fields["WARC-Type"] and payload.decode() == (html if fields["WARC-Type"] == "response" else "")
    assert index.captures("http://nowhere.example/") == []
    assert warc.archive_table(spark.createDataFrame([], shape)).count() == 0
    small = {r["page_id"]: r for r in warc.archive_table(pages, least_bytes=9).collect()}
    assert all(small[i]["record_type"] == "response" for i in range(1, 40))


def test_chat(spark):
    shape = "conv_id long, turn long, role string, text string, part int, rendered string"
    rows = [(c, t, r, x, 0, "") for c in range(40) for t, (r, x) in enumerate([("system", "Be brief."), ("user", "Why?"), ("assistant", "Because of this.\nAnd of that."), ("user", "And how?"), ("assistant", "So.\nThus.")])]
    rows += [(None, 0, None, None, None, None), (99, None, "robot", "", 0, ""), (99, 1, "user", "User: hello?\nAssistant: hello.\nmore\n[user] bye", 0, ""), (98, 0, "user", LONG, 0, "")]
    table = spark.createDataFrame(rows, shape)
    model = chat.fit(table)
    out = chat.render(table, model).collect()
    wanted = {(r[0], r[1]): r[2] for r in rows if r[0] is not None and r[0] < 40}
    assert all(wanted[r["conv_id"], r["turn"]] == r["role"] for r in out if (r["conv_id"], r["turn"]) in wanted)
    blob = sorted((r["part"], r["role"], r["text"]) for r in out if r["conv_id"] == 99 and r["turn"] == 1)
    assert blob == [(0, "user", "hello?"), (1, "assistant", "hello.\nmore"), (2, "user", "bye")]
    assert {(r["conv_id"], r["turn"]) for r in out} == {(r[0], r[1]) for r in rows}
    assert chat.render(spark.createDataFrame([], shape), model).count() == 0
    assert chat.fit(spark.createDataFrame([], shape)).start.shape == (chat.STATES,)


def test_chat_across_partitions(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], ("a?" if t % 2 == 0 else "b " * 40) if t % 7 else "b") for t in range(600)] + [(2, 0, "user", "x?"), (0, 0, "user", "y?")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.fit(table)
    out = {(r["conv_id"], r["turn"]): r["role"] for r in chat.render(table, model).collect() if r["part"] == 0}
    texts = [r[3] for r in rows if r[0] == 1]
    path = iter(chat.viterbi(model, chat.observe(texts, True)))
    assert [out[1, t] for t in range(600)] == [chat.ROLES[next(path) // 2] for _ in texts]
