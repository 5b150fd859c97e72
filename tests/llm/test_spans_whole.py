"""Runs are removed where they repeat, all of them, and nowhere else."""

import pytest

pytest.importorskip("terrafold.llm")

from terrafold.llm import spans  # noqa: E402


def said(name, n):
    return " ".join(f"{name}{k}" for k in range(n)) + ". "


def test_rows_without_id_keep_their_own_text(spark):
    passage = said("shared", 30) + said("more", 30)
    first = said("a", 5) + passage
    copy = said("b", 25) + said("c", 25) + passage + said("d", 25)
    other = said("e", 25) + said("f", 25) + said("g", 30) + said("h", 30) + said("i", 25)
    for key in (None, 7):
        docs = spark.createDataFrame([(1, first), (key, copy), (key, other)], "doc_id long, text string")
        got = {r["text"] for r in spans.dedup_spans(docs).collect()}
        assert got == {first, said("b", 25) + said("c", 25) + said("d", 25).rstrip(), other}


def test_rows_that_share_an_id_are_ordered_by_text(spark):
    passage, own = said("shared", 30) + said("more", 30), said("b", 25) + said("c", 25)
    docs = spark.createDataFrame([(1, passage), (2, passage), (2, own), (None, own + passage)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in spans.dedup_spans(docs).collect())
    assert got == [("1", passage), ("2", ""), ("2", own), ("None", "")]
    alike = spark.createDataFrame([(5, passage + own), (5, own + passage + said("q", 30))], "doc_id long, text string")
    kept = " ".join(r["text"] for r in spans.dedup_spans(alike).collect())
    assert kept.count("shared0 ") == kept.count("b0 ") == kept.count("q0 ") == 1


def test_every_run_of_sentences_without_bounds(spark):
    docs = spark.createDataFrame([(1, "Yes. No. Or so."), (2, "But. Yes. No. Then."), (3, "Yes. Or so.")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in spans.dedup_spans(docs, words=0).collect()}
    assert got == {1: "Yes. No. Or so.", 2: "But. Then.", 3: "Yes. Or so."}


def test_removed_as_if_every_run_were_hashed(spark):
    import random

    rng = random.Random(3)
    pool = [said(f"p{k}x", n) for k, n in enumerate([60, 40, 3, 15, 5, 10, 5, 10, 25, 1, 49, 55])]
    texts = ["Start here. " + pool[0] + pool[1] + said("u", 7), said("v", 9) + pool[0] + pool[1] + said("w", 8)]
    for k in range(60):
        at = rng.randrange(len(pool))
        texts.append(said(f"l{k}y", rng.randrange(1, 30)) + "".join(pool[at : at + rng.randrange(1, 5)]) + said(f"r{k}z", rng.randrange(1, 30)))
    seen, want = set(), []
    for text in texts:
        parts = [text[a:b] for a, b in spans.sentences(text)]
        keys, gone = [" ".join(p.split()).lower() for p in parts], set()
        for k in range(len(keys)):
            for end in range(k + 1, len(keys) + 1):
                words = len(" ".join(keys[k:end]).split())
                if words >= 50 or end - k >= 2 and words >= 20:
                    key = tuple(keys[k:end])
                    if key in seen:
                        gone |= set(range(k, end))
                    seen.add(key)
        want.append("".join(p for k, p in enumerate(parts) if k not in gone).rstrip() if gone else text)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in spans.dedup_spans(docs).orderBy("doc_id").collect()]
    assert got == want and "p1x" not in got[1]
