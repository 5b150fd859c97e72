"""The filter audit against documents sent through every order one by one, and its cases."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

pytest.importorskip("terrafold.llm")

from terrafold.llm import audit  # noqa: E402

WORDS = [f"w{k}" for k in range(60)]
LONG = " ".join(WORDS)
MANY = " ".join(f"word{k}" for k in range(50_000))
ROWS = [
    (1, LONG, "a"), (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (4, LONG + " #x", "b"), (5, LONG.upper(), "b"), (6, "one two", None), (7, "one two", ""),
    (8, None, "c"), (9, "", "c"), (None, LONG, "c"), (None, "only this & that", "c"), (10, "same " * 80, "a"), (11, "Same same " * 40 + "$", "a"), (12, MANY, "d"),
    (13, "\x0b\x0c a\x1cb", "d"), (0, LONG, "e"), (14, "ÀÉ " * 60, "e"), (15, "AB cd" + " x" * 40, "e"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, None, 1), (6, 0, 1), (None, 1, 1), (12, 1, None), (99, 1, 1), (11, 1, 1), (11, 1, 1)]


def masks(rows):
    texts = [(i, t or "", s or "") for i, t, s in rows]
    for i, t, part in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = i is not None and any(j is not None and j < i and u == t for j, u, _ in texts)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), smaller]
        yield i, part, "".join(x for x, f in zip("ABCDE", fails) if f)


def expected(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    docs, table = list(masks(rows)), {}
    for order in map("".join, permutations("ABCDE")):
        for part in {p for _, p, _ in docs}:
            for step, f in enumerate(order, 1):
                c = Counter(kept=0)
                for i, p, fails in docs:
                    if p == part:
                        past, here = any(x in fails for x in order[: step - 1]), f in fails
                        c["kept"] += not past and not here
                        c["removed"] += here and not past
                        c["redundant"] += here and past
                        c["unique_fails"] += fails == f
                        c["good_lost"] += here and not past and i in good
                        c["toxic_lost"] += here and not past and i in toxic
                table[part, order, step] = [c[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")]
    shapley = Counter()
    for (part, order, step), v in table.items():
        shapley[part, order[step - 1]] += v[1]
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in table.items()}


@pytest.fixture(scope="module")
def tables(spark):
    clash = {"mask": F.lit("x"), "hash": F.lit(1), "first": F.lit(None), "good": F.lit(7), "quality": F.lit(1), "n": F.lit(5), "id": F.lit(3)}
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns(clash)
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("id", F.lit(1))


def test_equals_documents_sent_through_every_order(tables):
    rows = audit.document_audit(*tables).collect()
    assert len(rows) == 600 * 6
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in rows}
    assert got == expected(ROWS, LABELS)


def test_empty_tables(spark, tables):
    docs, labels = tables
    assert audit.document_audit(docs.limit(0), labels).count() == 0
    rows = audit.document_audit(docs, labels.limit(0)).collect()
    assert len(rows) == 3600 and not any(r["good_lost"] or r["toxic_lost"] for r in rows)


def test_other_filters_and_orders(spark):
    """The operator itself: three filters of a caller, two orders, no classes."""
    df = spark.range(100).select(F.lit("p").alias("part"), audit.bits({"x": F.col("id") < 10, "y": F.col("id") % 2 == 0, "z": F.lit(None) > 1}, "xyz").alias("mask"))
    rows = {(r["filter_order"], r["step"]): r for r in audit.interaction_audit(df, "xyz", (), ["xyz", "zyx"]).collect()}
    assert [rows["xyz", k]["removed"] for k in (1, 2, 3)] == [10, 45, 0] and [rows["zyx", k]["kept"] for k in (1, 2, 3)] == [100, 50, 45]
    assert rows["xyz", 1]["shapley"] == 10 + 5 and rows["xyz", 2]["redundant"] == 5 and rows["xyz", 2]["unique_fails"] == 45


def test_hot_text_and_hot_null_id(spark):
    """A third of all rows with one text, another third without an id."""
    rows = spark.range(3000).selectExpr("if(id % 3 = 1, null, id) as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text", "'s' as source")
    found = audit.filter_masks(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert found.filter(F.col("mask").bitwiseAND(16) != 0).count() == 999 and found.count() == 3000
