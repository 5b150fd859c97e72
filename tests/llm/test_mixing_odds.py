"""Pareto order sampling: odds, targets, repeated rows."""

import math
from collections import defaultdict

import pytest

pytest.importorskip("terrafold.llm")

from terrafold.llm import mixing  # noqa: E402


def words(n):
    return " ".join(["w"] * n)


def test_near_target_with_repeated_rows(spark):
    """A third of a source's rows, and more, are one row again and again."""
    rows = [(1, words(100), "a")] * 100 + [(k, words(1 + k % 7), "a") for k in range(2, 102)] + [(k, words(40), "b") for k in range(500, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    found = mixing.mix(docs.select("doc_id", "text", "source"), weights=(9.0, 10.0)).collect()
    for size in {r["source_size"] for r in found}:
        own = [r for r in found if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 20 and all(r["taken"] <= 3 * r["size"] for r in own)
    again = mixing.mixed(docs.repartition(3), weights=(9.0, 10.0)).groupBy("doc_id").count().collect()
    copies = defaultdict(int)
    for r in found:
        copies[r["doc_id"]] += r["taken"] // r["size"]
    assert {r["doc_id"]: r["count"] for r in again} == {k: n for k, n in copies.items() if n}


def test_order_of_the_sample_is_that_of_the_pareto_variable(spark):
    rows = [(k, words(1 + (k * 37) % 400), "ab"[k % 2]) for k in range(1, 1001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing._sized(docs, "doc_id", "text", "source", mixing.SEED).cache()
    odds = mixing._odds(mixing._counts(sized), mixing.source_targets(mixing._counts(sized), (1.0, 7.0))).cache()
    plan = {r["source"]: r for r in odds.collect()}
    uniform = {r["id"]: r["u"] for r in sized.collect()}
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs, weights=(1.0, 7.0)).collect()}
    for source in "ab":
        p = plan[source]
        own = [(k, len(t.split())) for k, t, s in rows if s == source]
        sure = {k for k, n in own if n > p["top"]}
        odd = {k: p["factor"] * math.floor(math.sqrt(n) * 1024) for k, n in own if k not in sure}
        size = dict(own)
        # Expected words are what is due, and inclusion is unequal.
        assert abs(sum(odd[k] * size[k] for k in odd) - p["due"]) < 1e-6 * p["due"] and max(odd.values()) < 1 and max(odd.values()) > 5 * min(odd.values())
        order = sorted(odd, key=lambda k: (uniform[k] / (1 - uniform[k])) / (odd[k] / (1 - odd[k])))
        want, left = set(sure), p["due"]
        for k in order:
            if size[k] > left:
                break
            want.add(k)
            left -= size[k]
        got = {k for k, _ in own if taken[k] > p["copies"]}
        assert want <= got and len(got - want) <= 1


def test_certain_copies(spark):
    rows = [(1, words(900), "a")] + [(k, words(10), "a") for k in range(2, 12)] + [(k, words(100), "b") for k in range(20, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing._sized(docs, "doc_id", "text", "source", mixing.SEED)
    odds = {r["source"]: r for r in mixing._odds(mixing._counts(sized), mixing.source_targets(mixing._counts(sized), (95.0, 105.0))).collect()}
    assert odds["a"]["top"] == 10 and abs(odds["a"]["due"] - 50) < 1e-6 and odds["b"]["due"] == pytest.approx(50)
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, weights=(95.0, 105.0)).collect()}
    assert got[1] == 900 and sum(got[k] for k in range(2, 12)) == 50
