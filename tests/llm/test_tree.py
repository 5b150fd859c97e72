"""The k-means tree: several levels, best bins first, leaves that stay small, recall that is measured."""

from itertools import islice

import numpy as np
import pytest

pytest.importorskip("terrafold.llm")

from pyspark.sql import functions as F  # noqa: E402

from terrafold.llm import kmtree  # noqa: E402
from terrafold.llm import queries as Q  # noqa: E402


def clustered(n, clusters=40, width=16):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(clusters, width))[rng.integers(0, clusters, n)] + 0.1 * rng.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def depth(tree, node=0):
    return 1 + max((depth(tree, int(kid)) for kid in tree.children[node][0]), default=0) if tree.children[node] else 1


def test_deep_tree_walks_every_leaf_once_and_near_ones_first(monkeypatch):
    monkeypatch.setattr(kmtree, "BRANCH", 4)
    monkeypatch.setattr(kmtree, "LEAF_ROWS", 32)
    x = clustered(2000)
    tree = kmtree.Tree(x, len(x), 1.0)
    assert depth(tree) >= 4
    at = tree.assign(x)
    assert set(at.tolist()) <= set(range(tree.leaves))
    for q in x[:20]:
        # A row goes down by nearest centres, one level at a time.
        node, lifted = 0, tree.lift(q[None])[0]
        while tree.children[node]:
            kids, centres, _ = tree.children[node]
            node = int(kids[((centres - lifted) ** 2).sum(1).argmin()])
        assert tree.leaf[node] == tree.assign(q[None])[0]
        order = list(tree.walk(q))
        assert sorted(order) == list(range(tree.leaves))
    hits = []
    for q in range(100):
        near = np.argsort(-(x @ x[q]), kind="stable")[1:21]
        hits.append(np.isin(at[near], list(islice(tree.walk(x[q]), tree.leaves // 10))).mean())
    assert np.mean(hits) >= 0.9


def leaves_and_share(spark, n):
    x = clustered(n)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    report = kmtree.recall_report(table, F.col("vec_id") % 20 == 0).first()
    return report["leaves"], report["leaves_visited"] / report["leaves"], report["held_out"], report["recall"]


def test_share_of_leaves_falls_as_rows_grow(spark, monkeypatch):
    # A sample in proportion to the rows, as for tables beyond ``SAMPLE`` rows.
    monkeypatch.setattr(kmtree, "SAMPLE", 100)
    monkeypatch.setattr(kmtree, "LEAF_ROWS", 32)
    few = leaves_and_share(spark, 1000)
    many = leaves_and_share(spark, 6000)
    assert many[0] >= 4 * few[0] and many[1] < few[1]
    assert few[2] >= 10 and many[2] == kmtree.HELD_OUT
    assert few[3] >= 0.9 and many[3] >= 0.9


def test_sample_is_bounded_and_by_hash(spark, monkeypatch):
    monkeypatch.setattr(kmtree, "SAMPLE", 50)
    monkeypatch.setattr(kmtree, "SAMPLE_VALUES", 40 * 16)
    x = clustered(1000)
    table = spark.createDataFrame([(i, v.tolist(), 16) for i, v in enumerate(x)], "id long, v array<double>, dim int")
    least = [r["id"] for r in table.orderBy(F.xxhash64("id"), "id").limit(40).collect()]
    np.testing.assert_array_equal(kmtree._sample(table, {16: 1000})[16], x[least])
    assert kmtree._sample(table.limit(0), {}) == {}


def test_leaves_cut_into_units_give_whole_results(spark, monkeypatch):
    monkeypatch.setattr(kmtree, "UNIT", 16)
    x = clustered(400, clusters=3)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in kmtree.nearest(table, F.col("vec_id") % 20 == 0, recall=1.0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 400, 20):
        scores = (x * x[q]).sum(axis=1)
        scores[q] = -np.inf
        wanted = np.lexsort((np.arange(400), -scores))[:20]
        assert [v for _, v in sorted(found[q])] == wanted.tolist()


def test_held_out_recall_on_driver_tables(spark):
    for sf in ("sf0.001", "sf0.01"):
        report = Q.op5_kmeans_tree_recall(spark, f"/root/testdata/{sf}").first()
        assert report["held_out"] >= 1 and report["recall"] >= 0.9
