"""Links of vectors of several lengths in several blocks are counted once."""

import numpy as np
import pytest

pytest.importorskip("terrafold.llm")

from terrafold.llm import ego  # noqa: E402


def test_lengths_missing_in_a_block(spark):
    rng = np.random.RandomState(8)
    one, many = rng.normal(size=4), rng.normal(size=(3, 16))
    rows = [one + rng.normal(scale=0.05, size=4) for _ in range(12)] + [many[k % 3] + rng.normal(scale=0.3, size=16) for k in range(300)]
    table = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    want = []
    for k, v in enumerate(rows):
        alike = [w for j, w in enumerate(rows) if j != k and len(w) == len(v)]
        want.append(sum(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)) >= 0.9 for w in alike))
    got = [r["n_links"] for r in ego.near_duplicates(table, block=16).orderBy("vec_id").collect()]
    assert got == want


def test_distant_blocks_are_skipped_level_by_level(spark, monkeypatch):
    """Clustered vectors: under half of the block pairs are left, with levels above the blocks, and no link is lost."""
    rng = np.random.RandomState(8)
    centres = rng.normal(size=(60, 24))
    v = (centres[np.arange(3000) % 60] + rng.normal(scale=0.15, size=(3000, 24))).astype(np.float32)
    table = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(ego, "TOP", 4)
    monkeypatch.setattr(ego, "FAN", 3)
    asked, plain = [], ego.block_pairs

    def counted(ordered, eps, names):
        pairs = plain(ordered, eps, names)
        asked.append((pairs.count(), ordered.agg({"block": "max"}).first()[0] + 1))
        return pairs

    monkeypatch.setattr(ego, "block_pairs", counted)
    got = ego.near_duplicates(table, block=30).toPandas().sort_values("vec_id")
    pairs, blocks = asked[0]
    assert blocks == 100 and pairs < 0.47 * blocks * (blocks + 1) / 2
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    assert got.n_links.tolist() == links.sum(1).tolist() and links.sum() > 10_000


def test_equal_ids_with_other_vectors_and_doubles(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.01]), (3, [0.0, 0.0, 1.0])]
    got = {(r["vec_id"], r["component_id"], r["kept"]) for r in ego.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True)}


def test_distinct_vectors_that_share_an_id(spark):
    """Links are counted for each vector; an id's number is that of the vector with most."""
    rows = [(1, [1.0, 0.0, 0.0]), (1, [1.0, 0.1, 0.0]), (4, [0.0, 0.0, 1.0]), (5, [0.0, 0.1, 1.0]), (5, [0.0, 0.1, 1.0])]
    found = ego.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == [(1, 1, 1), (1, 1, 1), (4, 2, 4), (5, 2, 4), (5, 2, 4)]
