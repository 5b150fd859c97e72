"""Snapshots read what differs only, sketches are exact up to the cap, gates come with the write."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import gates, sketches, snapshots

SHAPE = "k long, a string, b double"


def rows_of(n, seed):
    r = random.Random(seed)
    return [(k, r.choice(["x", None, "y"]), r.choice([None, float(r.randrange(9))])) for k in range(n)]


def expected(now, then):
    digest = lambda rows: {k: sorted([(a, b) for j, a, b in rows if j == k], key=str) for k in {r[0] for r in rows if r[0] is not None}}
    a, b = digest(now), digest(then)
    return sorted([(k, "new") for k in a if k not in b] + [(k, "vanished") for k in b if k not in a] + [(k, "changed") for k in a if k in b and a[k] != b[k]])


@pytest.fixture()
def pair(spark, tmp_path):
    def make(now, then):
        old = snapshots.write_snapshot(spark.createDataFrame(then, SHAPE), f"{tmp_path}/old", "k")
        new = snapshots.write_snapshot(spark.createDataFrame(now, SHAPE).repartition(3), f"{tmp_path}/new", "k", like=old)
        return new, old

    return make


@pytest.mark.parametrize("case", ["some", "none", "empty baseline", "empty now", "repeated", "null keys"])
def test_changes(pair, case):
    then = rows_of(500, 1)
    now = [r for r in then if r[0] % 50] + [(1000 + k, "n", 1.0) for k in range(7)]
    now = [(k, "changed" if k % 97 == 0 else a, b) for k, a, b in now]
    if case == "none":
        now = list(reversed(then))
    elif case == "empty baseline":
        then = []
    elif case == "empty now":
        now = []
    elif case == "repeated":
        then, now = then + then[:5] + then[:5], now + now[:3] + [(now[0][0], "more", None)]
    elif case == "null keys":
        then, now = then + [(None, "x", 1.0)], now + [(None, "y", 2.0)] * 3
    new, old = pair(now, then)
    assert sorted(map(tuple, snapshots.changes(new, old).collect())) == expected(now, then)


def test_swapped_values_are_a_change(pair):
    """The same values under other columns, or nulls that move, are no equal rows."""
    new, old = pair([(1, "x", None), (2, None, 3.0), (3, "y", 1.0)], [(1, None, None), (2, None, 3.0), (3, "y", 2.0)])
    assert sorted(map(tuple, snapshots.changes(new, old).collect())) == [(1, "changed"), (3, "changed")]


def test_only_differing_leaves_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "LEAF_ROWS", 20)
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    old = snapshots.write_snapshot(df, f"{tmp_path}/old", "k")
    new = snapshots.write_snapshot(df.withColumn("v", F.when(F.col("k") == 4321, 99).otherwise(F.col("v"))), f"{tmp_path}/new", "k", like=old)
    branches = [r["node"] for r in snapshots.differing(new, old, 1).collect()]
    leaves = snapshots.differing(new, old, 2).withColumnRenamed("node", "leaf")
    assert len(branches) == 1 and leaves.count() == 1
    some = new.rows(branches, leaves)
    assert 0 < some.count() < 200 and "PartitionFilters: [isnotnull(branch" in some._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in snapshots.changes(new, old).collect()] == [(4321, "changed")]
    assert snapshots.changes(old, old).count() == 0 == snapshots.differing(old, old, 0).count()


def test_snapshots_of_other_shapes_are_an_error(spark, tmp_path, monkeypatch):
    a = snapshots.write_snapshot(spark.range(10).withColumnRenamed("id", "k"), f"{tmp_path}/a", "k")
    monkeypatch.setattr(snapshots, "LEAF_ROWS", 1)
    b = snapshots.write_snapshot(spark.range(500).withColumnRenamed("id", "k"), f"{tmp_path}/b", "k")
    with pytest.raises(ValueError):
        snapshots.changes(b, a)


def test_alerts(spark):
    changed = spark.createDataFrame([(1, "new"), (2, "new"), (3, "changed"), (4, "new")], "key long, status string")
    metrics = spark.createDataFrame([(1, 5.0, 1), (2, 9.0, 9), (3, 99.0, 99), (4, 1.0, None)], "id long, value double, tx long")
    mapped = spark.createDataFrame([(2,)], "id long")
    got = sorted(map(tuple, snapshots.alerts(changed, metrics, "id", ["value", "tx"], mapped, top=3).collect()))
    assert got == [("tx", 3, 1, 1.0), ("value", 3, 1, 5.0)]
    assert len(snapshots.alerts(changed, metrics, "id", ["value"], top=4).collect()) == 3


def test_delta_loses_no_id(spark):
    now = spark.range(60).select(F.col("id").alias("k"), (100 - F.col("id")).cast("double").alias("v"))
    got = {r["k"]: r["rank"] for r in gates.delta(now, spark.range(10).withColumnRenamed("id", "k"), "k", "v", top=3).collect()}
    assert sorted(got) == list(range(10, 60)) and {k: r for k, r in got.items() if r} == {10: 1, 11: 2, 12: 3}


@pytest.mark.parametrize("cap", [5, 100, 10_000])
def test_distinct_counts(spark, cap):
    df = spark.range(3000).select((F.col("id") % 40).alias("few"), F.col("id").alias("many"), F.lit(None).cast("string").alias("none"), F.concat(F.lit("s"), F.col("id") % 7).alias("`odd.name"))
    got = {r["column"]: (r["distinct"], r["estimate"]) for r in sketches.distinct_counts(df.repartition(7), df.columns, cap).collect()}
    for name, n in (("few", 40), ("many", 3000), ("none", 0), ("`odd.name", 7)) if cap > 7 else (("few", 40), ("many", 3000), ("none", 0)):
        assert got[name][0] == min(n, cap)
        if n < cap:
            assert got[name][1] == n
    if cap == 100:
        assert 2000 < got["many"][1] < 4200
    assert {r["distinct"] for r in sketches.distinct_counts(df.limit(0), ["few", "many"], cap).collect()} <= {0}


def test_sets_merge_in_any_order():
    rng = np.random.default_rng(2)
    whole = rng.integers(0, 2**63, 5000).astype(np.uint64)
    parts = [sketches.merged([p], 64) for p in np.array_split(whole, 9)]
    one = sketches.merged(parts, 64)
    two = sketches.merged([sketches.merged(parts[:4][::-1], 64), sketches.merged(parts[4:], 64)], 64)
    assert one.tolist() == two.tolist() == np.unique(whole)[:64].tolist()


def test_samples_and_counts(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("a"), F.when(F.col("id") > 997, F.col("id")).alias("b"), F.lit(None).cast("int").alias("c"))
    first = {r["column"]: r["samples"] for r in sketches.samples(df, ["a", "b", "c"]).collect()}
    assert first == {r["column"]: r["samples"] for r in sketches.samples(df.repartition(9), ["a", "b", "c"]).collect()}
    assert set(first["a"]) <= {"0", "1", "2"} and set(first["b"]) <= {"998", "999"} and first["c"] == [] and first["a"] and first["b"]
    top = [tuple(r) for r in sketches.value_counts(df, ["a", "b"], 2).orderBy("column", "rank").collect()]
    assert top == [("a", "0", 334, 1), ("a", "1", 333, 2), ("b", None, 998, 1), ("b", "998", 1, 2)]
    assert [tuple(r) for r in sketches.null_counts(df, 2).collect()] == [("c", 1000), ("b", 998)]


def jobs(spark, work):
    context = spark.sparkContext
    group = f"count-{random.random()}"
    context.setJobGroup(group, group)
    try:
        work()
        return len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_gates_come_with_the_write(spark, tmp_path):
    """One job writes the stage and gives the report; hard failures stop it."""
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") > 2, F.col("id") - 50).alias("v"), F.lit("2020-01-01").cast("date").alias("d"))
    checks = gates.stage_gates(df.columns, ["d"], ["v"])
    seen, report = gates.observed(df, checks)
    assert jobs(spark, lambda: seen.write.parquet(f"{tmp_path}/t")) == 1
    found = {}
    assert jobs(spark, lambda: found.update({r["name"]: (r["value"], r["passed"]) for r in report(stop=False)})) == 0
    assert found == {"has rows": (100, True), "d is read in at least 95 %": (1.0, True), "v is positive": (48, False)}
    assert spark.read.parquet(f"{tmp_path}/t").count() == 100
    with pytest.raises(gates.GateError):
        report()
    missing = gates.stage_gates(df.columns, ["other"])
    assert [r["passed"] for r in gates.run_gates(df, missing, stop=False)] == [True, False]


def test_owner_with_too_many_members_is_an_error(spark):
    from terrafold.operators import registers

    df = spark.range(30).select((F.col("id") % 3).alias("o"), F.col("id").alias("m")).unionByName(spark.createDataFrame([(None, 5), (None, None), (1, 1)], "o long, m long"))
    assert {r["o"]: r["ids"] for r in registers.ids_of(df, "o", "m", most=10).collect()} == {0: [*range(0, 30, 3)], 1: [*range(1, 30, 3)], 2: [*range(2, 30, 3)], None: [5]}
    with pytest.raises(Exception, match="more than 9 members of"):
        registers.ids_of(df, "o", "m", most=9).collect()
