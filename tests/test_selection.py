"""Exact medians digit by digit against Spark's own, and what a task gets."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from terrafold.operators import aggregates, impute, selection

NUMBERS = [0.0, -0.0, 1.5, -1.5, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 1.0000000000000002, 1.0, 3.0]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 400])
def test_equals_medians(spark, n):
    r = random.Random(n)
    make = lambda: r.choice([None, r.choice(NUMBERS[:8]), r.gauss(0, 1), r.gauss(0, 1e-9), float(r.randrange(5)), 10 ** r.uniform(-300, 300)])
    rows = [(r.choice(["a", "b", None]), r.choice([1, None]), make(), make()) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, j int, x double, y double")
    got = {(x["k"], x["j"]): (x["median_x"], x["median_y"]) for x in selection.exact_medians(df, ["k", "j"], ["x", "y"]).collect()}
    for key in {x[:2] for x in rows}:
        for at in (2, 3):
            values = [x[at] for x in rows if x[:2] == key and x[at] is not None]
            mine = got.get(key, (None, None))[at - 2]
            assert (mine is None) == (not values)
            if values:
                low, high = statistics.median_low(values), statistics.median_high(values)
                assert mine == (low if low == high else low * 0.5 + high * 0.5)


@pytest.mark.parametrize("value", NUMBERS)
def test_single_values_come_back(spark, value):
    df = spark.createDataFrame([(value,)] * 3, "x double")
    assert selection.exact_medians(df, [], ["x"]).first()[0] == value


def test_order_of_bits(spark):
    values = sorted({x + 0.0 for x in NUMBERS}) + [float("nan")]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", selection.ordered_bits("x").alias("b")).select("*", selection.value_of("b").alias("back")).collect()
    unsigned = [r["b"] & (2**64 - 1) for r in rows]
    assert unsigned == sorted(unsigned) and len(set(unsigned)) == len(values)
    assert all(r["x"] == r["back"] or math.isnan(r["x"]) and math.isnan(r["back"]) for r in rows)


def test_no_task_gets_more_than_the_digits(spark):
    """200,000 distinct values: the sums of a level are at most 65,536, and fewer values go on with every level."""
    df = spark.range(200_000).select((F.rand(3) * F.pow(F.lit(10.0), F.rand(4) * 6)).alias("x"))
    counts = df.groupBy(F.lit(0).alias("_column"), "x").agg(F.count("*").alias("n")).withColumn("bits", selection.ordered_bits("x"))
    counts = spark.createDataFrame(counts.select("_column", "n", "bits").toPandas())
    total = counts.agg(F.sum("n")).first()[0]
    targets = spark.createDataFrame([(0, (total + 1) // 2, (total + 1) // 2, 0)], "_column int, rank long, left long, prefix long")
    sizes = []
    for level in range(selection.LEVELS):
        sums = selection.digit_sums(counts, ["_column"], targets, level).orderBy("digit").collect()
        sizes.append(len(sums))
        left, upto = targets.first()["left"], 0
        for s in sums:
            if upto + s["n"] >= left:
                prefix = (targets.first()["prefix"] << 16 | s["digit"]) & (2**64 - 1)
                row = (0, (total + 1) // 2, left - upto, prefix - 2**64 * (prefix >= 2**63))
                targets = spark.createDataFrame([row], "_column int, rank long, left long, prefix long")
                break
            upto += s["n"]
    assert max(sizes) <= 65_536 and sizes[0] < 1000 and sizes[2] < 200
    values = sorted(x[0] for x in df.collect())
    assert targets.select(selection.value_of("prefix")).first()[0] == values[(total + 1) // 2 - 1]


def test_fills(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", None, 2), ("b", None, None), (None, 5.0, 9)], "k string, v double, w int")
    out = {(r["k"], r["v_missing"]): (r["v"], r["w"], r["w_missing"]) for r in impute.impute_median(df, ["k"], ["v", "w"]).collect()}
    assert out == {("a", 0): (1.0, 1.0, 0), ("a", 1): (1.0, 2.0, 0), ("b", 1): (3.0, 2.0, 1), (None, 0): (5.0, 9.0, 0)}
    assert impute.impute_median(df.limit(0), ["k"], ["v"]).count() == 0
    none = impute.impute_median(df.filter("v is null"), ["k"], ["v"]).collect()
    assert [r["v"] for r in none] == [0.0, 0.0]
    filled = aggregates.median_fill(df, ["k"], "v").collect()
    assert sorted((str(r["k"]), r["group_median_v"]) for r in filled if r["group_median_v"]) == [("None", 5.0), ("a", 1.0), ("a", 1.0)]
