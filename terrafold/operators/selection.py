"""Exact medians of any number of values, digit by digit.

A median as an aggregate holds every distinct value of its group in one task,
and the median of a whole table is one group. Here values are counted first
(distributed by key and value). A value's 64 bits, turned so that their order
is that of the numbers, are four digits of 16 bits. Per level the counts of the
next digit are summed for those values that agree so far with the one sought,
and a running sum over at most 65,536 digits says which digit holds its rank.
After four levels the digits are the value. Nothing but those sums meets in
one task, however large a group is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS, LEVELS = 16, 4
_LOW, _TOP = np.int64(0x7FFFFFFFFFFFFFFF), np.int64(-0x8000000000000000)


@F.pandas_udf(T.LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """Bits of a double that, read as an unsigned number, have the order of the doubles; NaN is the largest."""
    bits = (x.to_numpy(dtype=np.float64) + 0.0).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & _LOW) ^ _TOP)


@F.pandas_udf(T.DoubleType())
def from_ordered_bits(x: pd.Series) -> pd.Series:
    bits = x.to_numpy(dtype=np.int64) ^ _TOP
    return pd.Series((bits ^ ((bits >> 63) & _LOW)).view(np.float64))


def value_of(bits: str) -> Column:
    """The double of ordered bits that are not null; pandas has no NaN apart from null."""
    return F.coalesce(from_ordered_bits(bits), F.lit(float("nan")))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, nulls being equal; the right side's keys go."""
    names = {k: f"_r_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    return left.join(right, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])).drop(*names.values())


def digit_sums(counts: DataFrame, keys: Sequence[str], targets: DataFrame, level: int) -> DataFrame:
    """Per target the sums of ``n`` by the digit of ``level``, of values that agree with it up to there: all that a task gets."""
    shift = BITS * (LEVELS - 1 - level)
    digit = F.shiftrightunsigned("bits", shift).bitwiseAND((1 << BITS) - 1).alias("digit")
    if level == 0:
        sums = counts.groupBy(*keys, digit).agg(F.sum("n").alias("n"))
        return _same(sums, targets, keys)
    matched = _same(counts.withColumn("prefix", F.shiftrightunsigned("bits", shift + BITS)), targets, [*keys, "prefix"])
    return matched.groupBy(*keys, "rank", "left", "prefix", digit).agg(F.sum("n").alias("n"))


def exact_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "median_{}") -> DataFrame:
    """Median of each column per group of ``keys`` (null keys are a group): keys and ``name`` per column, NULL where it has no value.

    Columns are numbers and are read as doubles; nulls are left out.
    """
    keys = [*keys]
    taken = keys + ["_column"]
    pairs = F.array(*[F.struct(F.lit(k).alias("_column"), F.col(c).cast("double").alias("_value")) for k, c in enumerate(columns)])
    values = df.select(*keys, F.inline(pairs)).filter("_value is not null")
    counts = values.groupBy(*taken, "_value").agg(F.count("*").alias("n")).withColumn("bits", ordered_bits("_value")).drop("_value")
    total = counts.groupBy(*taken).agg(F.sum("n").alias("n"))
    ranks = F.array_distinct(F.array(F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")))
    targets = total.select(*taken, F.explode(ranks).alias("rank")).withColumns({"left": F.col("rank"), "prefix": F.lit(0).cast("long")})
    for level in range(LEVELS):
        so_far = Window.partitionBy(*taken, "rank").orderBy("digit")
        found = digit_sums(counts, taken, targets, level).withColumn("upto", F.sum("n").over(so_far))
        found = found.filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
        targets = found.select(
            *taken, "rank", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), F.shiftleft("prefix", BITS).bitwiseOR(F.col("digit")).alias("prefix")
        )
    chosen = targets.withColumn("_value", value_of("prefix"))

    def middle(k: int) -> Column:
        own = F.when(F.col("_column") == k, F.col("_value"))
        return F.when(F.min(own) == F.max(own), F.min(own)).otherwise(F.min(own) * 0.5 + F.max(own) * 0.5)

    return chosen.groupBy(*keys).agg(*[middle(k).alias(name.format(c)) for k, c in enumerate(columns)])


def medians_by_and_of_all(df: DataFrame, keys: Sequence[str], columns: Sequence[str], group: str, everything: str) -> tuple[DataFrame, DataFrame]:
    """Medians per group and those of all rows, from one selection: (keys and ``group``s, one row of ``everything``s)."""
    both = df.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_all"))
    both = both.withColumns({k: F.when(F.col("_all") == 0, F.col(k)) for k in keys})
    found = exact_medians(both, [*keys, "_all"], columns, "{}")
    per_group = found.filter("_all = 0").select(*keys, *[F.col(c).alias(group.format(c)) for c in columns])
    # An aggregate without keys has one row, also of nothing.
    whole = found.filter("_all = 1").agg(*[F.max(c).alias(everything.format(c)) for c in columns])
    return per_group, whole
