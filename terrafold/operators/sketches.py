"""Distinct values of all columns, exactly up to a cap, from sets that can be merged.

Per column a task keeps the ``cap`` least of its values' 64-bit hashes. Merged
sets are again the least hashes of all, so any number of tasks can be merged in
any order, in two steps, and no set is larger than ``cap``. With fewer hashes
than ``cap`` their number is the number of distinct values. With ``cap`` of
them the largest says how densely hashes lie, which gives an estimate of all
(its standard error is about 1 / sqrt(cap)).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAP, SAMPLES, MERGED = 10_000, 5, 64
_SETS = "column string, part int, hashes binary"


def _named(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def merged(sets: list[np.ndarray], cap: int) -> np.ndarray:
    """The ``cap`` least hashes of several sets."""
    return np.unique(np.concatenate(sets))[:cap] if sets else np.zeros(0, np.uint64)


def estimate(hashes: np.ndarray, cap: int) -> int:
    if len(hashes) < cap:
        return len(hashes)
    return round((len(hashes) - 1) / (float(hashes[-1]) / 2.0**64))


def distinct_counts(df: DataFrame, columns: list[str], cap: int = CAP) -> DataFrame:
    """(column, distinct, estimate): ``distinct`` stops at ``cap`` (A16), ``estimate`` goes on; nulls are no value."""
    hashed = df.select(*[F.when(_named(c).isNotNull(), F.xxhash64(_named(c))).alias(f"h{k}") for k, c in enumerate(columns)])
    n = len(columns)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = [np.zeros(0, np.uint64)] * n
        for batch in batches:
            for k in range(n):
                values = batch.column(k).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
                own[k] = merged([own[k], values], cap)
        part = TaskContext.get().partitionId() % MERGED
        yield pa.RecordBatch.from_arrays([pa.array(columns, pa.string()), pa.array([part] * n, pa.int32()), pa.array([x.tobytes() for x in own], pa.binary())], ["column", "part", "hashes"])

    def merge(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(b, np.uint64) for b in table["hashes"].to_pylist()]
        return pa.table({"column": table["column"][:1].combine_chunks(), "part": table["part"][:1].combine_chunks(), "hashes": pa.array([merged(sets, cap).tobytes()], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        hashes = np.frombuffer(merge(table)["hashes"][0].as_py(), np.uint64)
        return pa.table({"column": table["column"][:1].combine_chunks(), "distinct": pa.array([len(hashes)], pa.int64()), "estimate": pa.array([estimate(hashes, cap)], pa.int64())})

    sets = hashed.mapInArrow(gather, _SETS).groupBy("column", "part").applyInArrow(merge, _SETS)
    return sets.groupBy("column").applyInArrow(count, "column string, distinct long, estimate long")


def samples(df: DataFrame, columns: list[str], n: int = SAMPLES) -> DataFrame:
    """(column, samples): up to ``n`` distinct values of each column as text, the same ones in every run.

    They are the values of least hash under ``n`` hashes, one aggregate over the
    table; where one value is the least of several hashes there are fewer.
    """
    pick = lambda c, k: F.min(F.when(c.isNotNull(), F.struct(F.xxhash64(F.lit(k), c).alias("h"), c.cast("string").alias("v"))))["v"]
    rows = []
    for name in columns:
        c = _named(name)
        values = F.array(*[pick(c, k) for k in range(n)])
        rows.append(F.struct(F.lit(name).alias("column"), F.array_distinct(F.filter(values, lambda v: v.isNotNull())).alias("samples")))
    return df.agg(F.array(*rows).alias("s")).select(F.inline("s"))


def value_counts(df: DataFrame, columns: list[str], top: int) -> DataFrame:
    """(column, value, n, rank): the ``top`` most frequent values of each column, NULL one of them, least first on ties.

    One scan of the table, unpivoted; counts are combined before the shuffle,
    and the best of each of many buckets before the best of a column.
    """
    from pyspark.sql import Window

    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _named(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n"))
    order = [F.col("n").desc(), F.col("value").asc_nulls_last()]
    bucket = Window.partitionBy("column", F.pmod(F.xxhash64("value"), F.lit(MERGED))).orderBy(*order)
    few = counts.withColumn("rank", F.row_number().over(bucket)).filter(F.col("rank") <= top).drop("rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))).filter(F.col("rank") <= top)


def null_counts(df: DataFrame, top: int = 20) -> DataFrame:
    """(column, nulls): the ``top`` columns with most nulls (A30), by one aggregate with a value per column."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(_named(c).isNull()).alias("nulls")) for c in df.columns])
    return df.agg(rows.alias("r")).select(F.inline("r")).orderBy(F.col("nulls").desc(), "column").limit(top)


def group_cardinality(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Distinct values per column, the product that they would allow, and the groups there are (A30): (name, n)."""
    counts = [F.countDistinct(c).cast("decimal(38,0)").alias(c) for c in [*columns, key]]
    row = df.agg(*counts)
    product = F.lit(1).cast("decimal(38,0)")
    for c in columns:
        product = (product * F.col(c)).cast("decimal(38,0)")
    pairs = [F.struct(F.lit(f"unique_{c}").alias("name"), F.col(c).cast("long").alias("n")) for c in [*columns, key]]
    return row.select(F.inline(F.array(*pairs, F.struct(F.lit("upper_bound").alias("name"), product.cast("long").alias("n")))))
