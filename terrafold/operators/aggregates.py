"""Aggregates: exact medians, dominant values, shares, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import exact_medians
from .sketches import CAP, distinct_counts, samples


def dominant(df: DataFrame, keys: list[str], value: str, out: str | None = None) -> DataFrame:
    """The most frequent non-null value per key, least on ties (A10).

    Counts come first (combined before the shuffle), so a hot key has as many
    rows as distinct values when the best is taken.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("v"))).alias("b")
    return counts.groupBy(*keys).agg(best, F.sum("n").alias("total")).select(
        *keys, F.col("b.v").alias(out or f"dominant_{value}"), (-F.col("b.less")).alias("n"), "total"
    )


def dominant_by(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The value with the largest total weight per key, least on ties."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    best = F.min(F.struct((-F.col("w")).alias("less"), F.col(value).alias("v"))).alias("b")
    return sums.groupBy(*keys).agg(best).select(*keys, F.col("b.v").alias(value), (-F.col("b.less")).alias(weight))


def mode_of(c: str | Column) -> Column:
    """Mode, the least on ties."""
    return F.mode(c, True)


def top_k(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """The ``k`` most frequent values per key with counts and ranks."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col(value))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_share(df: DataFrame, keys: list[str], value: str, digits: int = 4) -> DataFrame:
    """Share of the most frequent value per key (A14), with the number of values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(
        F.max("n").alias("top_n"), F.sum("n").alias("total"), F.count("*").alias("n_values"), F.round(F.max("n") / F.sum("n"), digits).alias("top_share")
    )


def segment_month(df: DataFrame, keys: list[str], medians: list[str], count: str, flags: list[str] = (), modes: list[str] = ()) -> DataFrame:
    """The panel's aggregate (A1, A2): exact medians, a count, any-flags, modes."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(
        *[F.median(c).alias(f"median_{c}") for c in medians],
        F.count(count).alias("transaction_count"),
        *[F.max(c).alias(c) for c in flags],
        *[mode_of(c).alias(c) for c in modes],
    )


def rents(df: DataFrame, keys: list[str] = ("year_month", "area_id", "bedroom")) -> DataFrame:
    """Median rent, number and median rent an area unit (A3)."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.median("rent").alias("median_rent"), F.count("rent").alias("rent_count"), F.median("rent_sqft").alias("median_rent_sqft")
    )


def median_of_medians(panel: DataFrame, keys: list[str], median: str, count: str, out: str) -> DataFrame:
    """Second-level grouping (A8): the median of medians, and the sum of counts."""
    return panel.groupBy(*keys).agg(F.median(median).alias(f"{out}_median"), F.sum(count).alias(f"{out}_count"))


def median_fill(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Every row with the median of its group (A33); NULL groups have one too."""
    return null_safe_join(df, exact_medians(df, keys, [column], "group_median_{}"), keys)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    names = [f"_{k}" for k in keys]
    right = right.withColumnsRenamed(dict(zip(keys, names)))
    return left.join(right, reduce(Column.__and__, [left[k].eqNullSafe(right[n]) for k, n in zip(keys, names)]), how).drop(*names)


def missing_rates(df: DataFrame, keys: list[str], missing: Column) -> DataFrame:
    """Rows, missing rows and rate per key."""
    flag = missing.cast("int")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(flag).alias("missing_rows"), F.avg(flag).alias("missing_rate"))


def cross_tab(df: DataFrame, rows: str | list[str], columns: str, values: list[str]) -> DataFrame:
    """Counts of ``columns``' stated values per ``rows`` (A23, A24), 0 where none."""
    return df.groupBy(*([rows] if isinstance(rows, str) else rows)).pivot(columns, values).count().fillna(0)


def coverage_curve(df: DataFrame, key: str, points: list[int]) -> DataFrame:
    """Share of all rows that the N most frequent keys hold.

    Keys are counted, then summed by their count, so the running sum goes over
    distinct counts, not over keys.
    """
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    levels = per_key.groupBy("n").agg(F.count("*").alias("keys"))
    above = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = levels.select(
        "n",
        "keys",
        F.coalesce(F.sum("keys").over(above), F.lit(0)).alias("keys_above"),
        F.coalesce(F.sum(F.col("keys") * F.col("n")).over(above), F.lit(0)).alias("rows_above"),
        F.sum(F.col("keys") * F.col("n")).over(every).alias("rows_total"),
    ).withColumn("top_n", F.explode(F.array(*[F.lit(p) for p in points])))
    taken = F.greatest(F.lit(0), F.least(F.col("keys"), F.col("top_n") - F.col("keys_above"))) * F.col("n")
    return steps.groupBy("top_n").agg(F.sum(taken).alias("covered_rows"), F.max("rows_total").alias("total_rows")).withColumn(
        "coverage", F.round(F.col("covered_rows") / F.col("total_rows"), 6)
    )


def profile(df: DataFrame, columns: list[str] | None = None, cap: int = CAP) -> DataFrame:
    """Per column: type, nulls, share of nulls, distinct (up to ``cap``), an estimate beyond, min, max, mean, std, samples.

    One aggregate of the whole table for all but the distinct values, which come
    from a second scan, see ``sketches``.
    """
    kinds = dict(df.dtypes)
    names = list(columns or df.columns)
    rows = []
    for c in names:
        col = F.col(f"`{c}`")
        numeric = kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or kinds[c].startswith("decimal")
        x = col.cast("double") if numeric else F.lit(None).cast("double")
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kinds[c]).alias("type"),
                F.count("*").alias("rows"),
                F.count_if(col.isNull()).alias("nulls"),
                F.coalesce(F.round(F.avg(col.isNull().cast("int")) * 100, 2), F.lit(0.0)).alias("null_pct"),
                F.min(col).cast("string").alias("min"),
                F.max(col).cast("string").alias("max"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
            )
        )
    facts = df.agg(F.array(*rows).alias("p")).select(F.inline("p"))
    return facts.join(distinct_counts(df, names, cap), "column").join(samples(df, names), "column")


def label_dispersion(df: DataFrame, label: str, entity: str, area: str) -> DataFrame:
    """Per label: rows, entities, share of the top entity, areas."""
    per = df.filter(F.col(label).isNotNull()).groupBy(label, entity).agg(F.count("*").alias("n"))
    spread = per.groupBy(label).agg(
        F.sum("n").alias("tx"), F.count(entity).alias("n_entities"), F.round(F.max("n") / F.sum("n"), 4).alias("top_share")
    )
    return spread.join(df.groupBy(label).agg(F.countDistinct(area).alias("n_areas")), label)


def trailing_metrics(df: DataFrame, key: str, month: str, value: str, months: int = 12) -> DataFrame:
    """All-time and trailing count and value per key (A21), up to the last month."""
    last = df.agg(F.trunc(F.max(month), "month").alias("last"))
    cut = F.add_months("last", 1 - months)
    recent = F.trunc(month, "month") >= cut
    return df.crossJoin(F.broadcast(last)).groupBy(key).agg(  # one row
        F.count("*").alias("tx_all"),
        F.sum(value).alias("value_all"),
        F.count_if(recent).alias("tx_recent"),
        F.coalesce(F.sum(F.when(recent, F.col(value))), F.lit(0.0)).alias("value_recent"),
    )
