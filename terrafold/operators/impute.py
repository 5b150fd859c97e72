"""Imputation with provenance: every filled value says where it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import null_safe_join
from .selection import medians_by_and_of_all
from .windows import fill_both_ways

RENTS = ("median_rent", "median_rent_sqft")


def rent_missing(min_count: int):
    """A rent is missing if either value is NULL or too few contracts made it."""
    few = F.coalesce(F.col("rent_count"), F.lit(0)) < min_count
    return F.col(RENTS[0]).isNull() | F.col(RENTS[1]).isNull() | few


def impute_rents(panel: DataFrame, series: list[str], order: str, area: str, strategy: str = "tiered", min_count: int = 1) -> DataFrame:
    """Fill rents by tiers (I1), drop rows without (``drop``), or leave them.

    Tier 1: last, else next value of the series. Tier 2: the area's median of
    observed rows. Tier 3: the median of all observed rows. Adds
    ``rent_imputed`` and ``rent_imputation_source``. The panel is read for what
    it has and again for its medians, so pass a written one.
    """
    if strategy not in ("tiered", "drop", "none"):
        raise ValueError(f"unknown strategy {strategy!r}")
    panel = panel.withColumn("_missing", rent_missing(min_count))
    if strategy != "tiered":
        kept = panel if strategy == "none" else panel.filter(~F.col("_missing"))
        return kept.withColumns({"rent_imputed": F.lit(0), "rent_imputation_source": F.lit(None).cast("string")}).drop("_missing")
    filled = panel.withColumns({f"_t1_{c}": fill_both_ways(c, series, order) for c in RENTS})
    areas, everywhere = medians_by_and_of_all(panel.filter(~F.col("_missing")).select(area, *RENTS), [area], RENTS, "_t2_{}", "_t3_{}")
    joined = null_safe_join(filled, areas, [area]).crossJoin(F.broadcast(everywhere))  # one row
    source = (
        F.when(~F.col("_missing"), None)
        .when(F.col(f"_t1_{RENTS[0]}").isNotNull() & F.col(f"_t1_{RENTS[1]}").isNotNull(), "group_ffill_bfill")
        .when(
            F.coalesce(f"_t1_{RENTS[0]}", f"_t2_{RENTS[0]}").isNotNull() & F.coalesce(f"_t1_{RENTS[1]}", f"_t2_{RENTS[1]}").isNotNull(), "area_median"
        )
        .otherwise("global_median")
    )
    out = joined.withColumn("rent_imputation_source", source).withColumn("rent_imputed", F.col("_missing").cast("int"))
    out = out.withColumns({c: F.coalesce(f"_t1_{c}", f"_t2_{c}", f"_t3_{c}") for c in RENTS})
    return out.drop("_missing", *[f"_t{t}_{c}" for t in (1, 2, 3) for c in RENTS])


def unfilled_rents(panel: DataFrame) -> int:
    """Rows still without a rent; a tiered run over observed data must have none."""
    return panel.filter(F.col(RENTS[0]).isNull() | F.col(RENTS[1]).isNull()).count()


def impute_median(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Group median, else median of all, else 0; with a flag per column."""
    own = [f"_group_{c}" for c in columns]
    groups, overall = medians_by_and_of_all(df.select(*keys, *columns), keys, columns, "_group_{}", "_all_{}")
    out = null_safe_join(df, groups, keys).crossJoin(F.broadcast(overall))  # one row
    flags = {f"{c}_missing": F.col(c).isNull().cast("int") for c in columns}
    filled = {c: F.coalesce(c, f"_group_{c}", f"_all_{c}", F.lit(0.0)) for c in columns}
    return out.withColumns(flags | filled).drop(*own, *[f"_all_{c}" for c in columns])


def zero_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL counts are 0 (I4)."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in columns})


def training_fill(df: DataFrame, series: list[str], order: str, prices: list[str], rents: list[str], categories: list[str]) -> DataFrame:
    """Last preparation (I6): prices both ways, rents 0 with an any-rent flag, infinities 0, categories UNKNOWN."""
    from pyspark.sql import Window

    whole = Window.partitionBy(*series)
    out = df.withColumns({c: fill_both_ways(c, series, order) for c in prices})
    if rents:
        out = out.withColumn("has_actual_rent", F.max((F.coalesce(F.col(rents[0]), F.lit(0.0)) > 0).cast("int")).over(whole))
    clean = {c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c)) for c in [*prices, *rents]}
    out = out.withColumns(clean).fillna(0.0, rents)
    return out.withColumns({c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("UNKNOWN")) for c in categories})
