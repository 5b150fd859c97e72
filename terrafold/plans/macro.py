"""Macro series: daily rates to months, visitors and inventory to months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins, windows
from ..sources.schemas import TENORS


def rate_features(daily: DataFrame, tenor: str = "3_month") -> DataFrame:
    """Filled daily rates with changes, momentum, slope and volatility.

    One series of a few thousand days; the windows' single partition is meant.
    """
    df = daily.withColumn("_s", F.lit(1))
    df = df.withColumns({t: windows.fill_forward(t, ["_s"], "date") for t in TENORS})
    k = (["_s"], "date")
    return df.withColumns(
        {
            **{f"change_{n}": windows.difference(tenor, n, *k) for n in (21, 63, 126, 252)},
            **{f"momentum_{n}": windows.percent_change(tenor, n, *k) for n in (63, 126, 252)},
            "slope_12m_3m": F.col("`12_month`") - F.col("`3_month`"),
            **{f"volatility_{n}": windows.rolling_std(tenor, n, *k) for n in (63, 252)},
        }
    ).drop("_s")


def monthly(daily: DataFrame, date: str, means: list[str], last: list[str], keys: list[str] = ()) -> DataFrame:
    """Means of some columns and the last known value of others per month."""
    known = [F.max_by(c, F.when(F.col(f"`{c}`").isNotNull(), F.col(date))).alias(c) for c in last]
    return daily.groupBy(*keys, F.to_date(F.trunc(date, "month")).alias("year_month")).agg(*[F.avg(f"`{c}`").alias(c) for c in means], *known)


def monthly_rates(features: DataFrame) -> DataFrame:
    """Mean rates, and the last known derived value of each month."""
    derived = [c for c in features.columns if c.startswith(("change_", "momentum_", "slope_", "volatility_"))]
    return monthly(features, "date", TENORS, derived)


def tourism(visitors: DataFrame, inventory: DataFrame) -> DataFrame:
    """Visitors and inventory by month (W25, J7): quarters spread over their months."""
    v = windows.quarters_to_months(visitors, "year", "quarter").groupBy("month").agg(F.sum("visitors_thousands").alias("visitors_total"))
    i = windows.quarters_to_months(inventory, "year", "quarter").groupBy("month").agg(F.max("num_hotel_rooms").alias("hotel_rooms"))
    return joins.full_outer(v, i, "month")


def fill_months(panel_months: DataFrame, macro: DataFrame, columns: list[str]) -> DataFrame:
    """Macro values on the panel's months, gaps filled inside only, then 0 with a flag."""
    grid = panel_months.select("month").distinct().join(macro, "month", "left").withColumn("_s", F.lit(1))
    return windows.fill_interior(grid, columns, ["_s"], "month").drop("_s")
