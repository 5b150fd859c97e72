"""Entry point B: a batch of structured requests to forecasts, trends and investor figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bedrooms, dates
from ..operators import forecast, joins, serving, windows


def conform(requests: DataFrame) -> DataFrame:
    """Requests with normal bedroom, registration type and handover."""
    months = F.coalesce("handover_months", dates.handover_months(F.coalesce("raw_query", F.lit("")), F.col("as_of")))
    df = requests.withColumns({"bedroom": bedrooms.normalise(F.col("bedroom")), "handover_months": months})
    return df.withColumns(
        {
            "reg_type": F.coalesce("reg_type", bedrooms.reg_type(F.col("raw_query"), F.col("handover_months"), F.col("developer")), F.lit("Ready")),
            "property_type": F.coalesce("property_type", F.lit("Unit")),
            "horizon": F.lit(12),
        }
    )


def trend_insights(panel: DataFrame) -> DataFrame:
    """Per series: momentum, rents, volume, completions (M5)."""
    key = ["group_id"]
    out = windows.latest(panel, key, "year_month").select("group_id", F.col("year_month").alias("data_as_of"), "supply_units", "active_projects")
    parts = [
        windows.momentum(panel, key, "year_month", "median_price"),
        windows.change_at(panel, key, "year_month", "median_rent", 12, "rent_change_12m"),
        windows.volume_trend(panel, key, "year_month", "transaction_count"),
        windows.tail_sum(panel, key, "year_month", "units_completing", 6, "units_completing_6m"),
        panel.groupBy("group_id").agg(F.count("*").alias("months_of_history")),
    ]
    for p in parts:
        out = out.join(p, key, "left")
    return out


def analyze(requests: DataFrame, panel: DataFrame, areas: DataFrame, developers: DataFrame, rents: DataFrame) -> DataFrame:
    """One row per request: match, forecast, horizons, investor figures, trends, gated."""
    asked = conform(requests)
    series = windows.latest(panel, ["group_id"], "year_month")
    matched = asked.join(joins.segment_match(asked, series), "request_id", "left")
    current = series.select(F.col("group_id").alias("_g"), F.col("median_price").alias("current_sqft"), F.col("median_rent").alias("current_rent"))
    df = matched.join(current, F.col("group_id") == F.col("_g"), "left").drop("_g").withColumnRenamed("confidence", "model_confidence")
    df = serving.lookups(df, developers, areas, rents)
    df = forecast.investor_fields(forecast.horizons(forecast.fallback_forecast(df)))
    known = lambda c, yes: F.when(F.col(c).isNotNull(), yes).otherwise(50.0)
    df = df.withColumns({"area_confidence": known("area_median_sqft", 100.0), "developer_confidence": known("developer_stats", 100.0)})
    df = df.join(trend_insights(panel), "group_id", "left")
    return forecast.confidence_gate(df, {"area_median_sqft": "area", "developer_stats": "developer", "sqft_median": "model", "sqft_low": "model", "sqft_high": "model"})
