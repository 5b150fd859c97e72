"""Serving statistics: developers, areas, rents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import months_apart
from .joins import fuzzy_best
from .registry import substring_hits


def developer_stats(projects: DataFrame) -> DataFrame:
    """Per developer: projects, completed, active, units, completion, duration.

    Active is everything but FINISHED, an unknown status too; a missing
    duration counts as 0 months of 30 days; rates are rounded half to even.
    """
    finished = F.col("project_status").eqNullSafe(F.lit("FINISHED"))
    length = F.coalesce(months_apart(F.col("project_end_date"), F.col("project_start_date"), 30), F.lit(0.0))
    df = projects.filter("developer_name is not null").groupBy("developer_name").agg(
        F.countDistinct("project_number").alias("projects_total"),
        F.count_if(finished).alias("projects_completed"),
        F.count_if(~finished).alias("projects_active"),
        F.coalesce(F.sum("no_of_units"), F.lit(0)).alias("total_units"),
        F.bround(F.coalesce(F.avg("percent_completed"), F.lit(0.0)), 1).alias("avg_completion_percent"),
        F.bround(F.avg(length), 1).alias("avg_duration_months"),
    )
    rate = F.bround(F.try_divide(F.col("projects_completed") * 100.0, F.col("projects_total")), 1)
    return df.withColumns({"completion_rate": rate, "avg_delay_months": F.lit(0)})


def area_stats(tx: DataFrame, projects: DataFrame | None = None, key: str = "area_name", date: str = "date", price: str = "price") -> DataFrame:
    """Per area: median now and its change over 12 and 36 months, count, supply.

    Windows of 3 months end at the last date of all rows; one pass over the
    table with conditional medians.
    """
    last = tx.agg(F.to_date(F.max(date)).alias("_last"))
    d = F.to_date(date)
    back = lambda m: F.add_months("_last", -m)
    value = F.col(price)
    joined = tx.crossJoin(F.broadcast(last))  # one row
    stats = joined.groupBy(key).agg(
        F.median(F.when(d >= back(3), value)).alias("now"),
        F.median(F.when((d >= back(15)) & (d < back(12)), value)).alias("then12"),
        F.median(F.when((d >= back(39)) & (d < back(36)), value)).alias("then36"),
        F.count_if(d >= back(12)).alias("transaction_count_12m"),
    )
    change = lambda c: F.when(F.col(c) > 0, (F.col("now") - F.col(c)) / F.col(c) * 100)
    out = stats.select(key, F.col("now").alias("current_median"), change("then12").alias("price_change_12m"), change("then36").alias("price_change_36m"), "transaction_count_12m")
    if projects is None:
        return out
    supply = projects.filter(~F.col("project_status").eqNullSafe(F.lit("FINISHED"))).groupBy(F.col("area_name").alias("_a")).agg(F.sum("no_of_units").alias("supply_pipeline"))
    return out.join(supply, F.col(key) == F.col("_a"), "left").drop("_a").withColumn("supply_pipeline", F.coalesce(F.col("supply_pipeline").cast("long"), F.lit(0)))


def rent_benchmarks(rents: DataFrame, keys: list[str], date: str, rent: str, area: str | None = None, months: int = 12) -> DataFrame:
    """Median and count of the last ``months`` before the last date."""
    last = rents.agg(F.to_date(F.max(date)).alias("_last"))
    recent = rents.crossJoin(F.broadcast(last)).filter(F.to_date(date) >= F.add_months("_last", -months))  # one row
    extra = [F.median(F.when(F.col(area) > 0, F.col(rent) / F.col(area))).alias("median_rent_sqft")] if area else []
    return recent.groupBy(*keys).agg(F.median(rent).alias("median_annual_rent"), F.count("*").alias("rent_count"), *extra)


def _either_way(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, matched): the least known name that holds the name or is held by it; two automata, no pairs."""
    holds = substring_hits(known, "known", names, "name").select("name", "known")
    held = substring_hits(names, "name", known, "known").select("name", "known")
    return holds.unionByName(held).groupBy("name").agg(F.min("known").alias("matched"))


def match_developers(requests: DataFrame, column: str, known: DataFrame, least: float = 60.0) -> DataFrame:
    """(name, matched, score, method) per distinct name (M15): exact, substring either way, best partial score of ``least``.

    ``known``: developer_name. Names without a match, empty ones and "unknown"
    have no row.
    """
    names = requests.select(F.col(column).alias("name")).filter((F.col("name") != "") & (F.lower("name") != "unknown")).distinct()
    have = known.select(F.col("developer_name").alias("known")).filter("known <> ''").distinct()
    exact = names.join(have, F.col("name") == F.col("known")).select("name", F.col("known").alias("matched"))
    left = names.join(exact.select("name"), "name", "left_anti")
    part = _either_way(left, have)
    left = left.join(part.select("name"), "name", "left_anti")
    near = fuzzy_best(left, "name", have, "known", least, "partial_ratio")
    with_method = lambda df, method: df.select("name", "matched", F.lit(100.0).alias("score"), F.lit(method).alias("method"))
    return with_method(exact, "exact").unionByName(with_method(part, "substring")).unionByName(near.select("name", F.col("known").alias("matched"), "score", F.lit("fuzzy").alias("method")))


def match_areas(requests: DataFrame, column: str, known: DataFrame, least: float = 70.0) -> DataFrame:
    """(name, matched, score, method) per distinct name (M9): exact but for case, else the best score of ``least``."""
    names = requests.select(F.col(column).alias("name")).filter("name <> ''").distinct()
    have = known.filter("area_name <> ''").groupBy(F.lower("area_name").alias("_key")).agg(F.min("area_name").alias("matched"))
    exact = names.join(have, F.lower("name") == F.col("_key")).select("name", "matched", F.lit(100.0).alias("score"), F.lit("exact").alias("method"))
    left = names.join(exact.select("name"), "name", "left_anti")
    near = fuzzy_best(left, "name", have, "matched", least)
    return exact.unionByName(near.select("name", "matched", "score", F.lit("fuzzy").alias("method")))


def rent_for(requests: DataFrame, areas: DataFrame, rents: DataFrame, least: float = 70.0) -> DataFrame:
    """Rent benchmark per request (M15): request_id, matched_area, median_annual_rent, rent_method.

    The request's area is matched with the known ``areas`` (exact or fuzzy); then
    the benchmark of that area and bedroom, else one of an area whose name
    contains it (``contains``; without a match the area as asked). Of several
    the least area's. ``requests``: request_id, area, bedroom.
    """
    upper = lambda c: F.upper(F.col(c))
    asked = requests.select("request_id", "area", upper("bedroom").alias("_b")).filter("area <> '' and _b is not null")
    table = rents.select("area_name", upper("area_name").alias("_a"), upper("bedrooms").alias("_rb"), "median_annual_rent").filter("_a <> ''")
    matches = match_areas(requests, "area", areas, least).select(F.col("name").alias("area"), "matched")
    asked = asked.join(matches, "area", "left").withColumn("_want", F.upper(F.coalesce("matched", "area")))
    one = table.groupBy("_a", "_rb").agg(F.min(F.struct("area_name", "median_annual_rent")).alias("r"))
    exact = asked.filter("matched is not null").join(one, (F.col("_want") == F.col("_a")) & (F.col("_b") == F.col("_rb"))).select("request_id", "r", F.lit(0).alias("step"))
    inside = substring_hits(table, "_a", asked, "_want")
    near = asked.join(inside, "_want").join(one.withColumnsRenamed({"_a": "_a1", "_rb": "_rb1"}), (F.col("_a") == F.col("_a1")) & (F.col("_b") == F.col("_rb1")))
    best = exact.unionByName(near.select("request_id", "r", F.lit(1).alias("step"))).groupBy("request_id").agg(F.min(F.struct("step", "r")).alias("m"))
    return best.select(
        "request_id", F.col("m.r.area_name").alias("matched_area"), F.col("m.r.median_annual_rent").alias("median_annual_rent"),
        F.when(F.col("m.step") == 0, "exact").otherwise("contains").alias("rent_method"),
    )


def lookups(requests: DataFrame, developers: DataFrame, areas: DataFrame, rents: DataFrame) -> DataFrame:
    """Requests with developer, area and rent statistics (M9, M15), and how each was found; per-sqm prices converted here."""
    from ..functions.measures import SQFT_A_SQM

    d = match_developers(requests, "developer", developers).select(F.col("name").alias("_dn"), F.col("matched").alias("_d"), F.struct("score", "method").alias("developer_audit"))
    stats = developers.groupBy(F.col("developer_name").alias("_dk")).agg(F.min(F.struct(*developers.columns)).alias("developer_stats"))
    a = match_areas(requests, "area", areas).select(F.col("name").alias("_an"), F.col("matched").alias("_a"), F.struct("score", "method").alias("area_audit"))
    facts = areas.groupBy(F.col("area_name").alias("_ak")).agg(F.min((F.col("current_median") / SQFT_A_SQM)).alias("area_median_sqft"), F.max("transaction_count_12m").alias("transaction_count_12m"))
    out = requests.join(d, F.col("developer") == F.col("_dn"), "left").join(stats, F.col("_d") == F.col("_dk"), "left")
    out = out.join(a, F.col("area") == F.col("_an"), "left").join(facts, F.col("_a") == F.col("_ak"), "left")
    rent = rent_for(requests, areas, rents).select("request_id", "median_annual_rent", "rent_method")
    out = out.join(rent, "request_id", "left").withColumn("rent_method", F.coalesce("rent_method", F.lit("none")))
    return out.drop("_dn", "_d", "_dk", "_an", "_a", "_ak")


def display_list(names: DataFrame, label: str, rank: str) -> DataFrame:
    """One label per key for lists (O8): best rank, then the longest, then the least."""
    from pyspark.sql import Window

    from ..functions.text import label_key

    w = Window.partitionBy("_key").orderBy(F.col(rank), F.length(label).desc(), F.col(label))
    keyed = names.withColumn("_key", label_key(F.col(label))).filter("_key <> ''")
    return keyed.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_key", "_rn")


def mapped_first(names: DataFrame, mapped: str, order: str) -> DataFrame:
    """Mapped rows first, then by name."""
    return names.orderBy(F.coalesce(F.col(mapped), F.lit("")) == "", F.col(order))
