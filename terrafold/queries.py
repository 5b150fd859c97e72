"""The operators on the driver's tables, each with the SQL that says the same.

A line item with its order is a transaction: month = order month, area = the
customer's nation, brand = the part's brand, kind = the part's type, size class
from the part's size, handover = ship date, unit price = extended price over
quantity. Orders of urgent priority play the sparse rents, event values the
daily rates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bedrooms, dates, measures, text
from .operators import aggregates, clean, forecast, gates, impute, joins, labels, registers, serving, sketches, windows
from .plans import macro, panel
from .sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The transaction view in SQL; the DataFrame one is ``transactions``.
TX = """tx AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus,
  CAST(o_orderdate AS DATE) AS deal_day, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(l_shipdate AS DATE) AS handover,
  c_nationkey AS area, p_brand AS brand, p_type AS kind, p_size AS size, o_orderpriority AS priority,
  CASE WHEN p_size <= 10 THEN 'Studio' WHEN p_size <= 20 THEN '1BR' WHEN p_size <= 30 THEN '2BR' WHEN p_size <= 40 THEN '3BR' ELSE '4BR' END AS bedroom,
  l_extendedprice / l_quantity AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""
RENT = """rent AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, c_nationkey AS area, median(o_totalprice) AS median_rent,
  count(*) AS rent_count, median(o_totalprice / 100) AS median_rent_sqft
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)"""
PANEL = """seg AS (SELECT month, area, kind, median(price) AS median_price, count(*) AS transaction_count FROM tx
  WHERE price BETWEEN 100 AND 50000 GROUP BY 1, 2, 3),
  panel AS (SELECT seg.*, median_rent, coalesce(rent_count, 0) AS rent_count, median_rent_sqft,
  CAST(row_number() OVER (PARTITION BY area, kind ORDER BY month) - 1 AS INTEGER) AS time_idx FROM seg LEFT JOIN rent USING (month, area))"""


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_class(c):
    return F.when(c <= 10, "Studio").when(c <= 20, "1BR").when(c <= 30, "2BR").when(c <= 40, "3BR").otherwise("4BR")


def transactions(spark: SparkSession, d: str) -> DataFrame:
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    customer, part = table(spark, d, "customer"), table(spark, d, "part")
    joined = (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .join(part, line.l_partkey == part.p_partkey)
    )
    return joined.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus",
        F.to_date("o_orderdate").alias("deal_day"), F.to_date(F.trunc("o_orderdate", "month")).alias("month"), F.to_date("l_shipdate").alias("handover"),
        F.col("c_nationkey").alias("area"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"),
        F.col("o_orderpriority").alias("priority"), size_class(F.col("p_size")).alias("bedroom"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )


def rent_table(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    urgent = orders.filter(F.col("o_orderpriority") == "1-URGENT")
    sparse = urgent.join(customer, orders.o_custkey == customer.c_custkey)
    rows = sparse.select(
        F.to_date(F.trunc("o_orderdate", "month")).alias("month"), F.col("c_nationkey").alias("area"), F.col("o_totalprice").alias("rent"), (F.col("o_totalprice") / 100).alias("rent_sqft")
    )
    return aggregates.rents(rows, ["month", "area"])


def base_panel(spark: SparkSession, d: str) -> DataFrame:
    return panel.segment_panel(transactions(spark, d), ["month", "area", "kind"], ["area", "kind"], rent_table(spark, d), ["month", "area"])


@query("segment_month_panel", f"""WITH {TX}, {RENT}, {PANEL},
  f AS (SELECT *, coalesce(last_value(median_rent IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(median_rent IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS t1,
    (median_rent IS NULL) AS miss FROM panel WINDOW w AS (PARTITION BY area, kind ORDER BY time_idx)),
  a AS (SELECT area, median(median_rent) AS t2 FROM panel WHERE median_rent IS NOT NULL GROUP BY area),
  g AS (SELECT median(median_rent) AS t3 FROM panel WHERE median_rent IS NOT NULL)
  SELECT f.area, kind, month, time_idx, round(median_price, 8) AS median_price, transaction_count,
    round(coalesce(t1, t2, t3), 8) AS median_rent, CAST(miss AS INTEGER) AS rent_imputed,
    CASE WHEN NOT miss THEN NULL WHEN t1 IS NOT NULL THEN 'group_ffill_bfill' WHEN t2 IS NOT NULL THEN 'area_median' ELSE 'global_median' END AS rent_imputation_source
  FROM f LEFT JOIN a ON f.area = a.area CROSS JOIN g""")
def segment_month_panel(spark, d):
    filled = impute.impute_rents(base_panel(spark, d), ["area", "kind"], "time_idx", "area")
    return filled.select(
        "area", "kind", "month", "time_idx", F.round("median_price", 8).alias("median_price"), "transaction_count",
        F.round("median_rent", 8).alias("median_rent"), "rent_imputed", "rent_imputation_source",
    )


tiered = """WITH {0}, {1}, {2} SELECT area, kind, count(*) AS n, count_if(median_rent IS NULL) AS missing_rows,
  round(avg(CASE WHEN median_rent IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM panel GROUP BY 1, 2""".format(TX, RENT, PANEL)


@query("missing_rates", tiered)
def missing_rates(spark, d):
    rates = aggregates.missing_rates(base_panel(spark, d), ["area", "kind"], F.col("median_rent").isNull())
    return rates.withColumns({"missing_rate": F.round("missing_rate", 6), "missing_rows": F.col("missing_rows").cast("long")})


@query("median_impute_flag", f"""WITH {TX}, {RENT}, {PANEL}, a AS (SELECT area, median(median_rent) AS m FROM panel GROUP BY 1), g AS (SELECT median(median_rent) AS m FROM panel)
  SELECT panel.area, kind, month, round(coalesce(median_rent, a.m, g.m, 0), 4) AS median_rent, CAST(median_rent IS NULL AS INTEGER) AS median_rent_missing
  FROM panel JOIN a ON panel.area = a.area CROSS JOIN g""")
def median_impute_flag(spark, d):
    filled = impute.impute_median(base_panel(spark, d), ["area"], ["median_rent"])
    return filled.select("area", "kind", "month", F.round("median_rent", 4).alias("median_rent"), "median_rent_missing")


@query("project_dedup", """SELECT l_orderkey, l_linenumber, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END, l_shipdate DESC NULLS LAST, l_quantity DESC NULLS LAST, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def project_dedup(spark, d):
    kept = clean.first_row(
        table(spark, d, "lineitem"),
        ["l_orderkey", "l_linenumber"],
        [(F.col("l_linestatus") == "F").asc(), F.col("l_shipdate").desc_nulls_last(), F.col("l_quantity").desc_nulls_last(), F.col("l_extendedprice").asc()],
    )
    return kept.select("l_orderkey", "l_linenumber", "l_linestatus", F.to_date("l_shipdate").alias("l_shipdate"), "l_quantity", "l_extendedprice")


@query("dominant_value", f"""WITH {TX}, c AS (SELECT area, brand, count(*) AS n FROM tx GROUP BY 1, 2)
  SELECT area, brand AS dominant_brand, n, CAST(total AS BIGINT) AS total FROM (SELECT *, sum(n) OVER (PARTITION BY area) AS total,
  row_number() OVER (PARTITION BY area ORDER BY n DESC, brand) AS rn FROM c) WHERE rn = 1""")
def dominant_value(spark, d):
    return aggregates.dominant(transactions(spark, d), ["area"], "brand")


@query("dominant_by_weight", f"""WITH {TX}, c AS (SELECT area, brand, sum(l_quantity) AS l_quantity FROM tx GROUP BY 1, 2)
  SELECT area, brand, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY l_quantity DESC, brand) AS rn FROM c) WHERE rn = 1""")
def dominant_by_weight(spark, d):
    return aggregates.dominant_by(transactions(spark, d), ["area"], "brand", "l_quantity")


@query("mode_agg", f"""WITH {TX}, c AS (SELECT area, kind, bedroom, count(*) AS n FROM tx GROUP BY 1, 2, 3)
  SELECT area, kind, bedroom FROM (SELECT *, row_number() OVER (PARTITION BY area, kind ORDER BY n DESC, bedroom) AS rn FROM c) WHERE rn = 1""")
def mode_agg(spark, d):
    return transactions(spark, d).groupBy("area", "kind").agg(aggregates.mode_of("bedroom").alias("bedroom"))


@query("top_k_per_key", f"""WITH {TX}, c AS (SELECT area, brand, count(*) AS n FROM tx GROUP BY 1, 2)
  SELECT area, brand, n, CAST(row_number() OVER (PARTITION BY area ORDER BY n DESC, brand) AS INTEGER) AS rank FROM c QUALIFY rank <= 5""")
def top_k_per_key(spark, d):
    return aggregates.top_k(transactions(spark, d), ["area"], "brand", 5)


@query("share_concentration", f"""WITH {TX}, c AS (SELECT brand, l_suppkey, count(*) AS n FROM tx GROUP BY 1, 2)
  SELECT brand, max(n) AS top_n, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_values, round(max(n) / sum(n), 4) AS top_share FROM c GROUP BY 1""")
def share_concentration(spark, d):
    return aggregates.top_share(transactions(spark, d), ["brand"], "l_suppkey")


ACTIVE = """months AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders),
  p AS (SELECT c_nationkey AS area, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS end_date, 1 AS units FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("active_supply_by_month", f"""WITH {ACTIVE} SELECT area, month, CAST(sum(units) AS BIGINT) AS units, count(*) AS projects FROM months JOIN p ON end_date IS NULL OR end_date > month GROUP BY 1, 2""")
def active_supply_by_month(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    months = orders.select(F.to_date(F.trunc("o_orderdate", "month")).alias("month"))
    projects = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("c_nationkey").alias("area"), F.when(F.col("o_orderstatus") != "O", F.to_date("o_orderdate")).alias("end_date"), F.lit(1).alias("units")
    )
    return joins.active_by_month(projects, months, ["area"], ["units"]).select("area", "month", F.col("units").cast("long").alias("units"), F.col("projects").cast("long").alias("projects"))


@query("started_cumulative", f"""WITH {TX}, m AS (SELECT brand, month, count(*) AS started, sum(l_quantity) AS units FROM tx GROUP BY 1, 2)
  SELECT brand, month, CAST(sum(started) OVER w AS BIGINT) AS started, round(sum(units) OVER w, 4) AS units FROM m WINDOW w AS (PARTITION BY brand ORDER BY month)""")
def started_cumulative(spark, d):
    tx = transactions(spark, d)
    out = joins.started_by_month(tx, ["brand"], "deal_day", {"started": F.lit(1), "units": F.col("l_quantity")})
    return out.select("brand", F.to_date("month").alias("month"), F.col("started").cast("long").alias("started"), F.round("units", 4).alias("units"))


@query("completions_schedule", f"""WITH {TX} SELECT CAST(date_trunc('month', handover) AS DATE) AS month, area, CAST(sum(1) AS BIGINT) AS units_completing FROM tx WHERE deal_day < handover GROUP BY 1, 2""")
def completions_schedule(spark, d):
    return joins.schedule(transactions(spark, d), "deal_day", "handover", ["area"], F.lit(1), "units_completing")


@query("rollup_context", f"""WITH {TX}, s AS (SELECT month, area, kind, median(price) AS m, count(*) AS n FROM tx GROUP BY 1, 2, 3)
  SELECT month, round(median(m), 4) AS market_median, CAST(sum(n) AS BIGINT) AS market_count FROM s GROUP BY 1""")
def rollup_context(spark, d):
    seg = transactions(spark, d).groupBy("month", "area", "kind").agg(F.median("price").alias("m"), F.count("*").alias("n"))
    return aggregates.median_of_medians(seg, ["month"], "m", "n", "market").withColumn("market_median", F.round("market_median", 4))


@query("star_context_join", f"""WITH {TX}, {RENT}, s AS (SELECT month, area, count(*) AS n FROM tx GROUP BY 1, 2)
  SELECT month, area, n_name AS area_name, r_name AS region, n, round(median_rent, 4) AS median_rent, coalesce(rent_count, 0) AS rent_count
  FROM s LEFT JOIN rent USING (month, area) LEFT JOIN nation ON area = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def star_context_join(spark, d):
    seg = transactions(spark, d).groupBy("month", "area").agg(F.count("*").alias("n"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("area"), F.col("n_name").alias("area_name"), F.col("n_regionkey").alias("r"))
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("region"))
    out = joins.star(seg, [(rent_table(spark, d), ["month", "area"]), (nation, ["area"]), (region, ["r"])], zero=["rent_count"])
    return out.select("month", "area", "area_name", "region", "n", F.round("median_rent", 4).alias("median_rent"), "rent_count")


@query("full_outer_months", """WITH a AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS orders FROM orders GROUP BY 1),
  b AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS ships FROM lineitem GROUP BY 1)
  SELECT month, orders, ships FROM a FULL JOIN b USING (month)""")
def full_outer_months(spark, d):
    a = table(spark, d, "orders").groupBy(F.to_date(F.trunc("o_orderdate", "month")).alias("month")).agg(F.count("*").alias("orders"))
    b = table(spark, d, "lineitem").groupBy(F.to_date(F.trunc("l_shipdate", "month")).alias("month")).agg(F.count("*").alias("ships"))
    return joins.full_outer(a, b, "month")


@query("two_stage_fallback_join", f"""WITH {TX}, a AS (SELECT l_suppkey, kind, brand, count(*) n FROM tx WHERE priority = '1-URGENT' AND l_returnflag = 'R' GROUP BY 1, 2, 3), a1 AS (SELECT l_suppkey || '/' || kind AS key, brand FROM a QUALIFY row_number() OVER (PARTITION BY l_suppkey, kind ORDER BY n DESC, brand) = 1),
  b AS (SELECT area, kind, brand, count(*) n FROM tx WHERE l_linestatus = 'F' GROUP BY 1, 2, 3), b1 AS (SELECT area || '/' || kind AS key, brand FROM b QUALIFY row_number() OVER (PARTITION BY area, kind ORDER BY n DESC, brand) = 1)
  SELECT coalesce(a1.brand, b1.brand) AS value, CASE WHEN a1.brand IS NOT NULL THEN 'supplier' WHEN b1.brand IS NOT NULL THEN 'area' END AS source, count(*) AS n
  FROM tx LEFT JOIN a1 ON l_suppkey || '/' || kind = a1.key LEFT JOIN b1 ON area || '/' || kind = b1.key GROUP BY 1, 2""")
def two_stage_fallback_join(spark, d):
    tx = transactions(spark, d).withColumns({"supplier": F.concat_ws("/", "l_suppkey", "kind"), "place": F.concat_ws("/", "area", "kind")})
    first = aggregates.dominant(tx.filter("priority = '1-URGENT' and l_returnflag = 'R'"), ["supplier"], "brand", "value").select(F.col("supplier").alias("key"), "value")
    second = aggregates.dominant(tx.filter("l_linestatus = 'F'"), ["place"], "brand", "value").select(F.col("place").alias("key"), "value")
    out = joins.fallback(tx.select("supplier", "place"), [(first, "supplier", "supplier"), (second, "place", "area")], "value", "source")
    return out.groupBy("value", "source").agg(F.count("*").alias("n"))


DAILY = """daily AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2),
  sparse AS (SELECT event_type, day, CASE WHEN day(day) % 4 = 0 THEN NULL ELSE v END AS v FROM daily)"""


def daily(spark, d, sparse: bool = False) -> DataFrame:
    out = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return out.withColumn("v", F.when(F.dayofmonth("day") % 4 != 0, F.col("v"))) if sparse else out


@query("interior_gap_fill", f"""WITH {DAILY}, e AS (SELECT *, min(CASE WHEN v IS NOT NULL THEN day END) OVER (PARTITION BY event_type) AS lo, max(CASE WHEN v IS NOT NULL THEN day END) OVER (PARTITION BY event_type) AS hi,
  last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM sparse)
  SELECT event_type, day, round(CASE WHEN day BETWEEN lo AND hi THEN f ELSE 0 END, 6) AS v, CAST(v IS NULL AS INTEGER) AS v_missing FROM e""")
def interior_gap_fill(spark, d):
    out = windows.fill_interior(daily(spark, d, sparse=True), ["v"], ["event_type"], "day")
    return out.select("event_type", "day", F.round("v", 6).alias("v"), "v_missing")


@query("lag_diff_pct", f"""WITH {DAILY} SELECT event_type, day, round(v - lag(v, 3) OVER w, 6) AS diff, round((v / nullif(lag(v, 5) OVER w, 0) - 1) * 100, 6) AS pct FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day)""")
def lag_diff_pct(spark, d):
    k = ["event_type"]
    return daily(spark, d).select("event_type", "day", F.round(windows.difference("v", 3, k, "day"), 6).alias("diff"), F.round(windows.percent_change("v", 5, k, "day"), 6).alias("pct"))


@query("rolling_std_full_window", f"""WITH {DAILY} SELECT event_type, day, CASE WHEN count(v) OVER w = 7 THEN round(stddev_samp(v) OVER w, 6) END AS vol FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling_std_full_window(spark, d):
    return daily(spark, d).select("event_type", "day", F.round(windows.rolling_std("v", 7, ["event_type"], "day"), 6).alias("vol"))


@query("monthly_last_value", f"""WITH {TX}, p AS (SELECT area, deal_day, avg(price) AS v FROM tx GROUP BY 1, 2)
  SELECT area, CAST(date_trunc('month', deal_day) AS DATE) AS month, round(avg(v), 6) AS mean_v, round(arg_max(v, deal_day), 6) AS last_v FROM p GROUP BY 1, 2""")
def monthly_last_value(spark, d):
    per = transactions(spark, d).groupBy("area", "deal_day").agg(F.avg("price").alias("v"))
    out = macro.monthly(per.withColumn("w", F.col("v")), "deal_day", means=["v"], last=["w"], keys=["area"])
    return out.select("area", F.col("year_month").alias("month"), F.round("v", 6).alias("mean_v"), F.round("w", 6).alias("last_v"))


SERIES = f"{TX}, s AS (SELECT area, month, median(price) AS v, count(*) AS n FROM tx GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY month DESC) AS back FROM s)"


def series(spark, d) -> DataFrame:
    return transactions(spark, d).groupBy("area", "month").agg(F.median("price").alias("v"), F.count("*").alias("n"))


@query("momentum_trend", f"""WITH {SERIES}, p AS (SELECT area, max(CASE WHEN back = 1 THEN v END) v1, max(CASE WHEN back = 4 THEN v END) v4, max(CASE WHEN back = 7 THEN v END) v7, max(CASE WHEN back = 13 THEN v END) v13, max(back) AS n FROM b GROUP BY 1),
  c AS (SELECT area, (v1 / v4 - 1) * 100 AS c3, (v1 / v7 - 1) * 100 AS c6, (v1 / v13 - 1) * 100 AS c12 FROM p WHERE n >= 13)
  SELECT area, round(c3, 4) AS change_3m, round(c6, 4) AS change_6m, round(c12, 4) AS change_12m, CASE WHEN c3 > c6 / 2 + 2 THEN 'accelerating' WHEN c3 < c6 / 2 - 2 THEN 'decelerating' ELSE 'stable' END AS trend FROM c""")
def momentum_trend(spark, d):
    out = windows.momentum(series(spark, d), ["area"], "month", "v")
    return out.withColumns({f"change_{m}m": F.round(f"change_{m}m", 4) for m in (3, 6, 12)})


@query("recent_vs_year_ago", f"""WITH {SERIES} SELECT area, round(r, 6) AS recent_avg, round(y, 6) AS year_ago_avg, round((r / y - 1) * 100, 4) AS volume_trend FROM (
  SELECT area, avg(CASE WHEN back <= 3 THEN n END) AS r, avg(CASE WHEN back BETWEEN 13 AND 15 THEN n END) AS y, max(back) AS rows FROM b GROUP BY 1) WHERE rows >= 15""")
def recent_vs_year_ago(spark, d):
    out = windows.volume_trend(series(spark, d), ["area"], "month", "n")
    return out.select("area", F.round("recent_avg", 6).alias("recent_avg"), F.round("year_ago_avg", 6).alias("year_ago_avg"), F.round("volume_trend", 4).alias("volume_trend"))


@query("latest_per_series", f"WITH {SERIES} SELECT area, month, round(v, 8) AS v, n FROM b WHERE back = 1")
def latest_per_series(spark, d):
    return windows.latest(series(spark, d), ["area"], "month").withColumn("v", F.round("v", 8))


@query("history_tail", f"WITH {SERIES} SELECT area, month, round(v, 8) AS v, n FROM b WHERE back <= 24")
def history_tail(spark, d):
    return windows.tail(series(spark, d), ["area"], "month", 24).withColumn("v", F.round("v", 8))


@query("tail_aggregates", f"WITH {SERIES} SELECT area, CAST(sum(n) AS BIGINT) AS recent, round(avg(n), 6) AS recent_mean FROM b WHERE back <= 6 GROUP BY 1")
def tail_aggregates(spark, d):
    return windows.tail_sum(series(spark, d), ["area"], "month", "n", 6, "recent").withColumn("recent_mean", F.round("recent_mean", 6))


@query("level_change", f"WITH {SERIES} SELECT area, round(max(CASE WHEN back = 1 THEN v END) - max(CASE WHEN back = 6 THEN v END), 4) AS change FROM b GROUP BY 1")
def level_change(spark, d):
    return windows.change_at(series(spark, d), ["area"], "month", "v", 6, "change", percent=False).withColumn("change", F.round("change", 4))


@query("running_month_exclusion", f"""WITH {SERIES}, c AS (SELECT *, count(*) OVER (PARTITION BY area) AS k FROM s) SELECT area, max(month) AS last_month, count(*) AS rows FROM c WHERE NOT (month = DATE '2001-08-01' AND k >= 4) GROUP BY 1""")
def running_month_exclusion(spark, d):
    out = windows.drop_running_month(series(spark, d), ["area"], "month", F.lit("2001-08-15").cast("date"))
    return out.groupBy("area").agg(F.max("month").alias("last_month"), F.count("*").alias("rows"))


@query("series_gaps", f"""WITH {TX}, g AS (SELECT area, brand, kind, count(DISTINCT month) AS rows, max(date_diff('month', DATE '1995-01-01', month)) AS last FROM tx GROUP BY 1, 2, 3)
  SELECT area, brand, kind, rows, last FROM g WHERE rows <> last + 1""")
def series_gaps(spark, d):
    idx = ((F.year("month") - 1995) * 12 + F.month("month") - 1).cast("long")
    rows = transactions(spark, d).select("area", "brand", "kind", idx.alias("idx")).distinct()
    return windows.gaps(rows, ["area", "brand", "kind"], "idx")


@query("series_length_classes", f"""WITH {TX}, n AS (SELECT area, brand, count(DISTINCT month) AS n FROM tx GROUP BY 1, 2) SELECT count(*) AS series, count_if(n < 12) AS lt12, count_if(n < 24) AS lt24, count_if(n >= 24) AS ge24 FROM n""")
def series_length_classes(spark, d):
    return windows.length_classes(transactions(spark, d).select("area", "brand", "month").distinct(), ["area", "brand"])


@query("train_cutoff", f"""WITH {SERIES}, i AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY month) - 1 AS time_idx FROM s) SELECT area, count(*) AS rows FROM i WHERE time_idx <= (SELECT max(time_idx) FROM i) - 12 GROUP BY 1""")
def train_cutoff(spark, d):
    indexed = windows.series_index(series(spark, d), ["area"], ["month"])
    return windows.train_rows(indexed, "time_idx", 12).groupBy("area").agg(F.count("*").alias("rows"))


@query("walk_forward_folds", f"""WITH {SERIES}, f(fold, fold_end) AS (VALUES (0, DATE '1998-12-01'), (1, DATE '1999-12-01'), (2, DATE '2000-12-01')) SELECT fold, fold_end, count(*) AS rows, round(avg(v), 4) AS mean_v FROM s JOIN f ON month <= fold_end GROUP BY 1, 2""")
def walk_forward_folds(spark, d):
    out = windows.folds(series(spark, d), "month", ["1998-12-01", "1999-12-01", "2000-12-01"])
    return out.groupBy("fold", "fold_end").agg(F.count("*").alias("rows"), F.round(F.avg("v"), 4).alias("mean_v"))


@query("quarters_to_months", """WITH q AS (SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, count(*) AS n FROM orders GROUP BY 1, 2)
  SELECT CAST(make_date(y, 3 * q - 2 + CAST(k AS BIGINT), 1) AS DATE) AS month, n FROM q, generate_series(0, 2) AS g(k)""")
def quarters_to_months(spark, d):
    q = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("q")).agg(F.count("*").alias("n"))
    return windows.quarters_to_months(q, "y", "q").select("month", "n")


@query("future_rows", f"""WITH {SERIES}, r AS (SELECT area, avg(n) AS n, max(month) AS last FROM b WHERE back <= 6 GROUP BY 1), l AS (SELECT area, v FROM b WHERE back = 1)
  SELECT area, CAST(k AS INTEGER) AS step, CAST(last + to_months(CAST(k AS INTEGER)) AS DATE) AS month, round(n, 6) AS n, round(v, 8) AS v, round(sin(2 * pi() * month(last + to_months(CAST(k AS INTEGER))) / 12), 9) AS month_sin FROM r JOIN l USING (area), generate_series(1, 12) AS g(k)""")
def future_rows(spark, d):
    out = windows.future_rows(series(spark, d), ["area"], "month", 12, means=["n"], carry=["v"])
    return out.select("area", "step", "month", F.round("n", 6).alias("n"), F.round("v", 8).alias("v"), F.round("month_sin", 9).alias("month_sin"))


@query("windowed_period_change", f"""WITH {TX}, m AS (SELECT max(deal_day) AS last FROM tx), w AS (SELECT area, price, deal_day, last FROM tx, m),
  g AS (SELECT area, median(price) FILTER (deal_day >= last - INTERVAL 3 MONTH) AS now, median(price) FILTER (deal_day >= last - INTERVAL 15 MONTH AND deal_day < last - INTERVAL 12 MONTH) AS t12,
    median(price) FILTER (deal_day >= last - INTERVAL 39 MONTH AND deal_day < last - INTERVAL 36 MONTH) AS t36, count(*) FILTER (deal_day >= last - INTERVAL 12 MONTH) AS transaction_count_12m FROM w GROUP BY 1)
  SELECT area, round(now, 4) AS current_median, round((now - t12) / t12 * 100, 4) AS price_change_12m, round((now - t36) / t36 * 100, 4) AS price_change_36m, transaction_count_12m FROM g""")
def windowed_period_change(spark, d):
    out = serving.area_stats(transactions(spark, d), key="area", date="deal_day", price="price")
    return out.withColumns({c: F.round(c, 4) for c in ("current_median", "price_change_12m", "price_change_36m")})


@query("benchmark_12m", f"""WITH {TX}, m AS (SELECT max(deal_day) AS last FROM tx) SELECT area, bedroom, round(median(l_extendedprice), 4) AS median_annual_rent, count(*) AS rent_count FROM tx, m WHERE deal_day >= last - INTERVAL 12 MONTH GROUP BY 1, 2""")
def benchmark_12m(spark, d):
    out = serving.rent_benchmarks(transactions(spark, d), ["area", "bedroom"], "deal_day", "l_extendedprice")
    return out.withColumn("median_annual_rent", F.round("median_annual_rent", 4))


@query("trailing_12m_metrics", f"""WITH {TX}, m AS (SELECT date_trunc('month', max(deal_day)) - INTERVAL 11 MONTH AS cut FROM tx) SELECT l_suppkey, count(*) AS tx_all, round(sum(l_extendedprice), 2) AS value_all,
  count(*) FILTER (month >= cut) AS tx_recent, round(coalesce(sum(l_extendedprice) FILTER (month >= cut), 0), 2) AS value_recent FROM tx, m GROUP BY 1""")
def trailing_12m_metrics(spark, d):
    out = aggregates.trailing_metrics(transactions(spark, d), "l_suppkey", "deal_day", "l_extendedprice")
    return out.withColumns({c: F.round(c, 2) for c in ("value_all", "value_recent")})


@query("conditional_counts", """SELECT CAST(o_custkey % 50 AS BIGINT) AS developer, count(DISTINCT o_orderkey) AS total, count_if(o_orderstatus = 'F') AS completed, count_if(o_orderstatus IS DISTINCT FROM 'F') AS active,
  round(count_if(o_orderstatus = 'F') * 100.0 / count(DISTINCT o_orderkey), 4) AS rate FROM orders GROUP BY 1""")
def conditional_counts(spark, d):
    done = F.col("o_orderstatus").eqNullSafe(F.lit("F"))
    out = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("developer")).agg(
        F.countDistinct("o_orderkey").alias("total"), F.count_if(done).alias("completed"), F.count_if(~done).alias("active")
    )
    return out.withColumn("rate", F.round(F.col("completed") * 100.0 / F.col("total"), 4))


@query("crosstab", """SELECT o_orderstatus, count_if(o_orderpriority = '1-URGENT') AS "1-URGENT", count_if(o_orderpriority = '2-HIGH') AS "2-HIGH" FROM orders WHERE true GROUP BY 1""")
def crosstab(spark, d):
    return aggregates.cross_tab(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("pivot_flags", f"""WITH {TX}, p AS (SELECT area, brand, count_if(l_linestatus = 'O') AS "O", count_if(l_linestatus = 'F') AS "F" FROM tx GROUP BY 1, 2) SELECT area, brand, "O", "F", ("F" = 0) AS only_open FROM p""")
def pivot_flags(spark, d):
    tx = transactions(spark, d)
    p = aggregates.cross_tab(tx, ["area", "brand"], "l_linestatus", ["O", "F"])
    return p.withColumn("only_open", F.col("F") == 0)


@query("column_profile", """SELECT 'l_quantity' AS "column", count(*) AS rows, count_if(l_quantity IS NULL) AS nulls, least(count(DISTINCT l_quantity), 10000) AS "distinct", round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std FROM lineitem
  UNION ALL SELECT 'l_discount', count(*), count_if(l_discount IS NULL), least(count(DISTINCT l_discount), 10000), round(avg(l_discount), 4), round(stddev_samp(l_discount), 4) FROM lineitem
  UNION ALL SELECT 'l_orderkey', count(*), count_if(l_orderkey IS NULL), least(count(DISTINCT l_orderkey), 10000), round(avg(l_orderkey), 4), round(stddev_samp(l_orderkey), 4) FROM lineitem
  UNION ALL SELECT 'l_returnflag', count(*), count_if(l_returnflag IS NULL), least(count(DISTINCT l_returnflag), 10000), NULL, NULL FROM lineitem""")
def column_profile(spark, d):
    out = aggregates.profile(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_orderkey", "l_returnflag"])
    return out.select("column", "rows", "nulls", "distinct", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("capped_distinct", "SELECT least(count(DISTINCT l_partkey), 10000) AS n FROM lineitem")
def capped_distinct(spark, d):
    return sketches.distinct_counts(table(spark, d, "lineitem"), ["l_partkey"]).select(F.col("distinct").alias("n"))


@query("bucketize", """SELECT CASE WHEN o_totalprice >= 500000 THEN '500K-1M' WHEN o_totalprice >= 100000 THEN '100K-500K' ELSE '0-100K' END AS bucket, count(*) AS n FROM orders GROUP BY 1""")
def bucketize(spark, d):
    return table(spark, d, "orders").groupBy(measures.buckets(F.col("o_totalprice"), measures.PRICE_BUCKETS).alias("bucket")).agg(F.count("*").alias("n"))


@query("coverage_curve", f"""WITH {TX}, c AS (SELECT l_suppkey, count(*) AS n FROM tx GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, l_suppkey) AS k FROM c)
  SELECT CAST(p AS INTEGER) AS top_n, CAST(sum(n) FILTER (k <= p) AS BIGINT) AS covered_rows, CAST(sum(n) AS BIGINT) AS total_rows, round(sum(n) FILTER (k <= p) / sum(n), 6) AS coverage FROM r, (VALUES (10), (25), (50)) AS t(p) GROUP BY 1""")
def coverage_curve(spark, d):
    return aggregates.coverage_curve(transactions(spark, d), "l_suppkey", [10, 25, 50])


@query("label_dispersion", f"""WITH {TX}, c AS (SELECT brand, l_suppkey, count(*) AS n FROM tx GROUP BY 1, 2), s AS (SELECT brand, CAST(sum(n) AS BIGINT) AS tx, count(*) AS n_entities, round(max(n) / sum(n), 4) AS top_share FROM c GROUP BY 1),
  a AS (SELECT brand, count(DISTINCT area) AS n_areas FROM tx GROUP BY 1) SELECT * FROM s JOIN a USING (brand)""")
def label_dispersion(spark, d):
    return aggregates.label_dispersion(transactions(spark, d), "brand", "l_suppkey", "area")


@query("dispersion_gate", f"""WITH {TX}, c AS (SELECT brand, l_suppkey, count(*) AS n FROM tx GROUP BY 1, 2) SELECT brand, CAST(sum(n) AS BIGINT) AS tx, round(max(n) / sum(n), 4) AS top_share FROM c GROUP BY 1 HAVING sum(n) >= 100 AND count(*) >= 10 AND round(max(n) / sum(n), 4) <= 0.30 AND brand <> 'Brand#11'""")
def dispersion_gate(spark, d):
    out = gates.dispersed_labels(transactions(spark, d), "brand", "l_suppkey", "area", exempt=["Brand#11"], min_tx=100)
    return out.select("brand", "tx", "top_share")


SUPPLIER = """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN s_name || ' L.L.C' WHEN s_suppkey % 7 = 1 THEN s_name || ' Holding' WHEN s_suppkey % 7 = 2 THEN 'Palm Marina ' || s_suppkey
  WHEN s_suppkey % 7 = 3 THEN 'DMCC Authority' WHEN s_suppkey % 7 = 4 THEN '' ELSE s_name END AS name_en, CAST(s_suppkey AS VARCHAR) AS id, s_suppkey % 11 = 0 AS public, s_nationkey FROM supplier"""


def suppliers(spark, d) -> DataFrame:
    s, k = table(spark, d, "supplier"), F.col("s_suppkey") % 7
    name = (
        F.when(k == 0, F.concat("s_name", F.lit(" L.L.C"))).when(k == 1, F.concat("s_name", F.lit(" Holding"))).when(k == 2, F.concat(F.lit("Palm Marina "), "s_suppkey"))
        .when(k == 3, "DMCC Authority").when(k == 4, "").otherwise(F.col("s_name"))
    )
    return s.select("s_suppkey", name.alias("name_en"), F.col("s_suppkey").cast("string").alias("id"), (F.col("s_suppkey") % 11 == 0).alias("public"), "s_nationkey")


@query("suffix_leakage", f"""WITH s AS ({SUPPLIER}) SELECT name_en, 'LEGAL' AS source, CASE WHEN regexp_matches(name_en, '(?i)L\\.L\\.C') THEN 'SUFFIX' ELSE 'HOLDING' END AS leak, count(*) AS rows FROM s WHERE name_en LIKE '% L.L.C' OR name_en LIKE '% Holding' GROUP BY 1""")
def suffix_leakage(spark, d):
    return gates.suffix_leaks(suppliers(spark, d).withColumn("source", F.lit("LEGAL")), "name_en", "source")


@query("label_cascade", f"""WITH s AS ({SUPPLIER}) SELECT s_suppkey, CASE WHEN public THEN 'Public' WHEN s_suppkey % 7 = 3 THEN 'DEVELOPER_ID_' || id WHEN s_suppkey % 7 IN (2) THEN 'DEVELOPER_ID_' || id
  WHEN s_suppkey % 7 = 4 THEN 'DEVELOPER_ID_' || id ELSE trim(regexp_replace(replace(replace(name_en, ' L.L.C', ''), ' Holding', ''), '[^A-Za-z0-9_ ]', ' ', 'g')) END AS label,
  CASE WHEN public THEN 'PUBLIC_BRAND' WHEN s_suppkey % 7 = 3 THEN 'ID_FALLBACK_AUTHORITY' WHEN s_suppkey % 7 = 2 THEN 'ID_FALLBACK_SUSPICIOUS' WHEN s_suppkey % 7 = 4 THEN 'ID_FALLBACK' ELSE 'LEGAL_NORMALIZED_EN' END AS source FROM s""")
def label_cascade(spark, d):
    none = F.lit(None).cast("string")
    s = suppliers(spark, d).select(
        "s_suppkey", F.col("id").alias("developer_id"), F.when(F.col("public"), "Public").alias("brand_public"), none.alias("id_override"), none.alias("owner_override"),
        "name_en", none.alias("name_ar"), none.alias("umbrella"), F.lit(False).alias("umbrella_is_canonical"),
    )
    return labels.label_cascade(s).select("s_suppkey", F.col("developer_brand_label").alias("label"), F.col("developer_brand_label_source").alias("source"))


@query("canonical_id", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 4 = 2 THEN CAST(o_custkey AS VARCHAR) ELSE NULL END AS id FROM orders""")
def canonical_id(spark, d):
    k, key = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    raw = F.when(k == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit(".0"))).when(k == 1, F.concat(F.lit("A00"), key, F.lit("B7"))).when(k == 2, F.concat(F.lit(" 00"), key)).otherwise(F.lit("1.5"))
    return table(spark, d, "orders").select("o_orderkey", text.canonical_id(raw).alias("id"))


@query("norm_text", """SELECT p_partkey, upper(trim(regexp_replace(regexp_replace(p_name || ' - (' || p_brand || ')', '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS norm FROM part""")
def norm_text(spark, d):
    return table(spark, d, "part").select("p_partkey", text.norm_text(F.concat("p_name", F.lit(" - ("), "p_brand", F.lit(")"))).alias("norm"))


@query("tokens", """SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(trim(regexp_replace(p_name || '.' || p_type, '[^A-Za-z0-9_]+', ' ', 'g')), ' ')) AS token FROM part) WHERE token <> '' GROUP BY 1""")
def tokens(spark, d):
    t = table(spark, d, "part").select(F.explode(text.tokens(F.concat("p_name", F.lit("."), "p_type"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"))


@query("date_parse", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE quarter(o_orderdate) END AS INTEGER) AS quarter FROM orders""")
def date_parse(spark, d):
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, "32-01-2024").when(k == 1, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    day = dates.parse_flexible(raw)
    return table(spark, d, "orders").select("o_orderkey", day.alias("day"), F.quarter(day).alias("quarter"))


@query("phase_features", f"""WITH {TX} SELECT area, round(avg(date_diff('day', deal_day, handover) / 30.44), 6) AS signed, round(avg(greatest(date_diff('day', deal_day, handover) / 30.44, 0)), 6) AS ahead, CAST(sum(CASE WHEN abs(date_diff('day', deal_day, handover) / 30.44) <= 6 THEN 1 ELSE 0 END) AS BIGINT) AS near FROM tx GROUP BY 1""")
def phase_features(spark, d):
    tx = transactions(spark, d).select("area", *dates.phase_features(F.col("deal_day"), F.col("deal_day"), F.col("handover")))
    return tx.groupBy("area").agg(F.round(F.avg("months_to_handover_signed"), 6).alias("signed"), F.round(F.avg("months_to_handover"), 6).alias("ahead"), F.sum("near_handover").alias("near"))


@query("lifecycle_flip", f"""WITH {TX}, f AS (SELECT area, CASE WHEN l_linestatus = 'O' AND deal_day >= handover THEN 'Ready' WHEN l_linestatus = 'O' THEN 'OffPlan' ELSE 'Ready' END AS reg_type, l_linestatus = 'O' AND deal_day >= handover AS flip FROM tx)
  SELECT area, reg_type, count(*) AS n, CAST(sum(CAST(flip AS INTEGER)) AS BIGINT) AS flipped FROM f GROUP BY 1, 2""")
def lifecycle_flip(spark, d):
    reg = F.when(F.col("l_linestatus") == "O", "OffPlan").otherwise("Ready")
    tx = transactions(spark, d).select("area", *dates.lifecycle(reg, F.col("deal_day"), F.col("handover")))
    return tx.groupBy("area", "reg_type").agg(F.count("*").alias("n"), F.sum("offplan_after_handover").alias("flipped"))


@query("calendar_encodings", """SELECT DISTINCT CAST(month(o_orderdate) AS INTEGER) AS month, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, round(sin(2 * pi() * month(o_orderdate) / 12), 9) AS month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 9) AS month_cos FROM orders""")
def calendar_encodings(spark, d):
    m, q, s, c = dates.calendar_encodings(F.col("o_orderdate"))
    return table(spark, d, "orders").select(m, q, F.round(s, 9).alias("month_sin"), F.round(c, 9).alias("month_cos")).distinct()


WORDS = """w AS (SELECT doc_id, string_split(norm, ' ') AS ws FROM (SELECT doc_id, trim(regexp_replace(upper(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS norm FROM documents)),
  al(alias, brand, rank) AS (VALUES ('IDIOT', 'one word', 2), ('OF THE', 'two words', 1), ('THE', 'common', 3), ('TO THE', 'two words too', 4))"""


@query("alias_match_best", f"""WITH {WORDS}, r AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + n - 1], ' ') AS alias FROM w, generate_series(1, 2) AS g(n), unnest(range(1, len(ws) + 1)) AS u(i) WHERE i + n - 1 <= len(ws)),
  h AS (SELECT doc_id, alias, brand, rank, 1000 * len(string_split(alias, ' ')) + length(alias) AS score FROM r JOIN al USING (alias)),
  k AS (SELECT doc_id, count(DISTINCT brand) > 1 AS conflict FROM h GROUP BY 1)
  SELECT doc_id, alias, brand, CAST(score AS INTEGER) AS score, conflict FROM h JOIN k USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) = 1""")
def alias_match_best(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.upper("text").alias("text"))
    aliases = spark.createDataFrame([("IDIOT", "one word", 2), ("OF THE", "two words", 1), ("THE", "common", 3), ("TO THE", "two words too", 4)], "alias string, brand string, rank int")
    out = joins.alias_best(docs, "text", aliases, key=F.col("doc_id"))
    return out.select(F.col("text_id").cast("long").alias("doc_id"), "alias", "brand", "score", "conflict")


@query("alias_ambiguity", """WITH a AS (SELECT lower(trim(unnest(string_split(p_type || ', ' || p_brand, ',')))) AS alias, p_size % 5 AS area_name, p_size AS units FROM part), u AS (SELECT alias, area_name, sum(units) AS units FROM a WHERE alias <> '' GROUP BY 1, 2)
  SELECT alias, arg_min(area_name, (-units, area_name)) AS dominant, count(*) > 1 AS ambiguous FROM u GROUP BY 1""")
def alias_ambiguity(spark, d):
    ref = table(spark, d, "part").select((F.col("p_size") % 5).alias("area_name"), F.col("p_size").alias("total_units"), F.concat("p_type", F.lit(", "), "p_brand").alias("common_aliases"))
    return labels.area_aliases(ref).select("alias", "dominant", "ambiguous")


@query("segment_match_score", f"""WITH {TX}, s AS (SELECT DISTINCT CAST(area AS VARCHAR) AS area, kind, bedroom, brand, concat_ws('_', area, kind, bedroom, brand) AS g FROM tx),
  r AS (SELECT c_custkey AS request_id, CAST(c_nationkey AS VARCHAR) AS area, 'STANDARD' AS kind, '2BR' AS bedroom, 'Brand#' || (11 + c_custkey % 3) AS brand FROM customer),
  m AS (SELECT request_id, g, 40 + CASE WHEN s.bedroom = r.bedroom THEN 25 ELSE 0 END + CASE WHEN lower(s.kind) = lower(r.kind) THEN 15 ELSE 0 END + 10 + CASE WHEN s.brand = r.brand THEN 10 ELSE 0 END AS score FROM r JOIN s ON s.area = r.area)
  SELECT request_id, g AS group_id, CASE WHEN score >= 100 THEN 'exact' WHEN score >= 80 THEN 'partial_area_bedroom' WHEN score >= 55 THEN 'partial_area' ELSE 'area_only' END AS match_type,
  CAST(CASE WHEN score >= 100 THEN 95 WHEN score >= 80 THEN 75 WHEN score >= 55 THEN 60 ELSE 50 END AS DOUBLE) AS confidence FROM m QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, g) = 1""")
def segment_match_score(spark, d):
    s = transactions(spark, d).select(
        F.col("area").cast("string").alias("area"), F.col("kind").alias("property_type"), "bedroom", F.lit("Ready").alias("reg_type"), F.col("brand").alias("developer")
    ).distinct()
    s = s.withColumn("group_id", F.concat_ws("_", "area", "property_type", "bedroom", "developer"))
    customer = table(spark, d, "customer")
    r = customer.select(
        F.col("c_custkey").alias("request_id"), F.col("c_nationkey").cast("string").alias("area"), F.lit("STANDARD").alias("property_type"), F.lit("2BR").alias("bedroom"),
        F.lit("Ready").alias("reg_type"), F.concat(F.lit("Brand#"), 11 + F.col("c_custkey") % 3).alias("developer"),
    )
    return joins.segment_match(r, s)


REQUESTS = "SELECT o_orderkey, o_totalprice / 100 AS current_sqft, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 10 END AS current_rent, o_totalprice AS price, 12 AS horizon, 90.0 + o_custkey % 20 AS unit_sqft, 18 AS handover_months FROM orders"


def requests(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 100).alias("current_sqft"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") / 10).alias("current_rent"), F.col("o_totalprice").alias("price"),
        F.lit(12).alias("horizon"), (90.0 + F.col("o_custkey") % 20).alias("unit_sqft"), F.lit(18).alias("handover_months"), F.lit(None).cast("double").alias("area_median_sqft"),
    )


@query("fallback_forecast", f"""WITH r AS ({REQUESTS}) SELECT o_orderkey, round(current_sqft * power(1.01, 12), 4) AS sqft_median, round(current_sqft * power(1.01, 12) * 0.9, 4) AS sqft_low,
  round(CASE WHEN current_rent > 0 THEN current_rent * power(1 + 0.05 / 12, 12) ELSE price * 0.06 END, 4) AS rent_median FROM r""")
def fallback_forecast(spark, d):
    out = forecast.fallback_forecast(requests(spark, d))
    return out.select("o_orderkey", *[F.round(c, 4).alias(c) for c in ("sqft_median", "sqft_low", "rent_median")])


@query("cagr_extrapolate", f"""WITH r AS ({REQUESTS}) SELECT o_orderkey, round(current_sqft * power(power(1.01, 12), 24 / 12), 4) AS sqft_24m, round((power(power(1.01, 12), 24 / 12) - 1) * 100, 6) AS appreciation_24m FROM r""")
def cagr_extrapolate(spark, d):
    out = forecast.horizons(forecast.fallback_forecast(requests(spark, d)))
    return out.select("o_orderkey", F.round("sqft_median_24m", 4).alias("sqft_24m"), F.round("appreciation_24m", 6).alias("appreciation_24m"))


@query("investor_fields", f"""WITH r AS ({REQUESTS}) SELECT o_orderkey, 'series' AS anchor_source, round(current_sqft * power(1.01, 18) * unit_sqft / 1000, 1) AS handover_k, round(current_sqft * power(1.01, 30) * unit_sqft / 1000, 1) AS later_k FROM r""")
def investor_fields(spark, d):
    out = forecast.investor_fields(forecast.fallback_forecast(requests(spark, d)))
    # Totals are whole numbers; in thousands both engines round them alike.
    exact = [measures.extrapolate(F.col("anchor_sqft"), F.col("sqft_median"), F.col("horizon"), F.col("target_months") + m) * F.col("unit_sqft") / 1000 for m in (0, 12)]
    return out.select("o_orderkey", "anchor_source", F.round(exact[0], 1).alias("handover_k"), F.round(exact[1], 1).alias("later_k"))


@query("confidence_gate", """SELECT o_orderkey, CASE WHEN o_custkey % 100 >= 70 AND o_orderstatus <> 'P' THEN o_totalprice END AS shown, CAST(o_custkey % 100 >= 80 AS INTEGER) AS area_ok FROM orders""")
def confidence_gate(spark, d):
    level = (F.col("o_custkey") % 100).cast("double")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("shown"), level.alias("area_confidence"), level.alias("developer_confidence"), level.alias("model_confidence"),
        F.when(F.col("o_orderstatus") == "P", "area_only").otherwise("exact").alias("match_type"),
    )
    out = forecast.confidence_gate(rows, {"shown": "model"})
    return out.select("o_orderkey", "shown", F.col("area_trusted").cast("int").alias("area_ok"))


@query("set_difference", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01' EXCEPT SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01'")
def set_difference(spark, d):
    line = table(spark, d, "lineitem")
    return joins.new_keys(line.filter("l_shipdate >= timestamp '2001-06-01'"), line.filter("l_shipdate < timestamp '1995-06-01'"), "l_partkey")


@query("semi_anti_keys", """WITH w AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'), h AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW') SELECT count(*) AS wanted, count_if(o_custkey IN (SELECT o_custkey FROM h)) AS present FROM w""")
def semi_anti_keys(spark, d):
    orders = table(spark, d, "orders")
    return joins.key_presence(orders.filter("o_orderstatus = 'P'"), orders.filter("o_orderpriority = '5-LOW'"), ["o_custkey"])


@query("join_rate_audit", f"""WITH {TX}, {RENT}, j AS (SELECT tx.area, median_rent, CASE WHEN l_suppkey % 3 = 0 THEN 1 END AS s FROM tx LEFT JOIN rent USING (month, area))
  SELECT 'median_rent' AS channel, count(median_rent) AS matched, round(count(median_rent) / count(*), 6) AS rate FROM j UNION ALL SELECT 's', count(s), round(count(s) / count(*), 6) FROM j""")
def join_rate_audit(spark, d):
    j = transactions(spark, d).join(rent_table(spark, d), ["month", "area"], "left").withColumn("s", F.when(F.col("l_suppkey") % 3 == 0, 1))
    return joins.join_rates(j, ["median_rent", "s"]).withColumn("rate", F.round("rate", 6))


@query("learned_mapping", f"""WITH {TX}, c AS (SELECT area, kind, count(*) AS n FROM tx GROUP BY 1, 2), p AS (SELECT area, count(DISTINCT brand) AS projects FROM tx GROUP BY 1), b AS (SELECT area, arg_min(kind, (-n, kind)) AS kind, max(n) AS m, sum(n) AS t FROM c GROUP BY 1)
  SELECT b.area, kind, CAST(t AS BIGINT) AS tx, projects, round(m / t, 4) AS share, CASE WHEN round(m / t, 4) >= 0.18 AND projects >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM b JOIN p USING (area) WHERE t >= 30 AND round(m / t, 4) >= 0.1""")
def learned_mapping(spark, d):
    return labels.learned_mapping(transactions(spark, d), "area", "kind", "brand", 30, 0.1, 0.18, 5)


@query("spelling_conflicts", """WITH n AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) WHEN p_partkey % 3 = 1 THEN lower(p_type) ELSE p_type || '.' END AS name FROM part), c AS (SELECT trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9_ ]', '', 'g'), ' +', ' ', 'g')) AS key, name, count(*) AS n FROM n GROUP BY 1, 2)
  SELECT key, count(*) AS spellings, CAST(sum(n) AS BIGINT) AS rows, arg_min(name, (-n, name)) AS canonical FROM c GROUP BY 1 HAVING count(*) > 1""")
def spelling_conflicts(spark, d):
    k = F.col("p_partkey") % 3
    names = table(spark, d, "part").select(F.when(k == 0, F.upper("p_type")).when(k == 1, F.lower("p_type")).otherwise(F.concat("p_type", F.lit("."))).alias("name"))
    return labels.spelling_conflicts(names, "name")


@query("delta_report", """WITH c AS (SELECT l_partkey, round(sum(l_extendedprice), 2) AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01' GROUP BY 1),
  n AS (SELECT * FROM c WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01')), r AS (SELECT *, CAST(row_number() OVER (ORDER BY v DESC, l_partkey) AS INTEGER) AS k FROM n)
  SELECT l_partkey, v, CASE WHEN k <= 5 THEN k END AS rank FROM r""")
def delta_report(spark, d):
    line = table(spark, d, "lineitem")
    now = line.filter("l_shipdate >= timestamp '2001-01-01'").groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return gates.delta(now, line.filter("l_shipdate < timestamp '1995-06-01'"), "l_partkey", "v", top=5)


@query("polygon_centroid", """WITH p AS (SELECT p_partkey AS id, p_size * 1.0 AS s FROM part) SELECT id, round(s / 2, 6) AS lon, round(s, 6) AS lat, round(2 * s * s, 6) AS area FROM p""")
def polygon_centroid(spark, d):
    s = F.col("p_size").cast("double")
    points = F.array(*[F.struct((s * x).alias("lon"), (s * y).alias("lat")) for x, y in ((0, 0), (1, 0), (1, 2), (0, 2))])
    found = table(spark, d, "part").select(F.col("p_partkey").alias("id"), measures.polygon(points).alias("p"))
    return found.select("id", *[F.round(F.col(f"p.{c}"), 6).alias(c) for c in ("lon", "lat", "area")])


@query("bedroom_rules", """SELECT p_size, CASE WHEN p_size = 0 THEN 'Studio' WHEN p_size >= 6 THEN '6BR+' ELSE p_size || 'BR' END AS bedroom, CAST(least(p_size, 6) AS INTEGER) AS number FROM (SELECT DISTINCT p_size FROM part)""")
def bedroom_rules(spark, d):
    b = bedrooms.normalise(F.concat(F.col("p_size").cast("string"), F.lit(" bedrooms")))
    return table(spark, d, "part").select("p_size").distinct().select("p_size", b.alias("bedroom"), bedrooms.to_number(b).alias("number"))


@query("json_documents", """SELECT event_type, CAST(props->>'k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def json_documents(spark, d):
    return readers.json_column(table(spark, d, "events"), "props", "k long").groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("fuzzy_top1")
def fuzzy_top1(spark, d):
    typed = table(spark, d, "supplier").select(F.concat(F.lit("suplier "), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("name"))
    names = table(spark, d, "supplier").select(F.regexp_replace("s_name", "#", " ").alias("candidate"))
    return joins.fuzzy_best(typed, "name", names, "candidate", 70.0)


@query("similar_pairs")
def similar_pairs(spark, d):
    names = registers.union_names((table(spark, d, "part"), "p_name"), (table(spark, d, "nation"), "n_name"), (table(spark, d, "part"), "p_type"))
    return joins.similar_pairs(names, "name", 60.0)


from . import audit_queries, entity_queries, panel_queries, register_queries, report_queries  # noqa: E402, F401  (add their queries to those above)
