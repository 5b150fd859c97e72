"""Queries of registers, id sets and reports, and of operators that no query above runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import aggregates, gates, impute, registers
from .queries import PANEL, RENT, TX, base_panel, query, table, transactions


def priced_orders(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey)


@query("registrations", """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, c_nationkey, count(*) AS registrations, round(median(o_totalprice), 4) AS median_worth,
  round(avg(c_acctbal), 8) AS mean_balance FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def registrations(spark, d):
    measures = {"median_worth": F.round(F.median("o_totalprice"), 4), "mean_balance": F.round(F.avg("c_acctbal"), 8)}
    return registers.registrations(priced_orders(spark, d), "o_orderdate", "c_nationkey", measures)


@query("id_set", "SELECT CAST(l_suppkey AS VARCHAR) AS id FROM lineitem UNION SELECT CAST(l_partkey AS VARCHAR) FROM lineitem")
def id_set(spark, d):
    return registers.id_set(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("union_names", "SELECT trim(n_name) AS name FROM nation UNION SELECT trim(r_name) FROM region UNION SELECT trim(p_brand) FROM part")
def union_names(spark, d):
    return registers.union_names((table(spark, d, "nation"), "n_name"), (table(spark, d, "region"), "r_name"), (table(spark, d, "part"), "p_brand"))


@query("ids_of_owner", "SELECT s_nationkey, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS ids FROM supplier GROUP BY 1")
def ids_of_owner(spark, d):
    out = registers.ids_of(table(spark, d, "supplier"), "s_nationkey", "s_suppkey")
    return out.select("s_nationkey", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


INDEX = """m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, min(CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_totalprice < 3000 THEN o_totalprice END) AS v FROM orders GROUP BY 1)"""


@query("month_index_fill", f"""WITH {INDEX} SELECT month, coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS v, CAST(v IS NULL AS INTEGER) AS v_missing FROM m""")
def month_index_fill(spark, d):
    rare = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") < 3000)
    rows = table(spark, d, "orders").select(F.to_date(F.trunc("o_orderdate", "month")).alias("month"), F.when(rare, F.col("o_totalprice")).alias("v"))
    return registers.fill_months(registers.constant_per_month(rows, "month", ["v"]), "month", ["v"])


@query("area_trend", f"""WITH {TX}, s AS (SELECT area, month, count(*) AS n FROM tx GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY month DESC) AS back FROM s),
  p AS (SELECT area, avg(CASE WHEN back <= 3 THEN n END) AS r, avg(CASE WHEN back BETWEEN 13 AND 15 THEN n END) AS y, max(back) AS rows FROM b WHERE back <= 15 GROUP BY 1)
  SELECT area, round(r, 6) AS recent_avg, round(y, 6) AS year_ago_avg, round((r / y - 1) * 100, 4) AS volume_trend FROM p WHERE rows >= 15""")
def area_trend(spark, d):
    per_series = transactions(spark, d).groupBy("area", "kind", "month").agg(F.count("*").alias("n"))
    out = registers.area_trend(per_series, "area", "month", "n")
    return out.select("area", F.round("recent_avg", 6).alias("recent_avg"), F.round("year_ago_avg", 6).alias("year_ago_avg"), F.round("volume_trend", 4).alias("volume_trend"))


@query("top_by_metric", """WITH v AS (SELECT o_custkey, sum(o_totalprice) AS value FROM orders GROUP BY 1)
  SELECT o_custkey, round(value, 2) AS value, CAST(row_number() OVER (ORDER BY round(value, 2) DESC, o_custkey) AS INTEGER) AS rank FROM v QUALIFY rank <= 25""")
def top_by_metric(spark, d):
    value = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return registers.top_by(value, "value", 25, "o_custkey")


@query("segmentation_audit", f"""WITH {TX}, c AS (SELECT brand, area, count(*) AS n FROM tx GROUP BY 1, 2),
  s AS (SELECT brand, max(n) AS top_n, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_values, round(max(n) / sum(n), 4) AS top_share FROM c GROUP BY 1)
  SELECT *, total AS rows FROM s WHERE total >= 200 AND top_share < 0.85""")
def segmentation_audit(spark, d):
    return registers.segmentation_audit(transactions(spark, d), "brand", "area")


@query("rent_missingness", f"""WITH {TX}, {RENT}, {PANEL}, i AS (SELECT *, date_diff('month', DATE '1995-01-01', month) AS idx FROM panel)
  SELECT area, kind, count(*) AS n, count_if(median_rent IS NULL) AS missing_rows, round(avg(CASE WHEN median_rent IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate, count(*) <> max(idx) + 1 AS has_gaps FROM i GROUP BY 1, 2""")
def rent_missingness(spark, d):
    idx = ((F.year("month") - 1995) * 12 + F.month("month") - 1).cast("long")
    out = registers.rent_missingness(base_panel(spark, d).withColumn("idx", idx), ["area", "kind"], "idx", "median_rent")
    return out.withColumns({"missing_rate": F.round("missing_rate", 6), "missing_rows": F.col("missing_rows").cast("long")})


@query("segment_month_core", f"""WITH {TX}, b AS (SELECT month, area, kind, brand, count(*) AS n FROM tx GROUP BY 1, 2, 3, 4),
  m AS (SELECT month, area, kind, brand FROM b QUALIFY row_number() OVER (PARTITION BY month, area, kind ORDER BY n DESC, brand) = 1),
  g AS (SELECT month, area, kind, round(median(price), 8) AS median_price, count(l_orderkey) AS transaction_count, max(CASE WHEN handover < deal_day THEN 1 ELSE 0 END) AS flipped FROM tx GROUP BY 1, 2, 3)
  SELECT g.*, m.brand FROM g JOIN m USING (month, area, kind)""")
def segment_month_core(spark, d):
    rows = transactions(spark, d).withColumn("flipped", (F.col("handover") < F.col("deal_day")).cast("int"))
    out = aggregates.segment_month(rows, ["month", "area", "kind"], ["price"], "l_orderkey", flags=["flipped"], modes=["brand"])
    return out.withColumn("median_price", F.round("median_price", 8))


@query("training_fill", f"""WITH {TX}, {RENT}, {PANEL} SELECT area, kind, month, round(median_price, 8) AS median_price, round(coalesce(median_rent, 0), 8) AS median_rent,
  max(CASE WHEN coalesce(median_rent, 0) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY area, kind) AS has_actual_rent FROM panel""")
def training_fill(spark, d):
    out = impute.training_fill(base_panel(spark, d), ["area", "kind"], "time_idx", ["median_price"], ["median_rent", "median_rent_sqft"], ["kind"])
    return out.select("area", "kind", "month", F.round("median_price", 8).alias("median_price"), F.round("median_rent", 8).alias("median_rent"), "has_actual_rent")


@query("rent_drop_strategy", f"""WITH {TX}, {RENT}, {PANEL} SELECT area, kind, month, round(median_rent, 8) AS median_rent, rent_count FROM panel WHERE median_rent IS NOT NULL AND rent_count >= 2""")
def rent_drop_strategy(spark, d):
    kept = impute.impute_rents(base_panel(spark, d), ["area", "kind"], "time_idx", "area", strategy="drop", min_count=2)
    return kept.select("area", "kind", "month", F.round("median_rent", 8).alias("median_rent"), "rent_count")


@query("empty_labels", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def empty_labels(spark, d):
    labelled = table(spark, d, "orders").withColumn("label", F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderpriority")))
    return gates.empty_labels(labelled, "label").select("o_orderkey")


@query("unmapped_owners", """WITH v AS (SELECT l_suppkey AS developer_id, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1),
  t AS (SELECT *, row_number() OVER (ORDER BY value DESC, developer_id) AS r FROM v QUALIFY r <= 50)
  SELECT developer_id, value FROM t WHERE developer_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)
  AND (value >= 1e9 OR r <= 10 OR developer_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0))""")
def unmapped_owners(spark, d):
    value = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("developer_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    supplier = table(spark, d, "supplier")
    ids = lambda where: supplier.filter(where).select(F.col("s_suppkey").alias("developer_id"))
    return gates.unmapped_owners(value.withColumn("high_confidence", F.lit(True)), ids("s_acctbal > 5000"), ids("s_acctbal < 0")).select("developer_id", "value")
