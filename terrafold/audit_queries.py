"""Queries of profiles, snapshots, gates, walk-forward errors, trends and files, each through its library function."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import dates
from .operators import clean, forecast, gates, registers, sketches, snapshots
from .plans import analysis, panel
from .queries import PANEL, RENT, SERIES, TX, base_panel, query, rent_table, series, table, transactions
from .sources import readers, writers
from .sources.shared import scratch
from .streaming import monthly


@query("distinct_counts", """SELECT unnest(['l_orderkey', 'l_partkey', 'l_quantity', 'l_returnflag', 'none']) AS "column", unnest([least(count(DISTINCT l_orderkey), 10000), least(count(DISTINCT l_partkey), 10000), count(DISTINCT l_quantity), count(DISTINCT l_returnflag), 0]) AS "distinct" FROM lineitem""")
def distinct_counts(spark, d):
    lines = table(spark, d, "lineitem").withColumn("none", F.lit(None).cast("string"))
    return sketches.distinct_counts(lines, ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "none"]).select("column", "distinct")


@query("value_counts", """WITH p AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders
    UNION ALL SELECT 'urgent', CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority END FROM orders), c AS (SELECT "column", value, count(*) AS n FROM p GROUP BY 1, 2)
  SELECT "column", value, n, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS LAST) AS INTEGER) AS rank FROM c QUALIFY rank <= 15""")
def value_counts(spark, d):
    orders = table(spark, d, "orders").withColumn("urgent", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority")))
    return sketches.value_counts(orders, ["o_orderstatus", "o_custkey", "urgent"], 15)


@query("null_counts", """WITH o AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS a, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS b, o_orderkey AS c FROM orders)
  SELECT * FROM (SELECT unnest(['a', 'b', 'c']) AS "column", unnest([count_if(a IS NULL), count_if(b IS NULL), count_if(c IS NULL)]) AS nulls FROM o) ORDER BY nulls DESC, "column" LIMIT 2""")
def null_counts(spark, d):
    orders = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("a"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("b"), F.col("o_orderkey").alias("c"))
    return sketches.null_counts(orders, 2)


@query("group_cardinality", f"""WITH {TX}, n AS (SELECT count(DISTINCT area) AS a, count(DISTINCT kind) AS k, count(DISTINCT bedroom) AS b, count(DISTINCT area || '/' || kind || '/' || bedroom) AS g FROM tx)
  SELECT unnest(['unique_area', 'unique_kind', 'unique_bedroom', 'unique_series', 'upper_bound']) AS name, unnest([a, k, b, g, a * k * b]) AS n FROM n""")
def group_cardinality(spark, d):
    rows = transactions(spark, d).withColumn("series", F.concat_ws("/", "area", "kind", "bedroom"))
    return sketches.group_cardinality(rows, ["area", "kind", "bedroom"], "series")


NOW, THEN = "o_orderdate >= TIMESTAMP '1995-06-01'", "o_orderdate < TIMESTAMP '2001-03-01'"


@query("snapshot_changes", f"""SELECT o_orderkey AS key, CASE WHEN NOT ({THEN}) THEN 'new' WHEN NOT ({NOW}) THEN 'vanished' ELSE 'changed' END AS status FROM orders WHERE NOT ({THEN}) OR NOT ({NOW}) OR (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')""")
def snapshot_changes(spark, d):
    orders, folder = table(spark, d, "orders"), scratch(spark, "snapshot")
    moved = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    baseline = snapshots.write_snapshot(orders.filter(THEN), f"{folder}/baseline", "o_orderkey")
    current = snapshots.write_snapshot(orders.filter(NOW).withColumn("o_totalprice", moved), f"{folder}/current", "o_orderkey", like=baseline)
    return snapshots.changes(current, baseline)


@query("delta_alerts", """WITH v AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS value, count(*) AS tx, min(o_orderdate) >= TIMESTAMP '1995-06-01' AS fresh FROM orders GROUP BY 1),
  r AS (SELECT *, CAST(row_number() OVER (ORDER BY value DESC, o_custkey) AS INTEGER) AS by_value, CAST(row_number() OVER (ORDER BY tx DESC, o_custkey) AS INTEGER) AS by_tx FROM v)
  SELECT 'value' AS rank_kind, by_value AS rank, o_custkey, value FROM r WHERE by_value <= 40 AND fresh AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
  UNION ALL SELECT 'tx', by_tx, o_custkey, CAST(tx AS DOUBLE) FROM r WHERE by_tx <= 40 AND fresh AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def delta_alerts(spark, d):
    orders, folder = table(spark, d, "orders"), scratch(spark, "snapshot")
    baseline = snapshots.write_snapshot(orders.filter("o_orderdate < timestamp '1995-06-01'").select("o_custkey"), f"{folder}/baseline", "o_custkey")
    current = snapshots.write_snapshot(orders.select("o_custkey"), f"{folder}/current", "o_custkey", like=baseline)
    metrics = orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.count("*").alias("tx"))
    mapped = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return snapshots.alerts(snapshots.changes(current, baseline), metrics, "o_custkey", ["value", "tx"], mapped, top=40)


@query("panel_gates", f"""WITH {TX}, {RENT}, {PANEL}, p AS (SELECT *, CASE WHEN kind = 'SMALL' THEN 'Unknown' WHEN kind = 'LARGE' THEN 'ALL_DEVELOPERS' ELSE kind END AS developer_name FROM panel)
  SELECT unnest(['No Unknown developers', 'No UNMAPPED_DEVELOPER__ rows', 'ALL_DEVELOPERS bucket small (<5%)', 'Lifecycle reg_type has both OffPlan and Ready', 'median_price within [100, 50k]', 'median_rent non-negative', 'median_rent not absurd (>2M)']) AS name,
    unnest([count_if(developer_name = 'Unknown') = 0, true, avg(CASE WHEN developer_name = 'ALL_DEVELOPERS' THEN 1.0 ELSE 0.0 END) < 0.05, count(DISTINCT CASE WHEN area > 10 THEN 1 ELSE 0 END) = 2, count_if(median_price < 100 OR median_price > 50000) = 0, count_if(median_rent < 0) = 0, count_if(median_rent > 2000000) = 0]) AS passed FROM p""")
def panel_gates(spark, d):
    name = F.when(F.col("kind") == "SMALL", "Unknown").when(F.col("kind") == "LARGE", "ALL_DEVELOPERS").otherwise(F.col("kind"))
    rows = base_panel(spark, d).withColumns({"developer_name": name, "reg_type": F.when(F.col("area") > 10, "Ready").otherwise("OffPlan")})
    report = gates.run_gates(rows, gates.panel_gates(rows.columns), stop=False)
    return spark.createDataFrame([(r["name"], r["passed"]) for r in report], "name string, passed boolean")


@query("observed_gates", """SELECT unnest(['has rows', 'day is read in at least 95 %', 'o_totalprice is positive', 'late']) AS name, unnest([CAST(count(*) AS DOUBLE), avg(CASE WHEN o_orderstatus <> 'P' THEN 1.0 ELSE 0.0 END), CAST(count_if(o_totalprice <= 0) AS DOUBLE), CAST(count_if(o_orderdate >= TIMESTAMP '2001-01-01') AS DOUBLE)]) AS value FROM orders""")
def observed_gates(spark, d):
    day = dates.parse_date(F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise("none"))
    stage = table(spark, d, "orders").withColumn("day", day)
    checks = [*gates.stage_gates(stage.columns, ["day"], ["o_totalprice"]), gates.none_of("late", gates.INFO, F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp"))]
    seen, report = gates.observed(stage, checks)
    writers.write_table(seen, f"{scratch(spark, 'stage')}/orders")
    return spark.createDataFrame([(r["name"], float(r["value"])) for r in report(stop=False)], "name string, value double")


FOLDS = ["1997-12-01", "1999-06-01", "2000-12-01"]


@query("walk_forward_errors", f"""WITH {TX}, s AS (SELECT area, month, median(price) AS v FROM tx GROUP BY 1, 2), f(fold, fold_end) AS (VALUES (0, DATE '1997-12-01'), (1, DATE '1999-06-01'), (2, DATE '2000-12-01')),
  h AS (SELECT fold, area, month, v, row_number() OVER (PARTITION BY fold, area ORDER BY month DESC) AS back, count(*) OVER (PARTITION BY fold, area) AS n FROM s JOIN f ON month <= fold_end),
  p AS (SELECT fold, area, max(CASE WHEN back = 1 THEN v END) AS mid, min(v) FILTER (back <= 24) AS low, max(v) FILTER (back <= 24) AS high FROM h WHERE n >= 24 GROUP BY 1, 2),
  a AS (SELECT fold, area, month, v, count(*) OVER (PARTITION BY fold, area) AS n FROM s JOIN f ON month > fold_end AND month <= fold_end + INTERVAL 12 MONTH)
  SELECT fold, count(*) AS rows, round(avg(abs(v - mid)), 6) AS mae, round(avg(CASE WHEN v BETWEEN low AND high THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM a JOIN p USING (fold, area) WHERE a.n = 12 GROUP BY 1""")
def walk_forward_errors(spark, d):
    rows = series(spark, d).select("area", "month", "v")
    out = forecast.fold_errors(forecast.walk_forward(rows, ["area"], "month", "v", FOLDS, forecast.last_value))
    return out.withColumns({"mae": F.round("mae", 6), "coverage": F.round("coverage", 6)})


@query("batch_forecast", f"""WITH {SERIES}, l AS (SELECT area, max(CASE WHEN back = 1 THEN v END) AS mid, min(v) FILTER (back <= 24) AS low, max(v) FILTER (back <= 24) AS high, max(month) AS last, count(*) AS n FROM b GROUP BY 1)
  SELECT area, CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS month, CAST(step AS INTEGER) AS step, CASE WHEN n >= 24 THEN round(low, 6) END AS low, CASE WHEN n >= 24 THEN round(mid, 6) END AS median, CASE WHEN n >= 24 THEN round(high, 6) END AS high,
    CASE WHEN n >= 24 THEN 'ok' ELSE 'insufficient history' END AS status FROM l, (SELECT unnest(range(1, 13)) AS step)""")
def batch_forecast(spark, d):
    out = forecast.batch_forecast(series(spark, d).select("area", "month", "v"), ["area"], "month", "v", forecast.last_value)
    return out.select("area", "month", "step", *[F.round(c, 6).alias(c) for c in ("low", "median", "high")], "status")


@query("trend_insights", f"""WITH {SERIES}, p AS (SELECT area, max(month) AS data_as_of, max(CASE WHEN back = 1 THEN n END) AS supply_units, max(back) AS k, max(CASE WHEN back = 1 THEN v END) v1, max(CASE WHEN back = 4 THEN v END) v4, max(CASE WHEN back = 7 THEN v END) v7, max(CASE WHEN back = 13 THEN v END) v13,
    avg(CASE WHEN back <= 3 THEN n END) AS r, avg(CASE WHEN back BETWEEN 13 AND 15 THEN n END) AS y, sum(n) FILTER (back <= 6) AS u FROM b GROUP BY 1)
  SELECT CAST(area AS VARCHAR) AS group_id, data_as_of, supply_units, CASE WHEN k >= 13 THEN round((v1 / v4 - 1) * 100, 4) END AS change_3m, CASE WHEN k >= 13 THEN CASE WHEN (v1 / v4 - 1) * 100 > (v1 / v7 - 1) * 50 + 2 THEN 'accelerating' WHEN (v1 / v4 - 1) * 100 < (v1 / v7 - 1) * 50 - 2 THEN 'decelerating' ELSE 'stable' END END AS trend,
    CASE WHEN k >= 15 THEN round((r / y - 1) * 100, 4) END AS volume_trend, CAST(u AS BIGINT) AS units_completing_6m, k AS months_of_history FROM p""")
def trend_insights(spark, d):
    rows = series(spark, d).select(F.col("area").cast("string").alias("group_id"), F.col("month").alias("year_month"), F.col("v").alias("median_price"), F.col("v").alias("median_rent"), F.col("n").alias("transaction_count"), F.col("n").alias("units_completing"), F.col("n").alias("supply_units"), F.col("n").alias("active_projects"))
    out = analysis.trend_insights(rows)
    return out.select("group_id", "data_as_of", "supply_units", F.round("change_3m", 4).alias("change_3m"), "trend", F.round("volume_trend", 4).alias("volume_trend"), F.col("units_completing_6m").cast("long").alias("units_completing_6m"), "months_of_history")


@query("missing_against_zero", f"""WITH {TX}, {RENT}, {PANEL}, x AS (SELECT median_rent IS NULL AS missing, rent_count, transaction_count FROM panel)
  SELECT 'rent_count' AS against, missing, rent_count = 0 AS zero, count(*) AS n FROM x GROUP BY 1, 2, 3 UNION ALL SELECT 'transaction_count', missing, transaction_count = 0, count(*) FROM x GROUP BY 1, 2, 3""")
def missing_against_zero(spark, d):
    return registers.missing_against_zero(base_panel(spark, d), "median_rent", ["rent_count", "transaction_count"])


@query("missing_keys", f"""WITH {TX}, {RENT}, {PANEL}, k AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, c_nationkey AS area FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 100000)
  SELECT count_if(k.area IS NOT NULL) AS present, count_if(k.area IS NULL) AS absent FROM panel LEFT JOIN k ON k.month = panel.month AND k.area = panel.area WHERE median_rent IS NULL""")
def missing_keys(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    raw = orders.filter("o_orderpriority = '2-HIGH'").join(customer, orders.o_custkey == customer.c_custkey)
    raw = raw.select(F.to_date(F.trunc("o_orderdate", "month")).alias("month"), F.col("c_nationkey").alias("area"), (F.col("o_totalprice") - 100_000).alias("amount"))
    return registers.missing_keys(base_panel(spark, d), "median_rent", raw, ["month", "area"], "amount")


CUSTOMER = T.StructType([T.StructField(n, t) for n, t in (("c_custkey", T.LongType()), ("c_name", T.StringType()), ("c_acctbal", T.DoubleType()), ("absent", T.IntegerType()))])


def written_csv(spark, d, name: str) -> str:
    path = f"{scratch(spark, 'csv')}/{name}"
    writers.write_table(table(spark, d, name), path, format="csv")
    return path


@query("csv_projected_scan", "SELECT c_custkey, c_acctbal FROM customer")
def csv_projected_scan(spark, d):
    return readers.csv(spark, written_csv(spark, d, "customer"), CUSTOMER, ["c_custkey", "c_acctbal"])


@query("csv_optional_scan", "SELECT c_custkey, c_name, c_acctbal, CAST(NULL AS INTEGER) AS absent FROM customer")
def csv_optional_scan(spark, d):
    return readers.optional(spark, written_csv(spark, d, "customer"), CUSTOMER)


@query("csv_all_strings", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type FROM part")
def csv_all_strings(spark, d):
    return readers.all_strings(spark, written_csv(spark, d, "part")).select("p_partkey", "p_name", "p_brand", "p_type")


@query("csv_tolerant_scan", "SELECT CASE WHEN s_acctbal > 0 THEN 'good' ELSE 'bad' END AS kind, count(*) AS n, CAST(sum(CASE WHEN s_acctbal > 0 THEN s_suppkey ELSE 0 END) AS BIGINT) AS keys FROM supplier GROUP BY 1")
def csv_tolerant_scan(spark, d):
    path = f"{scratch(spark, 'csv')}/supplier"
    whole = F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name", F.col("s_acctbal").cast("string"))
    rows = table(spark, d, "supplier").select(F.when(F.col("s_acctbal") > 0, whole).otherwise(F.concat(whole, F.lit(",one,too,many"))).alias("value"))
    rows.write.text(path)
    shape = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()), T.StructField("s_acctbal", T.DoubleType())])
    header = spark.createDataFrame([("s_suppkey,s_name,s_acctbal",)], "value string")
    header.coalesce(1).write.mode("append").text(path)
    good, bad = readers.tolerant_lines(spark.read.text(path), "s_suppkey,s_name,s_acctbal", shape)
    both = good.select(F.lit("good").alias("kind"), "s_suppkey").unionByName(bad.select(F.lit("bad").alias("kind"), F.lit(0).cast("long").alias("s_suppkey")))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("keys"))


@query("override_scan", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, 'last ' || n_name AS developer_brand FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'region ' || n_regionkey FROM nation WHERE n_regionkey = 1")
def override_scan(spark, d):
    path = f"{scratch(spark, 'csv')}/overrides"
    nation = table(spark, d, "nation")
    first = nation.select(F.concat(F.lit(" "), F.col("n_nationkey").cast("string"), F.lit(" ")).alias("n_nationkey"), F.concat(F.lit("region   "), F.col("n_regionkey").cast("string")).alias("developer_brand"), F.lit(0).alias("k"))
    later = nation.select(F.col("n_nationkey").cast("string").alias("n_nationkey"), F.when(F.col("n_regionkey") != 1, F.concat(F.lit("last "), "n_name")).otherwise("  ").alias("developer_brand"), F.lit(1).alias("k"))
    first.unionByName(later).coalesce(1).sortWithinPartitions("k").drop("k").write.option("header", "true").csv(path)
    return readers.overrides(spark, path, "n_nationkey")


@query("split_sink", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def split_sink(spark, d):
    folder, customer = scratch(spark, "split"), table(spark, d, "customer")
    segments = [r[0] for r in customer.select("c_mktsegment").distinct().collect()]  # a handful of names
    writers.write_split({s: customer.filter(F.col("c_mktsegment") == s) for s in segments}, folder)
    parts = [spark.read.parquet(f"{folder}/{s}") for s in segments]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("column_synonyms", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def column_synonyms(spark, d):
    raw = table(spark, d, "nation").toDF(" Nation Key ", "NAME", "n_regionkey")
    named = clean.rename_synonyms(clean.strip_headers(raw), {"nation key": "id", "Name": "name"})
    return clean.keep_ordered(named, ["id", "name", "none"])


@query("published_run", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def published_run(spark, d):
    folder = scratch(spark, "runs")
    run = writers.Run(spark, folder)
    run.write("orders", table(spark, d, "orders"))
    run.publish({"empty": 0})
    return readers.panel(spark, f"{writers.latest_run(spark, folder)}/orders", ["o_orderstatus"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("label_gates", f"""WITH {TX}, l AS (SELECT area, l_suppkey, CASE WHEN kind = 'SMALL' THEN 'Sky Tower' WHEN kind = 'LARGE' THEN 'Acme L.L.C' ELSE brand END AS label FROM tx), c AS (SELECT label, l_suppkey, count(*) AS n FROM l GROUP BY 1, 2), s AS (SELECT label, sum(n) AS tx, count(*) AS e, round(max(n) / sum(n), 4) AS top FROM c GROUP BY 1)
  SELECT unnest(['surviving_places', 'dispersed_labels', 'suffix_leaks', 'empty_labels']) AS name, unnest([(SELECT count_if(tx >= 1000 AND label = 'Sky Tower') FROM s), (SELECT count_if(tx >= 1000 AND e >= 10 AND top <= 0.3) FROM s), (SELECT count_if(label = 'Acme L.L.C') FROM l), 0]) AS n""")
def label_gates(spark, d):
    label = F.when(F.col("kind") == "SMALL", "Sky Tower").when(F.col("kind") == "LARGE", "Acme L.L.C").otherwise(F.col("brand"))
    rows = transactions(spark, d).select(label.alias("developer_brand_label"), F.lit("LEGAL").alias("developer_brand_label_source"), F.col("l_suppkey").alias("developer_id"), F.col("area").alias("area_id"))
    seen, report = gates.observed(rows, panel.label_gates())
    path = f"{scratch(spark, 'labelled')}/rows"
    writers.write_table(seen, path)
    found = panel.label_violations(spark.read.parquet(path)) | {r["name"]: r["value"] for r in report(stop=False)}
    return spark.createDataFrame(list(found.items()), "name string, n long")


@query("streamed_months", """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2)
  SELECT * FROM m WHERE month <= (SELECT max(month) - INTERVAL 45 DAY FROM m)""")
def streamed_months(spark, d):
    """Orders as a stream: months that the watermark has closed, each once."""
    folder = scratch(spark, "stream")
    stream = spark.readStream.schema(table(spark, d, "orders").schema).parquet(f"{d}/orders.parquet*")
    months = monthly.monthly_segments(stream, ["o_orderpriority"], "o_orderdate", "o_totalprice")
    monthly.to_table(months, f"{folder}/months", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/months").select(F.to_date("month").alias("month"), "o_orderpriority", "n", F.round(F.col("mean_value") * F.col("n"), 2).alias("total"))
