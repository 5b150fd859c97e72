"""Queries of names, keys, gates, forecasts and serving statistics, each through its library function."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import measures, text
from .operators import aggregates, forecast, gates, serving
from .queries import TX, query, table, transactions


@query("developer_stats", """WITH p AS (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS ship, sum(l_quantity) AS units, avg(CASE WHEN l_linestatus = 'F' THEN 100.0 ELSE 0.0 END) AS pct FROM lineitem GROUP BY 1),
  g AS (SELECT n_name AS developer_name, count(DISTINCT o_orderkey) AS projects_total, count_if(o_orderstatus = 'F') AS projects_completed, count_if(o_orderstatus IS DISTINCT FROM 'F') AS projects_active,
  round(coalesce(sum(units), 0), 2) AS total_units, round_even(coalesce(avg(pct), 0), 1) AS avg_completion_percent, round_even(avg(coalesce(date_diff('day', CAST(o_orderdate AS DATE), ship) / 30.0, 0)), 1) AS avg_duration_months
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN p ON o_orderkey = l_orderkey GROUP BY 1)
  SELECT *, round_even(projects_completed * 100.0 / projects_total, 1) AS completion_rate, 0 AS avg_delay_months FROM g""")
def developer_stats(spark, d):
    orders, customer, nation = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.to_date(F.max("l_shipdate")).alias("project_end_date"),
        F.sum("l_quantity").alias("no_of_units"),
        F.avg(F.when(F.col("l_linestatus") == "F", 100.0).otherwise(0.0)).alias("percent_completed"),
    )
    owned = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    projects = owned.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("n_name").alias("developer_name"), F.col("o_orderkey").alias("project_number"),
        F.when(F.col("o_orderstatus") == "F", "FINISHED").otherwise(F.col("o_orderstatus")).alias("project_status"),
        F.to_date("o_orderdate").alias("project_start_date"), "project_end_date", "no_of_units", "percent_completed",
    )
    return serving.developer_stats(projects).withColumn("total_units", F.round("total_units", 2))


@query("name_keys", """WITH s AS (SELECT DISTINCT '  ' || p_name || '.   ' || p_brand || ' - ' || p_size AS raw FROM part)
  SELECT raw, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS ws, trim(regexp_replace(regexp_replace(raw, '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS label,
  trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(upper(raw), '\\s+', ' ', 'g')), '\\s*-\\s*\\d+\\s*$', ''), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS name_key,
  trim(regexp_replace(regexp_replace(lower(raw), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS entity, trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')) AS lowered,
  regexp_replace(lower(raw), '[^\\w]|_', '', 'g') AS label_key FROM s""")
def name_keys(spark, d):
    raw = table(spark, d, "part").select(F.concat(F.lit("  "), "p_name", F.lit(".   "), "p_brand", F.lit(" - "), F.col("p_size").cast("string")).alias("raw")).distinct()
    c = F.col("raw")
    keys = {"ws": text.norm_ws, "label": text.norm_label, "name_key": text.norm_name_key, "entity": text.norm_entity, "lowered": text.norm_lower, "label_key": text.label_key}
    return raw.select("raw", *[f(c).alias(name) for name, f in keys.items()])


@query("group_keys", f"""WITH {TX}, s AS (SELECT DISTINCT n_name, CASE WHEN l_linestatus = 'O' THEN 'Unit' ELSE 'Villa' END AS property_type, bedroom,
  CASE WHEN l_returnflag = 'N' THEN 'OffPlan' ELSE 'Ready' END AS reg_type, brand FROM tx JOIN nation ON area = n_nationkey)
  SELECT n_name || '_' || property_type || '_' || bedroom || '_' || reg_type || '_St_' || brand || '_Co' AS key, replace(n_name, '_', ' ') AS area, property_type, bedroom, reg_type, 'St ' || brand || ' Co' AS developer FROM s""")
def group_keys(spark, d):
    tx, nation = transactions(spark, d), table(spark, d, "nation")
    kind = F.when(F.col("l_linestatus") == "O", "Unit").otherwise("Villa")
    reg = F.when(F.col("l_returnflag") == "N", "OffPlan").otherwise("Ready")
    owner = F.concat(F.lit("St. '"), "brand", F.lit("', Co."))
    keys = tx.join(nation, tx.area == nation.n_nationkey).select(text.group_id(F.col("n_name"), kind, F.col("bedroom"), reg, owner).alias("key")).distinct()
    return keys.withColumn("g", text.parse_group_id(F.col("key"))).select("key", "g.*")


@query("unit_measures", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * 0.09290304, 6) AS per_sqft, round(CASE WHEN l_quantity > 0 THEN (l_extendedprice / l_quantity - 1) * 100 END, 8) AS change,
  round(CASE WHEN l_quantity > 0 AND l_extendedprice / l_quantity > 2000 THEN l_extendedprice / 100 ELSE l_extendedprice END, 6) AS rent,
  round(coalesce(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END, CASE WHEN l_extendedprice > 0 AND l_quantity > 0 THEN l_extendedprice / l_quantity END), 8) AS price,
  round(CASE WHEN l_extendedprice > 0 AND l_discount > 0 THEN l_extendedprice * power(power((l_extendedprice + l_tax) / l_extendedprice, 1 / (l_discount * 100)), 24) END, 4) AS grown FROM lineitem""")
def unit_measures(spark, d):
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    priced = F.when(F.col("l_returnflag") == "R", price)
    grown = measures.extrapolate_or_null(price, price + F.col("l_tax"), F.col("l_discount") * 100, F.lit(24))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(measures.per_sqft(price), 6).alias("per_sqft"), F.round(measures.change_percent(price, quantity), 8).alias("change"),
        F.round(measures.repair_rent(price, quantity), 6).alias("rent"), F.round(measures.unit_price(priced, price, quantity), 8).alias("price"), F.round(grown, 4).alias("grown"),
    )


@query("match_rate_gate", """SELECT o_custkey, CASE WHEN avg(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) < 0.3 THEN 'FAIL' WHEN avg(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) < 0.95 THEN 'WARN' ELSE 'OK' END AS status
  FROM orders GROUP BY 1""")
def match_rate_gate(spark, d):
    orders = table(spark, d, "orders").withColumn("matched", F.when(F.col("o_orderstatus") != "P", F.lit(1)))
    return orders.groupBy("o_custkey").agg(gates.match_rate(orders, "matched", fail=0.3).alias("status"))


@query("forecast_anomalies", """WITH f AS (SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS now, avg(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END) AS later, max(o_totalprice) AS r0, min(o_totalprice) AS r1 FROM orders GROUP BY 1),
  g AS (SELECT o_custkey, concat_ws(',', CASE WHEN (later / now - 1) * 100 < -20 THEN 'large_drop' END, CASE WHEN (later / now - 1) * 100 > 50 THEN 'large_jump' END,
  CASE WHEN later < 100 THEN 'price_below_100' END, CASE WHEN r1 < 0.5 * r0 THEN 'rent_collapse' END) AS flags FROM f) SELECT * FROM g WHERE flags <> ''""")
def forecast_anomalies(spark, d):
    done, worth = F.col("o_orderstatus") == "F", F.col("o_totalprice")
    found = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.avg(F.when(done, worth)).alias("current"), F.avg(F.when(~done, worth)).alias("forecast"), F.max(worth).alias("rent_current"), F.min(worth).alias("rent_forecast")
    )
    return gates.anomalies(found).select("o_custkey", F.array_join("flags", ",").alias("flags"))


@query("vehicle_outliers", f"""WITH {TX}, c AS (SELECT l_suppkey, area, count(*) AS n, sum(l_extendedprice) AS v, sum(l_quantity) AS u FROM tx GROUP BY 1, 2)
  SELECT l_suppkey, round(max(n) / sum(n), 4) AS top_share, CAST(sum(n) AS BIGINT) AS tx_recent FROM c GROUP BY 1 HAVING round(max(n) / sum(n), 4) >= 0.06 AND (sum(v) >= 1e9 OR sum(n) >= 50 OR sum(u) >= 1500)""")
def vehicle_outliers(spark, d):
    tx = transactions(spark, d)
    size = tx.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("value"), F.count("*").alias("tx_recent"), F.sum("l_quantity").alias("units"))
    share = aggregates.top_share(tx, ["l_suppkey"], "area").select("l_suppkey", "top_share")
    metrics = size.join(share, "l_suppkey").withColumn("label", F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")))
    return gates.outliers(metrics, tx=50, units=1500, concentration=0.06).select("l_suppkey", "top_share", "tx_recent")


@query("market_position", """WITH p AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size * 50.0 WHEN p_size <= 10 THEN 450.0 WHEN p_size <= 20 THEN 750.0 ELSE 1200.0 END AS size, p_retailprice AS price FROM part),
  t AS (SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
  SELECT p_partkey, round(price / size, 6) AS asked_sqft, round((price / size / 1.5 - 1) * 100, 4) AS premium_percent, round(q / n, 6) AS years_of_supply FROM p LEFT JOIN t ON p_partkey = l_partkey""")
def market_position(spark, d):
    part = table(spark, d, "part")
    sold = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("transactions_12m"), F.sum("l_quantity").alias("supply_pipeline"))
    bedroom = F.when(F.col("p_size") <= 10, "Studio").when(F.col("p_size") <= 20, "1BR").otherwise("2BR")
    rows = part.join(sold, part.p_partkey == sold.l_partkey, "left").withColumns(
        {"unit_sqft": F.when(F.col("p_size") > 25, F.col("p_size") * 50.0), "bedroom": bedroom, "price": F.col("p_retailprice"), "market_sqft": F.lit(1.5)}
    )
    out = forecast.market_position(rows)
    return out.select("p_partkey", F.round("asked_sqft", 6).alias("asked_sqft"), F.round("premium_percent", 4).alias("premium_percent"), F.round("years_of_supply", 6).alias("years_of_supply"))


@query("what_if", """WITH s AS (SELECT 'base' AS scenario, l_returnflag, l_extendedprice AS p, l_tax AS t FROM lineitem UNION ALL SELECT 'cheaper', l_returnflag, CASE WHEN l_linestatus = 'O' THEN l_extendedprice * 0.9 ELSE l_extendedprice END, l_tax FROM lineitem
  UNION ALL SELECT 'taxed', l_returnflag, l_extendedprice, CASE WHEN l_linestatus = 'O' THEN l_tax + 0.01 ELSE l_tax END FROM lineitem)
  SELECT scenario, l_returnflag, round(avg(p), 4) AS price, round(avg(t), 8) AS tax FROM s GROUP BY 1, 2""")
def what_if(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice", "l_tax")
    made = forecast.scenarios(rows, {"cheaper": ("l_extendedprice", "*", 0.9), "taxed": ("l_tax", "+", 0.01)}, F.col("l_linestatus") == "O")
    return made.groupBy("scenario", "l_returnflag").agg(F.round(F.avg("l_extendedprice"), 4).alias("price"), F.round(F.avg("l_tax"), 8).alias("tax"))


@query("driver_attribution", f"""WITH {TX}, b AS (SELECT CAST(area AS VARCHAR) AS group_id, brand AS feature, max(l_extendedprice) AS importance FROM tx WHERE brand NOT IN ('Brand#1', 'Brand#13') GROUP BY 1, 2)
  SELECT group_id, feature, importance, round(importance / sum(importance) OVER (PARTITION BY group_id), 8) AS share, CAST(row_number() OVER (PARTITION BY group_id ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM b QUALIFY rank <= 8""")
def driver_attribution(spark, d):
    rows = transactions(spark, d).select(F.col("area").cast("string").alias("group_id"), F.col("brand").alias("feature"), F.col("l_extendedprice").alias("importance"))
    return forecast.attribution(rows, ["Brand#1", "Brand#13"]).withColumn("share", F.round("share", 8))


@query("forecast_errors", """WITH m AS (SELECT o_custkey, avg(o_totalprice) AS p FROM orders GROUP BY 1)
  SELECT round(avg(abs(o_totalprice - p)), 4) AS mae, round(avg(CASE WHEN o_totalprice BETWEEN 0.5 * p AND 1.5 * p THEN 1 ELSE 0 END), 8) AS coverage FROM orders JOIN m USING (o_custkey)""")
def forecast_errors(spark, d):
    orders = table(spark, d, "orders")
    known = orders.join(orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("p")), "o_custkey")
    out = forecast.errors(known.withColumns({"low": F.col("p") * 0.5, "high": F.col("p") * 1.5}), "o_totalprice", "p", "low", "high")
    return out.select(F.round("mae", 4).alias("mae"), F.round("coverage", 8).alias("coverage"))


@query("deal_costs", """SELECT o_orderkey, round(o_totalprice * 1.06 + 5000, 4) AS total_cost, round(c_acctbal - CASE WHEN o_orderstatus = 'F' THEN 100 ELSE 0 END, 4) AS net_cash,
  round((c_acctbal - CASE WHEN o_orderstatus = 'F' THEN 100 ELSE 0 END) / (o_totalprice * 1.06 + 5000) * 100, 6) AS cash_on_cash FROM orders JOIN customer ON o_custkey = c_custkey""")
def deal_costs(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    deals = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey", F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("rent_median"), F.when(F.col("o_orderstatus") == "F", F.lit(100.0)).alias("yearly_costs")
    )
    out = forecast.deal_costs(deals)
    return out.select("o_orderkey", F.round("total_cost", 4).alias("total_cost"), F.round("net_cash", 4).alias("net_cash"), F.round("cash_on_cash", 6).alias("cash_on_cash"))


@query("display_list", """WITH l AS (SELECT DISTINCT label, rank FROM (SELECT p_brand AS label, p_size AS rank FROM part UNION ALL SELECT upper(replace(p_brand, '#', ' # ')), p_size FROM part))
  SELECT label, rank FROM (SELECT *, regexp_replace(lower(label), '[^\\w]|_', '', 'g') AS k FROM l) QUALIFY row_number() OVER (PARTITION BY k ORDER BY rank, length(label) DESC, label) = 1""")
def display_list(spark, d):
    part = table(spark, d, "part")
    labels = part.select(F.col("p_brand").alias("label"), F.col("p_size").alias("rank"))
    spaced = part.select(F.upper(F.replace("p_brand", F.lit("#"), F.lit(" # "))).alias("label"), F.col("p_size").alias("rank"))
    return serving.display_list(labels.unionByName(spaced).distinct(), "label", "rank")
