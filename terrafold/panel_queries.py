"""Queries of the panel's own stages, of rates, documents and text functions, each through its library function."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import bedrooms, measures, text
from .operators import gates, labels, serving, windows
from .plans import macro, panel
from .queries import TX, query, table, transactions
from .sources import readers, schemas, writers
from .sources.shared import scratch

# Raw registry tables made of lines, parts and customers; the SQL says what the plan must make of them.
RAW = """raw AS (SELECT CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) AS transaction_id, CAST(o_orderdate AS DATE) AS deal, p_size, CAST(l_suppkey AS VARCHAR) AS project, c_nationkey, n_name AS master,
    l_extendedprice / l_quantity AS sqm, l_linestatus, o_orderstatus, p_type, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN nation ON c_nationkey = n_nationkey),
  prj AS (SELECT CAST(s_suppkey AS VARCHAR) AS project, CAST(s_nationkey AS VARCHAR) AS dev, DATE '1998-01-01' + CAST(s_suppkey AS INTEGER) AS handover FROM supplier WHERE s_acctbal > 0),
  mst AS (SELECT n_name AS master, arg_min(dev, (-n, dev)) AS dev FROM (SELECT n_name, dev, count(*) AS n FROM prj JOIN supplier ON project = CAST(s_suppkey AS VARCHAR) JOIN nation ON n_nationkey = s_suppkey % 25 GROUP BY 1, 2) GROUP BY 1)"""


def raw_transactions(spark, d):
    line, orders, customer, part, nation = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "part", "nation"))
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rooms = F.when(F.col("p_size") <= 10, "Studio").when(F.col("p_size") <= 40, "2 B/R").otherwise("Shop")
    none = F.lit(None).cast("string")
    return joined.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string").alias("transaction_id"), F.date_format("o_orderdate", "dd-MM-yyyy").alias("instance_date"), F.lit("Sell").alias("procedure_name_en"),
        F.when(F.col("o_orderpriority") == "5-LOW", "Commercial").otherwise("Residential").alias("property_usage_en"), F.when(F.col("p_type") == "SMALL", "Land").otherwise("Unit").alias("property_type_en"),
        F.when(F.col("l_linestatus") == "O", "Off-Plan Properties").otherwise("Existing Properties").alias("reg_type_en"), rooms.alias("rooms_en"), F.col("l_quantity").alias("procedure_area"),
        F.col("l_extendedprice").alias("actual_worth"), F.lit(None).cast("double").alias("meter_sale_price"), F.col("l_suppkey").cast("string").alias("project_number"), none.alias("project_name_en"),
        F.col("n_name").alias("master_project_en"), none.alias("building_name_en"), F.col("c_nationkey").cast("string").alias("area_id"), F.col("n_name").alias("area_name_en"),
        F.when(F.col("o_orderstatus") == "P", "2").otherwise("1").alias("trans_group_id"), none.alias("has_parking"),
    )


@query("enriched_transactions", f"""WITH {RAW}, k AS (SELECT transaction_id, deal, CASE WHEN p_size <= 10 THEN 'Studio' ELSE '2BR' END AS bedroom, raw.project, raw.master, sqm * 0.09290304 AS price, CASE WHEN l_linestatus = 'O' THEN 'OffPlan' ELSE 'Ready' END AS reg
    FROM raw WHERE o_orderpriority <> '5-LOW' AND p_type <> 'SMALL' AND p_size <= 40 AND o_orderstatus <> 'P' AND sqm * 0.09290304 BETWEEN 50 AND 90)
  SELECT transaction_id, deal AS instance_date, bedroom, round(price, 8) AS price, coalesce(prj.dev, mst.dev) AS developer_id, CASE WHEN prj.dev IS NOT NULL THEN 'project' WHEN mst.dev IS NOT NULL THEN 'master' END AS developer_source,
    CASE WHEN reg = 'OffPlan' AND deal >= handover THEN 'Ready' ELSE reg END AS reg_type, CASE WHEN reg = 'OffPlan' AND deal >= handover THEN 1 ELSE 0 END AS offplan_after_handover FROM k LEFT JOIN prj ON prj.project = k.project LEFT JOIN mst ON mst.master = k.master""")
def enriched_transactions(spark, d):
    supplier, nation = table(spark, d, "supplier").filter("s_acctbal > 0"), table(spark, d, "nation")
    projects = supplier.join(nation, F.col("s_suppkey") % 25 == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("string").alias("project_number"), F.col("s_nationkey").cast("string").alias("developer_id"), F.lit(None).cast("date").alias("project_start_date"),
        F.date_add(F.lit("1998-01-01").cast("date"), F.col("s_suppkey").cast("int")).alias("handover_date"), F.col("n_name").alias("master_project_en"),
    )
    developers = nation.select(F.col("n_nationkey").cast("string").alias("developer_id"), F.col("n_name").alias("developer_name_en"), F.col("n_name").alias("developer_name_ar"))
    groups = spark.createDataFrame([("1", "Sales"), ("2", "Mortgage")], schemas.TRANSACTION_GROUPS)
    out = panel.enrich(raw_transactions(spark, d), projects, developers, groups, panel.PanelConfig(price_low=50.0, price_high=90.0))
    return out.select("transaction_id", "instance_date", "bedroom", F.round("price", 8).alias("price"), "developer_id", "developer_source", "reg_type", "offplan_after_handover")


DAYS = """dy AS (SELECT CAST(ts AS DATE) AS date, avg(value) AS v, count(*) AS n FROM events GROUP BY 1), sp AS (SELECT date, CASE WHEN n >= 0 AND day(date) NOT IN (5, 6, 17) THEN v END AS m3, CASE WHEN day(date) <> 9 THEN v * 2 END AS m12 FROM dy),
  fl AS (SELECT date, last_value(m3 IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m3, last_value(m12 IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m12 FROM sp)"""


def daily_rates(spark, d):
    per = table(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("v"))
    three = F.when(~F.dayofmonth("date").isin(5, 6, 17), F.col("v"))
    twelve = F.when(F.dayofmonth("date") != 9, F.col("v") * 2)
    return per.select("date", *[(twelve if t == "12_month" else three).alias(t) for t in schemas.TENORS])


@query("rate_features", f"WITH {DAYS} SELECT date, round(m3, 6) AS m3, round(m3 - lag(m3, 21) OVER (ORDER BY date), 6) AS change_21, round(m12 - m3, 6) AS slope FROM fl")
def rate_features(spark, d):
    out = macro.rate_features(daily_rates(spark, d))
    return out.select("date", F.round("3_month", 6).alias("m3"), F.round("change_21", 6).alias("change_21"), F.round("slope_12m_3m", 6).alias("slope"))


@query("rate_table", f"WITH {DAYS} SELECT strftime(date, '%Y-%m') AS year_month, round(avg(m3), 6) AS rate_3_month, round(avg(m12), 6) AS rate_12_month FROM fl GROUP BY 1")
def rate_table(spark, d):
    out = readers.rate_table(macro.monthly_rates(macro.rate_features(daily_rates(spark, d))))
    return out.select("year_month", F.round("rate_3_month", 6).alias("rate_3_month"), F.round("rate_12_month", 6).alias("rate_12_month"))


@query("rate_sheets", f"WITH {DAYS} SELECT date, CAST(round(coalesce(m3, -1) * 100) AS BIGINT) AS cents, CASE WHEN date >= (SELECT min(date) + 10 FROM dy) THEN 'later' ELSE 'first' END AS sheet FROM sp WHERE m3 IS NOT NULL")
def rate_sheets(spark, d):
    """Two sheets as CSV, titles above their headers; days that both have are the later one's."""
    folder, rows = scratch(spark, "sheets"), daily_rates(spark, d).filter("`3_month` is not null").select("date", "3_month")
    first = rows.agg(F.min("date")).first()[0]
    lines = lambda df, mark, header: spark.createDataFrame([(0, "rates,,"), (1, header)], "k int, value string").unionByName(df.select(F.lit(2).alias("k"), F.concat_ws(",", F.date_format("date", "dd-MM-yyyy"), F.col("3_month").cast("string"), F.lit(mark)).alias("value"))).coalesce(1).sortWithinPartitions("k").select("value")
    lines(rows, "0.0", "Date,3 Month,1M").write.text(f"{folder}/a.csv")
    lines(rows.filter(F.col("date") >= F.date_add(F.lit(first), 10)), "1.0", "التاريخ,3 أشهر,شهر واحد").write.text(f"{folder}/b.csv")
    out = readers.rates(spark, [f"{folder}/a.csv", f"{folder}/b.csv"])
    return out.select("date", F.round(F.col("3_month") * 100).cast("long").alias("cents"), F.when(F.col("1_month") == 1.0, "later").otherwise("first").alias("sheet"))


@query("kml_polygons", "SELECT CAST(n_nationkey AS VARCHAR) AS community_num, n_name AS name, 3 AS points, round(n_nationkey + 1 / 3, 6) AS lon FROM nation WHERE n_nationkey > 0")
def kml_polygons(spark, d):
    path = f"{scratch(spark, 'kml')}/areas.kml"
    k = F.col("n_nationkey").cast("string")
    ring = F.concat(k, F.lit(",0,0 "), (F.col("n_nationkey") + 1).cast("string"), F.lit(",0,0 "), k, F.lit(",1,0"))
    number = F.when(F.col("n_nationkey") > 0, F.concat(F.lit('<SimpleData name="COMM_NUM">'), k, F.lit("</SimpleData>"))).otherwise("")
    mark = F.concat(
        F.lit("<Placemark><ExtendedData><SchemaData>"), number, F.lit('<SimpleData name="CNAME_E">'), F.col("n_name"), F.lit("</SimpleData></SchemaData></ExtendedData><Polygon><outerBoundaryIs><LinearRing><coordinates>"),
        ring, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"),
    )
    table(spark, d, "nation").coalesce(1).agg(F.concat(F.lit("<kml><Document>"), F.array_join(F.collect_list(mark), "\n"), F.lit("</Document></kml>")).alias("value")).write.text(path)
    found = readers.polygons(spark, path)
    return found.select("community_num", "name", F.size("ring").alias("points"), F.round(F.aggregate("ring", F.lit(0.0), lambda s, p: s + p["lon"]) / 3, 6).alias("lon"))


@query("json_documents_round_trip", "SELECT n_name AS brand, 'alias of ' || n_name AS alias, count(*) AS entities FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def json_documents_round_trip(spark, d):
    """A document of brands written as JSON and read by the reader of consolidations."""
    nation, supplier = table(spark, d, "nation"), table(spark, d, "supplier")
    owned = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.collect_list("s_name").alias("names"))
    brands = {r["n_name"]: {"registered_entities": r["names"], "aliases": [f"alias of {r['n_name']}"], "note": ""} for r in owned.collect()}  # a row per nation
    path = f"{scratch(spark, 'json')}/brands"
    writers.write_json(spark, {"brands": brands}, path)
    return readers.consolidation(spark, path).select("brand", F.explode("aliases").alias("alias"), F.size("registered_entities").cast("long").alias("entities"))


@query("canonical_by_key", "WITH c AS (SELECT replace(p_name, ' ', '') AS k, min(p_name) AS name FROM part GROUP BY 1) SELECT p_partkey, coalesce(name, typed) AS name FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN replace(p_name, ' ', '  ') ELSE p_brand END AS typed FROM part) LEFT JOIN c ON k = replace(typed, ' ', '')")
def canonical_by_key(spark, d):
    part = table(spark, d, "part")
    typed = part.select("p_partkey", F.when(F.col("p_size") > 25, F.replace("p_name", F.lit(" "), F.lit("  "))).otherwise(F.col("p_brand")).alias("name"))
    return labels.canonical_by_key(typed, "name", part.select(F.col("p_name").alias("name")))


@query("guard_misses", f"WITH {TX}, l AS (SELECT CASE WHEN kind = 'SMALL' THEN n_name WHEN kind = 'LARGE' THEN 'Sky Tower' ELSE brand END AS label FROM tx JOIN nation ON area = n_nationkey) SELECT label, count(*) AS tx FROM l WHERE label IN (SELECT n_name FROM nation) GROUP BY 1")
def guard_misses(spark, d):
    tx, nation = transactions(spark, d), table(spark, d, "nation")
    label = F.when(F.col("kind") == "SMALL", F.col("n_name")).when(F.col("kind") == "LARGE", "Sky Tower").otherwise(F.col("brand"))
    rows = tx.join(nation, F.col("area") == F.col("n_nationkey")).select(label.alias("label"), "l_suppkey", "area")
    return gates.guard_misses(rows, "label", "l_suppkey", "area", nation.select(F.col("n_name").alias("name"))).select("label", "tx")


@query("text_fields", """WITH s AS (SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN ' nan ' WHEN 'LARGE' THEN '' ELSE '  ' || p_name || ' ' END AS project, CASE WHEN p_size > 25 THEN 'None' ELSE p_brand END AS building, p_size, p_name, p_type FROM part)
  SELECT p_partkey, CASE WHEN p_type NOT IN ('SMALL', 'LARGE') THEN p_name END AS project, CASE WHEN p_size % 3 = 0 AND p_size <= 25 THEN building WHEN p_type NOT IN ('SMALL', 'LARGE') THEN p_name WHEN p_size <= 25 THEN building ELSE 'Master' END AS evidence,
    contains(' ' || upper(p_name) || ' ', ' RING ') AS ring, CASE WHEN p_size <= 2 THEN 'Studio' WHEN p_size <= 4 THEN p_size || 'BR' WHEN p_size <= 7 THEN '5BR+' END AS bedroom, CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END AS number FROM s""")
def text_fields(spark, d):
    part = table(spark, d, "part")
    project = F.when(F.col("p_type") == "SMALL", " nan ").when(F.col("p_type") == "LARGE", "").otherwise(F.concat(F.lit("  "), "p_name", F.lit(" ")))
    building = F.when(F.col("p_size") > 25, "None").otherwise(F.col("p_brand"))
    size = F.col("p_size").cast("string")
    said = F.when(F.col("p_size") <= 2, "a studio").when(F.col("p_size") <= 7, F.concat(F.lit("a "), size, F.lit(" bedroom flat"))).otherwise("a flat")
    return part.select(
        "p_partkey", text.nullify(project).alias("project"), text.evidence_value(F.when(F.col("p_size") % 3 == 0, "building"), project, building, F.lit("Master")).alias("evidence"),
        text.contains_phrase(F.upper("p_name"), F.lit("RING")).alias("ring"), bedrooms.from_text(said).alias("bedroom"), measures.number(F.when(F.col("p_size") > 10, size).otherwise("NaN")).alias("number"),
    )


@query("mapped_first", "SELECT n_name, CASE WHEN n_regionkey > 2 THEN 'yes' ELSE '' END AS mapped, CAST(row_number() OVER (ORDER BY n_regionkey <= 2, n_name) AS INTEGER) AS place FROM nation")
def mapped_first(spark, d):
    from pyspark.sql import Window

    nation = table(spark, d, "nation").select("n_name", F.when(F.col("n_regionkey") > 2, "yes").otherwise("").alias("mapped"))
    ordered = serving.mapped_first(nation, "mapped", "n_name").withColumn("_id", F.monotonically_increasing_id())
    return ordered.withColumn("place", F.row_number().over(Window.orderBy("_id"))).drop("_id")  # 25 rows


@query("macro_months", """WITH v AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, quarter(o_orderdate) AS q, sum(o_totalprice) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), i AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, quarter(o_orderdate) AS q, max(o_custkey) AS r FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2),
  e AS (SELECT make_date(y, 3 * q - 2 + k, 1) AS month, t FROM v, (SELECT CAST(unnest(range(0, 3)) AS BIGINT) AS k)), f AS (SELECT make_date(y, 3 * q - 2 + k, 1) AS month, r FROM i, (SELECT CAST(unnest(range(0, 3)) AS BIGINT) AS k))
  SELECT month, round(t, 2) AS visitors_total, r AS hotel_rooms FROM e FULL JOIN f USING (month)""")
def macro_months(spark, d):
    orders = table(spark, d, "orders")
    keys = [F.year("o_orderdate").alias("year"), F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("quarter")]
    visitors = orders.filter("o_orderstatus = 'F'").groupBy(*keys).agg(F.sum("o_totalprice").alias("visitors_thousands"))
    inventory = orders.filter("o_orderpriority = '1-URGENT'").groupBy(*keys).agg(F.max("o_custkey").alias("num_hotel_rooms"))
    return macro.tourism(visitors, inventory).withColumn("visitors_total", F.round("visitors_total", 2))


@query("monthly_fill", f"""WITH {TX}, m AS (SELECT DISTINCT month FROM tx), s AS (SELECT month, max(CASE WHEN month(month) NOT IN (4, 5) AND year(month) BETWEEN 1996 AND 2000 THEN n END) AS v FROM (SELECT month, count(*) AS n FROM tx GROUP BY 1) GROUP BY 1),
  e AS (SELECT month, v, last_value(v IGNORE NULLS) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f, first_value(v IGNORE NULLS) OVER (ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM s)
  SELECT month, CAST(CASE WHEN f IS NOT NULL AND b IS NOT NULL THEN f ELSE 0 END AS DOUBLE) AS v, CAST(v IS NULL AS INTEGER) AS v_missing FROM e""")
def monthly_fill(spark, d):
    tx = transactions(spark, d)
    known = tx.filter(~F.month("month").isin(4, 5) & F.year("month").between(1996, 2000)).groupBy("month").agg(F.count("*").cast("double").alias("v"))
    return macro.fill_months(tx.select("month"), known, ["v"]).select("month", "v", "v_missing")


@query("future_months", f"WITH {TX}, s AS (SELECT area, month, count(*) AS n FROM tx GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY month DESC) AS k FROM s) SELECT area, CAST(max(month) + to_months(CAST(step AS INTEGER)) AS DATE) AS month, CAST(step AS INTEGER) AS step, round(avg(n) FILTER (k <= 6), 6) AS n FROM b, (SELECT unnest(range(1, 7)) AS step) GROUP BY area, step")
def future_months(spark, d):
    rows = transactions(spark, d).groupBy("area", "month").agg(F.count("*").alias("n"))
    return windows.future_rows(rows, ["area"], "month", 6, means=["n"]).select("area", "month", "step", F.round("n", 6).alias("n"))
