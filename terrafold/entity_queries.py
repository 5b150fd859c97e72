"""Queries of names, brands, cascades, lookups and audits, each through its library function."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import bedrooms, dates, text
from .operators import clean, gates, joins, labels, registers, serving
from .plans import panel
from .queries import TX, query, table, transactions


@query("substring_alias_hits", """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS alias FROM part), a AS (SELECT alias FROM w UNION SELECT substr(alias, 1, 2) FROM w)
  SELECT alias, count(*) AS docs FROM documents JOIN a ON contains(lower(text), alias) GROUP BY 1""")
def substring_alias_hits(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("alias")).distinct()
    aliases = words.unionByName(words.select(F.substring("alias", 1, 2).alias("alias"))).distinct()
    docs = table(spark, d, "documents").select(F.lower("text").alias("text"))
    counts = docs.groupBy(F.md5("text").alias("key")).agg(F.count("*").alias("n"))
    hits = joins.substring_hits(docs, "text", aliases, key=F.md5("text"))
    return hits.join(counts, F.col("text") == F.col("key")).groupBy("alias").agg(F.sum("n").alias("docs"))


NAMED = """f AS (SELECT p_name AS project_name, p_type AS building_name, CAST(s_nationkey AS VARCHAR) AS area_name, p_brand AS developer_name, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4)"""


def named_facts(spark, d):
    line, part, supplier = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "supplier")
    joined = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    return joined.select(
        F.col("p_name").alias("project_name"), F.col("p_type").alias("building_name"), F.col("s_nationkey").cast("string").alias("area_name"), F.col("p_brand").alias("developer_name"),
        F.col("l_suppkey").cast("string").alias("developer_id"), F.col("l_partkey").cast("string").alias("project_number"), F.concat("p_brand", F.lit(" "), "p_type").alias("master_project"),
    )


@query("brand_inference", f"""WITH {NAMED}, g AS (SELECT *, lower(project_name || ' ' || building_name) AS t FROM f)
  SELECT CASE WHEN contains(t, 'ring') AND developer_name IN ('Brand#1', 'Brand#2', 'Brand#3') AND area_name = '3' THEN 'Rings'
    WHEN contains(t, 'ring') AND developer_name = 'Brand#4' AND area_name = '5' THEN 'Rings'
    WHEN (contains(t, 'red') OR contains(t, 'hot g')) AND developer_name = 'Brand#5' THEN 'Reds'
    WHEN contains(t, 'econ') THEN 'Economy' END AS brand, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1""")
def brand_inference(spark, d):
    rules = [
        ("Rings", 1, ["Ring"], None, {"3": ["Brand#1", "Brand#2", "Brand#3"], "5": ["Brand#4"]}),
        ("Reds", 2, ["red", "HOT  g"], "Brand#5", None),
        ("Economy", 3, ["econ"], None, None),
    ]
    rules = spark.createDataFrame(rules, "brand string, rank int, aliases array<string>, registered_under string, registered_under_by_area map<string,array<string>>")
    facts = named_facts(spark, d)
    keys = ["project_name", "building_name", "area_name", "developer_name"]
    counts = facts.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.join(labels.infer_brands(facts, rules), keys, "left").groupBy("brand").agg(F.sum("n").alias("n"))


@query("resolve_brands", """WITH f AS (SELECT l_suppkey, l_partkey, ' ' || upper(p_name) || ' ' AS a, ' ' || upper(p_type) || ' ' AS b, p_brand || ' ' || p_type AS m FROM lineitem JOIN part ON l_partkey = p_partkey),
  s AS (SELECT *, CASE WHEN a LIKE '% RED RING %' THEN 2008 WHEN a LIKE '% SMALL %' THEN 1005 WHEN a LIKE '% BOLTS %' THEN 1005 ELSE 0 END AS sa, CASE WHEN b LIKE '% ECONOMY %' THEN 1007 WHEN b LIKE '% SMALL %' THEN 1005 ELSE 0 END AS sb FROM f),
  r AS (SELECT *, greatest(sa, sb, CASE WHEN m LIKE '%ECONOMY' THEN 1007 WHEN m LIKE '%SMALL' THEN 1005 ELSE 0 END) AS best FROM s)
  SELECT CASE best WHEN 2008 THEN 'Ring Makers' WHEN 1007 THEN 'Economy' WHEN 1005 THEN 'Small Works' ELSE CASE WHEN s_acctbal > 5000 THEN 'Owner ' || s_nationkey WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45) THEN 'Large' WHEN m = 'Brand#1 STANDARD' THEN 'First' END END AS brand,
    CASE WHEN best > 0 THEN 'TEXT' WHEN s_acctbal > 5000 THEN 'LEGAL_MAP' WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45) THEN 'PROJECT_OVERRIDE' WHEN m = 'Brand#1 STANDARD' THEN 'MASTER_FALLBACK' ELSE 'UNRESOLVED' END AS brand_source, count(*) AS n
  FROM r JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def resolve_brands(spark, d):
    brands = spark.createDataFrame([("Ring Makers", ["Red Ring"], ["red-ring"]), ("Small Works", ["small", "TINY"], None), ("Economy", None, None)], "brand string, aliases array<string>, registered_entities array<string>")
    part, supplier = table(spark, d, "part"), table(spark, d, "supplier")
    legal = supplier.filter("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("developer_id"), F.concat(F.lit("Owner "), F.col("s_nationkey").cast("string")).alias("brand"))
    own = part.filter("p_size > 45").select(F.col("p_partkey").cast("string").alias("project_number"), F.lit("Large").alias("brand"))
    master = spark.createDataFrame([("Brand#1 STANDARD", "First")], "master_project string, brand string")
    out = labels.resolve_brands(named_facts(spark, d), labels.alias_dictionary(brands), legal, own, master)
    return out.groupBy("brand", "brand_source").agg(F.count("*").alias("n"))


@query("alias_dictionary", """WITH a AS (SELECT p_brand AS brand, upper(trim(regexp_replace(unnest([p_brand, p_name, p_type]), '[^\\w\\s]', ' ', 'g'))) AS alias FROM part)
  SELECT alias, min(brand) AS brand FROM a WHERE contains(alias, ' ') OR length(alias) >= 5 GROUP BY 1""")
def alias_dictionary(spark, d):
    brands = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.array("p_name").alias("aliases"), F.array("p_type").alias("registered_entities"))
    return labels.alias_dictionary(brands).select("alias", "brand")


@query("compile_developers", """SELECT CAST(s_suppkey AS VARCHAR) AS developer_id, CASE WHEN s_acctbal > 9000 THEN 'Override' WHEN s_acctbal > 0 THEN n_name ELSE 'Any supplier' END AS brand,
  CASE WHEN s_acctbal > 9000 THEN 'OVERRIDE' WHEN s_acctbal > 0 THEN 'EXACT' ELSE 'ALIAS' END AS source FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def compile_developers(spark, d):
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    owned = supplier.filter("s_acctbal > 0").join(nation, supplier.s_nationkey == nation.n_nationkey).groupBy(F.col("n_name").alias("brand")).agg(F.collect_list("s_name").alias("registered_entities"))
    brands = owned.select("brand", F.array().cast("array<string>").alias("aliases"), "registered_entities")
    registry = supplier.select(F.col("s_suppkey").cast("string").alias("developer_id"), F.concat(F.lit("The "), "s_name").alias("developer_name_en"), F.replace("s_name", F.lit("#"), F.lit(" # ")).alias("developer_name_ar"))
    aliases = spark.createDataFrame([("SUPPLIER", "Any supplier", 1)], "alias string, brand string, rank int")
    overrides = supplier.filter("s_acctbal > 9000").select(F.col("s_suppkey").cast("string").alias("developer_id"), F.lit("Override").alias("developer_brand"))
    return labels.compile_developers(registry, brands, aliases, overrides)


@query("validate_overrides", """WITH o AS (SELECT s_suppkey AS developer_id, CASE WHEN s_acctbal > 5000 THEN n_name WHEN s_acctbal > 0 THEN lower(replace(n_name, '_', ' - ')) ELSE 'Unheard of' END AS developer_brand FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  SELECT developer_id, developer_brand, (SELECT min(n_name) FROM nation WHERE regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(developer_brand), '[^a-z0-9]', '', 'g')) AS suggestion, 'non_canonical' AS reason
  FROM o WHERE developer_brand NOT IN (SELECT n_name FROM nation)""")
def validate_overrides(spark, d):
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    brand = F.when(F.col("s_acctbal") > 5000, F.col("n_name")).when(F.col("s_acctbal") > 0, F.lower(F.replace("n_name", F.lit("_"), F.lit(" - ")))).otherwise("Unheard of")
    overrides = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(F.col("s_suppkey").alias("developer_id"), brand.alias("developer_brand"))
    return labels.validate_overrides(overrides, nation.select(F.col("n_name").alias("brand")))[1].select("developer_id", "developer_brand", "suggestion", "reason")


AREAS = """names AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN ' n' || c_nationkey || ' ' WHEN o_orderpriority = '1-URGENT' THEN upper('region of ') || lower(r_name) WHEN o_orderstatus = 'P' THEN '' ELSE lower(n_name) END AS name, n_name, r_name, c_nationkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query("resolve_areas", f"""WITH {AREAS} SELECT o_orderkey, name, CASE WHEN name = '' THEN NULL WHEN name LIKE ' n%' THEN n_name WHEN name LIKE 'REGION%' THEN r_name || ' main' ELSE n_name END AS name_value,
  CASE WHEN name = '' THEN 0 WHEN name LIKE 'REGION%' THEN 60 ELSE 100 END::DOUBLE AS name_confidence, CASE WHEN name = '' THEN 'none' WHEN name LIKE ' n%' THEN 'abbrev' WHEN name LIKE 'REGION%' THEN 'ambiguous' ELSE 'exact' END AS name_method FROM names""")
def resolve_areas(spark, d):
    orders, customer, nation, region = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    name = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" n"), F.col("c_nationkey").cast("string"), F.lit(" ")))
        .when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("REGION OF "), F.lower("r_name")))
        .when(F.col("o_orderstatus") == "P", "")
        .otherwise(F.lower("n_name"))
    )
    short = nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("alias"), F.col("n_name").alias("area"))
    ambiguous = region.select(F.concat(F.lit("Region of "), "r_name").alias("alias"), F.concat("r_name", F.lit(" main")).alias("dominant"))
    return labels.resolve_areas(joined.select("o_orderkey", name.alias("name")), "name", short, nation.select(F.col("n_name").alias("area")), ambiguous)


@query("resolve_developers", """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN upper(n_name) WHEN c_acctbal > 0 THEN ' alias of ' || lower(n_name) END AS name, CASE WHEN c_acctbal > 0 THEN n_name END AS name_value,
  CASE WHEN c_acctbal > 0 THEN 'native ' || n_name END AS name_native, CASE WHEN c_acctbal > 0 THEN 100 ELSE 0 END::DOUBLE AS name_confidence, CASE WHEN c_acctbal > 5000 THEN 'exact' WHEN c_acctbal > 0 THEN 'alias' ELSE 'none' END AS name_method
  FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def resolve_developers(spark, d):
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    name = F.when(F.col("c_acctbal") > 5000, F.upper("n_name")).when(F.col("c_acctbal") > 0, F.concat(F.lit(" alias of "), F.lower("n_name")))
    mapping = nation.select(F.col("n_name").alias("english"), F.concat(F.lit("native "), "n_name").alias("arabic"), F.array(F.concat(F.lit("Alias of "), "n_name")).alias("aliases"))
    return labels.resolve_developers(customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("c_custkey", name.alias("name")), "name", mapping)


@query("replace_values", """SELECT c_custkey, coalesce(r_name, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN region ON r_regionkey = CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'FURNITURE' THEN 2 END""")
def replace_values(spark, d):
    region = table(spark, d, "region")
    alias = F.when(F.col("r_regionkey") == 1, "MACHINERY").when(F.col("r_regionkey") == 2, "FURNITURE")
    return clean.replace_values(table(spark, d, "customer"), "c_mktsegment", region.select(alias.alias("alias"), F.col("r_name").alias("canonical")).filter("alias is not null")).select("c_custkey", "c_mktsegment")


@query("umbrella_suggestions", """WITH p AS (SELECT o_custkey AS developer_id, o_orderpriority AS brand, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1, 2)
  SELECT developer_id, arg_min(brand, (-n, brand)) AS suggested, CAST(sum(n) AS BIGINT) AS projects, round(max(n) / sum(n), 4) AS agreeing, count(*) > 1 AS conflict FROM p GROUP BY 1""")
def umbrella_suggestions(spark, d):
    return labels.umbrella_suggestions(table(spark, d, "orders").select(F.col("o_custkey").alias("developer_id"), F.col("o_orderpriority").alias("brand"), F.col("o_orderkey").alias("project_number")))


@query("tag_labels", """SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'nation ' || s_nationkey ELSE 'other' END AS label, CASE WHEN s_acctbal > 0 AND s_nationkey < 9 THEN n_name END AS top_brand, CASE WHEN s_acctbal > 0 AND s_nationkey < 9 THEN 1 ELSE 0 END AS top FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def tag_labels(spark, d):
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation").filter("n_nationkey < 9")
    label = F.when(F.col("s_acctbal") > 0, F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))).otherwise("other")
    listed = nation.select(F.replace("n_name", F.lit("_"), F.lit(" - ")).alias("alias"), F.col("n_name").alias("canonical"))
    return labels.tag(supplier.select("s_suppkey", label.alias("label")), "label", listed, "top")


@query("mapping_coverage", """WITH n AS (SELECT DISTINCT p_brand AS name FROM part), m AS (SELECT n.name, n_name, CASE WHEN n_nationkey < 12 THEN n_name ELSE 'Gone' END AS target FROM n LEFT JOIN nation ON name = 'Brand#' || n_nationkey AND n_nationkey < 20)
  SELECT name, CASE WHEN n_name IS NOT NULL THEN target END AS target, CASE WHEN n_name IS NULL THEN 'missing' WHEN target = 'Gone' THEN 'invalid' ELSE 'ok' END AS status FROM m""")
def mapping_coverage(spark, d):
    nation = table(spark, d, "nation")
    mapping = nation.filter("n_nationkey < 20").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("alias"), F.when(F.col("n_nationkey") < 12, F.col("n_name")).otherwise("Gone").alias("canonical"))
    return labels.mapping_coverage(table(spark, d, "part").select(F.col("p_brand").alias("name")), mapping, nation.select(F.col("n_name").alias("name")))


@query("developer_matches", """WITH k AS (SELECT DISTINCT p_brand AS known FROM part), a AS (SELECT DISTINCT CASE WHEN s_acctbal > 6000 THEN 'Brand#' || s_nationkey WHEN s_acctbal > 2000 THEN 'New Brand#' || s_nationkey || ' Ltd' WHEN s_acctbal > 0 THEN 'and#' || s_nationkey ELSE 'Unknown' END AS name FROM supplier),
  e AS (SELECT name, known AS matched, 'exact' AS method FROM a JOIN k ON name = known), p AS (SELECT name, min(known) AS matched, 'substring' AS method FROM a JOIN k ON contains(name, known) OR contains(known, name) WHERE name NOT IN (SELECT name FROM e) GROUP BY 1)
  SELECT * FROM e UNION ALL SELECT * FROM p""")
def developer_matches(spark, d):
    key = F.col("s_nationkey").cast("string")
    name = (
        F.when(F.col("s_acctbal") > 6000, F.concat(F.lit("Brand#"), key)).when(F.col("s_acctbal") > 2000, F.concat(F.lit("New Brand#"), key, F.lit(" Ltd")))
        .when(F.col("s_acctbal") > 0, F.concat(F.lit("and#"), key)).otherwise("Unknown")
    )
    known = table(spark, d, "part").select(F.col("p_brand").alias("developer_name"))
    found = serving.match_developers(table(spark, d, "supplier").select(name.alias("developer")), "developer", known)
    return found.filter("method != 'fuzzy'").select("name", "matched", "method")


@query("rent_lookup", """WITH r AS (SELECT n_name || CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE ' outskirts' END AS area_name, CASE WHEN o_orderstatus = 'F' THEN '1br' ELSE '2BR' END AS bedrooms, median(o_totalprice) AS rent
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' AND n_nationkey < 9 OR o_orderpriority <> '1-URGENT' AND n_nationkey >= 5 GROUP BY 1, 2),
  q AS (SELECT c_custkey AS request_id, n_name AS area FROM customer JOIN nation ON c_nationkey = n_nationkey), x AS (SELECT request_id, area, min((area_name <> area, area_name, rent)) AS m FROM q JOIN r ON contains(area_name, area) AND bedrooms = '2BR' GROUP BY 1, 2)
  SELECT request_id, m[2] AS matched_area, round(m[3], 4) AS median_annual_rent, CASE WHEN m[1] THEN 'contains' ELSE 'exact' END AS rent_method FROM x""")
def rent_lookup(spark, d):
    orders, customer, nation = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    placed = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).filter((urgent & (F.col("n_nationkey") < 9)) | (~urgent & (F.col("n_nationkey") >= 5)))
    rents = placed.groupBy(
        F.concat("n_name", F.when(urgent, "").otherwise(" outskirts")).alias("area_name"), F.when(F.col("o_orderstatus") == "F", "1br").otherwise("2BR").alias("bedrooms")
    ).agg(F.median("o_totalprice").alias("median_annual_rent"))
    requests = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(F.col("c_custkey").alias("request_id"), F.lower("n_name").alias("area"), F.lit("2br").alias("bedroom"))
    out = serving.rent_for(requests, nation.select(F.col("n_name").alias("area_name")), rents)
    return out.withColumn("median_annual_rent", F.round("median_annual_rent", 4))


@query("override_status", """WITH s AS (SELECT l_suppkey AS developer_id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS labels FROM lineitem WHERE l_quantity > 49 AND l_discount < 0.02 GROUP BY 1)
  SELECT o.developer_id, expected, labels, CASE WHEN labels IS NULL THEN 'ABSENT' WHEN labels = expected THEN 'OK' ELSE 'CONFLICT' END AS status
  FROM (SELECT s_suppkey AS developer_id, CASE WHEN s_acctbal > 0 THEN 'N' ELSE 'R' END AS expected FROM supplier) AS o LEFT JOIN s ON s.developer_id = o.developer_id""")
def override_status(spark, d):
    seen = table(spark, d, "lineitem").filter("l_quantity > 49 and l_discount < 0.02").select(F.col("l_suppkey").alias("developer_id"), F.col("l_returnflag").alias("label"))
    overrides = table(spark, d, "supplier").select(F.col("s_suppkey").alias("developer_id"), F.when(F.col("s_acctbal") > 0, "N").otherwise("R").alias("expected"))
    return gates.override_status(seen, overrides).withColumn("labels", F.array_join("labels", ","))


@query("surviving_places", """WITH l AS (SELECT CASE p_type WHEN 'ECONOMY' THEN 'Sky Tower ' || p_size WHEN 'SMALL' THEN 'Holdings of ' || p_size ELSE 'Name ' || p_size END AS label FROM lineitem JOIN part ON l_partkey = p_partkey)
  SELECT label, count(*) AS tx FROM l WHERE label LIKE 'Sky Tower%' GROUP BY 1 HAVING count(*) >= 5""")
def surviving_places(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    size = F.col("p_size").cast("string")
    label = F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("Sky Tower "), size)).when(F.col("p_type") == "SMALL", F.concat(F.lit("Holdings of "), size)).otherwise(F.concat(F.lit("Name "), size))
    return gates.surviving_places(line.join(part, line.l_partkey == part.p_partkey).select(label.alias("label")), "label", 5)


OWNED = f"""{TX}, h AS (SELECT area, brand, kind, CASE WHEN l_suppkey > 30 THEN 'S' || l_suppkey % 7 END AS owner, lower(kind || ' ' || brand) AS t FROM tx)"""


def owned_facts(spark, d):
    owner = F.when(F.col("l_suppkey") > 30, F.concat(F.lit("S"), (F.col("l_suppkey") % 7).cast("string")))
    return transactions(spark, d).select(F.concat("kind", F.lit(" "), "brand").alias("text"), F.col("area").cast("string").alias("area"), owner.alias("owner"), "brand", "kind")


def brand_tokens(spark):
    return spark.createDataFrame([("Twos", "BRAND#2"), ("Twos", "ld#2"), ("Eco", "economy"), ("Eco", "econ"), ("None", "zzz")], "brand string, alias string")


ALIASED = f"""{OWNED}, a AS (SELECT 'Twos' AS brand, CAST(area AS VARCHAR) AS area, coalesce(owner, 'UNRESOLVED') AS owner FROM h WHERE contains(t, 'brand#2')
    UNION ALL SELECT 'Eco', CAST(area AS VARCHAR), coalesce(owner, 'UNRESOLVED') FROM h WHERE contains(t, 'econ')), c AS (SELECT brand, area, owner, count(*) AS n FROM a GROUP BY 1, 2, 3)"""


@query("alias_hits_by_owner", f"WITH {ALIASED} SELECT * FROM c")
def alias_hits_by_owner(spark, d):
    return registers.alias_hits_by_owner(owned_facts(spark, d), "text", "area", "owner", brand_tokens(spark))


@query("dominant_owners", f"""WITH {ALIASED} SELECT brand, area, arg_min(owner, (-n, owner)) AS owner, max(n) AS n, CAST(sum(n) AS BIGINT) AS total, round(max(n) / sum(n), 4) AS share,
  round(max(n) / sum(n), 4) < 0.3 AND sum(n) >= 20 AND NOT (brand = 'Eco' AND area IN ('1', '2', '3')) AS ambiguous FROM c GROUP BY 1, 2""")
def dominant_owners(spark, d):
    hits = registers.alias_hits_by_owner(owned_facts(spark, d), "text", "area", "owner", brand_tokens(spark))
    allowed = spark.createDataFrame([("Eco", a) for a in "123"], "brand string, area string")
    return registers.dominant_owners(hits, allowed, least_share=0.3, least_rows=20)


@query("rule_gaps", f"WITH {ALIASED} SELECT DISTINCT brand, area FROM c WHERE NOT (brand = 'Eco' AND area IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey <> 2))")
def rule_gaps(spark, d):
    hits = registers.alias_hits_by_owner(owned_facts(spark, d), "text", "area", "owner", brand_tokens(spark))
    rules = table(spark, d, "nation").filter("n_regionkey <> 2").select(F.lit("Eco").alias("brand"), F.col("n_nationkey").cast("string").alias("area"))
    return registers.rule_gaps(hits, rules)


@query("series_presence", f"""WITH {TX}, b AS (SELECT DISTINCT p_brand AS brand FROM part UNION SELECT n_name FROM nation), g AS (SELECT brand, count(*) AS rows, count(DISTINCT area || '/' || kind) AS groups FROM tx GROUP BY 1)
  SELECT b.brand, coalesce(rows, 0) AS rows, coalesce(groups, 0) AS groups FROM b LEFT JOIN g ON g.brand = b.brand""")
def series_presence(spark, d):
    panel_rows = transactions(spark, d).select("brand", F.concat_ws("/", "area", "kind").alias("group_id"))
    brands = registers.union_names((table(spark, d, "part"), "p_brand"), (table(spark, d, "nation"), "n_name"))
    return registers.series_presence(panel_rows, "brand", "group_id", brands.withColumnRenamed("name", "brand"))


@query("consolidation_leaks", f"""WITH {OWNED}, p AS (SELECT 'Brand#2' AS brand, brand AS label FROM h WHERE contains(t, '#2') UNION ALL SELECT 'Brand#7', brand FROM h WHERE contains(t, 'd#7') OR contains(t, 'omy brand#')),
  c AS (SELECT brand, label, count(*) AS n FROM p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, label) AS k FROM c WHERE label <> brand), l AS (SELECT brand, string_agg(label, ', ' ORDER BY k) AS labels FROM r WHERE k <= 5 GROUP BY 1)
  SELECT c.brand, CAST(sum(n) AS BIGINT) AS registered, CAST(sum(CASE WHEN label <> c.brand THEN n ELSE 0 END) AS BIGINT) AS leaked, max(labels) AS labels FROM c LEFT JOIN l ON l.brand = c.brand GROUP BY 1""")
def consolidation_leaks(spark, d):
    rules = spark.createDataFrame([("Brand#2", "#2"), ("Brand#7", "d#7"), ("Brand#7", "OMY Brand#")], "brand string, token string")
    return registers.consolidation_leaks(owned_facts(spark, d), "text", "brand", rules)


@query("clean_transactions", """SELECT o_orderkey AS transaction_id, CAST(o_orderdate AS DATE) AS instance_date, coalesce(r_name, c_mktsegment) AS area_name_en, CAST(year(o_orderdate) AS INTEGER) AS transaction_year, CAST(month(o_orderdate) AS INTEGER) AS transaction_month
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN region ON c_mktsegment = 'MACHINERY' AND r_regionkey = 1 WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND o_totalprice > 1000""")
def clean_transactions(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    day = F.when(F.col("o_orderstatus") == "P", "not a day").when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    raw = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("transaction_id"), day.alias("instance_date"), F.when(F.col("o_orderpriority") != "5-LOW", "Residential").otherwise("Commercial").alias("property_usage_en"),
        F.col("o_totalprice").alias("actual_worth"), (F.col("o_totalprice") - 1000).alias("procedure_area"), F.col("c_mktsegment").alias("area_name_en"),
    )
    areas = table(spark, d, "region").filter("r_regionkey = 1").select(F.lit("MACHINERY").alias("alias"), F.col("r_name").alias("canonical"))
    kept, _ = clean.clean_transactions(raw.unionByName(raw), areas)  # every row twice
    return kept.select("transaction_id", "instance_date", "area_name_en", "transaction_year", "transaction_month")


@query("clean_rents", """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS start, CASE o_orderpriority WHEN '1-URGENT' THEN 'Studio' WHEN '2-HIGH' THEN '2BR' WHEN '3-MEDIUM' THEN '6BR+' END AS bedrooms FROM orders)
  SELECT bedrooms, CAST(year(start) AS INTEGER) AS contract_year, count(*) AS n FROM r WHERE bedrooms IS NOT NULL AND (year(start) BETWEEN 1993 AND 1999 OR start IS NULL) GROUP BY 1, 2""")
def clean_rents(spark, d):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "Studio").when(F.col("o_orderpriority") == "2-HIGH", "2 bed rooms+hall").when(F.col("o_orderpriority") == "3-MEDIUM", "6 bed rooms+hall").otherwise("Shop")
    day = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    raw = table(spark, d, "orders").select(kind.alias("ejari_property_sub_type_en"), day.alias("contract_start_date"), day.alias("contract_end_date"))
    return clean.clean_rents(raw, 1993, 1999)["residential"].groupBy("bedrooms", "contract_year").agg(F.count("*").alias("n"))


@query("clean_dated", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS d_parsed, CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS year, CASE WHEN o_orderstatus <> 'P' THEN CAST(month(o_orderdate) AS INTEGER) END AS month,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(quarter(o_orderdate) AS INTEGER) END AS quarter, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m') END AS year_month FROM orders""")
def clean_dated(spark, d):
    day = F.when(F.col("o_orderstatus") == "P", "31-31-1999").when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return clean.clean_dated(table(spark, d, "orders").select("o_orderkey", day.alias("d")), ["d"]).drop("d")


@query("parse_counters", "SELECT 'd' AS \"column\", count_if(o_orderstatus <> 'P') AS parsed, count_if(o_orderstatus = 'P' AND o_totalprice > 5000) AS failed FROM orders")
def parse_counters(spark, d):
    day = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "dd-MM-yyyy")).when(F.col("o_totalprice") > 5000, "no day")
    return clean.parse_counters(clean.clean_dated(table(spark, d, "orders").select(day.alias("d")), ["d"]), ["d"])


@query("domain_and_year_filters", """SELECT CASE o_orderstatus WHEN 'F' THEN 'Ready' ELSE 'OffPlan' END AS reg_type, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders
  WHERE o_orderstatus IN ('F', 'O') AND (year(o_orderdate) BETWEEN 1994 AND 1999 OR o_orderpriority = '5-LOW') AND o_totalprice > 1000 AND o_totalprice < 400000 AND o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'h')) GROUP BY 1, 2""")
def domain_and_year_filters(spark, d):
    orders = table(spark, d, "orders").withColumn("y", F.year("o_orderdate")).withColumn("year", F.when(F.col("o_orderpriority") != "5-LOW", F.col("y")))
    known = clean.in_domain(orders, "o_orderstatus", {"F": "Ready", "O": "OffPlan"}, "reg_type")
    kept = known.filter(clean.within_or_null(F.col("year"), 1994, 1999) & clean.within(F.col("o_totalprice"), 1000, 400_000, closed=False))
    groups = orders.select(F.col("o_orderpriority").alias("group_id"), F.when(F.lower("o_orderpriority").contains("h"), "A Sale").otherwise("Mortgage").alias("name_en")).distinct()
    sales = panel.sale_groups(groups.withColumn("group_id", F.col("group_id")))
    return kept.join(sales, text.canonical_id(F.col("o_orderpriority")) == F.col("trans_group_id"), "left_semi").groupBy("reg_type", "y").agg(F.count("*").alias("n"))


@query("request_texts", """SELECT o_orderkey, CASE WHEN o_totalprice >= 1e6 THEN printf('AED %.2fM', o_totalprice / 1e6) WHEN o_totalprice >= 1e3 THEN printf('AED %.0fK', o_totalprice / 1e3) ELSE printf('AED %.0f', o_totalprice) END AS amount,
  CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderdate AS DATE) END AS day, CASE o_orderstatus WHEN 'F' THEN 18 WHEN 'O' THEN (2003 - year(o_orderdate)) * 12 + 3 - month(o_orderdate) END AS months,
  CASE o_orderstatus WHEN 'F' THEN 'OffPlan' WHEN 'O' THEN 'Ready' ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'OffPlan' END END AS reg_type FROM orders""")
def request_texts(spark, d):
    status = F.col("o_orderstatus")
    day = F.when(status == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    said = F.when(status == "F", "a flat, Handover in 18 months, off-plan").when(status == "O", "ready to move in March 2003").otherwise("something")
    return table(spark, d, "orders").select(
        "o_orderkey", text.format_currency(F.col("o_totalprice")).alias("amount"), dates.parse_date(day).alias("day"), dates.handover_months(said, F.col("o_orderdate")).alias("months"),
        bedrooms.reg_type(said, F.lit(None).cast("int"), F.when(F.col("o_orderpriority") == "1-URGENT", "D")).alias("reg_type"),
    )
