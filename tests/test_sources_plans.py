"""Files in, published runs out, and the plans end to end on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from terrafold.operators import clean
from terrafold.plans import analysis, macro, panel, serving
from terrafold.sources import readers, schemas, writers
from terrafold.streaming import monthly


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_readers(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'developer_id,developer_name_en,extra\n1," Em""aar ",x\n2,,y\n')
    with pytest.raises(ValueError):
        readers.csv(spark, path, schemas.DEVELOPERS)
    out = readers.optional(spark, path, schemas.DEVELOPERS)
    assert out.columns == schemas.DEVELOPERS.fieldNames() and out.filter("developer_id = '1'").first()["developer_name_ar"] is None
    assert readers.csv(spark, path, schemas.DEVELOPERS, ["developer_id"]).count() == 2
    bad = write(tmp_path / "b.csv", "group_id,name_en\n1,Sales\n2,x,y,z\n")
    good, broken = readers.tolerant(spark, bad, schemas.TRANSACTION_GROUPS)
    assert good.count() == 1 and broken.count() == 1
    ovr = write(tmp_path / "o.csv", "project_number,developer_brand\n1, A  B \n1,C\n,D\n2,\n")
    assert [tuple(r) for r in readers.overrides(spark, ovr, "project_number").collect()] == [("1", "C")]


def test_documents(spark, tmp_path):
    for text in ('["A", "B"]', '{"brands": ["A", "B"]}'):
        assert readers.name_list(spark, write(tmp_path / "n.json", text), "brands").count() == 2
    doc = json.dumps({"brands": {"E": {"registered_entities": ["x"], "aliases": ["e1"], "note": ""}}})
    assert readers.consolidation(spark, write(tmp_path / "c.json", doc)).first()["aliases"] == ["e1"]
    kml = """<kml><Document><Placemark><ExtendedData><SchemaData><SimpleData name="COMM_NUM">12</SimpleData><SimpleData name="CNAME_E">C</SimpleData></SchemaData></ExtendedData>
    <Polygon><outerBoundaryIs><LinearRing><coordinates>0,0,0 1,0,0 1,1,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>"""
    got = readers.polygons(spark, write(tmp_path / "k.kml", kml)).first()
    assert got["community_num"] == "12" and got["name"] == "C" and len(got["ring"]) == 3


def test_rates(spark, tmp_path):
    a = write(tmp_path / "r1.csv", "title,,\nDate,3 Month ,1M\n01-02-2024,5.1,4\n02-02-2024,5.2,4\n")
    b = write(tmp_path / "r2.csv", "التاريخ,3 أشهر,x\n02-02-2024,5.5,\n")
    out = {str(r["date"]): r["3_month"] for r in readers.rates(spark, [a, b]).collect()}
    assert out == {"2024-02-01": 5.1, "2024-02-02": 5.5}
    days = spark.createDataFrame([(k,) for k in range(64)], "k int").select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("k")).alias("date"), *[(F.col("k") * 1.0).alias(t) for t in schemas.TENORS])
    f = macro.rate_features(days)
    assert f.filter("volatility_63 is not null").count() == 2
    m = macro.monthly_rates(f).orderBy("year_month").collect()
    assert len(m) == 3 and m[1]["change_21"] == 21.0
    assert readers.rate_table(macro.monthly_rates(f)).columns[0] == "year_month"


def test_files(spark, tmp_path):
    (tmp_path / "Visitors_Q2_2023.csv").write_text("x")
    got = readers.files(spark, str(tmp_path), {"visitors": "visitors", "csv": "other"}).first()
    assert (got["year"], got["quarter"], got["kind"]) == (2023, "Q2", "visitors")


def test_runs(spark, tmp_path):
    run = writers.Run(spark, str(tmp_path))
    run.write("t", spark.range(3))
    with pytest.raises(RuntimeError):
        run.publish({"bad": 1})
    good = writers.Run(spark, str(tmp_path))
    good.write("t", spark.range(3))
    good.publish({"bad": 0})
    assert writers.latest_run(spark, str(tmp_path)) == good.path
    assert "| id |" in writers.markdown(spark.range(2), "T")
    writers.write_split({"a": spark.range(1), "b": spark.range(2)}, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/b")).count() == 2


def domain(spark):
    day = "01-0{}-2024"
    tx = [(str(k), day.format(k % 6 + 1), "Sale", "Residential", "Unit", "Off-Plan Properties", "2 B/R", 100.0, 1e6 + k, None, "7" if k % 2 else "", "Azizi Riviera", "MP", "B", "5", "Area", "1", "1") for k in range(60)]
    tx += [("x1", "bad date", "Sale", "Residential", "Unit", "Off-Plan Properties", "2 B/R", 100.0, 1e6, None, "7", "", "", "", "5", "Area", "1", "1"), ("x2", day.format(1), "Sale", "Residential", "Unit", "Off-Plan Properties", "Office", 100.0, 1e6, None, "7", "", "", "", "5", "Area", "1", "1")]
    raw = spark.createDataFrame(tx, schemas.TRANSACTIONS)
    projects = clean.projects(spark.createDataFrame([("p", "7", "3", "D", "3", "D", "01-01-2023", "01-04-2024", None, None, " active ", 50.0, "5", "Area", "MP", 40, 2, 0)], schemas.PROJECTS))
    developers = spark.createDataFrame([("3", "Azizi L.L.C", "ازيزي")], schemas.DEVELOPERS)
    groups = spark.createDataFrame([("1", "Sales"), ("2", "Mortgage")], schemas.TRANSACTION_GROUPS)
    return raw, projects, developers, groups


def test_panel_end_to_end(spark, tmp_path):
    raw, projects, developers, groups = domain(spark)
    brands = spark.createDataFrame([("Azizi", ["Azizi Riviera"], [])], "brand string, aliases array<string>, registered_entities array<string>")
    rents = spark.createDataFrame([("2024-02-01", "5", "2BR", 90000.0, 80.0)], "year_month string, area_id string, bedroom string, rent double, rent_sqft double").withColumn("year_month", F.to_date("year_month"))
    path = panel.run(spark, str(tmp_path), raw, projects, developers, groups, brands, rents)
    enriched, labelled, built = (spark.read.parquet(f"{path}/{n}") for n in ("enriched", "labelled", "panel"))
    assert writers.latest_run(spark, str(tmp_path)) == path
    assert enriched.count() == 60 and enriched.filter("developer_source = 'master'").count() == 30
    flips = enriched.filter("offplan_after_handover = 1")
    assert flips.count() > 0 and flips.filter("reg_type <> 'Ready'").count() == 0
    assert labelled.select("developer_brand_label", "developer_brand_label_source").distinct().collect() == [("Azizi", "PUBLIC_BRAND")]
    assert built.count() == 6 and built.filter("supply_units > 0").count() == 3 and built.agg(F.sum("units_completing")).first()[0] == 40
    clean_rows, quarantine = clean.clean_transactions(raw)
    assert clean_rows.count() == 61 and quarantine.count() == 1

    requests = spark.createDataFrame([(1, "Azizi", "5", "2 bed", 1e6, 900.0, None, None, 18, "off plan", "2024-07-01")], "request_id int, developer string, area string, bedroom string, price double, unit_sqft double, property_type string, reg_type string, handover_months int, raw_query string, as_of string").withColumn("as_of", F.to_date("as_of"))
    series = built.withColumnsRenamed({"area_id": "area", "developer_brand_label": "developer"})
    areas = spark.createDataFrame([("5", 1000.0, 3)], "area_name string, current_median double, transaction_count_12m long")
    stats = spark.createDataFrame([("Azizi", 3)], "developer_name string, projects_total int")
    bench = spark.createDataFrame([("5 north", "2BR", 70000.0)], "area_name string, bedrooms string, median_annual_rent double")
    got = analysis.analyze(requests, series, areas, stats, bench).first()
    assert got["match_type"] in ("exact", "partial_area_bedroom") and got["rent_method"] == "contains" and got["handover_total_median"] > 0


def test_rent_cleaning(spark):
    rows = [("01-01-2024", "01-01-2025", 5e4, 5e4, "A", "Flat", t, "Residential", "", 50.0, "", "", "", "", "") for t in ("Studio", "Shop", None)]
    rows.append(("01-01-2205", "01-01-2206", 5e4, 5e4, "A", "Flat", "Studio", "Residential", "", 50.0, "", "", "", "", ""))
    parts = clean.clean_rents(spark.createDataFrame(rows, schemas.RENT_CONTRACTS))
    assert parts["residential"].count() == 1 and parts["commercial"].count() == 2 and parts["unmapped"].count() == 2
    dated = clean.clean_dated(spark.createDataFrame([("a", "31-12-2024"), ("b", "x")], "id string, d string"), ["d"])
    assert dated.count() == 2 and clean.parse_counters(dated, ["d"]).first().asDict() == {"column": "d", "parsed": 1, "failed": 1}


def test_serving_plan(spark, tmp_path):
    tx = spark.createDataFrame([("A", "2024-01-01", 10.0), ("A", "2024-03-01", 30.0), ("A", "2023-01-15", 20.0)], "area_name string, date string, price double").withColumn("date", F.to_date("date"))
    projects = spark.createDataFrame([("D", "1", "ACTIVE", 10, 1.0, None, None, "A")], "developer_name string, project_number string, project_status string, no_of_units int, percent_completed double, project_start_date date, project_end_date date, area_name string")
    rents = spark.createDataFrame([("A", "2BR", "2024-01-01", 100.0, 10.0)], "area_name string, bedrooms string, date string, annual_amount double, actual_area double")
    reference = spark.createDataFrame([("A", 1, "a")], "area_name string, total_units int, common_aliases string")
    path = serving.publish(spark, serving.build(tx, projects, rents, reference), str(tmp_path))
    got = spark.read.parquet(f"{path}/area_stats").first()
    assert got["current_median"] == 20.0 and got["price_change_12m"] == 0.0 and got["supply_pipeline"] == 10


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "2024-01-05 00:00:00", 1.0), ("a", "2024-01-20 00:00:00", 3.0), ("a", "2024-06-01 00:00:00", 9.0)], "k string, ts string, v double").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(src)
    monthly.to_table(monthly.monthly_segments(stream, ["k"], "ts", "v"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["n"], r["mean_value"]) for r in got] == [(2, 2.0)]
