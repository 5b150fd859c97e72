"""Operators on tiny frames: nulls, ties, borders."""

import pytest
from pyspark.sql import functions as F

from terrafold.operators import aggregates, clean, forecast, gates, impute, joins, labels, serving, windows


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def months(spark, values, key="a"):
    data = [(key, f"{2020 + k // 12}-{k % 12 + 1:02d}-01", v) for k, v in enumerate(values)]
    return spark.createDataFrame(data, "k string, m string, v double").withColumn("m", F.to_date("m"))


def test_synonyms_and_columns(spark):
    df = spark.createDataFrame([(1, 2)], " O/N  string, `1 Month ` int".replace(" O/N ", "`O/N `"))
    out = clean.rename_synonyms(df, {"O/N": "overnight", "1 month": "1_month"})
    assert out.columns == ["overnight", "1_month"]
    assert clean.ensure_columns(out, {"x": "double"}).columns[-1] == "x"
    assert clean.keep_ordered(out, ["1_month", "none"]).columns == ["1_month"]


def test_filters(spark):
    df = spark.createDataFrame([(99.99,), (100.0,), (50000.0,), (50000.01,), (None,)], "v double")
    assert df.filter(clean.within(F.col("v"), 100, 50000)).count() == 2
    assert df.filter(clean.within(F.col("v"), 100, 50000, closed=False)).count() == 0
    assert df.filter(clean.within_or_null(F.col("v"), 100, 50000)).count() == 3
    words = spark.createDataFrame([("a",), ("b",), (None,)], "w string")
    assert rows(clean.in_domain(words, "w", {"a": "A"}), "w") == [("A",)]


def test_project_dedup(spark):
    df = spark.createDataFrame(
        [("1", "p", "2020-01-01", "2021-01-01", 10.0), ("2", "p", None, "2020-01-01", 99.0), ("3", "p", None, "2020-01-01", 99.5), ("4", "q", None, None, None), ("5", "q", None, None, None), ("6", None, None, None, None)],
        "project_id string, project_number string, cancellation_date string, handover_date string, percent_completed double",
    )
    assert rows(clean.dedup_projects(df), "project_id") == [("3",), ("4",)]


def test_dominant_and_modes(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", None), ("k", None), ("l", None)], "k string, v string")
    assert rows(aggregates.dominant(df, ["k"], "v", "v"), "k", "v", "n", "total") == [("k", "a", 1, 2)]
    assert rows(df.groupBy("k").agg(aggregates.mode_of("v").alias("m")), "k", "m") == [("k", "a"), ("l", None)]
    assert rows(aggregates.top_k(df, ["k"], "v", 1), "v", "rank") == [("a", 1)]
    w = spark.createDataFrame([("k", "x", 1), ("k", "y", 3), ("k", "x", 2)], "k string, v string, w int")
    assert rows(aggregates.dominant_by(w, ["k"], "v", "w"), "v", "w") == [("x", 3)]


def test_active_by_month_is_the_range_join(spark):
    days = ["2019-12-31", "2020-01-01", "2020-01-02", "2020-02-01", "2020-02-15", None, "2020-03-01", "2021-01-01"]
    p = spark.createDataFrame([("a" if k % 2 else "b", d, k + 1) for k, d in enumerate(days)], "area string, end_date string, units long").withColumn("end_date", F.to_date("end_date"))
    m = spark.createDataFrame([(f"2020-0{k}-01",) for k in range(1, 5)], "month string").withColumn("month", F.to_date("month"))
    got = rows(joins.active_by_month(p, m, ["area"], ["units"]), "area", "month", "units", "projects")
    plain = p.crossJoin(m).filter("end_date is null or end_date > month").groupBy("area", "month").agg(F.sum("units").alias("units"), F.count("*").alias("projects"))
    assert got == rows(plain, "area", "month", "units", "projects")


def test_fallback_and_keys(spark):
    f = spark.createDataFrame([("1", "m"), (None, "m"), ("9", None)], "p string, m string")
    a = spark.createDataFrame([("1", "x"), (None, "never")], "key string, value string")
    b = spark.createDataFrame([("m", "y")], "key string, value string")
    assert rows(joins.fallback(f, [(a, "p", "project"), (b, "m", "master")], "v", "s"), "v", "s") == [("x", "project"), ("y", "master"), (None, None)]
    assert joins.key_presence(f, f.filter("p = '1'"), ["p"]).first().asDict() == {"wanted": 2, "present": 1}
    assert rows(joins.new_keys(f, a.withColumnRenamed("key", "p"), "p"), "p") == [("9",)]


def test_alias_hits(spark):
    texts = spark.createDataFrame([("BY ELLINGTON HOUSE",), ("WELLINGTON",), ("",), (None,), ("PALM JUMEIRAH ONE",)], "t string")
    aliases = spark.createDataFrame([("ELLINGTON", "E", 2), ("ELLINGTON HOUSE", "H", 3), ("PALM", "P", 1), ("JUMEIRAH ONE", "J", 5)], "alias string, brand string, rank int")
    assert rows(joins.alias_hits(texts, "t", aliases), "t", "brand", "conflict") == [("BY ELLINGTON HOUSE", "H", True), ("PALM JUMEIRAH ONE", "J", True)]


def test_segment_match_tiers(spark):
    series = spark.createDataFrame(
        [("g1", "A", "Unit", "1BR", "Ready", "Dev"), ("g2", "A", "Unit", "1BR", "Ready", "ALL_DEVELOPERS"), ("g3", "B", "Villa", "2BR", "Ready", "X")],
        "group_id string, area string, property_type string, bedroom string, reg_type string, developer string",
    )
    ask = [(1, "a", "Unit", "1BR", "Ready", "dev"), (2, "A", "Unit", "1BR", "Ready", "other"), (3, "B", "Unit", "9BR", "OffPlan", "y"), (4, "Z", "Unit", "2br", "Ready", "y"), (5, "Z", "Unit", "8BR", "Ready", "y"), (6, None, None, None, None, None)]
    r = spark.createDataFrame(ask, "request_id int, area string, property_type string, bedroom string, reg_type string, developer string")
    got = {x["request_id"]: (x["group_id"], x["match_type"], x["confidence"]) for x in joins.segment_match(r, series).collect()}
    assert got == {1: ("g1", "exact", 95.0), 2: ("g2", "exact_all_developers", 85.0), 3: ("g3", "area_only", 50.0), 4: ("g3", "fallback_bedroom", 30.0), 5: (None, "no_match", 0.0), 6: (None, "no_match", 0.0)}


def test_fills(spark):
    df = months(spark, [None, 1.0, None, None, 4.0, None])
    assert [r[0] for r in df.select(windows.fill_both_ways("v", ["k"], "m"), "m").orderBy("m").collect()] == [1, 1, 1, 1, 4, 4]
    inner = windows.fill_interior(df, ["v"], ["k"], "m").orderBy("m").collect()
    assert [r["v"] for r in inner] == [0, 1, 1, 1, 4, 0] and [r["v_missing"] for r in inner] == [1, 0, 1, 1, 0, 1]
    assert all(r["v"] == 0 for r in windows.fill_interior(months(spark, [None, None]), ["v"], ["k"], "m").collect())


@pytest.mark.parametrize("n,some", [(12, 0), (13, 1), (14, 1)])
def test_momentum_needs_13(spark, n, some):
    out = windows.momentum(months(spark, [100.0 + k for k in range(n)]), ["k"], "m", "v").collect()
    assert len(out) == some
    if some:
        last = 100.0 + n - 1
        assert out[0]["change_3m"] == pytest.approx((last / (last - 3) - 1) * 100)


@pytest.mark.parametrize("n,some", [(14, 0), (15, 1)])
def test_volume_needs_15(spark, n, some):
    assert windows.volume_trend(months(spark, [float(k + 1) for k in range(n)]), ["k"], "m", "v").count() == some


def test_other_windows(spark):
    df = months(spark, [float(k) for k in range(15)])
    vol = [r[0] for r in df.select(windows.rolling_std("v", 7, ["k"], "m"), "m").orderBy("m").collect()]
    assert vol[:6] == [None] * 6 and vol[6] is not None
    assert windows.change_at(df, ["k"], "m", "v", 12, "c").first()["c"] == pytest.approx((14 / 3 - 1) * 100)
    assert windows.tail(df, ["k"], "m", 5).count() == 5
    assert windows.drop_running_month(df, ["k"], "m", F.lit("2021-03-20").cast("date")).count() == 14
    assert windows.drop_running_month(df.limit(3), ["k"], "m", F.lit("2020-03-20").cast("date")).count() == 3
    ahead = windows.future_rows(df, ["k"], "m", 3, means=["v"]).orderBy("step").collect()
    assert [str(r["m"]) for r in ahead] == ["2021-04-01", "2021-05-01", "2021-06-01"] and ahead[0]["v"] == 11.5
    q = spark.createDataFrame([(2024, "Q1", 5), (2024, None, 6), (2024, "Q9", 7)], "year int, quarter string, n int")
    assert [str(r["month"]) for r in windows.quarters_to_months(q, "year", "quarter").orderBy("month").collect()] == ["2024-01-01", "2024-02-01", "2024-03-01"]


def panel(spark):
    data = [("g1", 0, "a", None, None, 0), ("g1", 1, "a", 100.0, 1.0, 2), ("g1", 2, "a", None, 2.0, 0), ("g2", 0, "a", None, None, 0), ("g3", 0, "b", None, None, 0), ("g4", 0, None, 300.0, 3.0, 1)]
    return spark.createDataFrame(data, "group_id string, time_idx int, area string, median_rent double, median_rent_sqft double, rent_count int")


def test_tiers(spark):
    out = impute.impute_rents(panel(spark), ["group_id"], "time_idx", "area")
    got = {(r["group_id"], r["time_idx"]): (r["median_rent"], r["rent_imputation_source"], r["rent_imputed"]) for r in out.collect()}
    assert got[("g1", 0)] == (100.0, "group_ffill_bfill", 1) and got[("g1", 1)] == (100.0, None, 0) and got[("g1", 2)][1] == "group_ffill_bfill"
    assert got[("g2", 0)] == (100.0, "area_median", 1) and got[("g3", 0)] == (200.0, "global_median", 1)
    assert impute.unfilled_rents(out) == 0
    assert impute.impute_rents(panel(spark), ["group_id"], "time_idx", "area", "drop").count() == 2
    assert impute.impute_rents(panel(spark), ["group_id"], "time_idx", "area", "none").count() == 6
    with pytest.raises(ValueError):
        impute.impute_rents(panel(spark), ["group_id"], "time_idx", "area", "magic")


def test_other_fills(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), (None, 5.0)], "k string, v double")
    assert rows(impute.impute_median(df, ["k"], ["v"]), "k", "v", "v_missing") == sorted([("a", 1.0, 0), ("a", 1.0, 1), ("b", 3.0, 1), (None, 5.0, 0)], key=str)
    t = impute.training_fill(months(spark, [None, 2.0, float("inf")]).withColumn("c", F.lit(" ")), ["k"], "m", ["v"], [], ["c"])
    assert sorted(r["v"] for r in t.collect()) == [0.0, 2.0, 2.0] and t.first()["c"] == "UNKNOWN"


CASCADE = "developer_id string, brand_public string, id_override string, owner_override string, name_en string, name_ar string, umbrella string, umbrella_is_canonical boolean"


def test_label_cascade_has_all_ten_sources(spark):
    data = [
        ("1", "Pub", "x", None, None, None, None, None), ("2", "", "Over", None, None, None, None, None), ("3", None, None, "Own", None, None, None, None),
        ("4", None, None, None, "DMCC", None, None, None), ("5", None, None, None, "Sky Tower LLC", None, "Emaar", True), ("6", None, None, None, "Palm Marina", None, "X Holding", True),
        ("7", None, None, None, "City Developments L.L.C", None, None, None), ("8", None, None, None, None, "شركة النخيل", None, None), ("9", None, None, None, "NA", "", None, None), (None, None, None, None, None, None, None, None),
    ]
    out = labels.label_cascade(spark.createDataFrame(data, CASCADE)).collect()
    got = {r["developer_id"]: (r["developer_brand_label"], r["developer_brand_label_source"]) for r in out}
    assert got == {
        "1": ("Pub", "PUBLIC_BRAND"), "2": ("Over", "ID_BRAND_OVERRIDE"), "3": ("Own", "OWNER_OVERRIDE_DEVELOPER_ID"), "4": ("DEVELOPER_ID_4", "ID_FALLBACK_AUTHORITY"),
        "5": ("Emaar", "UMBRELLA_OWNER_FALLBACK_SUSPICIOUS"), "6": ("DEVELOPER_ID_6", "ID_FALLBACK_SUSPICIOUS"), "7": ("City Developments", "LEGAL_NORMALIZED_EN"),
        "8": ("شركة النخيل", "LEGAL_NORMALIZED_AR"), "9": ("DEVELOPER_ID_9", "ID_FALLBACK"), None: ("DEVELOPER_ID_MISSING", "MISSING_ID_FALLBACK"),
    }


def test_brand_resolution_order(spark):
    facts = spark.createDataFrame(
        [("1", "d1", "Azizi Riviera", None, "Meydan One"), ("2", "d1", None, "Plain", None), ("3", "d9", None, None, None), ("4", "d9", None, None, "M"), ("5", "d9", None, None, None)],
        "project_number string, developer_id string, project_name string, building_name string, master_project string",
    )
    brands = spark.createDataFrame([("Azizi", ["Azizi Riviera"], ["ازيزي"]), ("Meydan", ["Meydan One"], None)], "brand string, aliases array<string>, registered_entities array<string>")
    one = lambda k, v, name: spark.createDataFrame([(k, v)], f"{name} string, brand string")
    out = labels.resolve_brands(facts, labels.alias_dictionary(brands), one("d1", "Legal", "developer_id"), one("3", "Proj", "project_number"), one("M", "Mast", "master_project"))
    got = {r["project_number"]: (r["brand"], r["brand_source"]) for r in out.collect()}
    assert got == {"1": ("Azizi", "TEXT"), "2": ("Legal", "LEGAL_MAP"), "3": ("Proj", "PROJECT_OVERRIDE"), "4": ("Mast", "MASTER_FALLBACK"), "5": (None, "UNRESOLVED")}


def test_entities(spark):
    ref = spark.createDataFrame([("A", 10, "x, y"), ("B", 20, "X,, z"), ("C", None, None)], "area_name string, total_units int, common_aliases string")
    assert rows(labels.area_aliases(ref), "alias", "dominant", "ambiguous") == [("x", "B", True), ("y", "A", False), ("z", "B", False)]
    names = spark.createDataFrame([("Al Nakheel",), ("AL NAKHEEL",), ("Al Nakheel",), ("Al Nakhel",), (None,)], "n string")
    assert rows(labels.spelling_conflicts(names, "n"), "key", "canonical") == [("al nakheel", "Al Nakheel")]
    assert ("AL NAKHEEL", "Al Nakhel") in rows(joins.similar_pairs(names, "n"), "a", "b")
    ovr = spark.createDataFrame([("1", "Emaar"), ("2", "emaar.")], "developer_id string, developer_brand string")
    good, bad = labels.validate_overrides(ovr, spark.createDataFrame([("Emaar",)], "brand string"))
    assert good.count() == 1 and bad.first()["suggestion"] == "Emaar"
    req = spark.createDataFrame([("JVC",), ("zzz",), (None,)], "area string")
    steps = [(spark.createDataFrame([("jvc", "Al Barsha South Fourth")], "key string, value string"), "abbrev", 100.0)]
    assert rows(labels.resolve_names(req, "area", steps), "area_value", "area_method") == sorted([("Al Barsha South Fourth", "abbrev"), ("zzz", "fallback"), (None, None)], key=str)


def test_gates(spark):
    good = spark.createDataFrame([("D", "OffPlan", 100.0, 1.0, 3), ("E", "Ready", 50000.0, 0.0, 0)] * 20, "developer_name string, reg_type string, median_price double, median_rent double, units_completing int")
    assert all(r["passed"] for r in gates.run_gates(good, gates.panel_gates(good.columns)))
    for column, value in (("developer_name", F.lit("Unknown")), ("reg_type", F.lit("Ready")), ("median_price", F.lit(99.0)), ("median_rent", F.lit(-1.0))):
        with pytest.raises(gates.GateError):
            gates.run_gates(good.withColumn(column, value), gates.panel_gates(good.columns))
    soft = gates.run_gates(good.withColumn("units_completing", F.lit(0)), gates.panel_gates(good.columns))
    assert [r["name"] for r in soft if not r["passed"]] == ["units_completing has signal"]
    spread = spark.createDataFrame([("Lab", f"d{k % 12}", "a") for k in range(1200)] + [("Top", "d0", "a")] * 1200, "l string, e string, a string")
    assert rows(gates.dispersed_labels(spread, "l", "e", "a"), "l") == [("Lab",)]
    assert gates.dispersed_labels(spread, "l", "e", "a", exempt=["Lab"]).count() == 0
    leaks = spark.createDataFrame([("A LLC", "X"), ("B Holding", "PUBLIC_BRAND"), ("C Holding", "X"), ("D", "X")], "l string, s string")
    assert rows(gates.suffix_leaks(leaks, "l", "s"), "l", "leak") == [("A LLC", "SUFFIX"), ("C Holding", "HOLDING")]


def test_forecasts(spark):
    df = spark.createDataFrame(
        [(1, 1000.0, 50000.0, 1e6, 12, 800.0, 18, None, "1BR"), (2, None, None, None, 12, None, None, 900.0, None)],
        "id int, current_sqft double, current_rent double, price double, horizon int, unit_sqft double, handover_months int, area_median_sqft double, bedroom string",
    )
    out = {r["id"]: r for r in forecast.investor_fields(forecast.horizons(forecast.fallback_forecast(df))).collect()}
    assert out[1]["sqft_median"] == pytest.approx(1000 * 1.01**12) and out[1]["anchor_source"] == "series" and out[2]["anchor_source"] == "area"
    assert out[1]["handover_total_median"] == round(1000 * 1.01**18 * 800) and out[2]["handover_total_median"] is None
    assert out[2]["sqft_median"] == 1500.0 and out[2]["rent_median"] == 80000.0
    flows = spark.createDataFrame([("a", 0, -100.0), ("a", 12, 110.0), ("b", 0, 1.0)], "k string, m int, x double")
    got = {r["k"]: r["irr"] for r in forecast.internal_rate(flows, ["k"], "m", "x").collect()}
    assert got["a"] == pytest.approx(0.10, abs=1e-6) and got["b"] is None
    gate = spark.createDataFrame([(90.0, 60.0, 95.0, "exact", 1.0, 2.0, 3.0), (None, None, None, None, 1.0, 2.0, 3.0)], "area_confidence double, developer_confidence double, model_confidence double, match_type string, a double, d double, m double")
    assert rows(forecast.confidence_gate(gate, {"a": "area", "d": "developer", "m": "model"}), "a", "d", "m") == sorted([(1.0, None, 3.0), (None, None, None)], key=str)


def test_serving(spark):
    p = spark.createDataFrame([("D", "1", "FINISHED", 10, 100.0, None, None, "A"), ("D", "2", None, None, 50.0, None, None, "A")], "developer_name string, project_number string, project_status string, no_of_units int, percent_completed double, project_start_date date, project_end_date date, area_name string")
    r = serving.developer_stats(p).first()
    assert (r["projects_completed"], r["projects_active"], r["completion_rate"], r["total_units"], r["avg_duration_months"]) == (1, 1, 50.0, 10, 0.0)
    names = spark.createDataFrame([("Emaar", 2), ("EMAAR!", 1), ("emaar", 1), ("", 0)], "l string, r int")
    assert rows(serving.display_list(names, "l", "r"), "l") == [("EMAAR!",)]
