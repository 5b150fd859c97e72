"""Expressions on their edge rows."""

import pytest
from pyspark.sql import functions as F

from terrafold.functions import bedrooms, dates, fuzzy, measures, text


def ask(spark, expression, *values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_ids(spark):
    got = ask(spark, text.canonical_id, "85.0", "0085", "000", "A12B34", "1.5", None, "nan", " 7 ", "-3")
    assert got == ["85", "85", "0", "12", None, None, None, "7", "3"]


def test_normalisers(spark):
    assert ask(spark, text.norm_ws, "  a   b\t", None) == ["a b", None]
    assert ask(spark, text.nullify, " nan ", "None", "", "x ") == [None, None, None, "x"]
    assert ask(spark, text.norm_text, "شركة، (دبي)", "a-b_c") == ["شركة دبي", "A B_C"]
    assert ask(spark, text.norm_name_key, "Al  Barsha - 614", "Al-Barsha") == ["AL BARSHA", "AL BARSHA"]
    assert ask(spark, text.norm_entity, "The L.L.C.") == ["the llc"]
    assert ask(spark, text.tokens, "a, b  c", "") == [["a", "b", "c"], []]
    assert ask(spark, text.split_list, " a, ,b ") == [["a", "b"]]


def test_legal_labels(spark):
    assert ask(spark, text.legal_label, "Ellington Properties L.L.C", "ACME F Z C O", "NA", "LLC", None, "Nakheel PJSC Holding Co") == ["Ellington Properties", "ACME", "", "", "", "Nakheel"]
    assert ask(spark, lambda c: text.legal_label(c, arabic=True), "دبي ش.ذ.م.م") == ["دبي"]
    assert ask(spark, text.is_authority, "DMCC Authority", "Jebel Ali Freezone", "JEBEL ALI FREEZONE", "Emaar", None) == [True, False, True, False, False]
    assert ask(spark, text.is_place, "City Developments", "Palm Marina", "Palm Palm", "Sky Tower", "", None) == [False, True, False, True, False, False]
    assert ask(spark, lambda c: text.is_place(c, extra=("EAST", "city")), "East Homes", "City Homes") == [True, False]
    assert ask(spark, text.leaks_suffix, "X L.L.C", "X LLCO", "Nice", None) == [True, False, False, False]
    assert ask(spark, text.has_holding, "X Holdings", "Withholding", None) == [True, False, False]


def test_phrases(spark):
    assert ask(spark, lambda c: text.contains_phrase(c, F.lit("ELLINGTON")), "BY ELLINGTON X", "WELLINGTON", "ELLINGTON_X", None) == [True, False, False, False]
    assert ask(spark, text.alias_score, "A B", "ABCDEFGHIJ") == [2003, 1010]
    assert ask(spark, text.alias_is_strong, "A B", "ABCDEFGHIJ", "ABC") == [True, True, False]


def test_group_ids(spark):
    key = "Al_Barsha_First_Unit_6BR+_OffPlan_Some_Dev"
    assert ask(spark, text.parse_group_id, key, "X_Villa_Studio_Ready_D", "no key")[0].asDict() == {
        "area": "Al Barsha First", "property_type": "Unit", "bedroom": "6BR+", "reg_type": "OffPlan", "developer": "Some Dev",
    }
    assert ask(spark, lambda c: text.group_id(c, F.lit("Unit")), "Me'aisem, No.1") == ["Meaisem_No1_Unit"]
    assert ask(spark, text.format_currency, 1_250_000.0, 80_000.0, 500.0, None, kind="double") == ["AED 1.25M", "AED 80K", "AED 500", None]
    assert text.translate_names(["ab cd"], {"ab": "x", "ab cd": "whole"}) == ["whole"]


def test_bedrooms(spark):
    assert ask(spark, bedrooms.from_rooms, "3 B/R", "10 B/R", "Studio", "PENTHOUSE", "Single Room", "Office", None) == ["3BR", "6BR+", "Studio", "Penthouse", "Room", None, None]
    got = ask(spark, bedrooms.from_contract, "1bed room+Hall", "2 bed rooms+hall+Maids Room", "15 bed room+hall", "Villa", "Shop", None)
    assert got == ["1BR", "2BR", "6BR+", "Villa", None, None]
    assert ask(spark, bedrooms.to_number, "Studio", "6BR+", "Room", "Duplex", None) == [0, 6, 0, None, None]
    assert ask(spark, bedrooms.normalise, "2 bedrooms", "one bed", "0", "7br", "ph", "Room", "huge", "", None) == ["2BR", "1BR", "Studio", "6BR+", "Penthouse", "Room", None, None, None]
    assert ask(spark, lambda c: bedrooms.normalise(c, "input"), "huge") == ["huge"]
    assert ask(spark, bedrooms.from_text, "nice 2 bed flat", "STUDIO", "7 br", "x") == ["2BR", "Studio", "5BR+", None]
    zero = F.lit(None).cast("int")
    assert ask(spark, lambda c: bedrooms.reg_type(c, zero, F.lit("")), "off-plan and ready", "a resale", "x", None) == ["OffPlan", "Ready", None, None]
    assert ask(spark, lambda c: bedrooms.reg_type(c, F.lit(3), F.lit("")), "x") == ["OffPlan"]


def test_dates(spark):
    assert [str(x) for x in ask(spark, dates.parse_date, "31-12-2024", "2024-12-31", "32-01-2024", "")] == ["2024-12-31", "None", "None", "None"]
    assert [str(x) for x in ask(spark, dates.parse_flexible, "31-12-2024", "2024-12-31", "x", None)] == ["2024-12-31", "2024-12-31", "None", "None"]
    as_of = F.lit("2025-03-01").cast("date")
    got = ask(spark, lambda c: dates.handover_months(c, as_of), "handover in 18 months", "Mar 2026", "by 2026", "2020", "none", "september 2025")
    assert got == [18, 12, 15, None, None, 6]


def test_lifecycle(spark):
    day = F.to_date(F.lit("2024-05-10"))
    for shift, want in ((0, "Ready"), (-1, "OffPlan"), (1, "Ready")):
        row = spark.range(1).select(*dates.lifecycle(F.lit("OffPlan"), F.date_add(day, shift), day)).first()
        assert row["reg_type"] == want and row["offplan_after_handover"] == int(want == "Ready")
    row = spark.range(1).select(*dates.lifecycle(F.lit("OffPlan"), day, F.lit(None).cast("date"))).first()
    assert row["reg_type"] == "OffPlan"
    row = spark.range(1).select(*dates.phase_features(day, day, F.lit(None).cast("date"))).first()
    assert row["months_to_handover"] is None and row["near_handover"] == 0


def test_measures(spark):
    assert ask(spark, measures.number, "1.5", "x", "NaN", "Infinity", None) == [1.5, None, None, None, None]
    price = lambda c: measures.unit_price(F.lit(None).cast("double"), F.lit(100.0), c)
    assert ask(spark, price, 0.0, 4.0, None, kind="double") == [None, 25.0, None]
    assert ask(spark, lambda c: measures.extrapolate(F.lit(100.0), F.lit(121.0), c, F.lit(1)), 2, 0, kind="int") == [pytest.approx(110.0), 121.0]
    assert ask(spark, lambda c: measures.extrapolate_or_null(F.lit(100.0), F.lit(121.0), c, F.lit(1)), 0, kind="int") == [None]
    assert ask(spark, lambda c: measures.repair_rent(c, F.lit(10.0)), 20_000.0, 30_000.0, kind="double") == [20_000.0, 300.0]
    assert ask(spark, lambda c: measures.buckets(c, measures.RENT_BUCKETS), 0.0, 20_000.0, 19_999.0, 6e5, None, kind="double") == ["0-20K", "20K-40K", "0-20K", "500K+", None]
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in p])
    row = spark.range(1).select(measures.polygon(ring((0, 0), (2, 0), (2, 1), (0, 1))).alias("a"), measures.polygon(ring((0, 0), (1, 1), (2, 2))).alias("b"), measures.polygon(ring((0, 0), (1, 1))).alias("c")).first()
    assert tuple(row["a"]) == (1.0, 0.5, 2.0) and tuple(row["b"]) == (1.0, 1.0, 0.0) and row["c"] is None


def test_fuzzy():
    assert fuzzy.ratio("abc", "abc") == 100 and fuzzy.ratio("", "") == 100 and fuzzy.ratio("abc", "") == 0
    assert fuzzy.ratio("abcd", "abxd") == 75
    assert fuzzy.partial_ratio("marina", "dubai marina walk") == 100
    assert fuzzy.wratio("dubai marina", "marina dubai") >= 95
    assert fuzzy.wratio("", "x") == 0
