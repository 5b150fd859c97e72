"""What the findings of the third round were about, each on few rows."""


def test_no_missing_rent_has_no_counts(spark):
    from terrafold.operators import registers

    raw = spark.createDataFrame([(1, 5.0), (2, -5.0)], "area int, amount double")
    ask = lambda rows: tuple(registers.missing_keys(spark.createDataFrame(rows, "area int, rent double"), "rent", raw, ["area"], "amount").first())
    assert ask([(1, 3.0)]) == (None, None)
    assert ask([(1, None), (1, None)]) == (2, 0)
    assert ask([(2, None), (None, None)]) == (0, 2)


def test_amounts_are_rounded_as_by_c(spark):
    from terrafold.functions import text

    want = {
        198500.0: "AED 198K", 199500.0: "AED 200K", 1015000.0: "AED 1.01M", 1125000.0: "AED 1.12M", 500.5: "AED 500", 999.5: "AED 1000", -0.4: "AED -0",
        1.2e25: "AED 12000000000000000000.00M", float("inf"): "AED infM", float("nan"): "AED nanM", None: None,
    }
    rows = spark.createDataFrame([(v,) for v in want], "v double")
    assert [r[0] for r in rows.select(text.format_currency(rows.v)).collect()] == list(want.values())
    assert rows.limit(1).select(text.format_currency(rows.v.cast("int"), " a year")).first()[0] == "AED 198K a year"


def test_distinct_is_capped_where_the_survey_caps_it():
    from terrafold.operators import sketches
    from terrafold.queries import SQL

    assert sketches.CAP == 10_000 and f"least(count(DISTINCT l_partkey), {sketches.CAP})" in SQL["capped_distinct"]


def test_capped_distinct_is_whole_below_the_cap(spark):
    from terrafold.queries import QUERIES

    d = "/root/testdata/sf0.01"
    assert QUERIES["capped_distinct"](spark, d).first()[0] == spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey").distinct().count() > 1000


def test_polygon_is_one_pass(spark):
    from terrafold.queries import QUERIES

    plan = QUERIES["polygon_centroid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_polygon_of_odd_rings(spark):
    from terrafold.functions import measures

    rings = [
        ([(0.0, 0.0), (1.0, 0.0), (1.0, 2.0), (0.0, 2.0)], (0.5, 1.0, 2.0)), ([(0.0, 0.0), (1.0, 0.0), (1.0, 2.0), (0.0, 2.0), (0.0, 0.0)], (0.5, 1.0, 2.0)),
        ([(0.0, 0.0), None, (1.0, 1.0)], (None, None, 0.0)), ([(0.0, 0.0), (None, 1.0), (1.0, 2.0)], (None, 1.0, 0.0)), ([(3.0, 4.0)] * 3, (3.0, 4.0, 0.0)), ([], None), (None, None),
    ]
    df = spark.createDataFrame([(p,) for p, _ in rings], "p array<struct<lon: double, lat: double>>")
    assert [r[0] and tuple(r[0]) for r in df.select(measures.polygon(df.p)).collect()] == [want for _, want in rings]


def test_few_of_many_like_names_are_scored():
    from terrafold.functions import fuzzy

    nearest = fuzzy.Nearest([f"Supplier {k:09d}" for k in range(3000)])
    for k in (0, 123, 2999):
        assert nearest.best(f"suplier {k:09d}", 70.0)[0] == f"Supplier {k:09d}"
    nearest.best("suplier 000054321", 70.0)
    assert nearest.tried < 60


def test_nearest_is_the_best_of_all_for_every_score():
    import random

    from terrafold.functions import fuzzy

    rng = random.Random(5)
    words = ["Emaar", "EMAR", "of", "LLC", "Nakhel", "ß", "دبي", "000123", "000213", "X" * 70]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
    have, asked = sorted({name() for _ in range(150)} | {f"Supplier {k:04d}" for k in range(100)}), [name() for _ in range(30)] + ["suplier 0321", "", " "]
    for scorer, score in fuzzy.SCORES.items():
        nearest = fuzzy.Nearest(have, scorer)
        for opened in (1, 512):
            nearest.OPENED = opened
            for text in asked:
                less, best = min((-score(text.upper(), n.upper()), n) for n in have)
                assert nearest.best(text, 60.0) == ((best, -less) if -less >= 60.0 else None)


def test_names_are_dealt_to_more_than_one_task(spark):
    from terrafold.queries import QUERIES

    assert QUERIES["fuzzy_top1"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_facts_meet_the_brands_of_their_names_in_one_join(spark):
    from terrafold.operators import labels

    rows = [("1", "d", "Red Ring", None, None)] * 2 + [("1", "d", None, "red ring x", "y"), ("1", "d", None, None, None), ("1", "d", "z", "z", "z")]
    facts = spark.createDataFrame(rows, "project_number string, developer_id string, project_name string, building_name string, master_project string")
    aliases = spark.createDataFrame([("RED RING", "Ring", 1)], "alias string, brand string, rank int")
    no = lambda key: spark.createDataFrame([], f"{key} string, brand string")
    out = labels.resolve_brands(facts, aliases, no("developer_id"), no("project_number"), no("master_project"))
    assert sorted((r["brand_source"], r["project_name"] or "") for r in out.collect()) == [("TEXT", ""), ("TEXT", "Red Ring"), ("TEXT", "Red Ring"), ("UNRESOLVED", ""), ("UNRESOLVED", "z")]
    own = spark.read.parquet("/root/testdata/sf0.001/part.parquet").selectExpr("p_brand AS developer_id", "p_brand AS project_number", "p_name AS project_name", "p_type AS building_name", "p_type AS master_project", "p_name AS brand")
    plan = labels.resolve_brands(own.drop("brand"), aliases, own.limit(9), own.limit(8), own.limit(7))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 4
