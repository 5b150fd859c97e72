"""Nothing is left out: whole tables, long aliases, misspelt names."""

from terrafold.queries import QUERIES, SQL

D = "/root/testdata/sf0.01"


def test_every_customer_is_matched(spark):
    got = QUERIES["segment_match_score"](spark, D)
    customers = spark.read.parquet(f"{D}/customer.parquet").count()
    assert got.count() == got.select("request_id").distinct().count() == customers > 200


def test_every_urgent_order_is_a_rent(spark):
    from terrafold.queries import rent_table

    urgent = spark.read.parquet(f"{D}/orders.parquet").filter("o_orderpriority = '1-URGENT'").count()
    assert rent_table(spark, D).agg({"rent_count": "sum"}).first()[0] == urgent


def test_queries_take_no_part_of_a_table():
    parts = ("o_orderkey % 3 = 0 GROUP", "c_custkey <=", "l_suppkey % 3 = 0 GROUP", "area % 2", "<> 3", "<> 7")
    assert not [(name, part) for name in SQL for part in parts if part in SQL[name]]


def misspelt():
    import random

    rng = random.Random(4)
    names = ["NAKHEEL", "NAKHEL", "EMAAR", "IMAAR", "DAMAC", "Sobha Realty", "SOBHA", "Realty of Sobha", "a", "", " ", "B B B"]
    for base in ("ELLINGTON", "MERAAS HOLDING", "AZIZI", "BINGHATTI", "OMNIYAT", "PALM  MARINA"):
        for _ in range(12):
            x = list(base)
            for _ in range(rng.randrange(1, 4)):
                k = rng.randrange(len(x))
                x[k : k + 1] = rng.choice([[], ["X"], [x[k], x[k]], ["e"]])
            names.append("".join(x))
    return sorted(set(names))


def test_similar_pairs_are_those_of_all_pairs(spark):
    from terrafold.functions import fuzzy
    from terrafold.operators import joins

    names = misspelt()
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for least in (85.0, 60.0):
        got = {(r["a"], r["b"]) for r in joins.similar_pairs(df, "n", least).collect()}
        near = lambda a, b: abs(len(a) - len(b)) <= 0.3 * max(len(a), len(b))
        assert got == {(a, b) for a in names for b in names if a < b and near(a, b) and least <= fuzzy.ratio(a.lower(), b.lower()) < 100}
        assert ("NAKHEEL", "NAKHEL") in got


def test_fuzzy_best_is_the_best_of_all_pairs(spark):
    from terrafold.functions import fuzzy
    from terrafold.operators import joins

    names = misspelt()
    typed, have = names[::2] + ["IMAAR"], names[1::2] + ["EMAAR"]
    a, b = (spark.createDataFrame([(n,) for n in x], "n string") for x in (typed, have))
    got = {r["n"]: (r["c"], r["score"]) for r in joins.fuzzy_best(a, "n", b.withColumnRenamed("n", "c"), "c", 70.0).collect()}
    want = {}
    for x in typed:
        score, c = min((-fuzzy.wratio(x.upper(), y.upper()), y) for y in have)
        if -score >= 70.0:
            want[x] = (c, -score)
    assert got == want and "IMAAR" in got


def test_alias_of_eight_words(spark):
    from terrafold.operators import joins

    texts = spark.createDataFrame([("TOWER BY ONE TWO THREE FOUR L L C S ANNEX",), ("ONE TWO",)], "t string")
    aliases = spark.createDataFrame([("ONE TWO THREE FOUR L L C S", "Long", 1), ("ONE", "Short", 2), (None, "None", 3)], "alias string, brand string, rank int")
    got = {r["t"]: (r["brand"], r["conflict"]) for r in joins.alias_hits(texts, "t", aliases).collect()}
    assert got == {"TOWER BY ONE TWO THREE FOUR L L C S ANNEX": ("Long", True), "ONE TWO": ("Short", False)}
    assert joins.alias_hits(texts, "t", aliases.limit(0)).count() == 0
