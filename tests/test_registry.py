"""Registers of aliases and names, similar pairs and segment matches against all pairs; what they meet is counted."""

import random
import re

import pytest
from pyspark.sql import functions as F

from terrafold.functions import fuzzy
from terrafold.operators import joins, labels, registry, similar

SYLLABLES = "al na kheel em aar da mac so bha dub ai pro per ties real es tate de vel op ment mer aas del lin gton az izi bin ghat ti".split()


def made_names(n, seed=5):
    r = random.Random(seed)
    found = set()
    while len(found) < n:
        found.add(" ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 4))))
    return sorted(found)


def misspelt(name, r):
    letters = list(name)
    for _ in range(r.randint(0, 3)):
        k, kind = r.randrange(len(letters)), r.random()
        if kind < 0.4:
            letters[k] = r.choice("aeiou")
        elif kind < 0.7 and len(letters) > 1:
            del letters[k]
        else:
            letters.insert(k, r.choice("nstr "))
    return "".join(letters)


def column(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bound", [registry.BOUND, 12])
def test_substring_hits(spark, bound):
    texts = ["red ring", "ring", "bored ringer", "", None, "RED", "a" * 5000 + "ring", "éring中", "ring"]
    aliases = ["ring", "red", "bored", "g", "", None, "中", "ring", "xyz", "red ring"]
    found = registry.substring_hits(column(spark, texts, "t"), "t", column(spark, aliases, "alias"), bound=bound)
    want = {(t, a) for t in texts if t is not None for a in aliases if a and a in t}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    none = column(spark, [], "alias")
    assert registry.substring_hits(column(spark, texts, "t"), "t", none, bound=bound).count() == 0


def test_long_texts_by_key(spark):
    texts = column(spark, ["x" * 100_000 + "needle", "other"], "t")
    assert [r[0] for r in registry.substring_hits(texts, "t", column(spark, ["needle"], "alias"), key=F.md5("t")).select("t").collect()] == [
        r[0] for r in texts.filter("t != 'other'").select(F.md5("t")).collect()
    ]


def test_contains_aliases_with_condition(spark):
    texts = spark.createDataFrame([("ab", 1), ("ab", 2), ("b", 1)], "t string, k int")
    aliases = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1)], "alias string, n int")
    plain = texts.crossJoin(aliases).filter("contains(t, alias) and k = n")
    for bound in (registry.BOUND, 1):
        found = joins.contains_aliases(texts, "t", aliases, F.col("k") == F.col("n"), bound)
        assert found.columns == plain.columns and sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
        assert "NestedLoop" not in plan_of(found)


@pytest.mark.parametrize("bound", [registry.BOUND, 20])
def test_alias_best_in_parts(spark, bound):
    texts = ["BY ELLINGTON HOUSE", "WELLINGTON", "", None, "PALM  JUMEIRAH-ONE", "HOUSE ELLINGTON", "THE THE THE", "A B C D E F G H", "A B C D E F G"]
    aliases = [("ELLINGTON", "E", 2), ("ELLINGTON HOUSE", "H", 3), ("PALM", "P", 1), ("JUMEIRAH ONE", "J", 5), ("THE", "T", 4), ("A B C D E F G H", "L", 6)]
    got = joins.alias_best(column(spark, texts, "t"), "t", spark.createDataFrame(aliases, "alias string, brand string, rank int"), bound)
    want = {}
    for t in filter(None, texts):
        flat = f" {' '.join(re.sub(r'[^A-Z ]', ' ', t).split())} "
        hits = [(-(1000 * len(a.split()) + len(a)), r, b, a) for a, b, r in aliases if f" {a} " in flat]
        if hits:
            less, _, brand, alias = min(hits)
            want[t] = (alias, brand, -less, len({h[2] for h in hits}) > 1)
    ids = {r[0]: r[1] for r in column(spark, [t for t in texts if t], "t").select(F.md5("t"), "t").collect()}
    assert {ids[r["text_id"]]: (r["alias"], r["brand"], r["score"], r["conflict"]) for r in got.collect()} == want and len(want) == 5


def test_rules_in_order(spark):
    """All combinations of names, areas and developers against the rules tried one by one."""
    rules = [
        ("B", 2, ["tower b", "b hills"], None, {"X": ["dev1"], "Y": ["dev2", "dev3"]}),
        ("A", 1, ["Alpha"], "dev1", None),
        ("C", 3, ["gamma", "a"], None, None),
        ("D", 4, ["delta", ""], "dev9", {"X": ["dev3"]}),
        ("E", 5, [], None, None),
    ]
    names = [("Alpha one", None), ("the  TOWER", "B 7"), ("b hills", "gamma"), ("delta", "delta"), (None, None), ("zzz", "")]
    facts = [(p, b, area, dev) for p, b in names for area in ("X", "Y", " Z ", None) for dev in ("dev1", "dev2", "dev3", "dev9", "ALL_DEVELOPERS", None)]

    def expected(project, building, area, dev):
        text = re.sub(r"\s+", " ", f"{project or ''} {building or ''}".lower()).strip()
        area, dev = (area or "").strip(), (dev or "").strip()
        for brand, _, aliases, under, by_area in sorted(rules, key=lambda x: x[1]):
            if any(a and a.lower() in text for a in aliases):
                allowed = (by_area or {}).get(area)
                if dev == "ALL_DEVELOPERS" and (allowed or under) or (dev in allowed if allowed else dev == under if under else not by_area):
                    return brand
        return None

    table = spark.createDataFrame(rules, "brand string, rank int, aliases array<string>, registered_under string, registered_under_by_area map<string,array<string>>")
    df = spark.createDataFrame(facts * 2, "project_name string, building_name string, area_name string, developer_name string")
    found = labels.infer_brands(df, table)
    assert {tuple(r)[:4]: r["brand"] for r in found.collect()} == {f: b for f in facts if (b := expected(*f))}
    assert "NestedLoop" not in plan_of(found)


def test_brand_by_substring(spark):
    facts = spark.createDataFrame([("Sky Tower", "d1", "a"), ("sky tower", "d2", "b"), (None, "d1", "a"), ("Plain", "d1", "a")], "building_name string, developer_name string, area_name string")
    aliases = spark.createDataFrame([("sky", "S", 2, ["d1"], None), ("TOWER", "T", 1, None, "b"), ("tow", "W", 3, None, None)], "alias string, brand string, rank int, registered_under array<string>, area string")
    got = {(r["building_name"], r["developer_name"]): r["brand"] for r in labels.brand_by_substring(facts, aliases).collect()}
    assert got == {("Sky Tower", "d1"): "S", ("sky tower", "d2"): "T"}


@pytest.mark.parametrize("scorer", ["wratio", "ratio", "partial_ratio"])
def test_bounds_hold_and_few_are_tried(scorer):
    names, r = made_names(2000), random.Random(7)
    nearest = fuzzy.Nearest(names, scorer)
    asked = [misspelt(r.choice(names), r) for _ in range(60)] + ["", " ", "a", "zz zz", "al al al nakheel", "  x  y ", "İß"]
    for text in asked:
        scores = [fuzzy.SCORES[scorer](text.upper(), n.upper()) for n in nearest.names]
        assert all(s <= b + 1e-9 for s, b in zip(scores, nearest.bounds(text.upper())))
        less, name = min((-s, n) for s, n in zip(scores, nearest.names))
        assert nearest.best(text, 70.0) == ((name, -less) if -less >= 70.0 else None)
    if scorer != "partial_ratio":  # a part of a name shares its letters with many
        assert nearest.tried < 0.05 * len(asked) * len(names)


@pytest.mark.parametrize("bound", [registry.BOUND, 200])
def test_fuzzy_best_equals_all_pairs(spark, bound):
    names, r = made_names(60, 3), random.Random(2)
    asked = [misspelt(r.choice(names), r) for _ in range(40)] + ["", None, "qqq"]
    found = joins.fuzzy_best(column(spark, asked, "n"), "n", column(spark, [*names, None, ""], "c"), "c", 80.0, bound=bound)
    want = {}
    for a in filter(None, asked):
        less, c = min((-fuzzy.wratio(a.upper(), c.upper()), c) for c in names)
        if -less >= 80.0:
            want[a] = (c, pytest.approx(-less))
    assert {r["n"]: (r["c"], r["score"]) for r in found.collect()} == want and want


@pytest.mark.parametrize("least", [85.0, 60.0])
def test_similar_pairs_equal_all_pairs(spark, least):
    n = 2000 if least == 85.0 else 300
    r = random.Random(4)
    names = made_names(n * 3 // 4, 9)
    names += [misspelt(x, r) for x in names[: n - len(names)]] + ["", "x", "xy", "XY", "nakheel", "nakhel", "NAKHEEL"]
    names = sorted(set(names))
    df = column(spark, [*names, None, names[5]], "n")
    near = lambda a, b: abs(len(a) - len(b)) <= 0.3 * max(len(a), len(b))
    want = {(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if near(a, b) and least <= fuzzy.ratio(a.lower(), b.lower()) < 100}
    assert {(x["a"], x["b"]) for x in joins.similar_pairs(df, "n", least).collect()} == want and len(want) > 20
    if least == 85.0:
        assert similar.candidate_pairs(df, "n", least).count() < 0.05 * len(names) * (len(names) - 1) / 2


def test_segment_match_equals_all_series(spark):
    r = random.Random(6)
    values = {"area": ["A", "a", "B", "C", None], "property_type": ["Unit", "villa", None], "bedroom": ["1BR", "2br", "3BR"], "reg_type": ["Ready", "OffPlan"], "developer": ["X", "y", "ALL_DEVELOPERS", "all_developers", None]}
    pick = lambda: tuple(r.choice(v) for v in values.values())
    series = [(f"g{k:03d}", *pick()) for k in range(150)] + [("g000", "Z", "Unit", "9BR", "Ready", "X")]
    asked = [(k, *pick()) for k in range(300)] + [(900, "Q", None, "1br", None, None), (901, "Q", None, "7BR", None, None), (902, None, None, None, None, None), (903, "c", "Unit", "2BR", None, "y")]
    shape = ", ".join(f"{c} string" for c in values)
    eq = lambda a, b: a is not None and b is not None and a.lower() == b.lower()

    def expected(_, area, kind, bedroom, reg, dev):
        options = []
        for gid, a, k, b, g, d in series:
            if eq(a, area):
                points = 40 + 25 * eq(b, bedroom) + 15 * eq(k, kind) + 10 * eq(g, reg) + 10 * eq(d, dev)
                if points == 100:
                    options.append((1, -points, gid, "exact", 95.0))
                elif eq(b, bedroom) and eq(k, kind) and eq(g, reg) and d == "ALL_DEVELOPERS":
                    options.append((2, -points, gid, "exact_all_developers", 85.0))
                else:
                    options.append((3, -points, gid, *(("partial_area_bedroom", 75.0) if points >= 80 else ("partial_area", 60.0) if points >= 55 else ("area_only", 50.0))))
            if eq(b, bedroom):
                options.append((4, 0, gid, "fallback_bedroom", 30.0))
        return min(options)[2:] if options else (None, "no_match", 0.0)

    found = joins.segment_match(spark.createDataFrame(asked, f"request_id int, {shape}"), spark.createDataFrame(series, f"group_id string, {shape}"))
    assert {x["request_id"]: tuple(x)[1:] for x in found.collect()} == {a[0]: expected(*a) for a in asked}


def test_segment_match_meets_no_series_of_its_area_one_by_one(spark):
    """One area with 5,000 series: the index gives each request at most 16 entries."""
    series = spark.range(5000).selectExpr("concat('g', id) as group_id", "'A' as area", "concat('t', id % 7) as property_type", "concat(id % 9, 'BR') as bedroom", "'Ready' as reg_type", "concat('d', id) as developer")
    requests = spark.range(200).selectExpr("id as request_id", "'a' as area", "concat('t', id % 11) as property_type", "concat(id % 13, 'br') as bedroom", "'Ready' as reg_type", "concat('d', id * 31) as developer")
    keys = ["mask", "_area", *[f"_{c}" for c in joins.WEIGHTS]]
    index = joins._lattice(series).groupBy(*keys).agg(F.min("group_id"))
    per = joins._lattice(requests).join(index, keys).groupBy("request_id").count().agg(F.max("count")).first()[0]
    assert per <= 16 and joins.segment_match(requests, series).count() == 200
