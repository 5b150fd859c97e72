"""Which texts are compared, and that chains of candidates stay cheap."""

import pytest

pytest.importorskip("terrafold.llm")

from pyspark.sql import functions as F  # noqa: E402

from terrafold.llm import jaccard  # noqa: E402


def units_of(spark, bands, block, grams=None):
    grams = grams or dict.fromkeys(bands, 10)
    frame = spark.createDataFrame([(k, k, 1, b, grams[k]) for k, b in bands.items()], "rep long, row long, copies long, bands array<long>, grams long")
    met = {}
    for r in jaccard.candidate_units(frame, block).collect():
        met.setdefault((r["p"], r["q"]), []).append((r["side"], r["rep"]))
    pairs = []
    for (p, q), rows in met.items():
        assert len(set(rows)) == len(rows)
        left, right = [x for s, x in rows if s == 0], [x for s, x in rows if s == 1]
        own = [(a, b) for k, a in enumerate(left) for b in left[:k]] if p == q else [(a, b) for a in left for b in right]
        pairs += [tuple(sorted(x)) for x in own]
    return pairs


def test_pairs_with_a_common_band_meet_once(spark):
    import random

    rng = random.Random(4)
    bands = {k: sorted({rng.randrange(60) for _ in range(rng.randrange(1, 4))}) for k in range(90)}
    want = {(a, b) for a in bands for b in bands if a < b and set(bands[a]) & set(bands[b])}
    for block in (4, 256):
        pairs = units_of(spark, bands, block)
        assert len(pairs) == len(set(pairs)) and want <= set(pairs)


def test_only_near_sizes_meet_in_a_large_home(spark):
    """One band in all texts: pairs whose sizes allow a link meet once, and far fewer than all do."""
    import random

    rng = random.Random(8)
    bands = {k: [7] + ([100 + k // 9] if k % 3 else []) for k in range(400)}
    grams = {k: max(1, int(rng.lognormvariate(5, 1.2))) for k in bands}
    pairs = units_of(spark, bands, 16, grams)
    possible = {(a, b) for a in bands for b in range(a + 1, 400) if min(grams[a], grams[b]) >= 0.8 * max(grams[a], grams[b])}
    assert len(pairs) == len(set(pairs)) and possible <= set(pairs) and len(pairs) < 0.45 * 400 * 399 / 2


def test_near_sizes_of_several_homes_meet(spark):
    """Many bands and sizes, blocks of four texts: no pair that could link is missed."""
    import random

    rng = random.Random(3)
    bands = {k: sorted({rng.randrange(25) for _ in range(rng.randrange(1, 4))}) for k in range(150)}
    grams = {k: rng.choice([1, 2, 3, 4, 5, 50, 62, 63, 100, 124, 125, 126, 1000]) for k in bands}
    pairs = units_of(spark, bands, 4, grams)
    want = {(a, b) for a in bands for b in bands if a < b and set(bands[a]) & set(bands[b]) and min(grams[a], grams[b]) >= 0.8 * max(grams[a], grams[b])}
    assert len(pairs) == len(set(pairs)) and want <= set(pairs)


def test_classes_hold_what_can_link(spark):
    rows = spark.range(1, 3000).select(F.col("id").alias("g"), jaccard.size_class(F.col("id"), 0.8).alias("c")).collect()
    at = {r["g"]: r["c"] for r in rows}
    assert all(abs(at[g] - at[h]) <= 1 for g in at for h in range(-(-4 * g // 5), g + 1))


def test_a_chain_of_candidates_is_no_cluster(spark):
    """Each text shares a band with the next only: all pairs would be 44,850."""
    bands = {k: [k, k + 1] for k in range(300)}
    pairs = units_of(spark, bands, 256)
    assert {(k, k + 1) for k in range(299)} <= set(pairs) and len(pairs) == len(set(pairs)) < 2_000


def test_equal_ids_with_other_texts(spark):
    base = [f"w{k}" for k in range(60)]
    near, far = " ".join([*base[:-1], "x"]), " ".join(f"v{k}" for k in range(30))
    rows = [(1, " ".join(base)), (1, near), (2, " ".join([*base[:-1], "y"])), (3, far), (2, far)]
    got = {(r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(d, c, k) for d, c, _, k in got} >= {(1, 1, True), (2, 1, False)} and all(d != 1 or n <= 2 for d, _, n, _ in got)
