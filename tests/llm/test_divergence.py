"""The tournament against all pairs of full vectors; rounds, blocks, slices, cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("terrafold.llm")

from terrafold.llm import divergence  # noqa: E402

LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def expected(rows, least, top):
    groups, df, langs = defaultdict(Counter), defaultdict(Counter), {}
    for text, lang, source in ((t or "", a or "", s or "") for t, a, s in rows):
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(LOWER))
        groups[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang in df:
        kept = sorted((t for t, n in df[lang].items() if n >= least), key=str.encode)
        sources = sorted(s for a, s in groups if a == lang)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(groups[lang, s]) for s in sources}
        q = share(sum((groups[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            lead = [(p[s][t] - q[t], t) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            for part, values, most in (("pair", pairs, None), ("term", lead, top)):
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, o, v, k) for k, (v, o) in enumerate(ranked, 1)]
    return sorted(out)


def corpus(n, sources, seed=12):
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "abÀ中" for b in "cdEé" for c in "fg"] + ["Zz", "zZ"]
    rows = [(" ".join(r.choices(words, k=r.randint(0, 12))), r.choice(["en", "de", None]), f"s{min(r.randrange(sources), r.randrange(sources))}") for _ in range(n)]
    return rows + [(None, "en", "null text"), ("", "xx", "only"), ("rare words only", "yy", "a"), ("1 2 3", "yy", None), ("more", "yy", "b"), ("x1y2_z\x00q", "en", "s0")] * 2


def found(spark, rows, **how):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"slice": F.lit(1), "term": F.lit("t"), "doc_id": F.lit(None), "n": F.lit(2)})
    df = divergence.source_divergence(docs, **how)
    assert df.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("sources,how", [(5, {}), (6, {"teams": 3, "slice_entries": 20}), (9, {"teams": 4, "slice_entries": 7}), (2, {"slice_entries": 5})])
def test_equals_all_pairs_of_full_vectors(spark, sources, how):
    rows = corpus(250, sources)
    assert found(spark, rows, least_docs=3, top=7, **how) == expected(rows, 3, 7)


def test_tables_are_handed_on_when_full(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TABLE", 10)
    rows = corpus(600, 4)
    assert found(spark, rows, least_docs=30) == expected(rows, 30, 50)


def test_every_pair_of_blocks_meets_once(spark):
    """For 1 to 12 blocks: each pair meets once, in some round, and no block is twice in a round."""
    schema = "lang string, slice int, source string, block int, blocks int, size int, base long, vector binary, best array<struct<term:string,value:long>>"
    empty = divergence.pack(np.zeros(0, np.int64), np.zeros(0, np.int64))
    for blocks in range(1, 13):
        units = spark.createDataFrame([("x", 0, f"s{b}", b, blocks, 1, 10 * b, empty, []) for b in range(blocks)], schema)
        rows = divergence.tournament(units).collect()
        assert sorted((r["source"], r["item"]) for r in rows) == sorted((f"s{a}", f"s{b}") for a in range(blocks) for b in range(blocks) if a != b)
        assert all(r["value"] == 10 * abs(int(r["source"][1:]) - int(r["item"][1:])) for r in rows)


def test_shares_do_not_overflow():
    n = np.array([0, 1, 10**15, 9 * 10**14 + 7])
    total, terms = 2 * 10**15, 4
    assert divergence._shares(n, total, terms).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * terms) for c in n]


def test_empty(spark):
    assert found(spark, corpus(0, 1)[:0]) == []
    assert found(spark, [("a b", "en", "s")]) == []
