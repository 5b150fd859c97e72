"""Pairs of similar names, found through a positional index of their q-grams.

``ratio`` >= least says how many letters two names of given lengths have in
common, in order: L = least * (a + b) / 200 at least. So a - L letters of the
one are dropped and b - L of the other put in. Dropping a letter destroys at
most q of the q-grams, putting one in at most q - 1, and what is left of the
others has moved by no more than the letters put in or dropped before it. So

* of the first name's q-grams at least n - q * (a - L) - (q - 1) * (b - L)
  occur in the second, within those bounds of their places,
* and of any so many fewer ones plus one, at least one does.

Each name asks, for every length that the other may have, with that many of its
rarest q-grams; q is 1, 2 or 3, whichever promises the fewest candidates. The
index holds every name's q-grams with length and place. No pair is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import SCORERS

SIZES = (1, 2, 3)


def _grams(names: DataFrame) -> DataFrame:
    """(a, size, q, gram, place) of ``names`` (a), case ignored."""
    own = names.withColumn("_t", F.lower("a")).withColumn("size", F.length("_t"))

    def of(q: int) -> Column:
        places = F.when(F.col("size") >= q, F.sequence(F.lit(1), F.col("size") - (q - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda k: F.struct(F.lit(q).alias("q"), F.substring(F.col("_t"), k, F.lit(q)).alias("gram"), k.alias("place")))

    return own.select("a", "size", F.inline(F.concat(*[of(q) for q in SIZES])))


def candidate_pairs(names: DataFrame, name: str, least: float, apart: float = 0.3) -> DataFrame:
    """(a, b), a before b by length, then by name, that may have a ratio of ``least`` > 0: none that has is missing."""
    index = _grams(names.select(F.col(name).alias("a")).filter("a is not null").distinct())
    often = index.groupBy("q", "gram").agg(F.count("*").alias("n"))
    counted = index.join(often, ["q", "gram"])
    rarest = lambda q: F.array_sort(F.collect_list(F.when(F.col("q") == q, F.struct("n", "gram", "place")))).alias(f"g{q}")
    own = counted.groupBy("a", "size").agg(*[rarest(q) for q in SIZES])
    longest = F.floor(F.col("size") * ((200.0 - least) / least) + 1e-9).cast("int")
    asked = own.withColumn("other", F.explode(F.sequence(F.col("size"), longest)))
    common = F.ceil((F.col("size") + F.col("other")) * (least / 200.0) - 1e-9).cast("int")
    asked = asked.withColumns({"dropped": F.col("size") - common, "added": F.col("other") - common})

    def choice(q: int) -> Column:
        grams = F.col(f"g{q}")
        kept = F.size(grams) - q * F.col("dropped") - (q - 1) * F.col("added")
        some = F.slice(grams, F.lit(1), F.size(grams) - kept + 1)
        cost = F.aggregate(some, F.lit(0).cast("long"), lambda s, g: s + g["n"])
        return F.when((kept >= 1) & (F.col("dropped") >= 0), F.struct(cost.alias("cost"), F.lit(q).alias("q"), some.alias("some")))

    cheapest = F.array_min(F.filter(F.array(*[choice(q) for q in SIZES]), lambda c: c.isNotNull()))
    asked = asked.withColumn("c", cheapest).filter("c is not null")
    probes = asked.select("a", F.col("size").alias("_size"), "other", "dropped", "added", F.col("c.q").alias("_q"), F.explode("c.some").alias("g"))
    probes = probes.select("a", "_size", "other", "dropped", "added", "_q", F.col("g.gram").alias("_gram"), F.col("g.place").alias("_place"))
    there = index.select(F.col("a").alias("b"), "size", "q", "gram", "place")
    moved = F.col("place") - F.col("_place")
    on = (F.col("size") == F.col("other")) & (F.col("q") == F.col("_q")) & (F.col("gram") == F.col("_gram")) & (moved >= -F.col("dropped")) & (moved <= F.col("added"))
    near = F.abs(F.length("a") - F.length("b")) <= apart * F.greatest(F.length("a"), F.length("b"))
    return probes.join(there, on).filter(((F.col("_size") < F.col("other")) | (F.col("a") < F.col("b"))) & near).select("a", "b").distinct()


def similar_pairs(names: DataFrame, name: str, least: float = 85.0, apart: float = 0.3) -> DataFrame:
    """Pairs a < b of distinct names with ``least`` <= ratio < 100, lengths within ``apart`` of the longer."""
    pairs = candidate_pairs(names, name, least, apart).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.withColumn("score", SCORERS["ratio"](F.lower("a"), F.lower("b"))).filter((F.col("score") >= least) & (F.col("score") < 100))
