"""Joins: fallback keys, ranges, aliases, scored matches.

Dimension tables are joined without hints: Spark broadcasts those that its
statistics show to be small, and sorts the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .registry import BOUND, against, contained, nearest_names, sized, substring_hits
from .similar import similar_pairs  # noqa: F401  (part of this module's interface)


def star(fact: DataFrame, dims: list[tuple[DataFrame, list[str]]], zero: list[str] = ()) -> DataFrame:
    """Chain of left joins on differing keys (J4, J5, J6); counts in ``zero`` become 0 (I4)."""
    joined = reduce(lambda f, d: f.join(d[0], d[1], "left"), dims, fact)
    return joined.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in zero})


def fallback(fact: DataFrame, stages: list[tuple[DataFrame, str, str]], value: str, source: str) -> DataFrame:
    """Value of the first stage whose key matches, and which it was.

    ``stages``: (table with columns key and value, fact column, stage name).
    """
    joined = fact
    for k, (table, key, _) in enumerate(stages):
        dim = table.select(F.col("key").alias(f"_k{k}"), F.col("value").alias(f"_v{k}"))
        joined = joined.join(dim, F.col(key) == F.col(f"_k{k}"), "left")
    chosen = F.coalesce(*[F.when(F.col(f"_v{k}").isNotNull(), F.lit(n)) for k, (_, _, n) in enumerate(stages)])
    names = [n for k in range(len(stages)) for n in (f"_k{k}", f"_v{k}")]
    return joined.withColumns({value: F.coalesce(*[F.col(f"_v{k}") for k in range(len(stages))]), source: chosen}).drop(*names)


def full_outer(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join with one key column."""
    return left.join(right, key, "full")


def active_by_month(projects: DataFrame, months: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Sums over projects still running at the first of each month.

    A project counts in month m if its end is NULL or after m. Instead of a
    months x projects join, each project is taken off at the first month that
    is not before its end, and a running sum over months gives the rest: one
    groupBy and one window over (key, month). ``projects`` has ``end_date``,
    ``months`` first-of-month dates, of which the least and the last count.
    """
    bounds = months.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    off = F.when(F.trunc("end_date", "month") == F.col("end_date"), F.col("end_date")).otherwise(F.add_months(F.trunc("end_date", "month"), 1))
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]
    placed = projects.crossJoin(bounds).withColumn("month", F.when(off <= F.col("hi"), F.greatest(off, F.col("lo"))))  # one row
    ends = placed.groupBy(*keys, "month").agg(*totals, F.count("*").alias("projects"))
    whole = ends.groupBy(*keys).agg(*[F.sum(c).alias(f"{c}_all") for c in [*sums, "projects"]])
    span = F.sequence("lo", "hi", F.expr("interval 1 month"))
    grid = whole.crossJoin(bounds).withColumn("month", F.explode(span)).drop("lo", "hi")  # one row
    past = Window.partitionBy(*keys).orderBy("month")
    joined = grid.join(ends, [*keys, "month"], "left")
    left = [(F.col(f"{c}_all") - F.coalesce(F.sum(c).over(past), F.lit(0))).alias(c) for c in [*sums, "projects"]]
    return joined.select(*keys, "month", *left).filter("projects > 0")


def started_by_month(projects: DataFrame, keys: list[str], start: str, aggregates: dict[str, Column]) -> DataFrame:
    """Running totals of what has started by each month.

    ``aggregates``: name -> value summed; rows are months in which a key starts something.
    """
    per = projects.filter(F.col(start).isNotNull()).groupBy(*keys, F.trunc(start, "month").alias("month")).agg(
        *[F.sum(c).alias(n) for n, c in aggregates.items()]
    )
    w = Window.partitionBy(*keys).orderBy("month")
    return per.select(*keys, "month", *[F.sum(n).over(w).alias(n) for n in aggregates])


def schedule(df: DataFrame, at: str, handover: str, keys: list[str], value: Column, out: str) -> DataFrame:
    """What is due per handover month (A5, A6), of rows dated before it."""
    due = df.filter(F.col(at) < F.col(handover)) if at else df.filter(F.col(handover).isNotNull())
    return due.groupBy(F.trunc(handover, "month").alias("month"), *keys).agg(F.sum(value).cast("long").alias(out))


def text_id(text: str | Column) -> Column:
    """What stands for a text in ``alias_best``: 128 bits of it."""
    return F.md5(text)


def alias_best(texts: DataFrame, text: str, aliases: DataFrame, bound: int = BOUND, key: Column | None = None) -> DataFrame:
    """Best alias per text (J16): (text_id, alias, brand, score, conflict).

    ``text_id`` stands for equal texts, or is ``key``, as a string, where that
    is given: then each row has its own and need not be joined back.

    A normalised alias is found at word borders exactly if it occurs, between
    two spaces, in the text's words with a space before, between and after
    them. One automaton of all aliases finds them in one pass over a text,
    whatever their numbers of words; only the id of a text goes along with its
    aliases. ``aliases``: alias, brand, ``rank`` (less is preferred on equal
    scores); they are broadcast up to ``bound`` letters, beyond that texts meet
    them in parts, and frequent ones are left to Spark's skew join.
    """
    framed = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    words = texts.filter(F.col(text).isNotNull()).select((text_id(text) if key is None else key).alias("id"), framed(F.array_join(tokens(F.col(text)), " ")).alias("text"))
    entries = aliases.filter("alias <> ''").select(framed(F.col("alias")).alias("entry"))
    found = against(words, entries, contained, "alias string", bound).select(F.col("id").alias("text_id"), F.expr("substring(alias, 2, length(alias) - 2)").alias("alias"))
    hits = found.join(sized(aliases, "alias", bound), "alias")
    score = 1000 * F.size(F.split("alias", " ")) + F.length("alias")
    best = F.min(F.struct((-score).alias("less"), "rank", "brand", "alias")).alias("b")
    return hits.groupBy("text_id").agg(best, F.countDistinct("brand").alias("brands")).select(
        "text_id", F.col("b.alias").alias("alias"), F.col("b.brand").alias("brand"), (-F.col("b.less")).alias("score"), (F.col("brands") > 1).alias("conflict")
    )


def alias_hits(texts: DataFrame, text: str, aliases: DataFrame) -> DataFrame:
    """``alias_best`` with the distinct texts themselves, for short ones such as names."""
    distinct = texts.select(text).distinct()
    return distinct.join(alias_best(distinct, text, aliases), text_id(text) == F.col("text_id")).drop("text_id")


def contains_aliases(texts: DataFrame, text: str, aliases: DataFrame, condition: Column | None = None, bound: int = BOUND) -> DataFrame:
    """Alias contained anywhere in a text (J17); a further condition is tried on what contains one only."""
    hits = substring_hits(texts, text, aliases, "alias", bound=bound)
    joined = texts.join(hits, text).join(sized(aliases, "alias", bound), "alias").select(*texts.columns, *aliases.columns)
    return joined if condition is None else joined.filter(condition)


def fuzzy_best(left: DataFrame, name: str, right: DataFrame, candidate: str, least: float, scorer: str = "wratio", bound: int = BOUND) -> DataFrame:
    """Best candidate per distinct name with score >= ``least`` (J18): the answer of trying all, see ``Nearest``."""
    return nearest_names(left, name, right, candidate, least, scorer, bound)


#: Parts of a segment below its area, and what each adds to the score of a match in the area.
WEIGHTS = {"bedroom": 25, "property_type": 15, "reg_type": 10, "developer": 10}
AREA_SCORE, MARKET = 40, "ALL_DEVELOPERS"


def _lattice(df: DataFrame, developer: Column | None = None) -> DataFrame:
    """``df`` once for every subset of the parts: ``mask`` and the keys that the subset keeps, blank where it keeps none.

    Case is ignored. Subsets that hold a part without a value match nothing, nor does a row without an area.
    """
    columns = {c: F.lower(F.col(c)) for c in WEIGHTS} | ({"developer": developer} if developer is not None else {})
    masks = df.filter("area is not null").withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(WEIGHTS) - 1))))
    has = {c: F.col("mask").bitwiseAND(1 << k) != 0 for k, c in enumerate(WEIGHTS)}
    keys = {f"_{c}": F.when(has[c], columns[c]).otherwise(F.lit("")) for c in WEIGHTS}
    return masks.withColumns(keys | {"_area": F.lower("area")}).filter(" and ".join(f"_{c} is not null" for c in WEIGHTS))


def segment_match(requests: DataFrame, series: DataFrame) -> DataFrame:
    """The best series for each request, with match type and confidence.

    Both have area, property_type, bedroom, reg_type, developer; requests have
    ``request_id``, series ``group_id``. Exact 95; the market series
    (ALL_DEVELOPERS) 85; best score in the same area 75, 60 or 50; any series
    of the same bedroom 30; else none, 0. Equal scores go to the least id.

    A series is indexed under every subset of its parts, with the least id per
    subset; a request looks its own subsets up by equality, and the subset of
    the largest score that is there is its match. No request meets more than 16
    entries, however many series its area has.
    """
    parts = ["area", *WEIGHTS]
    shape = F.to_json(F.struct(*parts)).alias("shape")
    # Requests of one shape have one answer, so shapes are matched, not requests.
    asked, shapes = requests.select("request_id", shape), requests.select(*parts, shape).distinct()
    keys = ["mask", "_area", *[f"_{c}" for c in WEIGHTS]]
    index = _lattice(series).groupBy(*keys).agg(F.min("group_id").alias("group_id"))
    found = _lattice(shapes).select("shape", *keys).join(index, keys).select("shape", "mask", "group_id")
    full, market = 2 ** len(WEIGHTS) - 1, F.lit(MARKET.lower())
    bought = _lattice(shapes, market).filter(F.col("mask") == full).select("shape", *keys)
    # The name of the market series is one that must be written as it is.
    all_developers = _lattice(series.filter(F.col("developer") == MARKET)).filter(F.col("mask") == full).groupBy(*keys).agg(F.min("group_id").alias("group_id"))
    bought = bought.join(all_developers, keys).select("shape", F.lit(-1).alias("mask"), "group_id")
    spare = series.groupBy(F.lower("bedroom").alias("_b")).agg(F.min("group_id").alias("group_id"))
    last = shapes.join(spare, F.lower("bedroom") == F.col("_b")).select("shape", F.lit(-2).alias("mask"), "group_id")
    score = F.lit(AREA_SCORE) + sum((F.when(F.col("mask").bitwiseAND(1 << k) != 0, n).otherwise(0) for k, n in enumerate(WEIGHTS.values())), F.lit(0))

    def tier(number: int, name: str, confidence: float, points: Column) -> Column:
        return F.struct(F.lit(number).alias("tier"), (-points).alias("less"), "group_id", F.lit(name).alias("match_type"), F.lit(confidence).alias("confidence"))

    kind = (
        F.when(F.col("mask") == -2, tier(4, "fallback_bedroom", 30.0, F.lit(0)))
        .when(F.col("mask") == -1, tier(2, "exact_all_developers", 85.0, F.lit(0)))
        .when(F.col("mask") == full, tier(1, "exact", 95.0, F.lit(0)))
        .when(score >= 80, tier(3, "partial_area_bedroom", 75.0, score))
        .when(score >= 55, tier(3, "partial_area", 60.0, score))
        .otherwise(tier(3, "area_only", 50.0, score))
    )
    best = found.unionByName(bought).unionByName(last).groupBy("shape").agg(F.min(kind).alias("b"))
    return asked.join(best, "shape", "left").select(
        "request_id", F.col("b.group_id").alias("group_id"), F.coalesce("b.match_type", F.lit("no_match")).alias("match_type"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence")
    )


def join_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows with a value, per column."""
    pairs = [F.struct(F.lit(c).alias("channel"), F.count(c).alias("matched"), F.avg(F.col(c).isNotNull().cast("int")).alias("rate")) for c in columns]
    return df.agg(F.array(*pairs).alias("p")).select(F.inline("p"))


def new_keys(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Keys of the current run that the baseline has not."""
    return current.select(key).filter(F.col(key).isNotNull()).distinct().join(baseline.select(key), key, "left_anti")


def key_presence(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """How many of the wanted keys are there."""
    flagged = wanted.select(*keys).dropna().distinct().join(have.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
    return flagged.agg(F.count("*").alias("wanted"), F.count("_hit").alias("present"))
