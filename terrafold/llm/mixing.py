"""Mix sources to target weights by Pareto order sampling.

A document's size is its number of words. Each source gets a target from its
weight, capped at ``max_repeats`` times its size; what is cut off is shared
again by weight. With ratio = target / size of the source, every document is
taken floor(ratio) whole times for certain. What is still due of the source's
target is sampled with unequal probabilities: a document's inclusion
probability grows with the root of its size,

    p = f * root(size),    f such that the sum of p * size is what is due,

and documents for which that reaches 1 are taken once more for certain. The
others are ranked by the Pareto variable, random odds by inclusion odds,

    (u / (1 - u)) / (p / (1 - p)),    u uniform, from a hash of seed and id,

and taken from the least on: a sample of fixed size, in words. It stops before
the first document that would pass the words due; then the one further document
whose size fits the remaining gap best is added, if that brings the sum nearer.

The order within a source is never sorted as a whole. A rank is cut into
``LEVELS`` digits of ``BITS`` bits, and sums over digits find, level by level,
the rank at which the sample ends, so a source with a third of all rows is no
single group. Equal rows are one group with a multiplicity, of which as many
are taken as fit. Tables that are held in one place have a row per source, per
source and digit, or per source and distinct size.

Defined cases: a null text has size 0; null sources are one source, after all
others; documents of size 0 are taken 0 words (in ``mixed``: whole copies only);
ties in rank are ordered by id (null last), size and hash of the text; rows equal
in all of these are alike, and which of them are taken makes no difference; an
empty table gives no rows. Columns besides are kept by ``mixed`` and not read by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
LEVELS, BITS = 2, 15
LAST = 2**63 - 1
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def size_of(column: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(column).cast("string"), F.lit(WORD)).cast("long"), F.lit(0))


def uniform(column: str, seed: str = SEED) -> F.Column:
    """A number in (0, 1) from the id, the same in every run and engine."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2**52))


def source_targets(counts: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source: ``source_size`` and ``target``; one row per source. ``counts``: source, size, n.

    Filling by level: sources in the order of cap / weight are capped as long
    as their cap lies under their share of what the ones before left.
    """
    per = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    later = by_level.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    due = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    per = per.withColumn("level", due / F.sum("w").over(later))
    # Levels rise while sources are capped and fall after: the top one holds.
    open_level = F.max("level").over(every)
    return per.select(
        "source",
        "source_size",
        F.least("cap", F.col("w") * open_level).alias("target"),
    )


def _root(size: F.Column) -> F.Column:
    """The root of a size as an integer, so that sums do not depend on their order."""
    return F.floor(F.sqrt(size) * 1024).cast("long")


def _counts(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source", "size").agg(F.count("*").alias("n"))


def _odds(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """``counts``: source, size, n. Per source: copies, words that are sampled (``due``), factor of ``p``, and the largest size that is not certain."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.withColumn("copies", F.floor(ratio + 1e-12).cast("long"))
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size"))
    plan = plan.withColumn("rest", rest)
    one = plan.select(F.col("source").alias("s"), "rest")
    counts = counts.filter("size > 0").join(one, F.col("source").eqNullSafe(F.col("s"))).withColumn("root", _root(F.col("size")))
    # If all larger sizes are certain: their words, and those of the others.
    largest = Window.partitionBy("source").orderBy(F.col("size").desc())
    earlier, others = largest.rowsBetween(Window.unboundedPreceding, -1), largest.rowsBetween(0, Window.unboundedFollowing)
    words = F.col("n") * F.col("size")
    roots = F.sum(words.cast("decimal(38,0)") * F.col("root").cast("decimal(19,0)")).over(others).cast("double")
    open_words = F.col("rest") - F.coalesce(F.sum(words).over(earlier), F.lit(0))
    tried = counts.select(
        "source", "size", "root", (open_words / roots).alias("factor"), F.least(open_words, F.sum(words).over(others).cast("double")).alias("due")
    )
    found = (
        tried.filter(F.col("factor") * F.col("root") < 1)
        .groupBy(F.col("source").alias("s"))
        .agg(F.max(F.struct("size", "factor", "due")).alias("m"))
        .select("s", F.col("m.size").alias("top"), F.col("m.factor").alias("factor"), F.col("m.due").alias("due"))
    )
    joined = plan.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
    none = F.lit(0.0)
    return joined.select(
        "source", "source_size", "target", "copies", F.coalesce("top", F.lit(0)).alias("top"), F.coalesce("factor", none).alias("factor"), F.coalesce("due", none).alias("due")
    )


def _ranked(sized: DataFrame, odds: DataFrame) -> DataFrame:
    """``sized`` with ``rank`` (null: not sampled) and ``sure``, the copies taken for certain."""
    plan = odds.select(F.col("source").alias("_s"), "copies", "top", "factor", "due")
    place = F.spark_partition_id().alias("place")  # of the input, before any join
    joined = sized.select("*", place).join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    p, u = F.col("factor") * _root(F.col("size")), F.col("u")
    # The Pareto variable x as x / (1 + x), in (0, 1): it ranks alike.
    ahead, behind = u * (1.0 - p), p * (1.0 - u)
    sampled = (F.col("size") > 0) & (F.col("size") <= F.col("top")) & (F.col("due") > 0)
    rank = F.floor(ahead / (ahead + behind) * float(2 ** (LEVELS * BITS))).cast("long")
    sure = F.col("copies") + (F.col("size") > F.col("top")).cast("long")
    return joined.withColumns({"rank": F.when(sampled, rank), "sure": sure}).drop("copies", "top", "factor", "due", "u")


ROW = ("rank", "id", "size", "tie")


def _border(ranked: DataFrame, odds: DataFrame) -> DataFrame:
    """Per source: ``stop`` (a ``ROW``; those before it are taken), ``fit`` rows equal to it are taken, and one equal to ``extra``."""
    at = odds.filter("due > 0").select(F.col("source").alias("s"), "due", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("passed"))
    same = F.col("source").eqNullSafe(F.col("s"))
    for level in range(LEVELS - 1, -1, -1):
        digit = F.shiftright("rank", level * BITS)
        near = ranked.filter("rank is not null").join(at, same).filter(F.shiftright("rank", (level + 1) * BITS) == F.col("prefix"))
        sums = near.groupBy("source", digit.alias("digit")).agg(
            F.sum("size").alias("words"), F.first("due").alias("due"), F.first("passed").alias("passed")
        )
        before = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("passed", F.col("passed") + F.coalesce(F.sum("words").over(before), F.lit(0)))
        # Where the sum first reaches what is due.
        hit = sums.filter((F.col("passed") < F.col("due")) & (F.col("passed") + F.col("words") >= F.col("due")))
        at = cut(hit.select(F.col("source").alias("s"), "due", F.col("digit").alias("prefix"), "passed"))
    # Rows of one rank: one row here per group of equal ones.
    groups = (
        ranked.join(at, same & (F.col("rank") == F.col("prefix")))
        .groupBy("source", *ROW)
        .agg(F.count("*").alias("n"), F.first("due").alias("due"), F.first("passed").alias("passed"))
    )
    before = Window.partitionBy("source").orderBy(*ROW).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("passed", F.col("passed") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(before), F.lit(0)))
    fit = F.least("n", F.greatest(F.lit(0), F.floor((F.col("due") - F.col("passed")) / F.col("size")))).cast("long")
    found = F.struct(*ROW, "fit", (F.col("due") - F.col("passed") - F.col("fit") * F.col("size")).alias("gap"))
    stops = (
        groups.withColumn("fit", fit)
        .groupBy("source")
        .agg(F.coalesce(F.min(F.when(F.col("fit") < F.col("n"), found)), F.max(found)).alias("f"), F.min(F.when(F.col("fit") < F.col("n"), 1)).alias("open"))
        .select(F.col("source").alias("s"), F.struct(*[F.col(f"f.{c}").alias(c) for c in ROW]).alias("stop"), "f.fit", "f.gap", "open")
    )
    stops = cut(stops)
    row = F.struct(*ROW)
    outside = ranked.filter("rank is not null").join(stops, same).filter((row > F.col("stop")) | ((row == F.col("stop")) & (F.col("open") == 1)))
    miss = F.abs(F.col("gap") - F.col("size"))
    best = outside.groupBy("source").agg(F.min(F.when(miss < F.abs("gap"), F.struct(miss.alias("miss"), *ROW))).alias("e"))
    extra = best.filter("e is not null").select(F.col("source").alias("s2"), F.struct(*[F.col(f"e.{c}").alias(c) for c in ROW]).alias("extra"))
    return stops.join(extra, F.col("s").eqNullSafe(F.col("s2")), "left").select("s", "stop", "fit", "extra")


def _taken(ranked: DataFrame, border: DataFrame) -> DataFrame:
    """``ranked`` with ``times``, how often each row is taken."""
    row = F.struct(*ROW)
    joined = ranked.join(border, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    edge = F.coalesce((row == F.col("stop")) | (row == F.col("extra")), F.lit(False))
    inside = F.coalesce(F.col("rank").isNotNull() & (row < F.col("stop")), F.lit(False)).cast("long")
    plain = joined.filter(~edge).withColumn("times", F.col("sure") + inside)
    # Equal rows at the border are numbered, within input partitions and then over them.
    edges = joined.filter(edge)
    own = Window.partitionBy("source", *ROW, "place").orderBy(F.lit(0))
    counts = edges.groupBy("source", *ROW, "place").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source", *ROW).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.col("source").alias("_bs"), F.struct(*ROW).alias("_br"), F.col("place").alias("_bp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    numbered = edges.withColumn("_at", F.row_number().over(own)).join(
        bases, F.col("source").eqNullSafe(F.col("_bs")) & (row == F.col("_br")) & (F.col("place") == F.col("_bp"))
    )
    at = F.col("_base") + F.col("_at")
    at_stop = F.coalesce(row == F.col("stop"), F.lit(False))
    more = F.when(at_stop, F.col("fit")).otherwise(0) + F.coalesce(row == F.col("extra"), F.lit(False)).cast("long")
    numbered = numbered.withColumn("times", F.col("sure") + (at <= more).cast("long"))
    keep = [*[c for c in ranked.columns if c != "place"], "times"]
    return plain.select(*keep).unionByName(numbered.select(*keep))


def _sized(docs: DataFrame, id_column: str, text_column: str, source_column: str, seed: str, *more: F.Column) -> DataFrame:
    return docs.select(
        F.col(source_column).alias("source"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("id"),
        size_of(text_column).alias("size"),
        F.xxhash64(F.col(text_column).cast("string")).alias("tie"),
        uniform(id_column, seed).alias("u"),
        *more,
    )


def _plan(sized: DataFrame, weights, max_repeats: int) -> tuple[DataFrame, DataFrame]:
    """The odds and the border of every source."""
    counts = cut(_counts(sized))
    odds = cut(_odds(counts, source_targets(counts, weights, max_repeats)))
    return odds, cut(_border(cut(_ranked(sized, odds)), odds))


def mix(
    docs: DataFrame, id_column="doc_id", text_column="text", source_column="source", weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED
) -> DataFrame:
    """One row per document with what the mix takes of it.

    Columns: ``doc_id``, ``size``, ``source_size``, ``target`` (its source's)
    and ``taken`` (words, repeats counted).
    """
    sized = cut(_sized(docs, id_column, text_column, source_column, seed, F.col(id_column).alias("doc_id")))
    odds, border = _plan(sized, weights, max_repeats)
    per_source = odds.select(F.col("source").alias("s"), "source_size", "target")
    return (
        _taken(_ranked(sized, odds), border)
        .join(per_source, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))
    )


def mixed(
    docs: DataFrame, id_column="doc_id", text_column="text", source_column="source", weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    odds, border = _plan(cut(_sized(docs, id_column, text_column, source_column, seed)), weights, max_repeats)
    times = _taken(_ranked(_sized(docs, id_column, text_column, source_column, seed, whole), odds), border)
    again = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    return times.filter("times > 0").select("row", again.alias("again")).select("row.*")
