"""How filters of documents interact when they are applied one after the other.

A filter fails a document whatever the others do, so what an order of filters
does to a document follows from its mask of failures alone. The audit works on
*cells*: how many documents of a part have a mask, and how many of them are of
each class whose loss is counted. Cells are few (parts x masks x classes), the
documents are aggregated into them before anything else is asked.

Cells are unpivoted against the steps of every order: one row per cell, order
and step, with the bit of the step's filter if the cell fails it. A running
bit-or over the steps before says what failed earlier. From there on all
figures are conditional sums over (part, order, step):

* kept: neither failed before nor here,
* removed: failed here, nothing before; redundant: failed here and before,
* unique_fails: the mask is this filter's bit alone,
* one ``..._lost`` column per class: removed documents of that class,
* shapley: the sum of a filter's removed over all orders, a window total over
  (part, filter). Divided by the number of orders it is the filter's share.

``filter_masks`` builds the masks of five text filters, A to E. A to D are
expressions on the text. E (a repeat of a text with a smaller id) compares the
SHA-256 of whole texts: the least id per hash is aggregated before the shuffle
and joined back; hashes of many rows are broadcast, fewer than 256 of them.

Defined cases: a null text is an empty one; a null part is the empty string. A
null id is no smaller than any and has none smaller, so such a row never fails
E and makes no other row fail it; it has no labels. Rows that repeat an id and
its text do not fail by each other. Several label rows of an id count as one
that is good (toxic) if any of them is; null labels say nothing. Rows that
repeat are counted as often as they occur. Further columns are not read. An
empty table gives no rows, as there is no part; every part that occurs has all
orders and steps, zeros included.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_counted

#: Fixed: what separates words, and the letters that condition D seeks.
GAPS = r"[\x20\x09-\x0D]+"
MARKUP = r"[#$%&*|]"
LETTERS = "ABCDE"


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a whole text that is not null."""
    words = F.filter(F.split(text, GAPS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 50,
        "B": F.lit(100) * distinct < F.lit(65) * n,
        "C": F.lit(100).cast("long") * capitals > F.lit(5).cast("long") * F.length(text),
        "D": text.rlike(MARKUP),
    }


def bits(conditions: dict[str, Column], letters: str = LETTERS) -> Column:
    """The mask: bit k is set where the condition of the k-th letter holds; a null condition does not."""
    masks = [F.when(condition, 1 << letters.index(name)).otherwise(0) for name, condition in conditions.items()]
    return sum(masks[1:], masks[0])


def filter_masks(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """(part, mask, good, toxic): a row per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    narrow = cut(slim.select("id", "part", bits(text_conditions(F.col("text"))).alias("mask"), F.unhex(F.sha2("text", 256)).alias("hash")))
    firsts = narrow.groupBy("hash").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    repeat = F.when(F.col("id") > F.col("first"), 1 << LETTERS.index("E")).otherwise(0)
    full = join_counted(narrow, firsts, "hash", "rows").select("id", "part", (F.col("mask") + repeat).alias("mask"))
    seen = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    flag = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)).cast("int")).alias(name)
    marks = seen.agg(flag("quality"), flag("toxic")).filter("quality + toxic > 0").withColumn("salt", F.lit(0))
    # Null ids meet no label; a salt deals them out instead of sending them to one task.
    salt = F.when(F.col("id").isNull(), F.monotonically_increasing_id() % 4096).otherwise(0).cast("int")
    marked = full.withColumn("salt", salt).join(marks, ["id", "salt"], "left")
    return marked.select("part", "mask", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def interaction_audit(masks: DataFrame, letters: str = LETTERS, classes: Sequence[str] = ("good", "toxic"), orders: Sequence[str] | None = None) -> DataFrame:
    """Counts per part, order of filters and step; see above. ``masks``: part, mask and one 0/1 column per class.

    ``orders`` are words of ``letters``, all permutations by default: right for
    a handful of filters, as their number is the factorial.
    """
    orders = list(orders) if orders is not None else ["".join(p) for p in permutations(letters)]
    cell = ["part", "mask", *classes]
    cells = masks.groupBy(*cell).agg(F.count("*").alias("n"))
    ordered = cells.select("*", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    places = F.posexplode(F.split("filter_order", "(?<=.)(?=.)"))
    long = ordered.select("*", places.alias("place", "letter")).withColumn("step", F.col("place") + 1)
    bit = F.element_at(F.create_map(*[F.lit(x) for k, name in enumerate(letters) for x in (name, 1 << k)]), F.col("letter"))
    long = long.withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("filter_order", *cell).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    failed, past = F.col("fails") != 0, F.col("earlier") != 0
    count = lambda condition, name: F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)
    table = long.groupBy("part", "filter_order", "step", "letter").agg(
        count(~failed & ~past, "kept"),
        count(failed & ~past, "removed"),
        count(failed & past, "redundant"),
        count(F.col("mask") == F.col("bit"), "unique_fails"),
        *[count(failed & ~past & (F.col(c) == 1), f"{c}_lost") for c in classes],
    )
    return table.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def document_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over whole texts, per source."""
    return interaction_audit(filter_masks(docs, labels))
