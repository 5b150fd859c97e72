"""What the two similarity joins share once blocks of rows are compared."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted
from .components import components

#: Rows that comparing tasks give: links of the representative ``id, row``; or, in ``to``, one link of a spanning forest.
FOUND = "id long, row long, links long, to long"


class Forest:
    """Components of the rows of one unit, kept as labels.

    ``link(i, js)`` returns those of ``js`` whose links join two components;
    over a unit these are fewer than its rows, however many links there are.
    """

    def __init__(self, rows: int):
        self.label = np.arange(rows)

    def link(self, i: int, js: np.ndarray) -> np.ndarray:
        labels, first = np.unique(self.label[js], return_index=True)
        fresh = labels != self.label[i]
        if not fresh.any():
            return js[:0]
        self.label[np.isin(self.label, labels[fresh])] = self.label[i]
        return js[first[fresh]]


def classes(found: DataFrame, members: DataFrame) -> DataFrame:
    """Per id: ``component`` and ``n_links``, from what units found.

    ``found``: columns of ``FOUND``, about representatives. ``members``: id,
    rep, row, copies; ``rep`` is the least of ``copies`` equal rows, and ``row``
    a hash of what they hold, as an id may have several different ones: links
    are counted for each, and the largest number is the id's. What is known of
    a representative goes to its copies by ``join_counted``, so that a third of
    all rows may be copies of one.
    """
    node = F.struct("rep", "row").alias("node")
    links = found.withColumnRenamed("id", "rep").groupBy(node).agg(F.sum("links").alias("links"))
    linked = components(found.filter("to is not null"), "id", "to").withColumnRenamed("id", "rep")
    keyed = members.select("id", "rep", "copies", node)
    per_node = keyed.groupBy("node").agg(F.count("*").alias("rows")).join(links, "node", "left")
    per_node = cut(per_node.withColumn("rep", F.col("node.rep")).join(linked, "rep", "left").drop("rep"))
    return (
        join_counted(keyed, per_node, "node", "rows")
        .groupBy("id")
        .agg(
            F.min(F.coalesce("component", "rep")).alias("component"),
            F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
