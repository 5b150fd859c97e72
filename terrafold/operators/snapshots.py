"""What changed since a baseline, read from the ranges that differ only.

A snapshot is a table of (key, digest of the key's rows), ordered by a hash of
the key and cut into leaves, and a tree of digests over it: leaf, branch, root.
A node's digest is the exclusive or of the digests below it with their sum and
number, so it does not depend on order. Two snapshots with equal roots are
equal; otherwise only branches that differ, and in them leaves that differ, are
read (branches are partitions of the files), and their keys are compared. The
comparison loses no key, however many there are.

A baseline decides how many leaves there are, about one for ``LEAF_ROWS`` keys;
the snapshot that is compared with it takes the same number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF_ROWS, BRANCH_BITS, MOST_BITS = 10_000, 6, 24
_NODE = "level int, node long, keys long, digest long, total decimal(38,0)"


def _digest(columns: list[str]) -> Column:
    """Of one row: nulls count, and so does the column that they are in."""
    parts = [part for c in columns for part in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("long")


def digests(df: DataFrame, key: str, columns: list[str], bits: int) -> DataFrame:
    """(key, branch, leaf, digest) per key that is not null; a key's rows are one, whatever their order."""
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), _digest(columns).alias("d"))
    both = F.xxhash64(F.bit_xor("d"), F.sum(F.col("d").cast("decimal(38,0)")), F.count("*"))
    spread = F.xxhash64("key")
    keyed = rows.groupBy("key").agg(both.alias("digest")).withColumn("leaf", F.shiftrightunsigned(spread, 64 - bits))
    return keyed.select("key", F.shiftrightunsigned("leaf", bits - BRANCH_BITS).alias("branch"), "leaf", "digest")


def _nodes(rows: DataFrame) -> DataFrame:
    """The tree: a row per leaf (level 2), branch (1) and the root (0)."""
    facts = [F.count("*").alias("keys"), F.bit_xor(F.xxhash64("key", "digest")).alias("digest"), F.sum(F.xxhash64("digest", "key").cast("decimal(38,0)")).alias("total")]
    leaves = rows.groupBy("branch", "leaf").agg(*facts)
    up = [F.sum("keys").alias("keys"), F.bit_xor("digest").alias("digest"), F.sum("total").alias("total")]
    branches = leaves.groupBy("branch").agg(*up)
    root = branches.agg(*up)
    level = lambda df, n, node: df.select(F.lit(n).alias("level"), node.cast("long").alias("node"), "keys", "digest", F.col("total").cast("decimal(38,0)").alias("total"))
    return level(leaves, 2, F.col("leaf")).unionByName(level(branches, 1, F.col("branch"))).unionByName(level(root.filter("keys > 0"), 0, F.lit(0)))


class Snapshot:
    """A written snapshot: ``rows`` by branch, ``tree`` and the number of bits of a leaf."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        shape = spark.read.parquet(f"{path}/shape").first()
        self.bits, self.kind = shape["bits"], shape["kind"]

    @property
    def table(self) -> DataFrame:
        """All rows (key, leaf, digest, branch); there may be none."""
        return self.spark.read.schema(f"key {self.kind}, leaf long, digest long, branch long").parquet(f"{self.path}/rows")

    @property
    def tree(self) -> DataFrame:
        return self.spark.read.schema(_NODE).parquet(f"{self.path}/tree")

    def rows(self, branches: list[int], leaves: DataFrame) -> DataFrame:
        """(key, digest) of ``leaves`` (leaf), which lie in ``branches``, of which there are at most 64."""
        return self.table.filter(F.col("branch").isin(branches)).join(leaves, "leaf", "left_semi").select("key", "digest")


def write_snapshot(df: DataFrame, path: str, key: str, columns: list[str] | None = None, like: Snapshot | None = None) -> Snapshot:
    """Write the snapshot of ``df`` by ``key``; ``columns`` (by default all others) decide what counts as changed."""
    spark = df.sparkSession
    columns = [c for c in df.columns if c != key] if columns is None else columns
    if like is None:
        n = df.count()
        bits = min(MOST_BITS, max(BRANCH_BITS, (n // LEAF_ROWS).bit_length()))
    else:
        bits = like.bits
    rows = digests(df, key, columns, bits).repartition("branch").sortWithinPartitions("branch", "leaf", "key")
    rows.write.partitionBy("branch").mode("overwrite").parquet(f"{path}/rows")
    kind = rows.schema["key"].dataType.simpleString()
    spark.createDataFrame([(bits, kind)], "bits int, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")
    snapshot = Snapshot(spark, path)
    _nodes(snapshot.table).write.mode("overwrite").parquet(f"{path}/tree")
    return snapshot


def differing(current: Snapshot, baseline: Snapshot, level: int) -> DataFrame:
    """Nodes of ``level`` that are not the same in both."""
    a, b = (s.tree.filter(F.col("level") == level).select("node", F.struct("keys", "digest", "total").alias(n)) for s, n in ((current, "_a"), (baseline, "_b")))
    return a.join(b, "node", "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("node")


def changes(current: Snapshot, baseline: Snapshot) -> DataFrame:
    """(key, status) of every key that is ``new``, ``vanished`` or ``changed``."""
    if current.bits != baseline.bits:
        raise ValueError("both snapshots must have leaves of one size: write the later one like the baseline")
    branches = [r["node"] for r in differing(current, baseline, 1).collect()]  # at most 64
    leaves = differing(current, baseline, 2).withColumnRenamed("node", "leaf")
    now = current.rows(branches, leaves).withColumnRenamed("digest", "_now")
    then = baseline.rows(branches, leaves).withColumnRenamed("digest", "_then")
    status = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "vanished").when(F.col("_now") != F.col("_then"), "changed")
    return now.join(then, "key", "full").select("key", status.alias("status")).filter("status is not null")


def alerts(changed: DataFrame, metrics: DataFrame, key: str, kinds: list[str], mapped: DataFrame | None = None, top: int = 25) -> DataFrame:
    """New keys among the ``top`` by one of ``kinds``, unless ``mapped`` has them: rank_kind, rank, key, value (G9's tripwire)."""
    from .registers import top_by

    new = changed.filter("status = 'new'").select(F.col("key").alias(key))
    if mapped is not None:
        new = new.join(mapped.select(key), key, "left_anti")
    found = None
    for kind in kinds:
        best = top_by(metrics.select(key, kind), kind, top, key).select(F.lit(kind).alias("rank_kind"), "rank", key, F.col(kind).cast("double").alias("value"))
        found = best if found is None else found.unionByName(best)
    return found.join(new, key, "left_semi").select("rank_kind", "rank", key, "value")
