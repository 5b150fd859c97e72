"""What several operators share: the shared folder, columns, row batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that a task turns into Python objects at a time.
SLICE_ROWS = 256
#: A key with more than 1/HOT of all rows is hot; there are fewer than HOT of them.
HOT = 256


def shared_folder(spark: SparkSession) -> str:
    """Return the folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where a session on one
    machine has none, as in tests, a temporary folder is set instead; a cluster
    without one is an error, as executors would not find what others wrote.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="terrafold-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """Return the address of a new, unused folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """``left`` joined to ``right`` on ``key``, however often a key occurs in ``left``.

    ``right`` has one row per key and says in ``count`` how many rows of ``left``
    have it. Keys with more than 1/``HOT`` of all those rows are fewer than
    ``HOT``: they are broadcast, so that their rows stay where they are. Rows
    with other keys are shuffled, and no key has more than its share of a task.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT > total
    often = left.join(F.broadcast(right.filter(hot)), key)
    seldom = left.join(F.broadcast(right.filter(hot).select(key)), key, "left_anti").join(right.filter(~hot), key)
    return often.unionByName(seldom)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        names.append(name)
    return names


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that only a few rows at a time become objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def valid_vector(column: str) -> F.Column:
    """True for a vector that is not null, not zero and wholly finite."""
    values = F.transform(F.col(column), lambda x: x.cast("double"))
    finite = F.forall(
        values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(values, lambda x: x != 0.0), F.lit(False))
