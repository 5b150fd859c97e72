"""Embedding near-dedup by an epsilon grid order join.

Cosine >= t of two vectors is distance <= eps = sqrt(2 - 2t) of their unit
vectors. Unit vectors are projected on the leading principal dimensions, which
shortens distances only; a grid of width eps there gives each a cell, and
vectors are put in lexicographic order of their cells. The sequence is cut into
blocks of ``BLOCK`` vectors and those into ``FAN`` strips, each with a bounding
box of projections and of the length of what is left of the unit vectors: two
rests are no nearer than their lengths. Intervals are joined recursively, level
by level, down to strips: a pair of intervals whose boxes lie more than eps
apart is skipped with all that is below it. Pairs of blocks with a surviving
pair of strips are the units of work; a unit again skips pairs of ``STRIP``
vectors by their boxes, and compares the rest by a product of matrices, whose
values near the threshold are decided in double precision.

Equal vectors are one vector with a multiplicity. A unit emits per vector its
number of links, and a spanning forest of its links, never all pairs.

How much is skipped depends on the vectors. Clusters further apart than eps are
not compared (see the tests); of vectors that fill all directions evenly, as
random ones do, no interval is provably distant and all blocks meet.

The principal dimensions are fitted on a bounded sample (``SAMPLE`` vectors of
least id hash); they decide how much is skipped, not what is found.

Defined cases: vectors that are null, zero or hold null or non-finite
components link with nothing and are kept; so do rows with null ids. Vectors of
different length never link. Rows with equal ids count as copies if their
vectors are equal; an id's different vectors are vectors of their own, which may
link with each other, and ``n_links`` is that of the one with most links. An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_counted, partitions, valid_vector
from .links import FOUND, Forest, classes

THRESHOLD = 0.9
DIMENSIONS = 12
BLOCK, STRIP = 4096, 256
SAMPLE = 20_000
FAN, TOP = 8, 64


def principal(sample: np.ndarray, dimensions: int) -> np.ndarray:
    """Orthonormal columns along which unit vectors vary most."""
    centred = sample - sample.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    return axes[:, ::-1][:, :dimensions]


def _units(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _projected(raw: list[bytes], kind: str, axes: dict[int, np.ndarray], dimensions: int) -> np.ndarray:
    """Projections, and in a last column the length of the rest of the unit vector."""
    out = np.zeros((len(raw), dimensions + 1))
    width = np.array([len(r) for r in raw]) // np.dtype(kind).itemsize
    for dim in np.unique(width):
        at = np.flatnonzero(width == dim)
        basis = axes.get(int(dim))
        if basis is not None:
            v = _units(np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), dim))
            out[at, : basis.shape[1]] = v @ basis
    out[:, -1] = np.sqrt(np.maximum(0.0, 1.0 - (out * out).sum(axis=1)))
    return out


def distinct_vectors(vectors: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(per distinct valid vector: rep, copies, dim, raw; per row: id, rep, row, copies)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + 0.0  # one zero
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            parts = np.split(values, ends[:-1]) if len(ends) else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p.tobytes() for p in parts], pa.binary())], names=["id", "raw"]
            )

    rows = vectors.mapInArrow(work, "id long, raw binary")
    distinct = cut(rows.groupBy("raw").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    members = join_counted(rows, distinct, "raw", "copies").select("id", "rep", F.xxhash64("raw").alias("row"), "copies")
    return distinct, members


def in_grid_order(distinct: DataFrame, kind: str, axes: dict[int, np.ndarray], eps: float, dimensions: int, block: int) -> DataFrame:
    """``distinct`` with its projections ``p0..``, their rest and the number of its block."""
    names = [f"p{k}" for k in range(dimensions + 1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = _projected(batch.column(0).to_pylist(), kind, axes, dimensions)
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, p.T)], names=[*batch.schema.names, *names])

    projected = distinct.mapInArrow(work, "raw binary, rep long, copies long, " + ", ".join(f"{n} double" for n in names))
    order = [F.length("raw"), *[F.floor(F.col(n) / eps) for n in names[:-1]], F.col("rep")]
    placed = projected.repartitionByRange(partitions(distinct.sparkSession), *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))],
                names=[*batch.schema.names, "part", "at"],
            )
            at += n

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in projected.schema)
    numbered = cut(placed.mapInArrow(number, schema + ", part int, at long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    bases = numbered.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    strip = F.floor((F.col("base") + F.col("at")) / max(1, block // FAN))
    placed = numbered.join(bases, "part").withColumn("strip", strip)
    return placed.withColumn("block", F.floor(F.col("strip") / FAN)).drop("part", "at", "base")


def _apart(a: str, b: str, dimensions: int) -> F.Column:
    """Square of the least distance of two boxes."""
    total = F.lit(0.0)
    for k in range(dimensions):
        gap = F.greatest(
            F.lit(0.0), F.col(f"{b}.lo{k}") - F.col(f"{a}.hi{k}"), F.col(f"{a}.lo{k}") - F.col(f"{b}.hi{k}")
        )
        total = total + gap * gap
    return total


def joined_intervals(boxes: DataFrame, eps: float, dimensions: int) -> DataFrame:
    """Pairs of blocks ``p <= q`` whose boxes lie within eps, level by level.

    ``boxes``: block, lo0.., hi0... Pairs of at most ``TOP`` intervals are
    written out; from each level to the next an interval has ``FAN`` parts.
    """
    top = boxes.agg(F.max("block")).first()[0]
    levels, count = 0, (top or 0) + 1
    while count > TOP:
        levels, count = levels + 1, -(-count // FAN)
    pairs = None
    for level in range(levels, -1, -1):
        nodes = boxes.groupBy(F.floor(F.col("block") / FAN**level).alias("node")).agg(
            *[F.min(f"lo{k}").alias(f"lo{k}") for k in range(dimensions)],
            *[F.max(f"hi{k}").alias(f"hi{k}") for k in range(dimensions)],
        )
        if pairs is None:
            wanted = nodes.select(F.col("node").alias("p")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(TOP - 1))))
        else:
            wanted = pairs.select((F.col("p") * FAN).alias("p"), (F.col("q") * FAN).alias("q"))
            for side in "pq":
                wanted = wanted.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1)))).withColumn(side, F.col(side) + F.col("k"))
        pairs = cut(
            wanted.filter("p <= q").alias("w")
            .join(nodes.alias("a"), F.col("w.p") == F.col("a.node"))
            .join(nodes.alias("b"), F.col("w.q") == F.col("b.node"))
            .filter(_apart("a", "b", dimensions) <= eps * eps + 1e-9)
            .select(F.col("w.p").alias("p"), F.col("w.q").alias("q"))
        )
    return pairs


def block_pairs(ordered: DataFrame, eps: float, names: list[str]) -> DataFrame:
    """Pairs of blocks of ``ordered`` of which not all strips are provably distant."""
    low = [F.min(n).alias(f"lo{k}") for k, n in enumerate(names)]
    high = [F.max(n).alias(f"hi{k}") for k, n in enumerate(names)]
    boxes = cut(ordered.groupBy(F.col("strip").alias("block")).agg(*low, *high))
    near = joined_intervals(boxes, eps, len(names))
    return cut(near.select(F.floor(F.col("p") / FAN).alias("p"), F.floor(F.col("q") / FAN).alias("q")).distinct())


def _boxes_apart(a: np.ndarray, b: np.ndarray) -> float:
    gap = np.maximum(0.0, np.maximum(b.min(axis=0) - a.max(axis=0), a.min(axis=0) - b.max(axis=0)))
    return float((gap * gap).sum())


def _compare(held: list[tuple], same: bool, kind: str, threshold: float, out: list[tuple]) -> None:
    """One unit: rows (side, rep, copies, raw, projection, row), sorted by side; ``same`` if a block meets itself."""
    for width in {len(h[3]) for h in held}:
        rows = [h for h in held if len(h[3]) == width]
        if not same and rows[0][0] == rows[-1][0]:
            continue  # The length is missing on one side.
        reps = np.array([h[1] for h in rows])
        copies = np.array([h[2] for h in rows], dtype=np.int64)
        cells = np.array([h[4] for h in rows])
        exact = _units(np.frombuffer(b"".join(h[3] for h in rows), kind).reshape(len(rows), -1))
        quick = exact.astype(np.float32)
        split = sum(h[0] == 0 for h in rows)
        spans = [(a, min(a + STRIP, split)) for a in range(0, split, STRIP)]
        others = spans if same else [(a, min(a + STRIP, len(rows))) for a in range(split, len(rows), STRIP)]
        links, forest, eps2 = np.zeros(len(rows), dtype=np.int64), Forest(len(rows)), 2 - 2 * threshold
        for a, b in spans:
            for c, d in others:
                if same and c < a or _boxes_apart(cells[a:b], cells[c:d]) > eps2 + 1e-9:
                    continue
                near = quick[a:b] @ quick[c:d].T
                linked = near >= threshold + 1e-5
                i, j = np.nonzero(np.abs(near - threshold) < 1e-5)
                linked[i, j] = (exact[a + i] * exact[c + j]).sum(axis=1) >= threshold
                if a == c and same:
                    np.fill_diagonal(linked, False)
                hit = np.flatnonzero(linked.any(axis=1))
                if not len(hit):
                    continue
                links[a:b] += linked @ copies[c:d]
                if a != c:
                    links[c:d] += copies[a:b] @ linked
                for row in hit:
                    js = np.flatnonzero(linked[row]) + c
                    out.extend((int(reps[a + row]), rows[a + row][5], 0, int(reps[j])) for j in forest.link(a + row, js))
        out.extend((int(reps[k]), rows[k][5], int(links[k]), None) for k in np.flatnonzero(links))


def near_duplicates(
    table: DataFrame, id_column="vec_id", vector_column="embedding", threshold: float = THRESHOLD, dimensions: int = DIMENSIONS, block: int = BLOCK
) -> DataFrame:
    """Return ``vec_id, n_links, component_id, kept`` for every row."""
    spark = table.sparkSession
    eps = float(np.sqrt(2 - 2 * threshold))
    element = table.schema[vector_column].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    number = "float" if element == "float" else "double"
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(f"array<{number}>").alias("v"))
    distinct, members = distinct_vectors(rows.filter(F.col("id").isNotNull() & valid_vector("v")), kind)
    sample = distinct.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("raw").collect()  # at most SAMPLE
    by_length: dict[int, list[bytes]] = {}
    for r in sample:
        by_length.setdefault(len(r["raw"]), []).append(bytes(r["raw"]))
    axes = {}
    for size, raws in by_length.items():
        dim = size // np.dtype(kind).itemsize
        axes[dim] = principal(_units(np.frombuffer(b"".join(raws), kind).reshape(-1, dim)), dimensions)
    ordered = cut(in_grid_order(distinct, kind, axes, eps, dimensions, block))
    names = [f"p{k}" for k in range(dimensions + 1)]
    pairs = block_pairs(ordered, eps, names)
    ends = pairs.select("p", "q", F.col("p").alias("block"), F.lit(0).alias("side")).unionByName(
        pairs.filter("p < q").select("p", "q", F.col("q").alias("block"), F.lit(1).alias("side"))
    )
    units = (
        ordered.join(ends, "block")
        .select("p", "q", "side", "rep", "copies", "raw", F.array(*names).alias("cell"), F.xxhash64("raw").alias("row"))
        .repartition(partitions(spark), "p", "q")
        .sortWithinPartitions("p", "q", "side", *[F.floor(F.col("cell")[k] / eps) for k in range(dimensions)], "rep")
    )
    schema = pa.schema([(name, pa.int64()) for name in ("id", "row", "links", "to")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[tuple]) -> pa.RecordBatch:
            out: list[tuple] = []
            _compare(held, now[0] == now[1], kind, threshold, out)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], [], []))], schema=schema)

        now, held = None, []
        for batch in batches:
            for p, q, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if (p, q) != now:
                    if held:
                        yield done(held)
                    now, held = (p, q), []
                held.append(tuple(row))
        if held:
            yield done(held)

    found = cut(units.mapInArrow(work, FOUND))
    per_id = classes(found, members)
    return rows.select("id").join(per_id, "id", "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )
