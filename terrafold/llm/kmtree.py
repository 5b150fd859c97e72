"""Approximate nearest neighbours in a hierarchical k-means tree.

Nearness is the inner product. With one more component sqrt(M^2 - |x|^2) for
rows (M: the largest norm) and 0 for queries, the largest inner product is the
least distance, so k-means fits. The tree is fitted on a bounded sample of rows
of least id hash: ``SAMPLE`` rows, or one row in ``LEAF_ROWS / MIN_SAMPLE`` of a
large table so that leaves stay small, but at most ``SAMPLE_VALUES`` numbers.
Every row is put in the leaf that it reaches from the root by nearest centres. A query walks the tree best bin
first: a priority queue over nodes by distance to their centre; leaves are
visited as they come out, until as many are as calibration found necessary, and
they hold enough rows.

Calibration: for at most ``TRIALS`` queries the exact answer is computed over
all rows, and the least number of leaves is taken with which the share of true
neighbours in visited leaves reaches ``RECALL``. At most ``HELD_OUT`` further
queries measure the recall that this gives (``Index.held_out_recall``, logged,
and ``recall_report``). So recall is measured, not hoped for.

Leaves larger than ``UNIT`` rows are cut by a hash into units, so that a leaf
with a third of all rows (as copies make) is spread over tasks; a query that
visits a leaf goes to all its units. Each unit gives each of its queries its
best ``k`` rows; these are merged per query.

Defined cases: vectors that are null, zero or hold null or non-finite
components, and rows with null ids, take no part. Vectors of different length
are not compared. Rows that share an id with the query are the query's own.
Rows that repeat an id and its vector are one row, as a query and as a
candidate. An id with several vectors is several rows: as queries each has its
own answer with its own ranks, as candidates each may be found. Ties go to the
smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, valid_vector

K, RECALL = 20, 0.97
SAMPLE, SAMPLE_VALUES = 20_000, 2**24
TRIALS, HELD_OUT = 128, 64
BRANCH, LEAF_ROWS, MIN_SAMPLE = 16, 256, 8
UNIT = 4096

log = logging.getLogger(__name__)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of at most ``k`` clusters; starts are spread over a sorted projection."""
    spread = np.argsort(x @ np.linalg.norm(x, axis=0), kind="stable")
    centres = x[spread[np.linspace(0, len(x) - 1, k).astype(int)]]
    for _ in range(rounds):
        nearest = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
        at = nearest.argmin(1)
        counts = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = sums[counts > 0] / counts[counts > 0][:, None]
    return centres


class Tree:
    """Nodes in lists: ``centres[node]`` and ``children[node]`` (none: a leaf)."""

    def __init__(self, sample: np.ndarray, rows: int, top_norm: float, first_leaf: int = 0):
        self.top_norm, self.centres, self.children, self.leaf = top_norm, [], [], []
        self.leaves, self.first_leaf = 0, first_leaf
        self._grow(self.lift(sample), rows / max(1, len(sample)))

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.top_norm**2 - (x * x).sum(1)))
        return np.hstack([x, rest[:, None]])

    def _node(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append(None)
        self.leaf.append(-1)
        return len(self.centres) - 1

    def _grow(self, x: np.ndarray, scale: float) -> None:
        waiting = [(self._node(x.mean(0)), x)]
        while waiting:
            node, own = waiting.pop()
            if len(own) * scale > LEAF_ROWS and len(own) >= 2 * MIN_SAMPLE:
                centres = kmeans(own, min(BRANCH, len(own) // MIN_SAMPLE))
                if len(centres) > 1:
                    at = ((centres**2).sum(1)[None, :] - 2 * own @ centres.T).argmin(1)
                    kids = [self._node(c) for c in centres]
                    self.children[node] = (np.array(kids), centres, (centres**2).sum(1))
                    waiting.extend((kid, own[at == k]) for k, kid in enumerate(kids) if (at == k).any())
                    for k, kid in enumerate(kids):
                        if not (at == k).any():
                            self._end(kid)
                    continue
            self._end(node)

    def _end(self, node: int) -> None:
        self.leaf[node] = self.first_leaf + self.leaves
        self.leaves += 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row falls in."""
        x = self.lift(x)
        out, waiting = np.empty(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
        while waiting:
            node, at = waiting.pop()
            if self.children[node] is None:
                out[at] = self.leaf[node]
                continue
            kids, centres, squares = self.children[node]
            nearest = (squares[None, :] - 2 * x[at] @ centres.T).argmin(1)
            for k in np.unique(nearest):
                waiting.append((int(kids[k]), at[nearest == k]))
        return out

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        q = np.append(q, 0.0)
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.children[node] is None:
                yield self.leaf[node]
                continue
            kids, centres, squares = self.children[node]
            for distance, kid in zip((squares - 2 * centres @ q).tolist(), kids.tolist()):
                heapq.heappush(queue, (distance, kid))


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> Iterator[tuple[int, list, list]]:
    """Per query (its position) the ``k`` best rows by (inner product, smaller id), own id excluded.

    A product of matrices picks candidates; their scores are then summed one by
    one, so that equal vectors have equal scores.
    """
    for low in range(0, len(queries), 256):
        near = queries[low : low + 256] @ rows.T
        for at, scores in enumerate(near, low):
            scores[row_ids == query_ids[at]] = -np.inf
            some = np.flatnonzero(scores > -np.inf)
            if len(some) > k:
                edge = np.partition(scores[some], len(some) - k)[len(some) - k]
                some = some[scores[some] >= edge - 1e-9 * max(1.0, abs(edge))]
            exact = (rows[some] * queries[at]).sum(axis=1)
            order = np.lexsort((row_ids[some], -exact))[:k]
            yield at, row_ids[some][order].tolist(), exact[order].tolist()


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _merge(found: DataFrame, k: int) -> DataFrame:
    """Per query the best ``k`` of its units' answers: ``query_id, mark, hits``."""
    scored = found.withColumn(
        "hits", F.transform(F.arrays_zip("ids", "scores"), lambda h: F.struct((-h["scores"]).alias("less"), h["ids"].alias("vec_id")))
    )
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k)
    return scored.groupBy("query_id", "mark").agg(merged.alias("hits"))


#: ``mark`` is a hash of the query's vector.
HITS = "query_id long, mark long, ids array<long>, scores array<double>"


def _hits(rows: list[tuple]) -> pa.RecordBatch:
    queries, marks, ids, scores = zip(*rows) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays(
        [pa.array(queries, pa.int64()), pa.array(marks, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))],
        names=["query_id", "mark", "ids", "scores"],
    )


def _sample(vectors: DataFrame, rows: dict[int, int]) -> dict[int, np.ndarray]:
    """By vector length the rows of least id hash, in a number that is bounded; ``rows``: how many there are."""
    every = sum(rows.values())
    if not every:
        return {}
    wanted = min(max(SAMPLE, every * MIN_SAMPLE // LEAF_ROWS), max(1, SAMPLE_VALUES // max(rows)))
    share = 1.5 * wanted / every
    near = vectors if share >= 1 else vectors.filter(F.xxhash64("id") < F.lit(int(2**64 * share) - 2**63))
    found = near.orderBy(F.xxhash64("id"), "id").limit(wanted).select("dim", "v").toArrow().combine_chunks()
    by_dim = {}
    for dim in pc.unique(found["dim"]).to_pylist():
        own = found.filter(pc.equal(found["dim"], dim))["v"].combine_chunks()
        by_dim[dim] = _matrix(own)
    return by_dim


class Index:
    """Trees by vector length, rows by leaf, and the calibrated number of leaves."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, k: int = K, recall: float = RECALL):
        """``vectors``, ``queries``: (id, v array<double>), valid and not null."""
        self.k, self.recall, self.spark = k, recall, vectors.sparkSession
        vectors = vectors.withColumn("dim", F.size("v"))
        norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        facts = {r["dim"]: r for r in vectors.groupBy("dim").agg(F.count("*").alias("rows"), F.max(norm2).alias("top")).collect()}
        by_dim = _sample(vectors, {dim: r["rows"] for dim, r in facts.items()})
        self.trees: dict[int, Tree] = {}
        for dim in sorted(by_dim):
            leaves = sum(t.leaves for t in self.trees.values())
            self.trees[dim] = Tree(by_dim[dim], facts[dim]["rows"], float(np.sqrt(facts[dim]["top"])), leaves)
        # Lengths too rare for the sample have one leaf each, tried whole.
        for dim in sorted(set(facts) - set(by_dim)):
            leaves = sum(t.leaves for t in self.trees.values())
            self.trees[dim] = Tree(np.zeros((1, dim)), 1, float(np.sqrt(facts[dim]["top"])), leaves)
        self.rows = cut(self._assigned(vectors))
        counts = {r["leaf"]: r["count"] for r in self.rows.groupBy("leaf").count().collect()}  # a row per leaf
        self.sizes = counts
        self.leaves_to_visit, self.held_out, self.held_out_recall = self._calibrate(queries)
        log.info("%s leaves of %s visited, recall of %s held-out queries: %s", self.leaves_to_visit, len(counts), self.held_out, self.held_out_recall)

    def _assigned(self, vectors: DataFrame) -> DataFrame:
        trees = self.spark.sparkContext.broadcast(self.trees)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim in np.unique(batch.column(2).to_numpy(zero_copy_only=False)):
                    own = batch.filter(pc.equal(batch.column(2), int(dim)))
                    leaf = trees.value[int(dim)].assign(_matrix(own.column(1)))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(leaf)], names=["id", "v", "leaf"])

        return vectors.select("id", "v", "dim").mapInArrow(work, "id long, v array<double>, leaf long")

    def _calibrate(self, queries: DataFrame) -> tuple[int, int, float | None]:
        """Leaves to visit, held-out queries, and the share of their true neighbours in visited leaves."""
        trials = queries.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(TRIALS + HELD_OUT).collect()  # bounded so
        trials = [*{r["id"]: r for r in reversed(trials)}.values()][::-1]
        if not trials:
            return 1, 0, None
        held_out = {r["id"] for r in trials[2::3][:HELD_OUT]}
        own = self.spark.sparkContext.broadcast([(r["id"], np.array(r["v"])) for r in trials])
        k = self.k

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                widths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(widths):
                    asked = [(i, v) for i, v in own.value if len(v) == dim]
                    if asked:
                        part = pa.array(widths == dim)
                        rows = _matrix(batch.column(1).filter(part))
                        found = best(np.array([v for _, v in asked]), np.array([i for i, _ in asked]), rows, ids[widths == dim], k)
                        yield _hits([(asked[at][0], 0, *hit) for at, *hit in found])

        truth = _merge(self.rows.select("id", "v").mapInArrow(scan, HITS), k)
        wanted = truth.select("query_id", F.explode("hits").alias("h")).select("query_id", F.col("h.vec_id").alias("id"))
        homes = wanted.join(self.rows.select("id", "leaf"), "id").groupBy("query_id", "id").agg(F.min("leaf").alias("leaf"))
        homes = homes.groupBy("query_id").agg(F.collect_list("leaf").alias("leaves")).collect()  # ``k`` a query
        need: list[int] = []
        checked: list[int] = []
        vector = {r["id"]: np.array(r["v"]) for r in trials}
        for r in homes:
            q = vector[r["query_id"]]
            rank = {leaf: n for n, leaf in enumerate(self.trees[len(q)].walk(q), 1)}
            (checked if r["query_id"] in held_out else need).extend(rank[x] for x in r["leaves"])
        if not need:
            need = checked
        if not need:
            return 1, 0, None
        need.sort()
        visits = int(need[min(len(need) - 1, int(np.ceil(self.recall * len(need))) - 1)])
        return visits, len(held_out), float(np.mean([n <= visits for n in checked])) if checked else None

    def search(self, queries: DataFrame) -> DataFrame:
        """``query_id, rank, vec_id, score`` for ``queries`` (id, v)."""
        trees = self.spark.sparkContext.broadcast((self.trees, self.sizes))
        visits, k = self.leaves_to_visit, self.k

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, sizes = trees.value
            for batch in batches:
                leaves = []
                for v in batch.column(1).to_pylist():
                    seen, found = 0, []
                    for leaf in tree[len(v)].walk(np.array(v)) if len(v) in tree else ():
                        if len(found) >= visits and seen > k:
                            break
                        found.append(leaf)
                        seen += sizes.get(leaf, 0)
                    leaves.append(found)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], names=["id", "v", "leaves"])

        asked = queries.select("id", "v").mapInArrow(walk, "id long, v array<double>, leaves array<long>")
        # A row per leaf that is cut; leaves are no more than the sample has rows.
        large = [(leaf, -(-n // UNIT)) for leaf, n in self.sizes.items() if n > UNIT]
        units = F.broadcast(self.spark.createDataFrame(large, "leaf long, cuts int"))
        cuts = F.coalesce("cuts", F.lit(1))
        rows = self.rows.join(units, "leaf", "left").select("leaf", F.pmod(F.xxhash64("id", "v"), cuts).cast("int").alias("unit"), F.lit(0).alias("side"), "id", "v", F.lit(0).cast("long").alias("mark"))
        visit = (
            asked.select("id", "v", F.explode("leaves").alias("leaf"))
            .join(units, "leaf", "left")
            .select("leaf", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("unit"), F.lit(1).alias("side"), "id", "v", F.xxhash64("v").alias("mark"))
        )
        work = rows.unionByName(visit).repartition(partitions(self.spark), "leaf", "unit").sortWithinPartitions("leaf", "unit", "side", "id")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def done(held: tuple[list, list]) -> pa.RecordBatch:
                if not held[0] or not held[1]:
                    return _hits([])
                (row_ids, _, rows), (query_ids, marks, asked) = (map(np.array, zip(*side)) for side in held)
                return _hits([(int(query_ids[at]), int(marks[at]), *hit) for at, *hit in best(asked, query_ids, rows, row_ids, k) if hit[0]])

            now, held = None, ([], [])
            for batch in batches:
                matrix = [np.asarray(v) for v in batch.column(4).to_numpy(zero_copy_only=False)]
                keys = zip(*[batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5)])
                for (leaf, unit, side, number, mark), v in zip(keys, matrix):
                    if (leaf, unit) != now:
                        yield done(held)
                        now, held = (leaf, unit), ([], [])
                    held[side].append((number, mark, v))
            yield done(held)

        merged = _merge(work.mapInArrow(search, HITS), k)
        return merged.select("query_id", F.posexplode("hits").alias("at", "h")).select(
            "query_id", (F.col("at") + 1).alias("rank"), F.col("h.vec_id").alias("vec_id"), (-F.col("h.less")).alias("score")
        )


def _index(table: DataFrame, asked: F.Column, id_column: str, vector_column: str, k: int, recall: float) -> tuple[Index, DataFrame]:
    valid = table.filter(F.col(id_column).isNotNull() & valid_vector(vector_column)).withColumn("asked", asked)
    rows = valid.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"), "asked")
    # Repeated rows are one row; what is combined before the shuffle is a third of all rows at most once per task.
    rows = cut(rows.groupBy("id", "v").agg(F.max("asked").alias("asked")))
    queries = rows.filter("asked").select("id", "v")
    return Index(rows.select("id", "v"), queries, k, recall), queries


def nearest(table: DataFrame, asked: F.Column, id_column="vec_id", vector_column="embedding", k: int = K, recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest rows of every row for which ``asked`` holds."""
    index, queries = _index(table, asked, id_column, vector_column, k, recall)
    return index.search(queries)


def recall_report(table: DataFrame, asked: F.Column, id_column="vec_id", vector_column="embedding", k: int = K, recall: float = RECALL) -> DataFrame:
    """One row: ``leaves``, ``leaves_visited``, ``held_out`` queries that calibration did not see and their ``recall``; null if there are none."""
    index, _ = _index(table, asked, id_column, vector_column, k, recall)
    found = (len(index.sizes), index.leaves_to_visit, index.held_out, index.held_out_recall)
    return table.sparkSession.createDataFrame([found], "leaves long, leaves_visited long, held_out long, recall double")
