"""N-gram Jaccard join by MinHash banding.

Texts are cut into words at ASCII white space; a text's n-grams are the runs of
``n`` words (a shorter text has one n-gram, all its words). Rows and bands are
chosen for a target recall at the threshold. Equal word sequences are one text
with a multiplicity. Texts are shuffled on their band hashes; the least text of
a band is its hub. A text's home is the least hub of its bands, or the least
home of a text that shares a band with it; homes are cut into blocks of about
``block`` texts, so that near copies lie together. A home of more than one
block is cut by size first: a set of n-grams cannot reach the threshold with
one that is smaller by more than that factor, so texts are put in classes whose
borders grow by 1 / threshold, and a block meets blocks of its own class and
the two beside it only. The blocks of a home meet each other in units of work;
texts that share a band with a text of another home also meet the blocks of
that home, again of near classes. A unit compares full n-gram sets
and emits, per text, its number of links, and a spanning forest of its links.

So chance candidates do not chain into ever larger clusters: a home reaches two
steps far, and components are formed of verified links alone.
A pair meets in the one unit of its two blocks, and is counted once. No output
or shuffle has a row per pair, and a band with a third of all texts is spread
over the pairs of its blocks.

Result: one row per document with ``class_id`` (the smallest document id that
links reach, itself included), ``n_links`` (other documents linked directly,
copies counted) and ``kept`` (it is the one that stays).

Defined cases: null and blank texts have no n-grams and link with nothing; rows
with equal ids count as copies of one document id and get one row each; null
ids take no part in links and stay (class null, no links); an empty table gives
no rows; texts of one id are never linked with each other; very long texts are compared whole; columns besides are not read by
``jaccard_classes`` and kept by ``representatives``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, join_counted, partitions, slices
from .links import FOUND, Forest, classes

N, THRESHOLD = 5, 0.8
RECALL, MAX_HASHES = 0.999, 192
BLOCK = 256
#: Rows of a band that are joined to its blocks in one place.
SPREAD = 4096

_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
_STEPS = np.random.RandomState(11).randint(1, 2**62, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def choose_bands(threshold: float, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance candidates, for which
    bands enough for ``recall`` at ``threshold`` need at most ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError(f"recall {recall} at {threshold} needs more than {most} hashes")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, for a whole text at once."""
    data = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    return _mix(np.add.reduceat(data.astype(np.uint64) * _POWERS[place % len(_POWERS)], starts))


def ngram_hashes(text: str | None, n: int = N) -> np.ndarray:
    """The set of a text's n-grams, as sorted 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    return grams_of(word_hashes(words), n)


def grams_of(hashes: np.ndarray, n: int) -> np.ndarray:
    size = min(n, len(hashes))
    total = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
    for k in range(size):
        total += hashes[k : k + len(total)] * _STEPS[k % 64] ** np.uint64(1 + k // 64)
    return np.unique(_mix(total + np.uint64(size)))


class MinHasher:
    def __init__(self, bands: int, rows: int):
        random = np.random.RandomState(7)
        self.bands, self.rows = bands, rows
        self.xor = random.randint(0, 2**32, bands * rows, dtype=np.uint64).astype(np.uint32)[:, None]
        self.factor = (random.randint(0, 2**31, bands * rows, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]
        self.steps = _STEPS[: rows] if rows <= 64 else np.resize(_STEPS, rows)

    def bands_of(self, grams: np.ndarray) -> np.ndarray:
        low = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
        least = np.full(self.bands * self.rows, 2**32 - 1, dtype=np.uint32)
        for at in range(0, len(low), 2048):
            part = (low[None, at : at + 2048] ^ self.xor) * self.factor
            np.minimum(least, part.min(axis=1), out=least)
        keyed = (least.reshape(self.bands, self.rows).astype(np.uint64) * self.steps).sum(axis=1, dtype=np.uint64)
        return _mix(keyed + np.arange(self.bands, dtype=np.uint64) * _STEPS[60]).view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Per document with words: id, row (hash of the text), ``text_key`` (16 bytes of its word sequence), band hashes, n-grams."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(bands, rows)
        for batch in slices(batches):
            ids, own, keys, hashes, sizes = [], [], [], [], []
            for doc, text, row in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                words = text.encode("utf-8", "surrogatepass").split()
                if words:
                    ids.append(doc)
                    own.append(row)
                    keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                    grams = grams_of(word_hashes(words), n)
                    hashes.append(hasher.bands_of(grams))
                    sizes.append(len(grams))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(own, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(
                        np.arange(len(ids) + 1, dtype=np.int32) * bands,
                        np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.int64),
                    ),
                    pa.array(sizes, pa.int64()),
                ],
                names=["id", "row", "text_key", "bands", "grams"],
            )

    return docs.filter("id is not null and text is not null").mapInArrow(
        work, "id long, row long, text_key binary, bands array<long>, grams long"
    )


def _compare(units: Iterator[tuple], n: int, threshold: float, out: dict) -> None:
    """Verify one pair of blocks: rows (side, id, copies, grams, row)."""
    sides = ([], [])
    for side, *row in units:
        sides[side].append(row)
    same = not sides[1]
    left, right = sides[0], sides[0] if same else sides[1]
    rows = left if same else left + right
    values, at = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
    sizes = np.array([len(r[2]) for r in rows], dtype=np.float64)
    owner = np.repeat(np.arange(len(rows)), sizes.astype(np.int64))
    # Only n-grams that two of these texts share can link them.
    shared = np.bincount(at) > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    owner, column = owner[keep], column[at[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    a, b = len(left), len(right)
    common = np.zeros((a, b), dtype=np.float32)
    step = 4096
    for low in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, [low, low + step])
        block = np.zeros((len(rows), step), dtype=np.float32)
        block[owner[lo:hi], column[lo:hi] - low] = 1
        common += block[:a] @ (block if same else block[a:]).T
    size_a, size_b = sizes[:a], sizes if same else sizes[a:]
    union = size_a[:, None] + size_b[None, :] - common
    linked = common >= threshold * union - 1e-9
    reps = np.array([r[0] for r in rows])
    linked &= reps[:a, None] != reps[None, (0 if same else a) :]
    copies_a = np.array([r[1] for r in left], dtype=np.int64)
    copies_b = np.array([r[1] for r in right], dtype=np.int64)
    for row, links in zip(left, linked @ copies_b):
        if links:
            out["id"].append(row[0]), out["row"].append(row[3]), out["links"].append(int(links)), out["to"].append(None)
    if not same:
        for row, links in zip(right, copies_a @ linked):
            if links:
                out["id"].append(row[0]), out["row"].append(row[3]), out["links"].append(int(links)), out["to"].append(None)
    # A spanning forest says as much about components as all links do.
    forest = Forest(len(rows))
    for i in range(a):
        for j in forest.link(i, np.flatnonzero(linked[i]) + (0 if same else a)):
            out["id"].append(rows[i][0]), out["row"].append(rows[i][3]), out["links"].append(0), out["to"].append(rows[j][0])


def _verified(units: DataFrame, n: int, threshold: float) -> DataFrame:
    """``units``: sorted by (p, q, side); gives (id, row, links, to)."""
    schema = pa.schema([(name, pa.int64()) for name in ("id", "row", "links", "to")])
    nothing = lambda: {name: [] for name in schema.names}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], nothing()
        for batch in slices(batches):
            for home_p, p, home_q, q, side, doc, row, copies, text in zip(*[c.to_pylist() for c in batch.columns]):
                if (home_p, p, home_q, q) != now:
                    if len(held) > 1:
                        _compare(held, n, threshold, out)
                    now, held = (home_p, p, home_q, q), []
                grams = ngram_hashes(text, n)
                if held and held[-1][:2] == (side, doc) and np.array_equal(held[-1][3], grams):
                    continue  # a repeated row, already among the copies
                held.append((side, doc, copies, grams, row))
            if len(out["id"]) > 5000:
                yield pa.RecordBatch.from_pydict(out, schema)
                out = nothing()
        if len(held) > 1:
            _compare(held, n, threshold, out)
        yield pa.RecordBatch.from_pydict(out, schema)

    return units.mapInArrow(work, FOUND)


UNIT = ("home_p", "part_p", "home_q", "part_q", "side", "rep", "row", "copies", "text")
#: A block's number: its class of sizes above, its part of that class below.
CLASS = 1 << 32


def size_class(grams: Column, threshold: float) -> Column:
    """Two sets that reach the threshold are of one class or of neighbouring ones."""
    return F.floor(F.log(F.greatest(grams, F.lit(1)).cast("double")) / math.log(1 / threshold)).cast("long")


def candidate_units(texts: DataFrame, block: int, threshold: float = THRESHOLD) -> DataFrame:
    """Which texts meet in which unit: ``p, q`` (blocks, p <= q), ``side, rep, row, copies``.

    ``texts``: rep, row, copies, bands, grams. A block is a struct of home and
    part, a part a class of sizes and a number within it (see ``CLASS``).
    """
    texts = cut(texts)
    banded = texts.select("rep", "row", "copies", "grams", F.explode("bands").alias("band"))
    hubs = cut(
        banded.groupBy("band")
        .agg(F.min("rep").alias("hub"), F.max("rep").alias("top"), F.count("*").alias("n"))
        .filter("hub < top")
        .select("band", "hub", "n")
    )
    shared = cut(join_counted(banded, hubs, "band", "n"))
    homes = cut(shared.groupBy("rep", "row").agg(F.min("hub").alias("home")))
    # Once more, so that near copies without the hub's bands come to its home too.
    least = cut(shared.join(homes, ["rep", "row"]).groupBy("band").agg(F.min("home").alias("home"), F.count("*").alias("m")))
    homes = cut(join_counted(shared, least, "band", "m").groupBy("rep", "row", "copies", "grams").agg(F.min("home").alias("home")))
    # Small homes are one block; in large ones only texts of near sizes meet.
    totals = cut(homes.groupBy("home").agg(F.count("*").alias("total")))
    sized = F.when(F.col("total") > block, size_class(F.col("grams"), threshold)).otherwise(F.lit(0).cast("long"))
    classed = cut(join_counted(homes, totals, "home", "total").select("rep", "row", "copies", "home", "total", sized.alias("class")))
    slot = F.struct("home", "class").alias("slot")
    by_class = Window.partitionBy("home").orderBy("class")
    parts = classed.groupBy("home", "class").agg(F.count("*").alias("size"), F.ceil(F.count("*") / block).cast("int").alias("parts"))

    def beside(step: int) -> Column:
        """The parts of the class before or after, if the home has it; its classes are few."""
        number, there = F.lag("parts", -step).over(by_class), F.lag("class", -step).over(by_class)
        return F.when(there == F.col("class") + step, number).otherwise(0)

    around = F.array(*[F.struct((F.col("class") + k).alias("class"), c.alias("parts")) for k, c in ((-1, beside(-1)), (0, F.col("parts")), (1, beside(1)))])
    slots = cut(parts.select(slot, "size", "parts", around.alias("around")))
    own = (F.col("class") * CLASS + F.pmod(F.xxhash64("rep", "row"), F.col("parts"))).alias("part")
    keyed = classed.select("*", slot)
    placed = cut(join_counted(keyed, slots, "slot", "size").select("rep", "row", "copies", "home", "total", "class", "parts", "around", own))

    def meet(texts: DataFrame, home: str, others: Column) -> DataFrame:
        """Every text with all parts of ``others`` (class, parts) of ``home``."""
        numbers = F.flatten(F.transform(others, lambda c: F.when(c["parts"] > 0, F.transform(F.sequence(F.lit(0), c["parts"] - 1), lambda k: c["class"] * CLASS + k)).otherwise(F.array().cast("array<long>"))))
        each = texts.withColumn("_part", F.explode(numbers))
        own, other = F.struct("home", "part"), F.struct(F.col(home).alias("home"), F.col("_part").alias("part"))
        side = (own > other).cast("int").alias("side")
        return each.select(F.least(own, other).alias("p"), F.greatest(own, other).alias("q"), side, "rep", "row", "copies")

    # Few bands have texts of several homes: those texts meet the other homes.
    salts = F.ceil(F.col("n") / SPREAD).cast("int")
    owned = shared.select("rep", "row", "band", "grams", salts.alias("salts")).join(placed.drop("around", "total"), ["rep", "row"])
    at = cut(owned.groupBy("band", F.col("home").alias("other"), F.col("class").alias("other_class"), F.col("parts").alias("others"), "salts").agg(F.max("grams").alias("most"), F.min("grams").alias("fewest")))
    several = at.groupBy("band").agg(F.min("other").alias("a"), F.max("other").alias("b")).filter("a < b").select("band")
    others = at.join(several, "band").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    strangers = owned.withColumn("salt", F.pmod(F.xxhash64("rep", "row"), F.col("salts")).cast("int")).join(others, ["band", "salt"])
    # A class of another home that has only texts of far sizes in the band has none to link with.
    near = (F.col("grams") >= F.col("fewest") * (threshold - 1e-9)) & (F.col("most") >= F.col("grams") * (threshold - 1e-9))
    across = strangers.filter((F.col("home") != F.col("other")) & near).select("rep", "row", "copies", "home", "part", "other", "other_class", "others").distinct()
    back = F.array(F.struct(F.col("other_class").alias("class"), F.col("others").alias("parts")))
    return meet(placed.filter("total > 1"), "home", F.col("around")).unionByName(meet(across, "other", back))


def jaccard_classes(
    docs: DataFrame, id_column="doc_id", text_column="text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """Return ``doc_id, class_id, n_links, kept`` for every row of ``docs``."""
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    docs = docs.withColumn("row", F.xxhash64("text"))
    bands, rows = choose_bands(threshold, recall)
    signed = cut(signatures(docs, n, bands, rows))
    # Equal word sequences: the least id stands for all.
    texts = cut(
        signed.groupBy("text_key")
        .agg(F.min(F.struct("id", "row")).alias("least"), F.count("*").alias("copies"))
        .select("text_key", F.col("least.id").alias("rep"), F.col("least.row").alias("rep_row"), "copies")
    )
    joined = join_counted(signed, texts, "text_key", "copies")
    members = cut(joined.select("id", "rep", F.col("rep_row").alias("row"), "copies"))
    units = candidate_units(
        joined.filter("id = rep and row = rep_row").select("rep", "row", "copies", F.array_distinct("bands").alias("bands"), "grams"), block, threshold
    )
    full = units.join(docs.filter("text is not null").withColumnRenamed("id", "rep"), ["rep", "row"])
    placed = full.select("p.home", "p.part", "q.home", "q.part", "side", "rep", "row", "copies", "text").toDF(*UNIT)
    found = cut(_verified(placed.repartition(partitions(docs.sparkSession), *UNIT[:4]).sortWithinPartitions(*UNIT[:6]), n, threshold))
    ids = docs.select("id")
    per_id = classes(found, members).withColumnRenamed("component", "class_id")
    return ids.join(per_id, "id", "left").select(
        F.col("id").alias("doc_id"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce(F.col("id") == F.coalesce("class_id", "id"), F.lit(True)).alias("kept"),
    )


def representatives(docs: DataFrame, id_column="doc_id", text_column="text", **options) -> DataFrame:
    """``docs`` without those that a smaller id of their class stands for."""
    (gone,) = free_name(docs, "_gone")
    found = jaccard_classes(docs, id_column, text_column, **options)
    dropped = found.filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col(id_column) == F.col(gone), "left_anti")
