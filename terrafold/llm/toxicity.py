"""Severity of toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector shared by all
ordered thresholds. Features are sparse: lower-case words, and word beginnings
of 4 and 5 letters (they catch inflected forms not seen in training), valued
log(1 + distinct words that match). The labels only say toxic or not; grade 0
is not toxic, and toxic texts get grade 1, 2 or 3 by terciles of the number of
distinct candidate features in them. L1 keeps the weights few. A text is
rejected if P(grade >= 1) reaches ``REJECT``.

The model is fitted on a bounded sample: at most ``TRAIN_ROWS`` labelled rows,
those with the least hash of their id, and at most ``CANDIDATES`` features,
the most significant ones. Everything else covers all rows.

Defined cases: a null or empty text has no features; a null label is no label;
documents labelled twice are used twice; without labels of both kinds every
text has severity 0 and none is rejected; null and repeated ids are scored row
by row; other columns are kept by ``acceptable``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Container, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

TRAIN_ROWS = 20_000
CANDIDATES = 2_000
MIN_TEXTS, MIN_Z = 5, 4.0
PREFIXES = (4, 5)
L1, ROUNDS = 5e-5, 400
REJECT = 0.5
WORD = re.compile(r"\w+")
#: Words that a ``Matcher`` remembers.
ENTRIES = 100_000


def features(text: str | None) -> Counter:
    """Feature -> distinct words that have it; beginnings are marked ``x*``."""
    words = set(WORD.findall((text or "").lower()))
    found = Counter(words)
    for size in PREFIXES:
        found.update(w[:size] + "*" for w in words if len(w) >= size)
    return found


class Matcher:
    """Counts those of ``names`` that a text has, as ``features`` counts all.

    What a word has is looked up once per task; at most ``ENTRIES`` words are
    remembered, so memory is bounded.
    """

    def __init__(self, names: Container[str]):
        self.names, self.known, self.blank = names, {}, set()

    def __call__(self, text: str | None) -> dict[str, int]:
        found: dict[str, int] = {}
        for word in set(WORD.findall((text or "").lower())) - self.blank:
            own = self.known.get(word)
            if own is None:
                own = [f for f in (word, *(word[:size] + "*" for size in PREFIXES if len(word) >= size)) if f in self.names]
                if len(self.known) + len(self.blank) < ENTRIES:
                    if own:
                        self.known[word] = own
                    else:
                        self.blank.add(word)
            for feature in own:
                found[feature] = found.get(feature, 0) + 1
        return found


@dataclass
class Ordinal:
    """Weights by feature and ascending thresholds; ``trained`` is False for none."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()

    @property
    def trained(self) -> bool:
        return bool(self.thresholds)

    def probabilities(self, text: str | None) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ..."""
        return self.at(features(text))

    def at(self, found: Mapping[str, int]) -> list[float]:
        """The same for counted features; those without a weight do nothing."""
        eta = math.fsum(self.weights[f] * math.log1p(n) for f, n in found.items() if f in self.weights)
        return [1.0 / (1.0 + math.exp(min(700.0, t - eta))) for t in self.thresholds]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fit_ordinal(
    rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grades: np.ndarray, width: int, l1: float = L1, rounds: int = ROUNDS
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for sparse x (coordinates) and grades 0..K.

    Proximal gradient steps with momentum; thresholds stay ascending because
    their gaps are kept as exponentials.
    """
    top, n = int(grades.max()), len(grades)
    share = np.array([(grades <= k).mean() for k in range(top)]).clip(1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(top))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    state = np.concatenate([np.zeros(width), start[:1], gaps])

    def thresholds(z: np.ndarray) -> np.ndarray:
        return z[width] + np.concatenate([[0.0], np.cumsum(np.exp(z[width + 1 :]))])

    def loss(z: np.ndarray) -> tuple[float, np.ndarray]:
        theta = np.concatenate([[-np.inf], thresholds(z), [np.inf]])
        eta = np.bincount(rows, vals * z[cols], minlength=n)
        high, low = _sigmoid(theta[grades + 1] - eta), _sigmoid(theta[grades] - eta)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        g_eta = (d_high - d_low) / n
        g_theta = np.zeros(top + 2)
        np.add.at(g_theta, grades + 1, -d_high / n)
        np.add.at(g_theta, grades, d_low / n)
        inner = g_theta[1:-1]
        after = np.cumsum(inner[::-1])[::-1]
        return -np.log(p).mean(), np.concatenate(
            [np.bincount(cols, vals * g_eta[rows], minlength=width), [after[0]], after[1:] * np.exp(z[width + 1 :])]
        )

    step, momentum, ahead = 1.0, 1.0, state.copy()
    for _ in range(rounds):
        value, gradient = loss(ahead)
        while True:
            new = ahead - step * gradient
            new[:width] = np.sign(new[:width]) * np.maximum(np.abs(new[:width]) - step * l1, 0.0)
            moved = new - ahead
            if loss(new)[0] <= value + gradient @ moved + moved @ moved / (2 * step) + 1e-12:
                break
            step /= 2
        grown = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / grown * (new - state)
        state, momentum, step = new, grown, step * 1.1
    return state[:width], thresholds(state)


def _sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, rows: int) -> DataFrame:
    chosen = (
        labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
        .select(F.col(id_column).cast("long").alias("id"), (F.col(label_column) > 0).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(rows)
    )
    # At most ``rows`` rows of two numbers, so it may be sent everywhere.
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("label", "text")


def train(
    docs: DataFrame, labels: DataFrame, id_column="doc_id", text_column="text", label_column="toxic", rows: int = TRAIN_ROWS, candidates: int = CANDIDATES
) -> Ordinal:
    """Fit the model on at most ``rows`` labelled documents."""
    sample = _sample(docs, labels, id_column, text_column, label_column, rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(1).to_pylist():
                seen.update(features(text).keys())
                seen[""] += 1
        yield pa.RecordBatch.from_pydict(
            {"feature": pa.array(list(seen), pa.string()), "toxic": pa.array(list(seen.values()), pa.int64())}
        )

    schema = "feature string, toxic long"
    toxic = sample.filter("label = 1").mapInArrow(count, schema).groupBy("feature").agg(F.sum("toxic").alias("toxic"))
    toxic_rows = toxic.filter(F.col("toxic") >= MIN_TEXTS)
    ranked = toxic_rows.orderBy(F.col("toxic").desc(), "feature").limit(20 * candidates).collect()  # bounded: candidates
    seen_toxic = {r["feature"]: r["toxic"] for r in ranked}
    n_toxic = seen_toxic.pop("", 0)
    names = frozenset(seen_toxic)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, matcher = Counter(), Matcher(names)
        for batch in slices(batches):
            for text in batch.column(1).to_pylist():
                seen.update(matcher(text).keys())
                seen[""] += 1
        yield pa.RecordBatch.from_pydict(
            {"feature": pa.array(list(seen), pa.string()), "toxic": pa.array(list(seen.values()), pa.int64())}
        )

    clean_rows = sample.filter("label = 0").mapInArrow(clean, schema).groupBy("feature").agg(F.sum("toxic").alias("n"))
    seen_clean = {r["feature"]: r["n"] for r in clean_rows.collect()}  # bounded as above
    n_clean = seen_clean.pop("", 0)
    if not n_toxic or not n_clean:
        return Ordinal()

    def z(feature: str) -> float:
        a, b = seen_toxic[feature] / n_toxic, seen_clean.get(feature, 0) / n_clean
        pooled = (seen_toxic[feature] + seen_clean.get(feature, 0) + 1) / (n_toxic + n_clean + 1)
        return (a - b) / math.sqrt(pooled * (1 - min(pooled, 0.999)) * (1 / n_toxic + 1 / n_clean))

    scored = sorted(((-z(f), f) for f in seen_toxic))[:candidates]
    chosen = [f for s, f in scored if -s >= MIN_Z]
    if not chosen:
        return Ordinal()
    number = {f: k for k, f in enumerate(chosen)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(number)
        for batch in slices(batches):
            labels, cols, vals = [], [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sorted((number[f], n) for f, n in matcher(text).items())
                labels.append(label)
                cols.append([f for f, _ in own])
                vals.append([math.log1p(n) for _, n in own])
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.int32()), pa.array(cols, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float64()))],
                names=["label", "cols", "vals"],
            )

    data = sample.mapInArrow(vectors, "label int, cols array<int>, vals array<double>").collect()  # at most ``rows``
    data.sort(key=lambda r: (r["label"], r["cols"], r["vals"]))  # partitions come in any order
    label = np.array([r["label"] for r in data])
    hits = np.array([len(r["cols"]) for r in data])
    cuts = np.quantile(hits[label == 1], [1 / 3, 2 / 3])
    grades = np.where(label == 1, 1 + (hits > cuts[0]).astype(int) + (hits > cuts[1]).astype(int), 0)
    _, grades = np.unique(grades, return_inverse=True)
    weights, thresholds = fit_ordinal(
        np.repeat(np.arange(len(data)), hits),
        np.array([c for r in data for c in r["cols"]], dtype=np.int64),
        np.array([v for r in data for v in r["vals"]], dtype=np.float64),
        grades,
        len(chosen),
    )
    kept = {f: float(w) for f, w in zip(chosen, weights) if w}
    return Ordinal(kept, tuple(map(float, thresholds)))


def score(docs: DataFrame, model: Ordinal, text_column="text", reject: float = REJECT) -> DataFrame:
    """``docs`` with ``p_toxic``, ``expected_severity``, ``grade``, ``rejected``.

    ``expected_severity`` is the sum of P(grade >= k); ``grade`` the largest k
    with P(grade >= k) >= 1/2. Columns of these names in ``docs`` are replaced.
    """
    added = ["p_toxic", "expected_severity", "grade", "rejected"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    names = docs.columns
    at_text = names.index(text_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.weights)
        for batch in slices(batches):
            found = [model.at(matcher(t)) for t in batch.column(at_text).to_pylist()]
            p = [x[0] if x else 0.0 for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(p, pa.float64()),
                    pa.array([float(sum(x)) for x in found], pa.float64()),
                    pa.array([sum(y >= 0.5 for y in x) for x in found], pa.int32()),
                    pa.array([y >= reject for y in p], pa.bool_()),
                ],
                names=[*names, *added],
            )

    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("p_toxic", T.DoubleType()),
            T.StructField("expected_severity", T.DoubleType()),
            T.StructField("grade", T.IntegerType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    return docs.mapInArrow(work, schema)


def acceptable(docs: DataFrame, labels: DataFrame, text_column="text", **options) -> DataFrame:
    """``docs`` without the rejected ones, columns unchanged."""
    model = train(docs, labels, text_column=text_column, **options)
    at_text = docs.columns.index(text_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.weights)
        for batch in slices(batches):
            keep = [not p or p[0] < REJECT for p in (model.at(matcher(t)) for t in batch.column(at_text).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
