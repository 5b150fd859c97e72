"""Chat formatting: roles of a transcript by a hidden Markov model.

A transcript is the rows of a conversation in order of ``turn``; a row's text
may hold several lines, and several speakers' turns with or without markers
("User:", "### Assistant", "[system]", "<|user|>"). Hidden states are role and
place (first line of a turn, or inside one); each line emits a speaker marker,
whether it starts the row, the magnitude of the row's length, a question mark
at its end, and whether it opens the conversation. Viterbi finds the likeliest
states; a turn starts with each first-line state, and a row always starts one.
Turns are then rendered canonically, without their markers:

    <|role|>
    text
    <|end|>

The model is fitted by counting on a bounded sample of labelled rows
(``TRAIN_ROWS``, of conversations with the least id hash).

Rows are range-partitioned by (conversation, turn), so one conversation with a
third of all rows is spread over tasks. Decoding stays exact: per partition only
its first and last conversation can go on elsewhere, so two small max-plus
matrices per partition are enough to settle the states at the borders.

Defined cases: a null text is one empty line; null conversations are one
conversation, null turns come first; equal turns are ordered by a hash of the text; an
unknown role label is not learnt from; without labels the model has even
counts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, slices

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # 2 * role: first line of a turn; 2 * role + 1: inside
TRAIN_ROWS = 20_000
#: Least probability that the first line of a turn stands inside a row.
INNER_TURN = 0.02
#: Fixed: words that mark a speaker, by role.
NAMES = {
    "system": ("system", "sys", "instruction", "instructions"),
    "user": ("user", "human", "question", "q", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "gpt", "model"),
}
_MARKER = re.compile(
    r"\s*(?:(?:<\|(?:im_start\|>)?|\[|\*\*|#{1,6} ?)\s*(?P<a>[A-Za-z]+)\s*(?:\|>|\]|\*\*|:)?|(?P<b>[A-Za-z]+)(?=\s*:))\s*:?\s*"
)
_ROLE_OF = {name: k for k, role in enumerate(ROLES) for name in NAMES[role]}
#: Number of values of each feature of a line.
SIZES = (4, 2, 16, 2, 2)


def marker(line: str) -> tuple[int, int]:
    """(role of the speaker marker or -1, characters it takes)."""
    found = _MARKER.match(line)
    role = _ROLE_OF.get((found["a"] or found["b"]).lower(), -1) if found else -1
    return (role, found.end()) if role >= 0 else (-1, 0)


def observe(texts: list[str | None], opens: bool) -> np.ndarray:
    """Features of all lines of some rows in order, one line each."""
    seen = []
    for text in texts:
        text = text or ""
        size = min(14, len(text).bit_length())
        for k, line in enumerate(text.split("\n")):
            seen.append((marker(line)[0] + 1, int(k == 0), 15 if k else size, int(line.rstrip().endswith("?")), int(opens)))
            opens = False
    return np.array(seen, dtype=np.int64).reshape(-1, len(SIZES))


@dataclass
class Model:
    """Logs of start, transition and emission probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """Log emission of each line (rows) from each state."""
        out = np.zeros((len(seen), STATES))
        for k, table in enumerate(self.emit):
            out += table[:, seen[:, k]].T
        # A row's first line starts a turn.
        out[np.ix_(seen[:, 1] == 1, np.arange(1, STATES, 2))] = -np.inf
        return out


def estimate(sequences: list[tuple[np.ndarray, list[int]]]) -> Model:
    """Count start, moves and emissions of labelled sequences (one each added)."""
    start, move = np.ones(STATES), np.ones((STATES, STATES))
    emit = [np.ones((STATES, n)) for n in SIZES]
    emit[0][1::2, 1:] = 0.01  # a marker seldom stands inside a turn
    for role in range(len(ROLES)):  # markers mean what they say, whatever the sample
        emit[0][2 * role, role + 1] += 20
        for other in range(STATES):
            if other // 2 != role:
                move[2 * role + 1, other] -= 0.999 * (other % 2)
        move[2 * role] -= 0.999 * np.array([s % 2 and s // 2 != role for s in range(STATES)])
    for seen, states in sequences:
        start[states[0]] += 1
        for a, b in zip(states, states[1:]):
            move[a, b] += 1
        for k in range(len(SIZES)):
            np.add.at(emit[k], (states, seen[:, k]), 1)
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    model = Model(log(start), log(move), [log(e) for e in emit])
    # Samples have one turn a row. A turn may yet begin inside a row, mostly at
    # a marker; the row's length says something at the row's first line only.
    begins = np.arange(0, STATES, 2)
    model.emit[1][begins, 0] = np.maximum(model.emit[1][begins, 0], np.log(INNER_TURN))
    model.emit[2][:, 15] = 0.0
    return model


def fit(table: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` rows (conv_id, turn, role, text) with known roles."""
    sample = (
        table.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.lower("role").alias("role"), F.col("text").cast("string"))
        .filter(F.col("conv_id").isNotNull())
        .orderBy(F.xxhash64("conv_id"), "conv_id", "turn", "text")
        .limit(rows)
        .collect()  # at most ``rows``
    )
    sequences, known = [], {role: k for k, role in enumerate(ROLES)}
    now, texts, states = object(), [], []
    for r in [*sample, None]:
        if r is None or r["conv_id"] != now:
            if texts and None not in states:
                sequences.append((observe(texts, True), states))
            texts, states = [], []
        if r is not None:
            now, role = r["conv_id"], known.get(r["role"])
            texts.append(r["text"])
            lines = (r["text"] or "").count("\n")
            states.extend([None] * (lines + 1) if role is None else [2 * role] + [2 * role + 1] * lines)
    return estimate(sequences)


def viterbi(model: Model, seen: np.ndarray, before: int | None = None, last: int | None = None) -> list[int]:
    """The likeliest states; ``before``: the state of the line before the first
    (None: the transcript starts here); ``last``: the state the last line has."""
    emit = model.scores(seen)
    score = (model.start if before is None else model.move[before]) + emit[0]
    back = np.zeros((len(seen), STATES), dtype=np.int64)
    for t in range(1, len(seen)):
        step = score[:, None] + model.move
        back[t] = step.argmax(axis=0)
        score = step[back[t], np.arange(STATES)] + emit[t]
    state = int(score.argmax()) if last is None else last
    path = [state]
    for t in range(len(seen) - 1, 0, -1):
        state = int(back[t, state])
        path.append(state)
    return path[::-1]


def span(model: Model, seen: np.ndarray, starts: bool) -> np.ndarray:
    """Best log score from the state before (row; the same for all if the
    transcript starts here) to the state of the last line (column)."""
    emit = model.scores(seen)
    best = (np.tile(model.start, (STATES, 1)) if starts else model.move) + emit[0]
    for t in range(1, len(seen)):
        best = (best[:, :, None] + model.move[None]).max(axis=1) + emit[t]
    return best


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list, list]]:
    """(conv_id, turns, texts) of each conversation in a sorted partition."""
    now, turns, texts, any_row = None, [], [], False
    for batch in slices(batches):
        for conv, turn, text in zip(*[c.to_pylist() for c in batch.columns[:3]]):
            if any_row and conv != now:
                yield now, turns, texts
                turns, texts = [], []
            now, any_row = conv, True
            turns.append(turn), texts.append(text)
    if any_row:
        yield now, turns, texts


def _borders(model: Model, ends: list) -> dict[int, dict[str, tuple]]:
    """Per partition: states before and at its first and last conversations.

    ``ends``: rows (part, conv_id, where, matrix), at most two per partition.
    """
    chains, chain, now = [], [], None
    for part, conv, where, matrix in sorted(ends, key=lambda r: (r[0], r[2] != "first")):
        goes_on = chain and conv == now and where != "last"
        if not goes_on and chain:
            chains.append(chain)
            chain = []
        chain.append((part, where, matrix))
        now = conv
    if chain:
        chains.append(chain)
    found: dict[int, dict[str, tuple]] = {}
    for chain in chains:
        if len(chain) == 1:
            continue
        score, back = np.array(chain[0][2]).reshape(STATES, STATES)[0], []
        for _, _, matrix in chain[1:]:
            step = score[:, None] + np.array(matrix).reshape(STATES, STATES)
            back.append(step.argmax(axis=0))
            score = step.max(axis=0)
        states = [int(score.argmax())]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        states.reverse()
        for k, (part, where, _) in enumerate(chain):
            found.setdefault(part, {})[where] = (states[k - 1] if k else None, states[k])
    return found


def render_turn(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>"


def render(table: DataFrame, model: Model) -> DataFrame:
    """Per recovered turn: ``conv_id, turn, part, role, text, rendered``.

    ``part`` numbers the turns within an input row, from 0.
    """
    spark = table.sparkSession
    rows = table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("text").cast("string").alias("text"))
    ordered = cut(rows.repartitionByRange(partitions(spark), "conv_id", "turn", F.xxhash64("text")).sortWithinPartitions("conv_id", "turn", F.xxhash64("text"), "text"))
    # The least and the last row of each partition tell which conversations go on.
    firsts = (
        ordered.groupBy(F.spark_partition_id().alias("part"))
        .agg(
            F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")).alias("a"),
            F.max(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")).alias("b"),
        )
        .orderBy("part")
        .collect()  # a row per partition
    )
    starts, last, seen_any = {}, None, False
    for r in firsts:
        starts[r["part"]] = not (seen_any and r["a"]["conv_id"] == last)
        last, seen_any = r["b"]["conv_id"], True

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found, held = TaskContext.get().partitionId(), [], None
        for conv, _, texts in _conversations(batches):
            if held is None:
                opens = starts[part]
                found.append((part, conv, "first", span(model, observe(texts, opens), opens).ravel().tolist()))
            held = (conv, texts, len(found))
            found = found[:1] if len(found) > 1 else found
            found.append((part, conv, "last", texts))
        if len(found) > 1:
            if found[1][1] == found[0][1]:
                found = found[:1]
            else:
                texts = found[1][3]
                found[1] = (part, found[1][1], "last", span(model, observe(texts, True), True).ravel().tolist())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f[0] for f in found], pa.int32()),
                pa.array([f[1] for f in found], pa.int64()),
                pa.array([f[2] for f in found], pa.string()),
                pa.array([f[3] for f in found], pa.list_(pa.float64())),
            ],
            names=["part", "conv_id", "where", "matrix"],
        )

    matrices = ordered.mapInArrow(ends, "part int, conv_id long, where string, matrix array<double>").collect()  # two per partition
    borders = spark.sparkContext.broadcast(_borders(model, [tuple(r) for r in matrices]))
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("rendered", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, first, out = TaskContext.get().partitionId(), True, []
        own = borders.value.get(number, {})
        pending = None

        def emit(conv, turns, texts, where) -> None:
            opens = starts[number] if where == "first" else True
            before, last = own.get(where, (None, None)) if where else (None, None)
            path = iter(viterbi(model, observe(texts, opens), before, last))
            for turn, text in zip(turns, texts):
                parts: list[tuple[str, list[str]]] = []
                for line in (text or "").split("\n"):
                    state = next(path)
                    if state % 2 == 0 or not parts:
                        parts.append((ROLES[state // 2], [line[marker(line)[1] :]]))
                    else:
                        parts[-1][1].append(line)
                for k, (role, lines) in enumerate(parts):
                    body = "\n".join(lines).strip()
                    out.append((conv, turn, k, role, body, render_turn(role, body)))

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out.clear()
            return made

        for conversation in _conversations(batches):
            if pending is not None:
                emit(*pending, "first" if first else None)
                first = False
                if len(out) > 2000:
                    yield batch()
            pending = conversation
        if pending is not None:
            emit(*pending, "first" if first else "last")
        if out:
            yield batch()

    return ordered.mapInArrow(decode, "conv_id long, turn long, part int, role string, text string, rendered string")
