"""The two models against plain enumeration and a search of their own."""

import itertools
import math
import re

import numpy as np
import pytest

pytest.importorskip("terrafold.llm")

from terrafold.llm import chat, toxicity  # noqa: E402

TALKS = [
    [None, "a\nb"],
    ["User: hello?\nAssistant: hi", "x"],
    ["", "what is this?\nit is that", "ok"],
    ["### System\nbe kind", "a question?", "[assistant] an answer"],
]


def random_model(seed):
    rng = np.random.default_rng(seed)
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    move = log(rng.random((chat.STATES, chat.STATES)) + 0.01)
    return chat.Model(log(rng.random(chat.STATES) + 0.01), move, [log(rng.random((chat.STATES, n)) + 0.01) for n in chat.SIZES])


def path_score(model, seen, path, before=None):
    """The log probability of one path, summed line by line."""
    total, last = 0.0, before
    for line, state in zip(seen.tolist(), path):
        if line[1] and state % 2:  # a row starts a turn
            return -math.inf
        total += model.start[state] if last is None else model.move[last, state]
        total += sum(model.emit[k][state, value] for k, value in enumerate(line))
        last = state
    return total


def all_paths(seen):
    return itertools.product(range(chat.STATES), repeat=len(seen))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("texts", TALKS)
def test_viterbi_is_the_best_of_all_paths(seed, texts):
    model, seen = random_model(seed), chat.observe(texts, True)
    best = max(all_paths(seen), key=lambda p: path_score(model, seen, p))
    assert tuple(chat.viterbi(model, seen)) == best
    before, last = 3, 2 * seed if seen[-1][1] else 2 * seed + 1
    ending = (p for p in all_paths(seen) if p[-1] == last)
    best = max(ending, key=lambda p: path_score(model, seen, p, before))
    assert tuple(chat.viterbi(model, seen, before, last)) == best


def test_span_is_the_best_score_between_two_states():
    model, seen = random_model(7), chat.observe(["a?\nb", "c"], False)
    found = chat.span(model, seen, False)
    wanted = np.full((chat.STATES, chat.STATES), -np.inf)
    for before in range(chat.STATES):
        for p in all_paths(seen):
            wanted[before, p[-1]] = max(wanted[before, p[-1]], path_score(model, seen, p, before))
    np.testing.assert_allclose(found, wanted, rtol=0, atol=1e-9)


def test_rendered_turns_are_those_of_the_best_path(spark):
    model = random_model(11)
    rows = [(conv, turn, text) for conv, texts in enumerate(TALKS) for turn, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(3)
    found = {(r["conv_id"], r["turn"], r["part"]): r["role"] for r in chat.render(table, model).collect()}
    wanted = {}
    for conv, texts in enumerate(TALKS):
        seen = chat.observe(texts, True)
        path = iter(max(all_paths(seen), key=lambda p: path_score(model, seen, p)))
        for turn, text in enumerate(texts):
            starts = [s for s in (next(path) for _ in (text or "").split("\n")) if s % 2 == 0]
            wanted |= {(conv, turn, part): chat.ROLES[s // 2] for part, s in enumerate(starts)}
    assert found == wanted


def penalised(x, grades, w, cuts, l1):
    """Mean negative log likelihood of an ordinal model, and the penalty, row by row."""
    if any(a >= b for a, b in zip(cuts, cuts[1:])):
        return math.inf
    total = 0.0
    for row, grade in zip(x, grades):
        upto = [0.0, *[1 / (1 + math.exp(float(row @ w) - c)) for c in cuts], 1.0]
        total -= math.log(max(upto[grade + 1] - upto[grade], 1e-300))
    return total / len(x) + l1 * float(np.abs(w).sum())


def line_search(f, low, high):
    """The least of a convex function of one number, by thirds."""
    while high - low > 1e-7:
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if f(a) <= f(b) else (a, high)
    return (low + high) / 2


def test_fit_equals_a_search_along_coordinates():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (60, 3)) * np.log(2.0)
    noise = rng.logistic(size=60)
    grades = np.digitize(x @ np.array([2.0, -1.0, 0.0]) + noise, [0.3, 1.5])
    rows, cols = np.nonzero(x)
    l1 = 0.01
    w, cuts = toxicity.fit_ordinal(rows, cols, x[rows, cols], grades, 3, l1=l1, rounds=3000)
    z = np.array([0.0, 0.0, 0.0, -0.5, 0.5])
    for _ in range(60):
        for k in range(5):
            at = lambda v: penalised(x, grades, np.r_[z[:k], v, z[k + 1 :]][:3], np.r_[z[:k], v, z[k + 1 :]][3:], l1)  # noqa: E731, B023
            low = z[3] + 1e-9 if k == 4 else -8.0
            high = z[4] - 1e-9 if k == 3 else 8.0
            z[k] = line_search(at, low, high)
    np.testing.assert_allclose(np.r_[w, cuts], z, atol=2e-3)
    # As many rounds as in use come to the same value.
    fewer = toxicity.fit_ordinal(rows, cols, x[rows, cols], grades, 3, l1=l1)
    assert penalised(x, grades, *fewer, l1) <= penalised(x, grades, z[:3], z[3:], l1) + 1e-6


def test_scores_are_sums_over_grades(spark):
    model = toxicity.Ordinal({"vile": 2.0, "vile*": 0.5, "nice": -1.5}, (0.5, 1.5, 3.0))
    texts = [None, "", "vile", "Vile VILE vileness vilest", "nice vile", "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(docs, model).collect():
        words = set(re.findall(r"\w+", (r["text"] or "").lower()))
        counts = {"vile": "vile" in words, "nice": "nice" in words, "vile*": sum(w.startswith("vile") for w in words)}
        eta = sum(model.weights[f] * math.log(1 + n) for f, n in counts.items())
        upto = [0.0, *[1 / (1 + math.exp(eta - t)) for t in model.thresholds], 1.0]
        shares = [b - a for a, b in zip(upto, upto[1:])]
        assert r["expected_severity"] == pytest.approx(sum(k * p for k, p in enumerate(shares)))
        assert r["p_toxic"] == pytest.approx(1 - shares[0])
        assert r["grade"] == sum(sum(shares[k:]) >= 0.5 for k in (1, 2, 3))
        assert r["rejected"] == (1 - shares[0] >= toxicity.REJECT)
