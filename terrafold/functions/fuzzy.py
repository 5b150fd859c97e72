"""Fuzzy scores of names (F38), 0..100, as Arrow-batched functions.

``ratio``: 200 * matching characters / all characters, matched by longest common
subsequence (insertions and deletions only). ``partial_ratio``: the best ratio
of the shorter name with any window of its length in the longer. ``wratio``:
the best of ratio, the same on sorted and on shared words (times 0.95), and for
names of very different length of the partial score (times 0.9 or 0.6). The
published descriptions of these scores are followed; equality to the last
digit with another library is not claimed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for k, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    return max(ratio(short, long[max(0, k) : k + n]) for k in range(1 - n, len(long)) if long[max(0, k) : k + n])


def _sorted_words(a: str) -> str:
    return " ".join(sorted(a.split()))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_x or not only_y):
        return 100.0
    joined = [f"{both} {only}".strip() for only in (only_x, only_y)]
    found = [ratio(*joined)]
    if both:
        found += [ratio(both, joined[0]), ratio(both, joined[1])]
    return max(found)


def wratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    far = max(len(a), len(b)) / min(len(a), len(b))
    words = max(ratio(_sorted_words(a), _sorted_words(b)), token_set_ratio(a, b))
    if far < 1.5:
        return max(ratio(a, b), 0.95 * words)
    scale = 0.9 if far <= 8 else 0.6
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * max(partial_ratio(_sorted_words(a), _sorted_words(b)), words))


def _scorer(score):
    @F.pandas_udf(T.DoubleType())
    def column(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64")

    return column


RATIO, PARTIAL_RATIO, WRATIO = _scorer(ratio), _scorer(partial_ratio), _scorer(wratio)
SCORERS = {"ratio": RATIO, "partial_ratio": PARTIAL_RATIO, "wratio": WRATIO}


SCORES = {"ratio": ratio, "partial_ratio": partial_ratio, "wratio": wratio}


def _distinct_words(a: str) -> str:
    return " ".join(sorted(set(a.split())))


class Nearest:
    """The best of a list of names for one name after the other, case ignored.

    Every score is made of ratios, and a ratio cannot exceed what the letters
    that two texts share allow, whatever their order. Names of the same letters
    (as they are, and of their distinct words) have one bound, so bounds are
    taken of groups of names. Groups are opened from the largest bound down, and
    no longer once the bound falls below the best score found or the least one
    wanted. Of the names of opened groups the plain ratio is found at once, by
    bits, which tightens their bounds before scores are computed: the answer is
    that of trying all. ``tried`` counts the names whose scores were computed.
    """

    #: Names of about so many are opened at once; texts of more letters than bits are not compared by bits.
    OPENED, BITS = 512, 63

    def __init__(self, names: list[str], scorer: str = "wratio"):
        self.score, self.scorer, self.tried = SCORES[scorer], scorer, 0
        self.names = sorted(names)
        self.upper = [n.upper() for n in self.names]
        self.letters = {c: k for k, c in enumerate(sorted({c for n in self.upper for c in n}))}
        codes, sizes = self._codes(self.upper)
        bare_codes, bare_sizes = self._codes([_distinct_words(n) for n in self.upper])
        words = np.array([len(_sorted_words(n)) for n in self.upper], dtype=np.int64)
        counts, bare = self._counts(codes, sizes), self._counts(bare_codes, bare_sizes)
        groups: dict[bytes, int] = {}
        of = np.array([groups.setdefault(a.tobytes() + b.tobytes() + w.tobytes(), len(groups)) for a, b, w in zip(counts, bare, words)], dtype=np.int64)
        first = np.unique(of, return_index=True)[1]
        self.plain, self.bare, self.words = (counts[first], sizes[first]), (bare[first], bare_sizes[first]), words[first]
        # The names of group g are members[starts[g] : starts[g + 1]].
        self.group, self.members = of, np.argsort(of, kind="stable")
        self.starts = np.searchsorted(of[self.members], np.arange(len(first) + 1))
        self.codes, self.sizes, self.offsets = codes, sizes, np.cumsum(sizes) - sizes
        having: dict[str, list[int]] = {}
        for k, n in enumerate(self.upper):
            for word in set(n.split()):
                having.setdefault(word, []).append(k)
        self.having = {word: np.array(ks, dtype=np.int64) for word, ks in having.items()}

    def _codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The letters of all texts as numbers, one text after the other, and the texts' sizes."""
        codes = np.fromiter((self.letters[c] for text in texts for c in text), dtype=np.int32)
        return codes, np.array([len(t) for t in texts], dtype=np.int64)

    def _counts(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n, rows = max(1, len(self.letters)), np.repeat(np.arange(len(sizes)), sizes)
        counts = np.zeros((len(sizes), n), dtype=np.int32)
        np.add.at(counts, (rows, codes), 1)
        return counts

    def _shared(self, table: np.ndarray, text: str) -> np.ndarray:
        own: dict[int, int] = {}
        for c in text:
            if c in self.letters:
                own[self.letters[c]] = own.get(self.letters[c], 0) + 1
        return np.minimum(table[:, list(own)], list(own.values())).sum(axis=1) if own else np.zeros(len(table), dtype=np.int32)

    def _word_of(self, text: str) -> np.ndarray:
        """The numbers of names with a word of the text."""
        found = [self.having[word] for word in set(text.split()) if word in self.having]
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)

    def bounds(self, text: str) -> np.ndarray:
        """No name's score for ``text`` (in upper case) is larger."""
        return np.maximum(*self._bounds(text))[self.group]

    def _bounds(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Per group what no name's plain ratio for ``text`` (in upper case) exceeds, and no other part of its score."""
        counts, sizes = self.plain
        shared, short = self._shared(counts, text), np.minimum(sizes, len(text))
        with np.errstate(divide="ignore", invalid="ignore"):
            whole = np.where(sizes + len(text) > 0, 200.0 * shared / (sizes + len(text)), 100.0)
            if self.scorer == "ratio":
                return whole, np.zeros(len(whole))
            # A window has at least the letters that it shares.
            part = np.where(short > 0, 200.0 * shared / (short + shared), 100.0)
            if self.scorer == "partial_ratio":
                return np.zeros(len(part)), part
            bare_counts, bare_sizes = self.bare
            bare, sharing = _distinct_words(text), np.unique(self.group[self._word_of(text)])
            both = self._shared(bare_counts, bare)
            # Without a common word all distinct words are compared with all; with one, a part of them may be.
            in_sets = 200.0 * both / np.maximum(1, bare_sizes + len(bare))
            least = np.minimum(bare_sizes, len(bare))[sharing]
            in_sets[sharing] = np.where(least > 0, 200.0 * both[sharing] / (both[sharing] + least), 0.0)
            in_order = 200.0 * shared / np.maximum(1, self.words + len(_sorted_words(text)))
            words = np.minimum(100.0, np.maximum(in_sets, in_order))
            far = np.maximum(sizes, len(text)) / np.maximum(1, short)
            scale = np.where(far <= 8, 0.9, 0.6)
            sorted_short = np.minimum(self.words, len(_sorted_words(text)))
            sorted_part = np.minimum(100.0, np.where(sorted_short > 0, 200.0 * shared / (sorted_short + np.minimum(shared, sorted_short)), 100.0))
            wide = np.maximum(scale * part, 0.95 * scale * np.maximum(sorted_part, words))
            none = (sizes == 0) | (len(text) == 0)
            return np.where(none, 0.0, whole), np.where(none, 0.0, np.where(far < 1.5, 0.95 * words, wide))

    def ratios(self, text: str, names: np.ndarray) -> np.ndarray:
        """``ratio`` of ``text`` (of at most BITS letters) with names given by number, as ``_common`` has it, for all at once."""
        where, full = np.zeros(len(self.letters) + 1, dtype=np.uint64), np.uint64((1 << len(text)) - 1)
        for k, c in enumerate(text):
            if c in self.letters:
                where[self.letters[c]] |= np.uint64(1 << k)
        sizes, starts = self.sizes[names], self.offsets[names]
        row = np.full(len(names), full, dtype=np.uint64)
        for k in range(int(sizes.max(initial=0))):
            inside = k < sizes
            hit = row & where[np.where(inside, self.codes[np.where(inside, starts + k, 0)], -1)]
            row = (row + hit | row - hit) & full
        common = len(text) - np.bitwise_count(row).astype(np.int64)
        return np.where(sizes + len(text) > 0, 200.0 * common / np.maximum(1, sizes + len(text)), 100.0)

    def best(self, text: str, least: float) -> tuple[str, float] | None:
        """(name, score) of the largest score that is at least ``least``, the least name on ties."""
        text, best = text.upper(), None
        whole, rest = self._bounds(text)
        rest = rest + 1e-9
        bounds = np.maximum(whole, rest) + 1e-9
        open_, = np.nonzero(bounds >= least)
        order = open_[np.argsort(-bounds[open_], kind="stable")]
        names = np.cumsum(self.starts[order + 1] - self.starts[order])
        at = 0
        while at < len(order) and (best is None or bounds[order[at]] >= -best[0]):
            end = max(at + 1, int(np.searchsorted(names, (names[at - 1] if at else 0) + self.OPENED, side="right")))
            found = np.concatenate([self.members[self.starts[g] : self.starts[g + 1]] for g in order[at:end].tolist()])
            at = end
            exact, other = whole[self.group[found]], rest[self.group[found]]
            by_bits = len(text) <= self.BITS and self.scorer != "partial_ratio"
            if by_bits:
                exact = np.where(exact > 0, self.ratios(text, found), 0.0)
            tight = np.maximum(exact, other) + 1e-9
            for k in np.lexsort((found, -tight)).tolist():
                if tight[k] < (least if best is None else -best[0]):
                    break
                name = self.names[found[k]]
                # At most as good as the best, as the plain ratio is exact, and no lesser name.
                if by_bits and best is not None and exact[k] <= -best[0] and other[k] < -best[0] and name > best[1]:
                    continue
                self.tried += 1
                score = self.score(text, self.upper[found[k]])
                if score >= least and (best is None or (-score, name) < best):
                    best = -score, name
        return (best[1], -best[0]) if best else None
