"""The backtracking encoder against the library, its reasoning against merges replayed, decoding, cases."""

import hashlib
import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

pytest.importorskip("terrafold.llm")
from tokenizers import Tokenizer  # noqa: E402

from terrafold.llm import bpe  # noqa: E402
from terrafold.llm import queries as Q  # noqa: E402

PATH, D = public_tokenizers.path("word_bpe_49k.json"), "/root/testdata/sf0.001"


def want(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(library):
    r = random.Random(13)
    letters, names = "aaabcdeeehinorstt lmnp 'sdT1-<|>&é ßÀ中İ́\n\x85²", sorted(library.get_vocab())
    yield from ("".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000))
    yield from ("".join(r.choice(names).replace("</w>", r.choice([" ", ""])) for _ in range(r.randint(1, 8))) for _ in range(3000))
    yield from ("".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(0x300, 0xD7FF), r.randint(0x10000, 0x1FFFF)])) for _ in range(r.randint(0, 20))) for _ in range(1500))
    yield from ["x<|endoftext|>y", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "</w> a</w>b", "a" * 5000, "ab" * 3000, "12 3", "it's WE'LL"]


@pytest.mark.parametrize("entries", [bpe.ENTRIES, 3])
def test_equals_library(library, entries):
    own = bpe.BacktrackingEncoder(PATH, entries)
    for text in texts(library):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, text
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)
    assert len(own.compatible) <= entries and len(own.known) <= entries


def test_small_vocabulary_equals_merges_replayed():
    """All words of three letters up to length 8, with merges that often disagree with the longest match."""
    merges = [("a", "b"), ("b", "c"), ("ab", "ab"), ("a", "a"), ("c", "a</w>"), ("ab", "c"), ("bc", "bc"), ("aa", "a"), ("abc", "ca</w>"), ("b", "b")]
    base = list("abc") + [x + "</w>" for x in "abc"]
    vocab = {t: k for k, t in enumerate(base + [a + b for a, b in merges])}
    parts = bpe.Merges({"model": {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges], "end_of_word_suffix": "</w>"}})

    def replay(word):
        row = [*word[:-1], word[-1] + "</w>"]
        for a, b in merges:
            k = 0
            while k < len(row) - 1:
                if (row[k], row[k + 1]) == (a, b):
                    row[k : k + 2] = [a + b]
                k += 1
        return row

    names = list(vocab)
    words = [""]
    for _ in range(7):
        words += [w + c for w in words for c in "abc" if len(w) == len(words[-1])]
    for word in filter(None, words):
        row = [vocab[t] for t in replay(word)]
        assert not any(parts.crossed(a, b) for a, b in zip(row, row[1:])), (word, [names[i] for i in row])
    assert parts.crossed(vocab["a"], vocab["b"]) and not parts.crossed(vocab["ab"], vocab["a"])


def test_vocabulary_out_of_order_is_an_error():
    with pytest.raises(ValueError):
        bpe.Merges({"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ba": 2, "ab": 3}, "merges": [["a", "b"], ["b", "a"]]}})


def test_query(spark, library):
    docs = pd.read_parquet(f"{D}/documents.parquet")
    got = sorted(map(tuple, Q.op13_bpe_round_trip(spark, D).collect()))
    assert got == sorted(want(library, i, t) for i, t in zip(docs.doc_id, docs.text))


def test_cases(spark, library):
    long = " ".join(f"word{k % 97}x{k}" for k in range(40_000))
    rows = [(1, "One two."), (1, "One two."), (None, "One two."), (2, None), (3, ""), (4, " \n"), (5, long), (6, "a" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit("x"), "ids": F.lit(1), "ids_sha256": F.lit(None)})
    found = bpe.round_trip_digests(docs, PATH)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted((want(library, i, t) for i, t in rows), key=key)
    decoded = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH)
    expected = [(i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows]
    assert sorted(map(tuple, decoded.collect()), key=key) == sorted(expected, key=key)
    assert bpe.round_trip_digests(docs.limit(0), PATH).count() == 0
