"""Operators on driver tables against plain brute force."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

pytest.importorskip("terrafold.llm")

from terrafold.llm import queries as Q  # noqa: E402
from terrafold.llm import spans, toxicity  # noqa: E402
from terrafold.llm.packing import Plan  # noqa: E402
from terrafold.llm.tokens import Encoder  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402


def plain_ids(name):
    """What the library gives, freshly loaded and with nothing set."""
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: library.encode(text, add_special_tokens=False).ids

D = "/root/testdata/sf0.001"


def frame(name):
    return pd.read_parquet(f"{D}/{name}.parquet")


def groups_of(texts, n=5, least=0.8):
    sets = []
    for t in texts:
        w = t.encode().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], links


def spans_removed(rows):
    """(doc_id, text) in order of id -> texts without later occurrences."""
    seen, out = set(), []
    for _, text in rows:
        parts = [text[a:b] for a, b in spans.sentences(text)]
        keys = [" ".join(p.split()).lower() for p in parts]
        gone = set()
        for k in range(len(keys)):
            for end in range(k + 1, len(keys) + 1):
                words = len(" ".join(keys[k:end]).split())
                if words >= 50 or end - k >= 2 and words >= 20:
                    key = tuple(keys[k:end])
                    if key in seen:
                        gone |= set(range(k, end))
                    seen.add(key)
        out.append("".join(p for k, p in enumerate(parts) if k not in gone).rstrip() if gone else text)
    return out


def test_packing_and_tokens(spark):
    docs = frame("documents")
    got = Q.op3_best_fit_packing(spark, D).toPandas()
    encode, want = plain_ids("word_bpe_49k.json"), []
    for i, t in zip(docs.doc_id, docs.text):
        ids = np.append(encode(t), [1]).astype("<u4")
        want += [(i, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(want)
    assert got.sequence_id.nunique() == -(-got.length.sum() // 4096)


def test_byte_tokens(spark):
    docs = frame("documents").sort_values("doc_id")
    got = Q.op7_sorted_string_table(spark, D).toPandas().sort_values("doc_id")
    encode, start = plain_ids("byte_bpe_50k.json"), 0
    for text, r in zip(docs.text, got.itertuples()):
        ids = np.append(encode(text), [2]).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("kind,name", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_encoder_equals_library(kind, name):
    import random

    e, encode, r = Encoder(public_tokenizers.path(name), kind, entries=10), plain_ids(name), random.Random(3)
    texts = ["", " a  b\n\n c", "it's 123 45.6 ²x ½ ªº", "İstanbul Ωmega", "don't WE'LL I'M'S <|endoftext|>", "a\x0bb\x0cc \x85 \x1c", "中文 字", "ÀÉ×÷ß ¿¡§°±"]
    texts += ["x<|endoftext|>y", "<|startoftext|> a", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "<|endoftext|><|startoftext|>é 中"]
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "a", "The", "é", "中", "'s", "12", "\n", "endoftext"]
    texts += ["".join(r.choices(parts, k=r.randint(1, 9))) for _ in range(3000)]
    want = [np.asarray(encode(t), dtype="<u4").tobytes() for t in texts]
    assert e.encode_all(texts) == want and [e.encode(t) for t in texts] == want


def test_jaccard(spark):
    docs = frame("documents").sort_values("doc_id")
    got = Q.op8_ngram_jaccard_join(spark, D).toPandas().sort_values("doc_id")
    classes, links = groups_of(docs.text.tolist())
    assert got.n_links.tolist() == links and got.class_id.tolist() == [int(docs.doc_id.iloc[c]) for c in classes]


def test_spans(spark):
    docs = frame("documents").sort_values("doc_id")
    got = Q.op4_substring_dedup(spark, D).toPandas().sort_values("doc_id")
    assert got.text.tolist() == spans_removed(list(zip(docs.doc_id, docs.text)))


def test_vectors(spark):
    e = frame("embeddings").sort_values("vec_id")
    v, ids = np.array(e.embedding.tolist(), dtype=np.float64), e.vec_id.to_numpy()
    found = Q.op5_kmeans_tree(spark, D).toPandas()
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        s[q] = -np.inf
        own = found[found.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, s[np.searchsorted(ids, own.vec_id)])
        hit, total = hit + len(set(own.vec_id) & set(ids[np.lexsort((ids, -s))[:20]])), total + 20
    assert hit / total >= 0.9
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    got = Q.op9_embedding_near_dedup(spark, D).toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == links.sum(1).tolist()


def test_ego_on_clusters(spark):
    from terrafold.llm import ego

    rng = np.random.RandomState(5)
    centres = rng.normal(size=(40, 16))
    v = (centres[rng.randint(0, 40, 1500)] + rng.normal(scale=0.25, size=(1500, 16))).astype(np.float32)
    table = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = ego.near_duplicates(table, block=64).toPandas().sort_values("vec_id")
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    label = np.arange(1500)
    while True:
        new = np.minimum(label, np.where(links, label[None, :], 10**9).min(1))
        if (new == label).all():
            break
        label = new
    assert got.n_links.tolist() == links.sum(1).tolist() and got.component_id.tolist() == label.tolist() and links.sum() > 1000


def test_warc(spark):
    pages = frame("pages").sort_values("page_id")
    got = Q.op6_warc(spark, D).toPandas().sort_values("page_id")
    raw = [(h or "").encode() for h in pages.html]
    assert got.payload_bytes.tolist() == [len(r) for r in raw]
    assert got.payload_digest.tolist() == [base64.b32encode(hashlib.sha1(r).digest()).decode() for r in raw]


def test_chat_accuracy(spark):
    from terrafold.llm import chat

    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    held = "conv_id % 2 = 1"
    model = chat.fit(table.filter("conv_id % 2 = 0"))
    out = chat.render(table.filter(held), model).toPandas()
    truth = table.filter(held).toPandas()
    both = truth.merge(out[out["part"] == 0], on=["conv_id", "turn"], suffixes=("", "_got"))
    assert len(both) == len(truth) and (both.role == both.role_got).mean() > 0.93


def test_toxicity_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 2 = 0"))
    out = toxicity.score(docs.join(labels.filter("doc_id % 2 = 1"), "doc_id"), model).toPandas()
    toxic = out[out.toxic == 1]
    assert toxic.rejected.mean() > 0.93 and out[out.toxic == 0].rejected.mean() < 0.01
    assert model.thresholds == tuple(sorted(model.thresholds)) and toxic.expected_severity.mean() > 1


def test_matcher_counts_as_features_do(monkeypatch):
    texts = [*frame("documents").text, "", None, "One ones ONE oneself"]
    names = {f for t in texts[:20] for f in toxicity.features(t)} | {"ones*", "one"}
    want = [{f: n for f, n in toxicity.features(t).items() if f in names} for t in texts]
    assert list(map(toxicity.Matcher(names), texts)) == want
    monkeypatch.setattr(toxicity, "ENTRIES", 3)
    assert list(map(toxicity.Matcher(names), texts)) == want


def test_plan_never_loses_a_piece():
    rng = np.random.RandomState(1)
    for capacity in (1, 7, 64, 4096):
        for _ in range(4):
            counts = {int(x): int(n) for x, n in zip(rng.randint(1, capacity + 1, 60), rng.randint(1, 2000, 60))}
            plan = Plan(counts, capacity)
            seen = defaultdict(int)
            for times, lengths in plan.groups:
                assert sum(lengths) <= capacity
                for x in lengths:
                    seen[x] += times
            assert dict(seen) == counts
            slots = plan.slots()
            assert plan.sequences >= -(-sum(x * n for x, n in counts.items()) // capacity)
            assert len(slots["length"]) == sum(len([1 for k, x in enumerate(g) if k == 0 or g[k - 1] != x]) for _, g in plan.groups)


def test_pipeline(spark):
    import corpus_pipeline

    docs = frame("documents").sort_values("doc_id")
    model = toxicity.train(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet"))
    docs = docs[[not (p := model.probabilities(t)) or p[0] < toxicity.REJECT for t in docs.text]]
    classes, _ = groups_of(docs.text.tolist())
    docs = docs[[c == k for k, c in enumerate(classes)]]
    docs = docs.assign(text=spans_removed(list(zip(docs.doc_id, docs.text))))
    spark_docs = spark.createDataFrame(docs)
    from terrafold.llm.mixing import mix

    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mix(spark_docs).collect()}
    want = {i: t // s for i, (t, s) in taken.items() if s and t}
    got = corpus_pipeline.run(spark, D).toPandas()
    assert got[got.piece == 0].groupby("doc_id").size().to_dict() == want
    assert got.groupby("sequence_id").length.sum().max() <= 4096
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "mixing", "packing"]
