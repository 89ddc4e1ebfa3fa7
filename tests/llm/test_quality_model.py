import random
import zlib

import numpy as np

from kgraph.llm import quality_model as q
from kgraph.llm.quality_model import AttentionMil, MilParams, bags, classify, fit

SCHEMA = "doc_id long, text string, score string, held_out string, predicted int"


def test_bags_take_whole_texts():
    texts = [b"", b"abc", b"x" * 512, b"y" * 513, b"ab cd" * 1000]
    rows, counts = bags(texts)
    assert counts.tolist() == [1, 1, 1, 2, 10] and rows.shape == (15, q.WIDTH)
    one = np.concatenate([bags([t])[0] for t in texts])
    assert np.allclose(rows, one)
    long = bytes(random.Random(1).choices(range(32, 120), k=3 * q.SLICE // 2))
    a, n = bags([long])
    assert n[0] == -(-len(long) // 512) and (a[:, : q.BUCKETS].sum(axis=1) > 0).all()
    assert bags([b"one two three " * 90])[0][0, q.BUCKETS] > 0.5 > bags([long[:1500]])[0][0, q.BUCKETS]


def test_gradients():
    rng = np.random.default_rng(1)
    m = AttentionMil(MilParams(hidden=5, gate=3))
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    counts = np.array([1, 4, 2])
    x, y = rng.random((7, q.WIDTH)), np.array([1.0, 0.0, 1.0])
    loss = lambda: float(-np.mean(y * np.log(p := m.forward(x, counts)["p"]) + (1 - y) * np.log(1 - p)))
    grads = m.gradients(x, counts, y)
    for k, g in grads.items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 6)]:
            old = m.w[k][at]
            m.w[k][at] = old + 1e-5
            up = loss()
            m.w[k][at] = old - 1e-5
            down = loss()
            m.w[k][at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6, k


def corpus(n, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(["the", "river", "house", "went", "slowly", "under", "tree"]) + rng.choice("abcde") for _ in range(rng.choice([30, 200, 600]))]
        bad = i % 4 == 0
        if bad:  # one stretch of junk within an otherwise clean document
            at = rng.randrange(len(words))
            words[at : at + 25] = [w + "%%% &&&" for w in words[at : at + 25]] or ["%%% &&&"] * 20
        rows.append((i, " ".join(words), "s", "h", 0))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(600)
    rows += [(None, None, "", "", 0), (-1, "", "", "", 0), (-1, "", "", "", 0)]
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    got = classify(docs, known, MilParams(epochs=12)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = dict(labels)
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2}
    out = [r for r in out if r.doc_id in truth]
    assert sum(truth[r.doc_id] == r.predicted for r in out) / len(out) > 0.95
    # held-out labels have no say
    flipped = [(k, 1 - v if zlib.crc32(str(k).encode()) % 4 == 2 else v) for k, v in labels]
    other = classify(docs, spark.createDataFrame(flipped, "doc_id long, quality int"), MilParams(epochs=12)).collect()
    assert {r.doc_id: round(r.score, 6) for r in other if r.doc_id in truth} == {r.doc_id: round(r.score, 6) for r in got if r.doc_id in truth}


def test_degenerate_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "", "", 0), (2, None, "", "", 0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in classify(docs, none).collect()] == [0.5, 0.5]
    assert classify(spark.createDataFrame([], SCHEMA), none).collect() == []
    assert fit(np.zeros((2, q.WIDTH)), np.array([1, 1]), np.ones(2)).scores([b""]) == [0.75]
