from __future__ import annotations

import zlib

import numpy as np
import pytest

from wayfare.llm import quality
from wayfare.llm.common import table


def test_passages():
    x, n = quality.passages(["", None, "a b c", "W0rd!! | " * 200, "z" * 5000])
    assert n.tolist() == [1, 1, 1, 4, 12] and x.shape == (19, quality.FEATURES) and np.isfinite(x).all()
    alone = np.concatenate([quality.passages([t])[0] for t in ("a b c", "W0rd!! | " * 200)])
    assert np.allclose(alone, x[2:7])
    assert quality.passages([])[0].shape[0] == 0


def test_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(k, quality.FEATURES)).astype(np.float32) for k in (1, 3, 5)]
    y = np.array([0.0, 1.0, 0.0])
    model = quality.train(bags, y, epochs=1)
    x, n = np.concatenate(bags), np.array([1, 3, 5])

    def loss():
        p = model.score(x, n)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in model.gradients(x, n, y).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, step = model.weights[name][at], 1e-5
        model.weights[name][at] = old + step
        high = loss()
        model.weights[name][at] = old - step
        low = loss()
        model.weights[name][at] = old
        assert (high - low) / (2 * step) == pytest.approx(g[at], rel=1e-3, abs=1e-7)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    own = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in own]) > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "")], "doc_id long, text string").selectExpr("*", "9 as score")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(docs, none).collect()
    assert [r.score for r in got] == [0.5] * 4 and [r.predicted for r in got] == [1] * 4
    both = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (7, None)], "doc_id long, quality int")
    assert quality.classify(docs, both).count() == 4 and quality.classify(docs.limit(0), both).count() == 0


def plain_score(model, passages):
    """The forward pass of one document, in loops over passages and units."""
    import math

    w = model.weights
    hidden, gates = [], []
    for x in passages:
        x = [(v - m) / s for v, m, s in zip(x.tolist(), model.mean.tolist(), model.scale.tolist(), strict=True)]
        h = [math.tanh(sum(x[f] * w["encode"][f][u] for f in range(len(x))) + w["encode_b"][u]) for u in range(len(w["encode_b"]))]
        gate = 0.0
        for g in range(len(w["attend"])):
            t = math.tanh(sum(h[u] * w["gate_t"][u][g] for u in range(len(h))))
            s = 1 / (1 + math.exp(-sum(h[u] * w["gate_s"][u][g] for u in range(len(h)))))
            gate += t * s * w["attend"][g]
        hidden.append(h)
        gates.append(math.exp(gate))
    z = [sum(a * h[u] for a, h in zip(gates, hidden, strict=True)) / sum(gates) for u in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, w["score"], strict=True)) + w["score_b"][0])))


def test_plain_version(spark):
    """Every score again, passage by passage, and what is held out; held-out labels change nothing."""
    docs = [(k, f"w{k} " * (k * 7 % 400) + ("Good words, well put. " if k % 2 else "x1 || 99 ") * (k % 40)) for k in range(60)] + [(60, None), (61, ""), (62, "Long " * 8000)]
    labels = [(k, k % 2) for k in range(60)]
    df, own = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(df, own)
    got = {r.doc_id: r for r in quality.classify(df, own).collect()}
    for k, text in docs:
        assert got[k].score == pytest.approx(plain_score(model, quality.passages([text])[0]), rel=1e-4)
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and got[k].predicted == int(got[k].score >= 0.3)
    turned = [(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, y in labels]
    again = {r.doc_id: r.score for r in quality.classify(df, spark.createDataFrame(turned, "doc_id long, quality int")).collect()}
    assert again == {k: r.score for k, r in got.items()}
