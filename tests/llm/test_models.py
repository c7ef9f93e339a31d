import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import langid as L
from tallyloom.llm import quality_cnn as Q
from tallyloom.llm import queries as R

from .conftest import ODD

SF = "/root/testdata/sf0.01"


def test_recurrent_gradient():
    rng = np.random.default_rng(0)
    layer = L.Layer(rng, 3)
    layer.p = {k: v.astype(np.float64) for k, v in layer.p.items()}
    x, w = rng.integers(0, 256, (5, 2)), rng.normal(size=(5, 2, 3))

    def loss():
        return float((layer.forward(x).astype(np.float64) * w).sum())

    loss()
    grads = layer.backward(x, w)
    for k in ("U", "b", "E"):
        at = (x[2, 0], 4) if k == "E" else tuple(0 for _ in layer.p[k].shape)
        layer.p[k][at] += 1e-3
        up = loss()
        layer.p[k][at] -= 2e-3
        down = loss()
        layer.p[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-2 * max(1.0, abs(grads[k][at]))


def test_positions_are_labelled_like_in_training():
    m = L.Model(["a", "b"])
    x = np.random.default_rng(1).integers(0, 256, (7, L.CHUNK)).astype(np.uint8)
    h = np.concatenate([m.ahead.forward(x.T), m.back.forward(x.T[::-1])[::-1]], 2)
    want = L.softmax(h @ m.out["V"] + m.out["c"])
    assert np.abs(m.positions(x) - want).max() < 1e-5
    text = bytes(range(1, 200))
    one, several = m.documents([text]), m.documents([b"zz", text, b"q" * 700])
    assert np.abs(one[0] - several[1]).max() < 1e-6


def test_language_query(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = R.op8_language_id(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(make):
    model = L.Model(["de", "en"])
    docs = make(ODD, lang_pred=["x"] * 9, __text=["y"] * 9)
    out = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert [out[i].lang_pred == "und" for i in range(9)] == [True, True, True, False, True, False, False, False, False] and out[0].score == 0.0
    assert L.learn(docs.filter("false"), F.lit(True)) is None and L.identify(docs, None).filter("lang_pred <> 'und'").count() == 0
    assert L.identify(docs.limit(0), model).count() == 0


def test_rare_languages_are_learned(make, spark):
    docs = make(["the cat"] * 400 + ["der hund", "", "le chien"], list(range(402)) + [5], extra=["en"] * 400 + ["de", "xx", "fr"]).drop("lang").withColumnRenamed("extra", "lang")
    assert L.learn(docs, F.lit(True), sample=8, steps=1).labels == ["de", "en", "fr"]  # xx has no text


def test_quality_query(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = R.op5_quality_cnn(spark, SF).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    clean, junk = ([r.predicted for r in held if labels[r.doc_id] == k] for k in (1, 0))
    assert np.mean(clean) > 0.97 and (not junk or np.mean(junk) < 0.3)


def test_scores_do_not_depend_on_neighbours():
    m = Q.Model()
    texts = [b"", b"abc", b"hello world " * 200, b"x" * 511, b"y " * 3000]
    together = m.score(texts)
    assert np.abs(together - np.concatenate([m.score([t]) for t in texts])).max() < 1e-6
    reverse = m.score(texts[::-1])[::-1]
    assert np.abs(together - reverse).max() < 1e-6


def test_network_by_hand():
    """Responses, pools and the unit, computed plainly."""
    m = Q.Model()
    text = b"the quick brown fox jumps over the lazy dog " * 40
    n = max(Q.SPAN, -(-(len(text) + Q.WIDTH - 1) // Q.BLOCK))
    n += (Q.SPAN - n) % Q.STRIDE
    x = np.zeros(n * Q.BLOCK + Q.WIDTH - 1, np.uint8)
    x[: len(text)] = np.frombuffer(text, np.uint8)
    conv = sum(m.p["emb"][x[k : k + n * Q.BLOCK]] @ m.p["w"][k] for k in range(Q.WIDTH)) + m.p["b"]
    conv[-(Q.WIDTH - 1) :] = -np.inf
    blocks = np.array([np.maximum(conv[a : a + Q.BLOCK], 0).max(0) for a in range(0, len(conv), Q.BLOCK)])
    chunks = [blocks[a : a + Q.SPAN] for a in range(0, n - Q.SPAN + 1, Q.STRIDE)]
    tops = np.array([np.maximum(np.concatenate([c.max(0), c.mean(0)]) @ m.p["w2"] + m.p["b2"], 0) for c in chunks])
    want = Q.sigmoid(np.concatenate([tops.max(0), tops.mean(0)]) @ m.p["v"] + m.p["c"][0])
    assert abs(m.score([text])[0] - want) < 1e-5


def test_convolution_gradient():
    m = Q.Model()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    m.p["b2"] += 0.3
    docs, y = [[b"the cat sat on the mat " * 30, b"a dog ran home, and it slept there for one hour or two. "], [b"!! junk || junk " * 20]], np.array([1.0, 0.0])
    docs = [[c[: Q.BLOCK * Q.SPAN] for c in d] for d in docs]

    def loss():
        p, out = m.p, 0.0
        for d, k in zip(docs, y):
            units = []
            for c in d:
                x = np.zeros(Q.BLOCK * Q.SPAN + Q.WIDTH - 1, np.uint8)
                x[: len(c)] = np.frombuffer(c, np.uint8)
                conv = sum(p["emb"][x[j : j + Q.BLOCK * Q.SPAN]] @ p["w"][j] for j in range(Q.WIDTH)) + p["b"]
                tops = np.maximum(conv.reshape(Q.SPAN, Q.BLOCK, -1).max(1), 0)
                units.append(np.maximum(np.concatenate([tops.max(0), tops.mean(0)]) @ p["w2"] + p["b2"], 0))
            z = np.concatenate([np.max(units, 0), np.mean(units, 0)]) @ p["v"] + p["c"][0]
            out -= np.log(Q.sigmoid(z if k else -z)) / len(docs)
        return out + 0.5e-4 * float(p["v"] @ p["v"])

    grads = m.gradients(docs, y)
    for k in m.p:
        at = np.unravel_index(np.abs(grads[k]).argmax(), m.p[k].shape)
        m.p[k][at] += 1e-4
        up = loss()
        m.p[k][at] -= 2e-4
        down = loss()
        m.p[k][at] += 1e-4
        assert abs((up - down) / 2e-4 - grads[k][at]) < 2e-2 * max(0.1, abs(grads[k][at])), k


def test_quality_of_odd_rows(make, spark):
    docs = make(ODD, score=["x"] * 9, __text=["y"] * 9)
    out = Q.classify(docs, Q.Model()).collect()
    assert len(out) == 9 and all(0 <= r.score <= 1 for r in out) and Q.classify(docs, None).filter("score <> 0.5").count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert Q.learn(docs, labels, F.lit(True)) is None and Q.classify(docs.limit(0), Q.Model()).count() == 0
