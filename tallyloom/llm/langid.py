"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into chunks of CHUNK bytes. One recurrent layer reads each chunk forwards, one backwards, both from a zero
state; every position gets a probability for each language, and a document's probabilities are the means over all its
positions. Training is by backpropagation through time and Adam, on the driver, over windows of about SAMPLE_DOCS
labelled documents, as many of each language, at least EACH[0] and at most EACH[1] (WINDOWS of WINDOW characters each, at
places drawn by hash); prediction reads whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as are all if no label was learned; rows with
a null id are never learned from; of tied languages the first in alphabetical order wins; repeated rows are predicted
each for itself; an input column that has the name of an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free, lean

#: The bound of the training sample: documents, and windows of so many characters from each.
SAMPLE_DOCS, WINDOWS, WINDOW = 3_000, 8, 96
EACH = (100, 1_000)
#: Bytes in a chunk, hidden units in each direction, training steps, windows in a step.
CHUNK, HIDDEN, STEPS, BATCH = 64, 8, 500, 192
#: Chunks that run side by side, and bytes of texts that are laid out at a time.
AT_ONCE, BYTES_AT_ONCE = 2_048, 1 << 20


class Layer:
    """A gated recurrent layer over byte sequences of shape (steps, batch)."""

    def __init__(self, rng: np.random.Generator, h: int):
        self.h = h
        s = 1 / np.sqrt(h)
        self.p = {"E": rng.normal(0, 0.3, (256, 3 * h)), "U": rng.uniform(-s, s, (h, 3 * h)), "b": np.zeros(h)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray) -> np.ndarray:
        steps, n = x.shape
        h, self.saved = np.zeros((n, self.h), np.float32), []
        out = np.empty((steps, n, self.h), np.float32)
        for t in range(steps):
            g, u = self.p["E"][x[t]], h @ self.p["U"]
            zr = 0.5 * np.tanh(0.5 * (g[:, : 2 * self.h] + u[:, : 2 * self.h])) + 0.5
            z, r = zr[:, : self.h], zr[:, self.h :]
            c = u[:, 2 * self.h :] + self.p["b"]
            m = np.tanh(g[:, 2 * self.h :] + r * c)
            self.saved.append((h, z, r, c, m))
            h = m + z * (h - m)
            out[t] = h
        return out

    def backward(self, x: np.ndarray, d_out: np.ndarray) -> dict[str, np.ndarray]:
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        dh = np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c, m = self.saved[t]
            dh = dh + d_out[t]
            dm = dh * (1 - z) * (1 - m * m)
            da = np.concatenate([dh * (h - m) * z * (1 - z), dm * c * r * (1 - r), dm], 1)
            du = np.concatenate([da[:, : 2 * self.h], dm * r], 1)
            for j in range(3 * self.h):
                grads["E"][:, j] += np.bincount(x[t], da[:, j], 256)
            grads["U"] += h.T @ du
            grads["b"] += du[:, 2 * self.h :].sum(0)
            dh = dh * z + du @ self.p["U"].T
        return grads


class Model:
    """Two layers and the output weights; ``labels`` in alphabetical order."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels, self.ahead, self.back = labels, Layer(rng, hidden), Layer(rng, hidden)
        self.out = {"V": rng.normal(0, 0.3, (2 * hidden, len(labels))).astype(np.float32), "c": np.zeros(len(labels), np.float32)}

    def train(self, windows: list[bytes], y: np.ndarray, steps: int = STEPS, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        params = [(self.ahead.p, k) for k in self.ahead.p] + [(self.back.p, k) for k in self.back.p] + [(self.out, k) for k in self.out]
        first, second = [np.zeros_like(p[k]) for p, k in params], [np.zeros_like(p[k]) for p, k in params]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(i, max(1, BATCH // len(by))) for i in by])
            x, on = np.zeros((len(pick), CHUNK), np.uint8), np.zeros((len(pick), CHUNK), np.float32)
            for row, i in enumerate(pick):
                w = windows[i]
                at = int(rng.integers(0, max(1, len(w) - CHUNK + 1)))
                w = np.frombuffer(w[at : at + CHUNK], np.uint8)
                x[row, : len(w)], on[row, : len(w)] = w, 1
            x, on = x.T, on.T / max(1.0, on.sum())
            h = np.concatenate([self.ahead.forward(x), self.back.forward(x[::-1])[::-1]], 2)
            p = softmax(h @ self.out["V"] + self.out["c"])
            p[:, np.arange(len(pick)), y[pick]] -= 1
            d = p * on[:, :, None]
            flat, d_flat = h.reshape(-1, h.shape[2]), d.reshape(-1, d.shape[2])
            dh = (d_flat @ self.out["V"].T).reshape(h.shape)
            half = self.ahead.h
            ga, gb = self.ahead.backward(x, dh[:, :, :half]), self.back.backward(x[::-1], dh[::-1, :, half:])
            grads = [*ga.values(), *gb.values(), flat.T @ d_flat, d_flat.sum(0)]
            clip = min(1.0, 1.0 / max(1e-9, float(np.sqrt(sum((g * g).sum() for g in grads)))))
            rate = 0.03 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
            for (p_, k), g, m, v in zip(params, grads, first, second):
                g = g * clip
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p_[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.ahead.saved = self.back.saved = []

    def states(self, layer: Layer, x: np.ndarray, out: np.ndarray, order: range) -> None:
        """The layer's states at each step, into ``out``; gates are computed as half a tanh."""
        k, n = layer.h, x.shape[1]
        gates, cand = 0.5 * layer.p["E"][:, : 2 * k], np.ascontiguousarray(layer.p["E"][:, 2 * k :])
        u_gates, u_cand = 0.5 * layer.p["U"][:, : 2 * k], np.ascontiguousarray(layer.p["U"][:, 2 * k :])
        h, g, c, m, a = np.zeros((n, k), np.float32), np.empty((n, 2 * k), np.float32), np.empty((n, k), np.float32), np.empty((n, k), np.float32), np.empty((n, 2 * k), np.float32)
        for t in order:
            np.take(gates, x[t], axis=0, out=g, mode="clip")
            np.matmul(h, u_gates, out=a)
            g += a
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            np.matmul(h, u_cand, out=c)
            c += layer.p["b"]
            c *= g[:, k:]
            np.take(cand, x[t], axis=0, out=m, mode="clip")
            c += m
            np.tanh(c, out=c)
            h -= c
            h *= g[:, :k]
            h += c
            out[t] = h

    def positions(self, chunks: np.ndarray) -> np.ndarray:
        """Probabilities at every position of chunks (n, CHUNK): (CHUNK, n, labels)."""
        x = np.ascontiguousarray(chunks.T)
        h = np.empty((CHUNK, len(chunks), 2 * self.ahead.h), np.float32)
        self.states(self.ahead, x, h[:, :, : self.ahead.h], range(CHUNK))
        self.states(self.back, x, h[:, :, self.ahead.h :], range(CHUNK - 1, -1, -1))
        return softmax(h @ self.out["V"] + self.out["c"])

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each non-empty text."""
        counts = np.array([-(-len(t) // CHUNK) for t in texts])
        starts = np.append(0, np.cumsum(counts))
        flat, on = np.zeros(starts[-1] * CHUNK, np.uint8), np.zeros(starts[-1] * CHUNK, np.float32)
        for t, s in zip(texts, starts * CHUNK):
            flat[s : s + len(t)], on[s : s + len(t)] = np.frombuffer(t, np.uint8), 1
        flat, on = flat.reshape(-1, CHUNK), on.reshape(-1, CHUNK)
        sums = np.empty((len(flat), len(self.labels)), np.float64)
        for at in range(0, len(flat), AT_ONCE):
            p = self.positions(flat[at : at + AT_ONCE])
            sums[at : at + AT_ONCE] = np.einsum("tnk,nt->nk", p, on[at : at + AT_ONCE])
        return np.add.reduceat(sums, starts[:-1], axis=0) / np.array([len(t) for t in texts])[:, None]


def softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(-1, keepdims=True)
    return x


def windows_of(docs: DataFrame, picked: DataFrame, label: str) -> DataFrame:
    """Windows of the picked documents (doc_id and label; a bounded number, broadcast), drawn by hash over whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    room = F.greatest(F.length(text) - WINDOW, F.lit(0)) + 1
    starts = F.array(*[(F.pmod(F.xxhash64("doc_id", F.lit(j)), room) + 1).cast("int") for j in range(WINDOWS)])
    rows = docs.select("doc_id", label, "text").join(F.broadcast(picked), ["doc_id", label])
    return rows.select(label, F.transform(starts, lambda s: F.substring(text, s, F.lit(WINDOW))).alias("windows"))


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, mod ``modulus``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def learn(docs: DataFrame, allowed: Column, sample: int = SAMPLE_DOCS, steps: int = STEPS) -> Model | None:
    """A model of all languages in ``docs`` where ``allowed``; None if there is no labelled text. Of each language, the
    documents with the smallest hashes are learned; up to EACH[1] (1,000) a window keeps only those of each partition."""
    ids = docs.filter(allowed & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    ids = ids.filter(F.length("text") > 0).select("doc_id", "lang").distinct()
    most = min(EACH[1], max(EACH[0], -(-sample // max(1, ids.select("lang").distinct().count()))))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = ids.withColumn("place", place).filter(F.col("place") <= most).drop("place")
    rows = sorted((r.lang, [w.encode() for w in r.windows if w]) for r in windows_of(docs, picked, "lang").collect())
    labels = sorted({lang for lang, ws in rows if ws})
    if not labels:
        return None
    model = Model(labels)
    model.train([w for _, ws in rows for w in ws], np.array([labels.index(lang) for lang, ws in rows for _ in ws]), steps)
    return model


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (None: all), lang_pred and score of each document."""
    added = ("lang_pred", "score")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            at = 0
            lengths = np.array([len(x or "") for x in batch.column(len(kept)).to_pylist()])
            while at < batch.num_rows:
                to = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), BYTES_AT_ONCE)))
                part, at = batch.slice(at, to - at), to
                texts = part.column(len(kept)).to_pylist()
                known = [i for i, x in enumerate(texts) if net and x and any(map(str.isalpha, x))]
                label, score = ["und"] * len(texts), [0.0] * len(texts)
                if known:
                    p = net.documents([texts[i].encode() for i in known])
                    for i, row in zip(known, p):
                        label[i], score[i] = net.labels[int(row.argmax())], float(min(1.0, row.max()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array(label, pa.string()), pa.array(score, pa.float64())], names=[*kept, *added])

    return docs.select(*[docs[f"`{c}`"] for c in kept], docs["text"].alias(free(kept, "__text"))).mapInArrow(lean(run), schema)
