"""Quality classification by a byte-level convolutional network, in numpy.

Learned filters of WIDTH bytes run over the whole text. Chunks of SPAN blocks of BLOCK bytes, each overlapping the next by
half, cover the document; a filter's response is max-pooled in each block, then over the chunk by maximum and by mean. A second
layer of HIDDEN units reads both, so it sees which filters fire, how many, and whether all blocks are alike, as in text that
repeats itself. Its units are pooled over the document's chunks by maximum and by mean, and a logistic unit combines both
into one probability of label 1. Nothing but bytes is read. Training is by backpropagation and Adam, on the driver, over at most SAMPLE labelled
documents of each label (CHUNKS chunks of each, at places drawn by hash); prediction reads whole texts.

Defined cases: null and empty texts are one chunk of zero bytes; very long texts are read to the end; without labelled text
of both labels all scores are 0.5; a document with labels of both kinds is learned with either; repeated rows are scored
each for itself; equal scores stay equal; an empty table gives an empty result; an input column that has the name of an
added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free, lean

#: The bound of the training sample: documents of each label, and chunks of each document.
SAMPLE, CHUNKS = 1_500, 6
#: Bytes a filter sees, filters, size of a byte's embedding, units of the second layer.
WIDTH, FILTERS, DEPTH, HIDDEN = 5, 24, 8, 16
#: Bytes in a block, blocks in a chunk, blocks from chunk to chunk.
BLOCK, SPAN, STRIDE = 64, 8, 4
STEPS, BATCH, THRESHOLD = 600, 64, 0.3
#: Share of chunks that are cut short in training; decay of all weights in a step, by the rate.
SHORT, DECAY = 0.15, 0.05
BYTES_AT_ONCE = 1 << 20


class Model:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, 0.4, s).astype(np.float32)
        self.p = {
            "emb": f(256, DEPTH), "w": f(WIDTH, DEPTH, FILTERS), "b": np.zeros(FILTERS, np.float32),
            "w2": f(2 * FILTERS, HIDDEN) * 0.5, "b2": np.zeros(HIDDEN, np.float32), "v": f(2 * HIDDEN) * 0.5, "c": np.zeros(1, np.float32),
        }

    def tables(self) -> np.ndarray:
        """A filter's response to each byte at each of its places: (WIDTH, 256, FILTERS)."""
        return np.einsum("bd,kdf->kbf", self.p["emb"], self.p["w"]).astype(np.float32)

    def units(self, pooled: np.ndarray) -> np.ndarray:
        """The second layer's units for chunks with these pooled responses: the largest, and the mean of the blocks'."""
        return np.maximum(pooled @ self.p["w2"] + self.p["b2"], 0)

    def train(self, docs: list[list[bytes]], y: np.ndarray, steps: int = STEPS, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in (0, 1)]
        p = self.p
        first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(i, BATCH // 2) for i in by])
            g = self.gradients([[c[: int(rng.integers(4, 80))] if rng.random() < SHORT else c for c in docs[i]] for i in pick], y[pick])
            rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
            for k in p:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.01 * (g[k] ** 2 - second[k])
                p[k] -= (rate * DECAY * p[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def gradients(self, docs: list[list[bytes]], y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss over documents of chunks (with a small decay of ``v``)."""
        size, p = BLOCK * SPAN, self.p
        chunks = [c for d in docs for c in d]
        counts = np.array([len(d) for d in docs])
        starts, owner = np.append(0, np.cumsum(counts))[:-1], np.repeat(np.arange(len(docs)), counts)
        x = np.zeros((len(chunks), size + WIDTH - 1), np.uint8)
        for row, c in enumerate(chunks):
            x[row, : len(c)] = np.frombuffer(c, np.uint8)
        tables = self.tables()
        conv = tables[0][x[:, :size]]
        for k in range(1, WIDTH):
            conv += tables[k][x[:, k : k + size]]
        conv = conv.reshape(len(x), SPAN, BLOCK, FILTERS)
        where = conv.argmax(2)
        tops = np.maximum(np.take_along_axis(conv, where[:, :, None], 2)[:, :, 0] + p["b"], 0)
        most, block = tops.max(1), tops.argmax(1)
        pooled = np.concatenate([most, tops.mean(1)], 1)
        unit = self.units(pooled)
        high, mean = np.maximum.reduceat(unit, starts), np.add.reduceat(unit, starts) / counts[:, None]
        feats = np.concatenate([high, mean], 1)
        d = (sigmoid(feats @ p["v"] + p["c"]) - y) / len(docs)
        g = {"v": feats.T @ d + 1e-4 * p["v"], "c": d.sum(keepdims=True)}
        d_feat = d[:, None] * p["v"]
        d_unit = d_feat[owner, HIDDEN:] / counts[owner][:, None] + d_feat[owner, :HIDDEN] * (unit == high[owner])
        d_unit = d_unit * (unit > 0)
        g["w2"], g["b2"] = pooled.T @ d_unit, d_unit.sum(0)
        d_pooled = d_unit @ p["w2"].T
        d_tops = np.repeat(d_pooled[:, None, FILTERS:] / SPAN, SPAN, 1)
        rows, filters = np.arange(len(x))[:, None], np.arange(FILTERS)[None]
        d_tops[rows, block, filters] += d_pooled[:, :FILTERS]
        d_tops *= tops > 0
        g["b"] = d_tops.sum((0, 1))
        d_tables = np.zeros_like(tables)
        at = where + (np.arange(SPAN) * BLOCK)[None, :, None]
        for k in range(WIDTH):
            code = x[rows[:, :, None], at + k].astype(np.int64) * FILTERS + filters[None]
            d_tables[k] = np.bincount(code.ravel(), d_tops.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        g["emb"] = np.einsum("kbf,kdf->bd", d_tables, p["w"])
        g["w"] = np.einsum("kbf,bd->kdf", d_tables, p["emb"])
        return g

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The probability of label 1 of each text, read from end to end."""
        blocks = np.array([max(SPAN, -(-(len(t) + WIDTH - 1) // BLOCK)) for t in texts])
        blocks += (SPAN - blocks) % STRIDE  # whole chunks: the last one ends with the last block
        starts = np.append(0, np.cumsum(blocks))
        flat = np.zeros(starts[-1] * BLOCK + WIDTH - 1, np.uint8)
        for t, s in zip(texts, starts * BLOCK):
            flat[s : s + len(t)] = np.frombuffer(t, np.uint8)
        tables, tops = self.tables(), np.empty((starts[-1], FILTERS), np.float32)
        last = np.sort((starts[1:, None] * BLOCK - np.arange(1, WIDTH)).ravel())  # padding from where filters see the next text
        step = 128  # blocks at a time, for the cache
        got, add = np.empty((step * BLOCK, FILTERS), np.float32), np.empty((step * BLOCK, FILTERS), np.float32)
        for at in range(0, starts[-1], step):
            n = (min(at + step, starts[-1]) - at) * BLOCK
            x = flat[at * BLOCK : at * BLOCK + n + WIDTH - 1]
            np.take(tables[0], x[:n], axis=0, out=got[:n], mode="clip")
            for k in range(1, WIDTH):
                np.take(tables[k], x[k : k + n], axis=0, out=add[:n], mode="clip")
                got[:n] += add[:n]
            got[last[np.searchsorted(last, at * BLOCK) : np.searchsorted(last, at * BLOCK + n)] - at * BLOCK] = -np.inf
            tops[at : at + step] = got[:n].reshape(-1, BLOCK, FILTERS).max(1)
        tops = np.maximum(tops + self.p["b"], 0)
        half = np.maximum.reduceat(tops, np.arange(0, len(tops), STRIDE))  # a document's blocks are a multiple of STRIDE
        pair = np.maximum(half, np.append(half[1:], half[-1:], 0))  # SPAN is two strides
        total = np.add.reduceat(tops, np.arange(0, len(tops), STRIDE))
        unit = self.units(np.concatenate([pair, (total + np.append(total[1:], total[-1:], 0)) / SPAN], 1))
        first, last = starts[:-1] // STRIDE, starts[1:] // STRIDE - 1
        most, mean = np.empty((len(texts), HIDDEN), np.float32), np.empty((len(texts), HIDDEN), np.float32)
        for i, (a, b) in enumerate(zip(first, last)):
            most[i], mean[i] = unit[a:b].max(0), unit[a:b].mean(0)
        return sigmoid(np.concatenate([most, mean], 1) @ self.p["v"] + self.p["c"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", sample: int = SAMPLE, steps: int = STEPS) -> Model | None:
    """A model of ``label`` (0 or 1), learned from the documents where ``allowed``; None without both kinds."""
    parts = []
    known = labels.filter(allowed & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("__y"))
    for k in (0, 1):
        parts.append(known.filter(F.col("__y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    picked = parts[0].unionByName(parts[1]).distinct()
    size, text = BLOCK * SPAN, F.coalesce(F.col("text"), F.lit(""))
    room = F.greatest(F.length(text) - size, F.lit(0)) + 1
    n = F.least(F.lit(CHUNKS), F.ceil(F.length(text) / size)).cast("int")
    starts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda j: (F.pmod(F.xxhash64("doc_id", j), room) + 1).cast("int"))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("__y", F.transform(starts, lambda s: F.substring(text, s, F.lit(size))).alias("chunks")).collect()
    rows = sorted((r["__y"], [c.encode()[:size] for c in r["chunks"]]) for r in rows)
    y = np.array([k for k, _ in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    model = Model()
    model.train([c for _, c in rows], y, steps)
    return model


def classify(docs: DataFrame, model: Model | None, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns (None: all), score and predicted (1 from ``threshold`` on) of each document."""
    added = ("score", "predicted")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            at = 0
            lengths = np.array([len(x or "") for x in batch.column(len(kept)).to_pylist()])
            while at < batch.num_rows:
                to = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), BYTES_AT_ONCE)))
                part, at = batch.slice(at, to - at), to
                texts = [(x or "").encode() for x in part.column(len(kept)).to_pylist()]
                score = net.score(texts).astype(np.float64) if net else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=[*kept, *added])

    return docs.select(*[docs[f"`{c}`"] for c in kept], docs["text"].alias(free(kept, "__text"))).mapInArrow(lean(run), schema)
