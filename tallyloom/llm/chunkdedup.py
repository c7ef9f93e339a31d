"""Substring deduplication by content-defined chunking with a gear rolling hash.

The gear hash of a position covers the last WINDOW bytes. A chunk starts where the hash is the smallest within RADIUS
bytes on either side and a character starts, so that boundaries follow from the bytes around them alone and shift with
them. Chunks are compared by a 128-bit digest; of all occurrences of a digest the first in the order of doc_id and place
stays. Repeated chunks go where a run of neighbouring ones has at least MIN_RUN bytes.

Equal chunks within a batch are resolved where they are read. Digests that repeat there are remembered for the rest of the
partition, so that a digest that a third of the rows hold is sent on about once for each partition only. Digests then meet
by their hash; repeated places are sent back to their documents.

Defined cases: null texts stay null; empty texts stay empty; a text that repeats earlier ones throughout becomes empty; very
long texts are hashed in segments, with the same boundaries; rows that repeat one another in doc_id and text count as one and
keep what it keeps; of equal doc_ids the smaller hash of id and text comes first; null ids come first; bytes without any
boundary are cut every MAX_CHUNK bytes; an empty table gives an empty result; input columns that have the names of added
ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free, lean
from .textnum import groups, stream

WINDOW, RADIUS, MAX_CHUNK, MIN_RUN = 16, 16, 1024, 96
#: Bytes of a text that are hashed at a time, and bytes before and after that their boundaries depend on.
SEGMENT, MARGIN = 1 << 20, 64
#: Bytes of texts whose equal chunks are resolved at once.
TOGETHER = 2 << 20
GEAR = stream(256, 21)
SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
LEAST = -(2**63)


def _boundaries(x: np.ndarray) -> np.ndarray:
    """Places in x where a chunk starts."""
    n = len(x)
    h = GEAR[x]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint64(k)) if k < n else h[k:]
    h *= SCRAMBLE
    h[(x & 0xC0) == 0x80] = NEVER
    m = np.full(n + 2 * RADIUS, NEVER)
    m[RADIUS : RADIUS + n] = h
    for k in (1, 2, 4, 8):
        m = np.minimum(m[:-k], m[k:])
    return np.flatnonzero((h < m[:n]) & (h <= m[RADIUS + 1 : RADIUS + 1 + n])) if n else np.empty(0, np.int64)


def cuts(text: bytes) -> np.ndarray:
    """The chunks' starts, and the text's length at the end."""
    x, n = np.frombuffer(text, np.uint8), len(text)
    if n <= SEGMENT:
        inner = _boundaries(x)
    else:
        found = []
        for s in range(0, n, SEGMENT):
            a = max(0, s - MARGIN)
            got = _boundaries(x[a : s + SEGMENT + MARGIN]) + a
            found.append(got[(got >= s) & (got < s + SEGMENT)])
        inner = np.concatenate(found)
    out = np.unique(np.concatenate([[0], inner, [n]])).astype(np.int64)
    if (np.diff(out) > MAX_CHUNK).any():
        more = [p for a, b in zip(out[:-1], out[1:]) if b - a > MAX_CHUNK for p in range(a + MAX_CHUNK, b, MAX_CHUNK)]
        starts = [next((q for q in range(p, p - 4, -1) if x[q] & 0xC0 != 0x80), p) for p in more]
        out = np.unique(np.concatenate([out, starts])).astype(np.int64)
    return out


def digests(text: bytes, at: np.ndarray) -> list[bytes]:
    new = hashlib.blake2b
    ends = at.tolist()
    return [new(text[a:b], digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:])]


def removed(at: np.ndarray, repeated: np.ndarray, least: int = MIN_RUN) -> np.ndarray:
    """Which chunks go: those in runs of repeated ones with enough bytes."""
    flag = np.zeros(len(at) - 1, bool)
    flag[repeated] = True
    edge = np.flatnonzero(np.diff(flag, prepend=False, append=False))
    for a, b in zip(edge[0::2], edge[1::2]):
        if at[b] - at[a] < least:
            flag[a:b] = False
    return flag


def _firsts(h1: np.ndarray, h2: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Which entries are the first of their digest in the given order."""
    by = np.lexsort((*order[::-1], h2, h1))
    a, b = h1[by], h2[by]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    out = np.empty(len(by), bool)
    out[by] = new
    return out


class Seen:
    """The first place sent so far of digests that repeat, in a table of fixed size; a digest takes the place of another one
    with the same slot."""

    SLOTS = 1 << 16

    def __init__(self):
        self.at = np.zeros(self.SLOTS, [("h1", "<u8"), ("h2", "<u8"), ("id", "<i8"), ("row", "<i8"), ("ord", "<i8")])
        self.at["id"] = np.iinfo(np.int64).max

    def later(self, e: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which entries (one for each digest) come after the place that is known of their digest."""
        known = self.at[(e["h1"] & np.uint64(self.SLOTS - 1)).astype(np.int64)]
        id_, row, ord_ = ids[e["doc"]], rows[e["doc"]], e["ord"]
        after = (id_ > known["id"]) | (id_ == known["id"]) & ((row > known["row"]) | (row == known["row"]) & (ord_ > known["ord"]))
        return (known["h1"] == e["h1"]) & (known["h2"] == e["h2"]) & after

    def add(self, e: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        new = np.empty(len(e), self.at.dtype)
        new["h1"], new["h2"], new["id"], new["row"], new["ord"] = e["h1"], e["h2"], ids[e["doc"]], rows[e["doc"]], e["ord"]
        self.at[(e["h1"] & np.uint64(self.SLOTS - 1)).astype(np.int64)] = new


def _mark_rows(ids: np.ndarray, rows: np.ndarray, ords: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(doc_id, row key, places) of each document."""
    by = np.lexsort((ords, rows, ids))
    i, r, o = ids[by], rows[by], ords[by].astype(np.int32)
    start = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (r[1:] != r[:-1]))) if len(by) else np.empty(0, int)
    end = np.append(start[1:], len(by)) if len(start) else start
    return [(int(i[a]), int(r[a]), o[a:b].tobytes()) for a, b in zip(start, end)]


ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i4"), ("ord", "<i4")])
WIRE = "bucket int, id long, row long, docs binary, entries binary"


def marks(docs: DataFrame) -> DataFrame:
    """__id, __row, places (binary, int32 each): the repeated chunks of documents (columns __id, __row, text)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for whole in batches:
            for part, texts in groups(whole, 2, TOGETHER):
                ids, rows = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                order = np.lexsort((rows, ids))
                keep = order[np.append(True, (ids[order][1:] != ids[order][:-1]) | (rows[order][1:] != rows[order][:-1]))]  # repeated rows once
                ids, rows = ids[keep], rows[keep]
                found, owner, place = [], [], []
                for d, i in enumerate(keep.tolist()):
                    if texts[i]:
                        got = digests(texts[i], cuts(texts[i]))
                        found += got
                        owner.append(np.full(len(got), d, np.int32))
                        place.append(np.arange(len(got), dtype=np.int32))
                if not found:
                    continue
                e = np.empty(len(found), ENTRY)
                pair = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
                e["h1"], e["h2"], e["doc"], e["ord"] = pair[:, 0], pair[:, 1], np.concatenate(owner), np.concatenate(place)
                first = _firsts(e["h1"], e["h2"], e["doc"], e["ord"])
                again, e = e[~first], e[first]
                late = seen.later(e, ids, rows)
                repeated = np.isin(e["h1"], again["h1"]) & ~late
                again, sent = np.concatenate([again, e[late]]), e[~late]
                seen.add(e[repeated], ids, rows)
                e = sent
                out = [(r % n, i, r, None, x) for i, r, x in _mark_rows(ids[again["doc"]], rows[again["doc"]], again["ord"])]
                bucket = (e["h1"] % np.uint64(n)).astype(np.int64)
                e = e[np.argsort(bucket, kind="stable")]
                for b, part_e in zip(range(n), np.split(e, np.cumsum(np.bincount(bucket, minlength=n))[:-1])):
                    if len(part_e):
                        used, local = np.unique(part_e["doc"], return_inverse=True)
                        part_e["doc"] = local
                        out.append((b, None, None, np.stack([ids[used], rows[used]], 1).tobytes(), part_e.tobytes()))
                cols = list(zip(*out))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["bucket", "id", "row", "docs", "entries"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs_of, base, passed = [], [], 0, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["docs"] is None:
                    passed.append((r["id"], r["row"], r["entries"]))
                    continue
                who, e = np.frombuffer(r["docs"], "<i8").reshape(-1, 2), np.frombuffer(r["entries"], ENTRY).copy()
                e["doc"] += base
                base += len(who)
                docs_of.append(who)
                held.append(e)
        if held:
            e, who = np.concatenate(held), np.concatenate(docs_of)
            _, one = np.unique(who, axis=0, return_inverse=True)  # the same row read twice is one
            one = one.reshape(-1)
            first = _firsts(e["h1"], e["h2"], one[e["doc"]], e["ord"])
            by = np.lexsort((e["h2"], e["h1"]))
            lead = np.empty(len(e), np.int64)
            start = np.flatnonzero(np.append(True, (e["h1"][by][1:] != e["h1"][by][:-1]) | (e["h2"][by][1:] != e["h2"][by][:-1])))
            lead_at = np.array([0]) if not len(start) else start
            firsts = by[first[by]]  # one for each digest, in the digests' order
            lead[by] = np.repeat(firsts, np.diff(np.append(lead_at, len(e))))
            same = (one[e["doc"]] == one[e["doc"][lead]]) & (e["ord"] == e["ord"][lead])
            again = e[~first & ~same]
            passed += _mark_rows(who[again["doc"], 0], who[again["doc"], 1], again["ord"])
        for at in range(0, len(passed), 10_000):
            cols = list(zip(*passed[at : at + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["__id", "__row", "places"])

    sent = docs.select("__id", "__row", "text").mapInArrow(lean(read), WIRE)
    return sent.repartitionById(n, F.col("bucket")).mapInArrow(lean(meet), "__id long, __row long, places binary")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The input's columns, text without what repeats, and n_chunks, n_removed (chunks), removed_bytes."""
    added = ("n_chunks", "n_removed", "removed_bytes")
    kept = [c for c in docs.columns if c.lower() not in added]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__doc"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("__id"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("__row"))
    found = marks(keyed).groupBy("__id", "__row").agg(F.collect_list("places").alias("__places"))
    rows = keyed.drop("text").join(found, ["__id", "__row"], "left").select(*[F.col("__doc")[c].alias(c) for c in kept], F.col("__places").alias(free(kept, "__places")))
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in added])
    at = kept.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, raws in groups(whole, at):
                texts, places, counts = part.column(at).to_pylist(), part.column(len(kept)).to_pylist(), []
                for i, (raw, where) in enumerate(zip(raws, places)):
                    c = cuts(raw) if raw else np.zeros(1, np.int64)
                    gone = removed(c, np.concatenate([np.frombuffer(x, np.int32) for x in where])) if where else np.zeros(0, bool)
                    if gone.any():
                        texts[i] = b"".join(raw[a:b] for a, b, g in zip(c[:-1].tolist(), c[1:].tolist(), gone) if not g).decode()
                    counts.append((len(c) - 1, int(gone.sum()), int(np.diff(c)[gone].sum()) if gone.any() else 0))
                cols = [part.column(i) for i in range(len(kept))]
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(list(x), pa.int64()) for x in zip(*counts))], names=[*kept, *added])

    return rows.mapInArrow(lean(clean), schema)
