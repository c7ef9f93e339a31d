"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Each occurrence of an
anchor (a common word) with the next CHAIN content words after it is a signature, kept as 32 bits of its hash; a
document's fingerprint is the set of its signatures, in ascending order, as hexadecimal digits, eight for each. Two
fingerprints are as alike as the Jaccard similarity of their sets.

A text without any such chain has the chains of three neighbouring words instead, or else its whole sequence of words,
or else its bytes, as one signature; so no fingerprint is empty and equal texts have equal ones.

Fingerprints that are alike from 0.8 on are grouped: sets are partitioned by length so that partners stand in the same partition
or the next, each partition has inverted lists of the rarest signatures of its sets, and sets that meet in one are compared
if neither their lengths nor maps of their signatures exclude it (``near_duplicates``).

Defined cases: null texts are empty; very long texts have all their signatures; null ids come first and have no group; rows
of one id follow the order of their texts' hashes and are in one group; repeated rows are each in the result; the only row of a
table is its own next document; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .setjoin import join
from .shared import erase, lean, written
from .textnum import groups, mixed, stream, words

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she so that the their them there they this to was we were which with you "
    "als am auch auf aus bei das dem den der des die ein eine einen er es für haben hat ich ihr im ist mit nach nicht noch oder sich sie sind so um und von war wie wir zu zum zur über "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour que qui sa se ses son sur un une vous à été être "
    "al como con de del el en es ese esta este ha la las lo los más me mi no nos o para pero por que se si sin su sus también un una uno y ya"
).split()
CHAIN = 2
#: Bytes of texts that are fingerprinted at a time.
BYTES_AT_ONCE = 2 << 20
#: Between words: ASCII but for letters and digits.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
KEYS = stream(CHAIN + 2, 31) | np.uint64(1)
ANCHOR_CODES = np.unique(words([a.encode() for a in ANCHORS], BETWEEN)[0])
LEAST = -(2**63)


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """The signatures of each text: distinct, ascending, uint32."""
    w, first = words(texts, BETWEEN)
    at = np.searchsorted(ANCHOR_CODES, w)
    anchor = ANCHOR_CODES[np.minimum(at, len(ANCHOR_CODES) - 1)] == w
    content, spots = np.flatnonzero(~anchor), np.flatnonzero(anchor)
    owner = np.searchsorted(first, spots, side="right") - 1
    k = np.searchsorted(content, spots)
    last = k + CHAIN - 1
    fits = np.zeros(len(spots), bool)
    fits[last < len(content)] = True
    fits[fits] = content[last[fits]] < first[owner[fits] + 1]
    spots, owner, k = spots[fits], owner[fits], k[fits]
    total = w[spots] * KEYS[0]
    for j in range(CHAIN):
        total = total + w[content[k + j]] * KEYS[1 + j]
    both = np.unique(owner.astype(np.uint64) << np.uint64(32) | mixed(total) >> np.uint64(32))
    ends = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    sigs = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = []
    for i, text in enumerate(texts):
        a, b = int(ends[i]), int(ends[i + 1])
        out.append(sigs[a:b] if b > a else _plain(w[first[i] : first[i + 1]], text))
    return out


def _plain(w: np.ndarray, text: bytes) -> np.ndarray:
    if len(w) >= 3:
        total = w[:-2] * KEYS[0] + w[1:-1] * KEYS[1] + w[2:] * KEYS[2]
        return np.unique((mixed(total + np.uint64(1)) >> np.uint64(32)).astype(np.uint32))
    if len(w):
        return (mixed((w * KEYS[: len(w)]).sum(keepdims=True) + np.uint64(2)) >> np.uint64(32)).astype(np.uint32)
    return np.frombuffer(hashlib.blake2b(text, digest_size=4).digest(), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """The Jaccard similarity; 0 where the lengths alone show it to be below ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / (len(a) + len(b) - both)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's signatures, four bytes each, in place of its text."""
    for whole in batches:
        for part, texts in groups(whole, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f.tobytes() for f in fingerprints(texts)], pa.binary())], names=["doc_id", "text"])


def _unpacked(texts: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint32).astype(np.uint64) for t in texts]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_signatures and component_id (the smallest doc_id that links reach) of each document; fingerprints link from
    a likeness of 0.8 on. The signatures are computed once and written; all passes of the join read them, not the texts."""
    sigs = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_packed), "doc_id long, text binary"), "signatures")
    out = join(sigs, _unpacked, by_length=True).withColumnRenamed("n_shingles", "n_signatures")
    erase(sigs)
    return out


def as_text(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the text replaced by as much of the start of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long, component_id long"
SENT = "part int, ahead boolean, doc_id long, k long, text boolean, tie long, packed binary"


def fingerprint(docs: DataFrame) -> DataFrame:
    """``with_next`` with each document's group of near duplicates among all documents."""
    return with_next(docs, near_duplicates(docs))


def with_next(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Fingerprints of all documents and of their texts edited with the next document's; component_id from ``groups``
    (doc_id, component_id), if given.

    Rows are dealt into ranges of doc_id that start at ids that occur, so the first row of a range is known; it is sent
    to the range before as well, as that range's last next document. Texts move once, compressed. Groups are dealt alike, a row
    for each id before its texts."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    shares = [i / n for i in range(1, n)] or [0.5]
    row = docs.select(key.alias("k")).agg(F.percentile_approx("k", shares, 10_000).alias("b"), F.min("k").alias("low")).first()
    low = row["low"]
    starts = np.array(sorted({b for b in row["b"] or [] if b > low}), np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                keys = batch.column(1).to_numpy(zero_copy_only=False)
                texts = pa.array([pack((x or "").encode()) for x in batch.column(3).to_pylist()], pa.binary())
                part = np.searchsorted(starts, keys, side="right")
                ahead = np.where(keys == low, len(starts), np.where(np.isin(keys, starts), part - 1, -1))
                again = np.flatnonzero(ahead >= 0)
                for index, to, flag in ((np.arange(len(keys)), part, False), (again, ahead[again], True)):
                    if len(index):
                        take = pa.array(index)
                        cols = [pa.array(to.astype(np.int32)), pa.array(np.full(len(index), flag)), batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(index), True)), batch.column(2).take(take), texts.take(take)]
                        yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SENT.split(", ")])

    def send_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids = batch.num_rows, batch.column(0)
            part = np.searchsorted(starts, ids.to_numpy(zero_copy_only=False), side="right").astype(np.int32)
            no = pa.array(np.full(n, False))
            yield pa.RecordBatch.from_arrays([pa.array(part), no, ids, ids, no, batch.column(1), pa.nulls(n, pa.binary())], names=[c.split()[0] for c in SENT.split(", ")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple[int | None, str, int | None]] = []  # each but the last has its next document behind it
        size, group = 0, (None, None)

        def flush(closing: str | None):
            nonlocal size
            texts = [t for _, t, _ in held]
            nexts = texts[1:] + ([closing] if closing is not None else [])
            done = held[: len(nexts)]
            changed = [edited(t, x).encode() for (_, t, _), x in zip(done, nexts)]
            own = fingerprints([t.encode() for t in (texts if closing is None else texts + [closing])])
            theirs = fingerprints(changed)
            cols = [
                pa.array([i for i, _, _ in done], pa.int64()), pa.array([len(t) for _, t, _ in done], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
                pa.array([as_text(f) for f in own[: len(done)]], pa.string()), pa.array([as_text(f) for f in theirs], pa.string()),
                pa.array([likeness(f, g) for f, g in zip(own, theirs)], pa.float64()), pa.array([likeness(f, g) for f, g in zip(own, own[1:])][: len(done)], pa.float64()),
                pa.array([len(f) for f in own[: len(done)]], pa.int64()), pa.array([g for _, _, g in done], pa.int64()),
            ]
            del held[: len(done)]
            size = sum(len(t) for _, t, _ in held)
            return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])

        part = None
        for batch in batches:
            for p, ahead, i, text, tie, packed in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5, 6))):
                if not text:
                    group = (i, tie)
                    continue
                text = unpack(packed).decode()
                if ahead:
                    if held and p == part:
                        yield flush(text)
                    held.clear()
                    size = 0
                    continue
                part = p
                held.append((i, text, group[1] if i is not None and i == group[0] else None))
                size += len(text)
                if size > BYTES_AT_ONCE and len(held) > 1:
                    yield flush(None)

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("k"), F.xxhash64("text").alias("tie"), "text").mapInArrow(lean(send), SENT)
    if groups is not None:
        ids = groups.filter("doc_id IS NOT NULL").select("doc_id", "component_id").distinct()
        sent = sent.unionByName(ids.mapInArrow(lean(send_groups), SENT))
    dealt = sent.repartitionById(len(starts) + 1, F.col("part")).sortWithinPartitions("part", "ahead", "k", "text", "tie")
    return dealt.mapInArrow(lean(compare), SCHEMA)
