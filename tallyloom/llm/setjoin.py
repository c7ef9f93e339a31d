"""N-gram Jaccard join: a size-aware heavy-light join of the documents' sets of word shingles.

Two sets of sizes n and m link when 5 |A and B| >= 4 |A or B|, so they share at least ceil(4 (n + m) / 9) shingles.
Equal sets are one class and are joined once.

* Light sets (size up to the boundary): for each size m that may link, all subsets of the fixed size ceil(4 (n + m) / 9)
  are enumerated; two light sets link exactly when they meet in a subset.
* Heavy sets scan inverted lists. Shingles have one global order, the frequent ones last. A set stands in the lists of
  its first n - ceil(8 n / 9) + 1 shingles and scans those of its first n - ceil(4 n / 5) + 1; two sets that link with
  a heavy one meet in such a list. All candidates, light ones too, are verified on their whole sets.
* The boundary is the size with the least cost, by the counts of sets of each size.

A long list is not expanded into pairs: its members are first compared with one of them, then with a few members of its
largest component; only those that stay outside are compared with the others, by whole sets and only until they are joined,
so that no more links than components leave a block. So components are exact, and copies stay cheap.
The lists of shingles that are counted often are dealt out over several tasks, each of which compares its own part first.

Defined cases: null texts and texts without words have empty sets and link with nothing; very long texts have all their
shingles; rows with a null id have a size and no component; rows of one id are one document, with all their texts; repeated
rows are each in the result; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, erase, lean, written
from .textnum import groups, mixed, shingle_sets, stream

WIDTH = 5
#: From texts to their sets: distinct, ascending, uint64.
Sets = Callable[[list[bytes]], list[np.ndarray]]
#: The largest boundary that is weighed; cost of a verified set, in list entries.
MOST_LIGHT, VERIFY = 12, 24
#: Shingles are counted over so many at a time; those found this often at once may go last in the order, at most so many.
COUNTED, OFTEN, LAST = 3_000_000, 3, 200_000
#: Lists with more sets are compared with one of them first; lists of shingles counted so often are split.
LONG, SPLIT = 32, 100_000
#: Members that then stand for their list in each further round, rounds, pairs below which rounds end, and members in a block.
HUBS, ROUNDS, FEW, BLOCK = 4, 4, 1_000, 2_048
#: The most bytes of sets in a block, about.
BLOCK_BYTES = 32 << 20
#: Parts that a list's members are dealt into when they meet its hubs.
SALTS = 16
#: Places of a map of ids for each id, and the most places (32 MB); beyond, rows and ids are joined.
PLACES, MOST_PLACES = 16, 1 << 28
ENTRY = np.dtype([("key", "<u8"), ("cls", "<i4"), ("flag", "u1")])
INDEX, SCAN, SUBSET, LEVEL, PART = 1, 2, 4, 8, 16
NONE = np.empty(0, np.uint64)


def word_shingles(texts: list[bytes]) -> list[np.ndarray]:
    return shingle_sets(texts, WIDTH)


def overlap(n: int, m: int) -> int:
    """The least number of common shingles of sets that link."""
    return -(-4 * (n + m) // 9)


def partners(n: int) -> range:
    """Sizes that can link with size n."""
    return range(-(-4 * n // 5), 5 * n // 4 + 1)


def indexed(n: int) -> int:
    return n - -(-8 * n // 9) + 1


def scanned(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def boundary(counts: dict[int, int]) -> int:
    """The largest light size: the one with the least cost over sets with these counts by size (up to 5/4 MOST_LIGHT)."""

    def cost(b: int) -> float:
        total = 0.0
        for n, c in counts.items():
            if n <= b:
                total += c * sum(math.comb(n, overlap(n, m)) for m in partners(n) if m <= b)
                total += c * indexed(n) * (5 * n >= 4 * (b + 1))
            else:
                total += c * (scanned(n) + VERIFY)
        return total

    return min(range(MOST_LIGHT + 1), key=lambda b: (cost(b), b))


@lru_cache(maxsize=256)
def _picks(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(-1, k)


_POWERS = stream(64, 41) | np.uint64(1)


def subset_keys(s: np.ndarray, light: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for each subset of a light set, for each size of partner, and its flag: LEVEL if the sizes are equal."""
    out, flags = [NONE], [np.empty(0, np.uint8)]
    for m in partners(len(s)):
        if m <= light:
            k = overlap(len(s), m)
            tag = np.uint64(min(len(s), m) * 64 + max(len(s), m))
            out.append(mixed((s[_picks(len(s), k)] * _POWERS[:k]).sum(1) + mixed(np.array([tag]))))
            flags.append(np.full(len(out[-1]), SUBSET | (LEVEL if m == len(s) else 0), np.uint8))
    return np.concatenate(out), np.concatenate(flags)


class Order:
    """The global order of shingles: by hash, but those in ``last`` come last, the rarer before the more frequent."""

    def __init__(self, last: np.ndarray, counts: np.ndarray):
        by = np.argsort(last)
        self.last, self.counts = last[by], counts[by]

    def first(self, s: np.ndarray, k: int) -> np.ndarray:
        """The first k shingles of a sorted set."""
        if not len(self.last):
            return s[:k]
        at = np.minimum(np.searchsorted(self.last, s), len(self.last) - 1)
        late = self.last[at] == s
        early = s[~late]
        if len(early) >= k:
            return early[:k]
        rest, often = s[late], self.counts[at[late]]
        return np.concatenate([early, rest[np.lexsort((rest, often))]])[:k]


    def parts(self, x: np.ndarray) -> np.ndarray:
        """How many parts the list of each shingle is dealt into."""
        if not len(self.last):
            return np.ones(len(x), np.uint64)
        at = np.minimum(np.searchsorted(self.last, x), len(self.last) - 1)
        return np.where(self.last[at] == x, 1 + self.counts[at] // SPLIT, 1).astype(np.uint64)


def length_parts(n: int) -> int:
    """The partition of a set's length: one ends where its first length's longest partner does."""
    k, low = 0, 1
    while (high := 5 * low // 4 + 1) <= n:
        k, low = k + 1, high
    return k


def _digest(s: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def row_key() -> Column:
    """The key of a row's doc_id and text. A class of equal sets is named by the smallest key of its rows."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _sizes(docs: DataFrame, make: Sets) -> DataFrame:
    """A row for each document (kind 0: doc_id, row key, n, class) and for each shingle that is often met at once (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        count = 0

        def often() -> pa.RecordBatch:
            x = np.concatenate([NONE, *held])
            x.sort()
            start = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, int)
            times = np.diff(np.append(start, len(x)))
            pick = times >= OFTEN
            k = int(pick.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(times[pick].astype(np.int64)), pa.array(x[start[pick]].view(np.int64)), pa.array(np.zeros(k, np.int64))], names=names)

        names = ["kind", "doc_id", "row", "n", "c1", "c2"]
        for whole in batches:
            for part, texts in groups(whole, 2):
                sets = make(texts)
                cls = [_digest(s) for s in sets]
                for s, c in zip(sets, cls):
                    if c not in seen:
                        seen.add(c)
                        held.append(s)
                        count += len(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([c[0] for c in cls], pa.int64()), pa.array([c[1] for c in cls], pa.int64())], names=names)
                if count >= COUNTED:
                    yield often()
                    held.clear()
                    seen.clear()
                    count = 0
        yield often()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text").mapInArrow(lean(run), "kind int, doc_id long, row long, n long, c1 long, c2 long")


def _pairs(n: np.ndarray, flag: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of entries can link: the smaller set is indexed, the larger one scans, the sizes fit."""
    swap = n[a] > n[b]
    s, r = np.where(swap, b, a), np.where(swap, a, b)
    one = (flag[s] & INDEX > 0) & (flag[r] & SCAN > 0)
    other = (n[s] == n[r]) & (flag[r] & INDEX > 0) & (flag[s] & SCAN > 0)
    return (one | other) & (5 * n[s] >= 4 * n[r])


def _meet(e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all entries of some keys: candidate pairs of classes, pairs that met in a subset, and (key, class) of long lists and
    of those that are dealt into parts."""
    e = e[np.lexsort((e["cls"], e["key"]))]
    if len(e):
        e = e[np.append(True, (e["key"][1:] != e["key"][:-1]) | (e["cls"][1:] != e["cls"][:-1]))]
    start = np.flatnonzero(np.append(True, e["key"][1:] != e["key"][:-1])) if len(e) else np.empty(0, int)
    size = np.diff(np.append(start, len(e)))
    size_of, flag, cls = n[e["cls"]], e["flag"], e["cls"].astype(np.int64)
    subset = (flag[start] & SUBSET) > 0 if len(e) else np.empty(0, bool)
    long_ = ((size > LONG) | (flag[start] & PART > 0)) & ~subset if len(e) else np.empty(0, bool)
    found, links, long = [], [], []
    for k in np.unique(size[(size > 1) & ~long_ & ~subset]).tolist():
        at = start[(size == k) & ~long_ & ~subset]
        i, j = np.triu_indices(k, 1)
        for c in range(0, len(at), max(1, 500_000 // len(i))):
            part = at[c : c + max(1, 500_000 // len(i))]
            a, b = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
            ok = _pairs(size_of, flag, a, b)
            found.append(np.stack([cls[a[ok]], cls[b[ok]]], 1))
    for g in np.flatnonzero(long_).tolist():
        rows = np.arange(start[g], start[g] + size[g])
        rows = rows[np.lexsort((cls[rows], size_of[rows]))]
        sizes, hub = size_of[rows], 0
        while hub < len(rows):  # each set that is small enough with one, then from the first that is too large on
            to = int(np.searchsorted(sizes, 5 * sizes[hub] // 4, side="right"))
            found.append(np.stack([np.full(to - hub - 1, cls[rows[hub]]), cls[rows[hub + 1 : to]]], 1))
            hub = to
        long.append(np.stack([np.full(len(rows), e["key"][start[g]].view(np.int64)), cls[rows]], 1))
    for g in np.flatnonzero((size > 1) & subset).tolist():
        rows = np.arange(start[g], start[g] + size[g])
        lo, hi = size_of[rows].min(), size_of[rows].max()
        if lo == hi and not flag[start[g]] & LEVEL:
            continue  # sets of one size that meet in a subset meant for another size
        low, high = cls[rows[size_of[rows] == lo]], cls[rows[size_of[rows] == hi]]
        links.append(np.stack([np.full(len(high), low[0]), high], 1))
        if lo != hi:
            links.append(np.stack([np.full(len(low), high[0]), low], 1))
    pairs = lambda x: np.unique(np.sort(np.concatenate([np.empty((0, 2), np.int64), *x]), 1), axis=0)
    found, links = pairs(found), pairs(links)
    return found[found[:, 0] != found[:, 1]], links[links[:, 0] != links[:, 1]], np.concatenate([np.empty((0, 2), np.int64), *long])


def _join(docs: DataFrame, light: int, order: Order, make: Sets, by_length: bool) -> DataFrame:
    """kind 0: candidate pairs of classes, kind 1: pairs that met in a subset, kind 2: (list, class) of long lists.
    ``by_length``: sets are partitioned by length, with lists of their own; a set scans its own partition and the one
    before, where the shorter sets that it can link with are."""
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts_of = shared.value.first, shared.value.parts
        for whole in batches:
            for _, texts in groups(whole, 0):
                known: dict[tuple[int, int], int] = {}
                table, keys, flags, salts = [], [], [], []
                for s in make(texts):
                    n = len(s)
                    if not n or (c := _digest(s)) in known:
                        continue
                    known[c] = len(table)
                    table.append((*c, n))
                    k, f = NONE, np.empty(0, np.uint8)
                    if n <= light:
                        k, f = subset_keys(s, light)
                    salt = np.zeros(len(k), np.uint64)
                    if 5 * n >= 4 * (light + 1):
                        p, i = (scanned(n) if n > light else 0), indexed(n)
                        got = first(s, max(p, i))
                        f2 = np.zeros(len(got), np.uint8)
                        f2[:p] |= SCAN
                        f2[:i] |= INDEX
                        dealt = parts_of(got)
                        f2[dealt > 1] |= PART
                        dealt = np.uint64(c[0] % (1 << 63)) % dealt
                        if by_length:
                            here = length_parts(n)
                            before = got[:p] if here else NONE
                            got = np.concatenate([mixed(got + np.uint64(here)), mixed(before + np.uint64(here - 1) if here else NONE)])
                            f2 = np.concatenate([f2, f2[: len(before)] & np.uint8(SCAN | PART)])
                            dealt = np.concatenate([dealt, dealt[: len(before)]])
                        k, f, salt = np.concatenate([k, got]), np.concatenate([f, f2]), np.concatenate([salt, dealt])
                    keys.append(k)
                    flags.append(f)
                    salts.append(salt)
                if not table:
                    continue
                e = np.empty(sum(map(len, keys)), ENTRY)
                e["key"], e["flag"] = np.concatenate(keys), np.concatenate(flags)
                e["cls"] = np.repeat(np.arange(len(table)), [len(k) for k in keys])
                part = ((mixed(e["key"]) + np.concatenate(salts)) % np.uint64(n_parts)).astype(np.int64)
                e = e[np.argsort(part, kind="stable")]
                table, out = np.array(table, np.int64), []
                for b, x in enumerate(np.split(e, np.cumsum(np.bincount(part, minlength=n_parts))[:-1])):
                    if len(x):
                        used, local = np.unique(x["cls"], return_inverse=True)
                        x["cls"] = local
                        out.append((b, table[used].tobytes(), x.tobytes()))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["bucket", "classes", "entries"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, base = [], [], 0
        for batch in batches:
            for c, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                t, e = np.frombuffer(c, "<i8").reshape(-1, 3), np.frombuffer(x, ENTRY).copy()
                e["cls"] += base
                base += len(t)
                tables.append(t)
                held.append(e)
        if not held:
            return
        t, e = np.concatenate(tables), np.concatenate(held)
        del tables, held
        by = np.lexsort((t[:, 1], t[:, 0]))
        new = np.append(True, (t[by][1:, :2] != t[by][:-1, :2]).any(1))
        one = np.empty(len(t), np.int64)
        one[by] = np.cumsum(new) - 1
        t = t[by[new]]
        e["cls"] = one[e["cls"]]
        found, links, long = _meet(e, t[:, 2])
        for kind, x in ((0, found), (1, links), (2, long)):
            for at in range(0, len(x), 50_000):
                a, b = x[at : at + 50_000, 0], x[at : at + 50_000, 1]
                left = np.stack([a, a * 0], 1) if kind == 2 else t[a, :2]
                cols = [pa.array(np.full(len(a), kind, np.int32)), pa.array(left[:, 0]), pa.array(left[:, 1]), pa.array(t[b, 0]), pa.array(t[b, 1])]
                yield pa.RecordBatch.from_arrays(cols, names=["kind", "a1", "a2", "b1", "b2"])

    sent = docs.filter("doc_id IS NOT NULL").select("text").mapInArrow(lean(send), "bucket int, classes binary, entries binary")
    return sent.repartitionById(n_parts, F.col("bucket")).mapInArrow(lean(meet), "kind int, a1 long, a2 long, b1 long, b2 long")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= 80 * (len(a) + len(b) - both)


def parity(s: np.ndarray) -> bytes:
    """A bit map of about as many bits as the set has shingles: each shingle turns one over. Two sets differ in at least
    as many shingles as their maps differ in bits."""
    bits = 1 << max(6, int(len(s)).bit_length())
    count = np.bincount((mixed(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(count & 1).tobytes()


def may_link(n: int, m: int, x: bytes, y: bytes) -> bool:
    """False only if the maps show that the sets differ in more than (n + m) / 9 shingles."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):  # the longer map, folded, is that of its set with fewer bits: places are taken mod a power of 2
        if len(a) > len(b):
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        else:
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return 9 * int(np.bitwise_count(a ^ b).sum()) <= n + m


def _sets_of(docs: DataFrame, ids: DataFrame, whole: bool, make: Sets) -> DataFrame:
    """id, n and the set (``whole``) or its bit map of the rows with the keys in ``ids`` (id), and of a few others: keys are
    told by a bit of a map of PLACES bits for each, which is broadcast, so that no text is shuffled."""
    ids = ids.distinct()
    places = max(1 << 20, 1 << (PLACES * ids.count()).bit_length())
    rows = docs.filter("doc_id IS NOT NULL").select(row_key().alias("id"), "text")
    shared = None
    if places <= MOST_PLACES:
        place = F.pmod(F.xxhash64("id"), F.lit(places))
        told = ids.select(place.alias("p")).groupBy((F.col("p") / 32768).cast("int").alias("k")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("m")).collect()
        bits = np.zeros((places // 32768, 4096), np.uint8)
        for r in told:
            bits[r["k"]] = np.frombuffer(bytes(r["m"]), np.uint8)
        shared = docs.sparkSession.sparkContext.broadcast(bits)
        rows = rows.withColumn("p", place)
    else:
        rows = rows.join(ids, "id", "left_semi").withColumn("p", F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of repeated rows, one for each partition
        for batch in batches:
            if shared is not None:
                p = batch.column(2).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(shared.value.reshape(-1)[p >> 3] >> (p & 7) & 1 == 1))
            fresh = []
            for i in batch.column(0).to_pylist():
                fresh.append(i not in seen)
                seen.add(i)
            chosen = batch.filter(pa.array(fresh, pa.bool_()))
            if chosen.num_rows:
                for part, texts in groups(chosen, 1):
                    sets = make(texts)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() if whole else parity(x) for x in sets], pa.binary())], names=["id", "n", "s"])

    return rows.mapInArrow(lean(run), "id long, n long, s binary")


def _likely(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (a, b) that their bit maps don't exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_link(*x) for x in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    maps = maps.dropDuplicates(["id"])
    side = lambda k: maps.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("s").alias(f"s{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean(run), "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets (id, s) link, as u, v."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(alike(a, b))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    s = sets.dropDuplicates(["id"])
    both = pairs.join(s.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(lean(check), "a long, b long").toDF("u", "v").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def _placed(found: DataFrame, node: str, component: str) -> DataFrame:
    return found.select(F.col("node").alias(node), F.col("component").alias(component))


def _fits(i: int, others: np.ndarray, n: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
    """Which of the others' sizes and maps don't exclude a link with member i."""
    ok = np.zeros(len(others), bool)
    sized = (5 * n[others] >= 4 * n[i]) & (5 * n[i] >= 4 * n[others])
    widths = np.array([len(maps[j]) for j in others])
    for w in np.unique(widths[sized]).tolist():
        at = np.flatnonzero(sized & (widths == w))
        mine, theirs = maps[i], np.stack([maps[j] for j in others[at]])
        while len(mine) > theirs.shape[1]:
            mine = mine[: len(mine) // 2] ^ mine[len(mine) // 2 :]
        while theirs.shape[1] > len(mine):
            half = theirs.shape[1] // 2
            theirs = theirs[:, :half] ^ theirs[:, half:]
        ok[at] = 9 * np.bitwise_count(mine ^ theirs).sum(1, dtype=np.int64) <= n[i] + n[others[at]]
    return ok


def _mains(placed: DataFrame) -> DataFrame:
    """Members of lists with several components: list, id, n, c, and the list's largest component, main."""
    sizes = placed.groupBy("list", "c").agg(F.count("*").alias("k"))
    main = sizes.groupBy("list").agg(F.max(F.struct("k", "c")).alias("m"), F.count("*").alias("kinds")).filter("kinds > 1").select("list", F.col("m.c").alias("main"))
    return placed.join(main, "list")


def _with_hubs(inside: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of HUBS members of a list's largest component, others each ``turn``, with all members outside it."""
    rank = F.row_number().over(Window.partitionBy("list").orderBy(F.xxhash64("id"), "id"))
    ranked = inside.filter("c = main").withColumn("r", rank).filter(F.col("r") <= (turn + 1) * HUBS)
    hubs = ranked.filter(F.col("r") > turn * HUBS).select("list", F.col("id").alias("hub"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    others = inside.filter("c <> main").select("list", "id", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    both = others.join(hubs, ["list", "salt"])
    return both.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _forest(of: range, ids: np.ndarray, c: np.ndarray, n: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all components (c) which links between a member in ``of`` and any member reach: no more links than
    components. Members that are joined by then are not compared."""
    bits, out = [np.frombuffer(parity(s), np.uint8) for s in sets], []
    c = np.unique(c, return_inverse=True)[1]
    for i in of:
        found = np.flatnonzero(c != c[i])
        for j in found[_fits(i, found, n, bits)]:
            if c[i] != c[j] and alike(sets[i], sets[j]):
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                c[c == c[j]] = c[i]
    return out


def _outside(inside: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) that join members outside the list's largest component with all that they link with in the list. Both
    sides are cut into blocks, by members and by bytes; each block of one meets each block of the other, with whole sets."""
    far = F.col("c") != F.col("main")
    blocks = lambda k, size: F.ceil(F.greatest(k / BLOCK, F.coalesce(size, F.lit(0)) * 8 / BLOCK_BYTES)).cast("int")
    counts = inside.groupBy("list").agg(blocks(F.count_if(far), F.sum(F.when(far, F.col("n")))).alias("ln"), blocks(F.count("*"), F.sum("n")).alias("rn"))
    rows = inside.join(counts, "list").join(sets.select("id", "s").dropDuplicates(["id"]), "id")
    own, each = (lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")), (lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1)))
    names = ["list", "l", "r", "id", "n", "c", "s"]
    some = rows.filter(far).withColumn("l", own("ln")).withColumn("r", each("rn")).select(*names)
    others = rows.withColumn("r", own("rn")).withColumn("l", each("ln")).select(*names).toDF(*[f"other_{k}" for k in names])

    def run(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        t = pd.concat([x, y.set_axis(names, axis=1)], ignore_index=True)
        sets_of = [np.frombuffer(s, np.uint64) for s in t["s"]]
        found = _forest(range(len(x)), *(t[k].to_numpy() for k in ("id", "c", "n")), sets_of)
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    theirs = others.groupBy("other_list", "other_l", "other_r")
    return some.groupBy("list", "l", "r").cogroup(theirs).applyInPandas(run, "u long, v long").distinct()


def _of_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between the classes of each doc_id that has several: of the first with all others."""
    cls = F.struct("c1", "c2")
    several = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(cls).alias("lo"), F.max(cls).alias("hi")).filter("lo <> hi")
    several = written(several.select("doc_id", F.col("lo.c1").alias("u1"), F.col("lo.c2").alias("u2")), "several")
    both = rows.filter("n > 0").join(several, "doc_id").filter("c1 <> u1 OR c2 <> u2").select("u1", "u2", "c1", "c2").distinct()
    first = classes.select(F.col("c1").alias("u1"), F.col("c2").alias("u2"), F.col("node").alias("u"))
    return both.join(first, ["u1", "u2"]).join(classes.select("c1", "c2", F.col("node").alias("v")), ["c1", "c2"]).select("u", "v")


def _grouped(docs: DataFrame, make: Sets, by_id: bool, by_length: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, row, n, c1, c2), classes (c1, c2, node, rep, n) and the component of each node that has links (node,
    component). ``by_id``: the texts of one doc_id are linked with each other. ``by_length``: all sets are compared in
    partitions by length, none by subsets."""
    seen = written(_sizes(docs, make), "sizes")
    rows = seen.filter("kind = 0").select("doc_id", "row", "n", "c1", "c2")
    often = seen.filter("kind = 1").groupBy("c1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c1").limit(LAST).toPandas()
    order = Order(often["c1"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64))
    classes = written(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("c1", "c2").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep"), F.min("n").alias("n")), "classes")
    light = 0
    if not by_length:
        light = boundary({r["n"]: r["c"] for r in classes.filter(F.col("n") <= 2 * MOST_LIGHT).groupBy("n").agg(F.count("*").alias("c")).collect()})
    met = written(_join(docs, light, order, make, by_length), "met")
    of = lambda side: classes.select(F.col("c1").alias(f"{side}1"), F.col("c2").alias(f"{side}2"), F.col("node").alias(side), F.col("n").alias(f"n_{side}"))
    named = met.filter("kind < 2").join(of("a"), ["a1", "a2"]).join(of("b"), ["b1", "b2"])
    pairs = written(named.select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").groupBy("a", "b").agg(F.max("kind").alias("kind")), "pairs")
    lists = written(met.filter("kind = 2").select(F.col("a1").alias("list"), "b1", "b2").join(of("b"), ["b1", "b2"]).select("list", F.col("b").alias("id"), F.col("n_b").alias("n")).distinct(), "lists")
    erase(met)
    docs.sparkSession._jvm.System.gc()  # lets the context's cleaner delete the shuffles of the jobs that are done
    maps = written(_sets_of(docs, _ends(pairs).unionByName(lists.select("id")), False, make), "maps")
    likely = written(_likely(pairs.select("a", "b"), maps), "likely")
    sets = written(_sets_of(docs, _ends(likely), True, make), "sets")
    held = [sets]
    # one candidate of each class and those that met in a subset first; of the rest, only those that are still apart
    met_in_subset = pairs.filter("kind = 1").select("a", "b").join(likely, ["a", "b"], "left_semi")
    first = written(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(met_in_subset).distinct(), "first")
    links = [written(_verified(first, sets), "links")]
    if by_id:
        links.append(written(_of_ids(rows, classes), "links"))
    whole = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(whole(parts[1:]))
    found = components(whole(links))
    apart = lambda df: df.join(_placed(found, "a", "ca"), "a", "left").join(_placed(found, "b", "cb"), "b", "left").filter("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    rest = written(apart(likely).join(first, ["a", "b"], "left_anti"), "rest")
    if rest.limit(1).count():
        links.append(written(_verified(rest, sets), "links"))
        found = components(whole(links))
    tried = [first, rest]
    turns: list[int | None] = [*range(ROUNDS), None] if lists.limit(1).count() else []
    while turns:
        turn = turns.pop(0)
        placed = lists.join(_placed(found, "id", "c"), "id", "left").select("list", "id", "n", F.coalesce("c", "id").alias("c"))
        inside = written(_mains(placed), "inside")
        if turn is None:  # all that is left
            if inside.limit(1).count():
                new = inside.select("id").distinct().join(whole(held).select("id"), "id", "left_anti")
                held.append(written(_sets_of(docs, new, True, make), "sets"))
                links.append(written(_outside(inside, whole(held)), "links"))
                found = components(whole(links))
            erase(inside)
            break
        more = written(_likely(_with_hubs(inside, turn), maps).join(whole(tried), ["a", "b"], "left_anti"), "more")
        erase(inside)
        count = more.count()
        tried.append(more)
        if count:
            new = _ends(more).distinct().join(whole(held).select("id"), "id", "left_anti")
            held.append(written(_sets_of(docs, new, True, make), "sets"))
            links.append(written(_verified(more, whole(held)), "links"))
            found = components(whole(links))
        if count < FEW:
            turns = [None]
    erase(pairs, lists, maps, likely, *held, *links, *tried)
    spark = docs.sparkSession
    del named, often
    spark._jvm.System.gc()
    return rows, classes, found


def join(docs: DataFrame, make: Sets = word_shingles, by_length: bool = False) -> DataFrame:
    """doc_id, n_shingles (the size of its set) and component_id (the smallest doc_id that links reach) of each document.
    ``make``: what the sets are of; ``by_length``: compare them in partitions by length."""
    rows, classes, found = _grouped(docs, make, True, by_length)
    linked = written(classes.join(found, "node").select("c1", "c2", "rep", "component"), "linked")
    least = written(linked.groupBy("component").agg(F.min("rep").alias("least")), "least")
    group = classes.select("c1", "c2", "rep").join(linked.join(least, "component").select("c1", "c2", "least"), ["c1", "c2"], "left")
    out = rows.join(group.select("c1", "c2", F.coalesce("least", "rep").alias("component")), ["c1", "c2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def text_groups(docs: DataFrame, make: Sets = word_shingles) -> DataFrame:
    """row (row_key) and group of each text with a doc_id, once. Texts are in one group where links between sets reach;
    a shared doc_id links nothing. A text with an empty set is a group of its own for each doc_id."""
    rows, classes, found = _grouped(docs, make, False)
    group = classes.join(found, "node", "left").select("c1", "c2", F.coalesce("component", "node").alias("group"))
    own = rows.filter("doc_id IS NOT NULL").join(group, ["c1", "c2"], "left")
    return own.groupBy("row").agg(F.min(F.coalesce("group", "row")).alias("group"))
