"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A topology is a tuple of regions, each a tuple of racks, each a tuple of shard weights; shards are numbered in
that order. For a row's key every shard draws ``-ln(u) / weight``, with ``u`` hashed from the key and the shard's own name.
The draw of a rack is the smallest of its shards', that of a region the smallest of its racks': again exponential, with the
sum of the weights. A row descends from the root to the region, the rack and the shard with the smallest draw. No draw
depends on anything outside its subtree, so a changed weight moves rows only into or out of the subtrees whose weights
changed, and an added shard takes rows only into itself, whatever region or rack it joins.

Slots: rows with the same key, size and digest are one group, numbered in bulk, so copies meet in no task.

Defined cases: null keys draw as one key; null texts have size 1 and crc32 0; very long texts count by their bytes; repeated
rows get slots of their own; empty tables give empty results; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Topology = tuple[tuple[tuple[float, ...], ...], ...]

#: Racks of a region and shards of a rack, in topologies by count.
RACKS, SHARDS = 2, 2
#: Slices of a shard that are numbered side by side, and the most shards x slices whose counts are broadcast.
SLICES, MOST_CELLS = 64, 1 << 16
#: Slots that are made of a group at once.
CHUNK = 65_536


def topology(n_shards: int) -> Topology:
    """The tree for a count of shards: regions of RACKS racks of SHARDS shards, filled in order."""
    if n_shards < 1:
        raise ValueError("a tree needs a shard")
    racks = [(1.0,) * min(SHARDS, n_shards - at) for at in range(0, n_shards, SHARDS)]
    return tuple(tuple(racks[at : at + RACKS]) for at in range(0, len(racks), RACKS))


def _draws(key: Column, name: str, weights: tuple[float, ...]) -> list[Column | None]:
    """The draw of each shard of a rack; None for weight 0."""
    u = lambda i: (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{name}/s{i}")), 11).cast("double") + F.lit(0.5)) / F.lit(2.0**53)
    return [-F.log(u(i)) / F.lit(float(w)) if w > 0 else None for i, w in enumerate(weights)]


def _least(draws: list[Column]) -> Column:
    return draws[0] if len(draws) == 1 else F.least(*draws)


def place(df: DataFrame, key: str, tree: Topology, out: str = "shard") -> DataFrame:
    """``df`` with the shard (int, from 0) that ``tree`` gives to each row's key."""
    k, names = F.col(key), {}
    draws, regions, first = {}, [], 0
    for i, racks in enumerate(tree):
        inner = []
        for j, shards in enumerate(racks):
            at = [(first + n, d) for n, d in enumerate(_draws(k, f"r{i}/k{j}", shards)) if d is not None]
            first += len(shards)
            for n, d in at:
                draws[names.setdefault(n, f"__{out}_{n}")] = d
            if at:
                inner.append([n for n, _ in at])
        if inner:
            regions.append(inner)
    if not regions:
        raise ValueError("every shard has weight 0")
    of = lambda shards: _least([F.col(names[n]) for n in shards])
    whole = lambda racks: _least([of(r) for r in racks])
    shard = lambda r: _first([(F.col(names[n]), F.lit(n)) for n in r])
    rack = lambda racks: _first([(of(r), shard(r)) for r in racks])
    df = df.withColumns(draws)
    return df.withColumn(out, _first([(whole(r), rack(r)) for r in regions]).cast("int")).drop(*draws)


def _first(children: list[tuple[Column, Column]]) -> Column:
    """The value of the child with the smallest draw, of equal ones the first."""
    if len(children) == 1:
        return children[0][1]
    least = _least([d for d, _ in children])
    found = F.when(children[0][0] == least, children[0][1])
    for d, value in children[1:-1]:
        found = found.when(d == least, value)
    return found.otherwise(children[-1][1])


def number(groups: DataFrame, shard: str, keys: list[str], n_shards: int, slices: int | None = None, out: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each shard for the members of groups (__n each, distinct in ``keys``). Each shard is
    cut into slices by the hash of ``keys``; slices are numbered in parallel and start where the smaller slices end. Groups are
    expanded last, in chunks that are dealt out anew where a group has more than one."""
    spark = groups.sparkSession
    slices = slices or max(SLICES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = groups.withColumn("__slice", F.pmod(F.xxhash64(*keys, F.lit("slice")), F.lit(slices)).cast("int"))
    counts = groups.groupBy(shard, "__slice").agg(F.sum("__n").alias("__of"))
    before = Window.partitionBy(shard).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "__slice", F.coalesce(F.sum("__of").over(before), F.lit(0)).alias("__start"))
    if n_shards * slices <= MOST_CELLS:
        starts = F.broadcast(starts)
    within = Window.partitionBy(shard, "__slice").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(starts, [shard, "__slice"])
    placed = placed.withColumn("__first", F.col("__start") + F.col("__before"))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / CHUNK))
    placed = placed.withColumn("__chunk", F.explode(chunks))
    placed = placed.filter("__n = 1").unionByName(placed.filter("__n > 1").repartition(*keys, "__chunk"))
    last = F.least(F.col("__n"), (F.col("__chunk") + 1) * CHUNK) - 1
    slots = F.explode(F.sequence(F.col("__chunk") * CHUNK, last))
    return placed.withColumn("__of", slots).withColumn(out, (F.col("__first") + F.col("__of")).cast("long")).drop("__slice", "__start", "__before", "__first", "__chunk", "__of", "__n")


def shard_documents(docs: DataFrame, n_shards: int = 8, slices: int | None = None) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keys = ["doc_id", "size", "text_crc32"]
    groups = place(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), "doc_id", topology(n_shards), "shard")
    rows = place(number(groups, "shard", keys, n_shards, slices), "doc_id", topology(n_shards + 1), "grown_shard")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
