import collections
import math
import zlib

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mixing as M
from tallyloom.llm import sharding as S

from .conftest import ODD


def test_shards(make):
    docs = make([f"text {i}" for i in range(4000)] + ODD)
    out = {r.doc_id: r for r in S.shard_documents(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(out[i].size == len(t.encode()) + 1 and out[i].text_crc32 == zlib.crc32(t.encode()) for i, t in texts.items())
    slots = collections.defaultdict(list)
    for r in out.values():
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.grown_shard in (r.shard, 8) for r in out.values()) and 300 < sum(r.grown_shard == 8 for r in out.values()) < 600
    assert max(map(len, slots.values())) < 1.3 * min(map(len, slots.values()))


def test_same_slots_whatever_the_partitions(make):
    docs = make([f"t{i}" for i in range(500)])
    a, b = S.shard_documents(docs), S.shard_documents(docs.repartition(7))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def _descend(key, tree):
    """The shard, by walking down plainly from a row's draws."""
    draw = lambda name, w: -math.log(((_xx(key, name) % 2**64 >> 11) + 0.5) / 2**53) / w if w > 0 else math.inf
    leaves, n = [], 0
    for i, racks in enumerate(tree):
        for j, shards in enumerate(racks):
            for k, w in enumerate(shards):
                leaves.append((draw(f"r{i}/k{j}/s{k}", w), i, j, n))
                n += 1
    least = lambda of: min(leaves_ for leaves_ in leaves if of(leaves_))
    region = least(lambda x: True)[1]
    rack = least(lambda x: x[1] == region)[2]
    return least(lambda x: x[1:3] == (region, rack))[3]


HASHES: dict = {}


def _xx(key, name):
    return HASHES[key, name]


def _hash_all(docs, tree):
    for i, racks in enumerate(tree):
        for j, shards in enumerate(racks):
            for k in range(len(shards)):
                name = f"r{i}/k{j}/s{k}"
                HASHES.update({(r.doc_id, name): r.h for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(name)).alias("h")).collect()})


@pytest.mark.parametrize("tree", [S.topology(7), S.topology(8), (((1.0, 2.5), (0.5,)), ((0.0, 4.0),), ((0.0,), (1.0, 1.0, 1.0)))])
def test_descent_against_a_plain_one(make, tree):
    docs = make([str(i) for i in range(300)])
    _hash_all(docs, tree)
    got = {r.doc_id: r.shard for r in S.place(docs, "doc_id", tree).collect()}
    assert got == {i: _descend(i, tree) for i in range(300)}


def test_every_growth_takes_rows_only_into_itself(make):
    docs = make([str(i) for i in range(1500)]).select("doc_id")
    rows = docs
    for n in range(1, 21):
        rows = S.place(rows, "doc_id", S.topology(n), f"a{n}")
    for r in rows.collect():
        assert all(r[f"a{n + 1}"] in (r[f"a{n}"], n) for n in range(1, 20))
    counts = collections.Counter(r["a20"] for r in rows.collect())
    assert set(counts) == set(range(20)) and max(counts.values()) < 120  # 75 on average


def test_topologies_fill_in_order():
    assert S.topology(1) == (((1.0,),),) and S.topology(7) == (((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0), (1.0,)))
    assert [sum(len(s) for racks in S.topology(n) for s in racks) for n in range(1, 30)] == list(range(1, 30))


def test_movement_stays_in_changed_subtrees(make):
    docs = make([str(i) for i in range(3000)])
    before, after = (((1.0, 1.0), (1.0, 1.0)),) * 2, (((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0), (1.0, 3.0)))
    moved = S.place(S.place(docs, "doc_id", before, "a"), "doc_id", after, "b").filter("a <> b")
    assert moved.count() > 0 and moved.filter("b < 4").count() == 0 and moved.filter("a >= 6 AND b < 6").count() == 0


def test_shards_of_odd_rows(make, spark):
    out = S.shard_documents(make(["a", "a", None, "b"], [1, 1, None, None], shard=["x"] * 4, __slice=["y"] * 4)).collect()
    assert len(out) == 4 and len({(r.shard, r.slot) for r in out}) == 4
    assert S.shard_documents(make(["a"]).limit(0)).count() == 0
    long = S.shard_documents(make(ODD, law=["x"] * 9)).collect()
    assert len(long) == 9 and {r.size for r in long} >= {1, 200_001}
    with pytest.raises(ValueError):
        S.topology(0)


@pytest.mark.parametrize("most", [1 << 16, 1])
def test_a_third_of_the_rows_alike(make, monkeypatch, most):
    """Copies of one row, and null ids, are numbered in bulk; also where the counts of slices are not broadcast."""
    monkeypatch.setattr(S, "MOST_CELLS", most)
    monkeypatch.setattr(S, "CHUNK", 7)
    docs = make(["same"] * 300 + [f"t{i}" for i in range(300)] + [f"n{i}" for i in range(300)], [5] * 300 + list(range(300)) + [None] * 300)
    out = S.shard_documents(docs).collect()
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert len(out) == 900 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in out if r.doc_id is None}) == 1 and len({r.shard for r in out if r.doc_id == 5}) == 1


def test_native_plan(make):
    plan = S.shard_documents(make(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _poisson(u, rate):
    k, c = 0, math.exp(-rate)
    while c < u:
        k += 1
        c += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
    return k


def test_copies_follow_the_inverse_distribution(make):
    import hashlib

    docs = make([f"text number {i}" for i in range(1000)])
    rates = {r["__source"]: r["__rate"] for r in M.rates(docs, {"s0": 3, "s1": 1}).collect()}
    sizes = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(F.length("text") + 1).alias("n")).collect()}
    total = sum(sizes.values())
    assert math.isclose(rates["s0"], 0.75 * total / sizes["s0"]) and math.isclose(rates["s1"], 0.25 * total / sizes["s1"])
    got = {r.doc_id: r.n for r in M.mix(docs, {"s0": 3, "s1": 1}).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in docs.collect():
        u = (int(hashlib.md5(f"7:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        assert got.get(r.doc_id, 0) == _poisson(u, rates[r.source])


def test_mix_is_shuffled_and_whole(make):
    out = M.mix(make([f"t{i}" for i in range(800)]), epochs=2.0).collect()
    assert 1400 < len(out) < 1800 and [r.copy for r in sorted(out, key=lambda r: (r.doc_id, r.copy))][0] == 1
    ids = [r.doc_id for r in out]
    assert ids != sorted(ids) and all(r.copy <= r.n_copies for r in out)


def test_hot_source_without_broadcast(make, monkeypatch):
    docs = make([f"t{i}" for i in range(300)])
    a = sorted(map(tuple, M.mix(docs).collect()))
    monkeypatch.setattr(M, "MAX_ENTRIES", 1)
    assert sorted(map(tuple, M.mix(docs).collect())) == a


def test_mix_of_odd_rows(make):
    docs = make(ODD + ["a", "a"], [None] + list(range(1, len(ODD))) + [5, 5], rate=["r"] * 11, copy=["c"] * 11, __w=["w"] * 11)
    out = M.mix(docs.withColumn("source", F.when(F.col("doc_id") != 3, F.col("source"))), epochs=3.0)
    assert out.columns == [*[c for c in docs.columns if c != "copy"], "n_copies", "copy", "shuffle_key"] and out.count() > 0
    assert M.mix(docs, {"nobody": 1.0}).count() == 0 and M.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rate", [0.01, 1.0, 250.0, 1e4, 1e6])
def test_tables_are_poisson_distributions(spark, rate):
    """Against the logarithms of the probabilities, whatever the rate."""
    row = M.tables(spark.createDataFrame([("s", rate), ("none", 0.0)], "__source string, __rate double")).first()
    low, cdf = row["__low"], row["__cdf"]
    assert low == max(0, math.floor(rate - M.REACH * math.sqrt(rate) - M.MORE)) and len(cdf) < 21 * math.sqrt(rate) + 90
    total = 0.0
    for k, c in enumerate(cdf, low):
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        assert abs(c - total) < 1e-8 if rate > 1e3 else abs(c - total) < 1e-13


def test_one_tiny_source_beside_a_large_one(make, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 1000)
    docs = make(["", *["x" * 9_999] * 100], source2=["tiny"] + ["big"] * 100).drop("source").withColumnRenamed("source2", "source")
    out = M.mix(docs)
    n = out.filter("source = 'tiny'").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.max("n_copies").alias("m")).first()
    assert 497_000 < n.n < 503_000 and n.n == n.d == n.m  # a rate of 500,000.5
