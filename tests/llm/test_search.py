import numpy as np
import pytest

from tallyloom.llm import topk as T
from tallyloom.llm import urlfilter as U
from tallyloom.llm.queries import RULES

VEC = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    v = {i: [int(np.floor(1024 * np.float64(np.float32(x)))) for x in e] for i, e in rows if e and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for q in v:
        if q % every == 0:
            best = sorted(((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("n,d,scale,block", [(300, 8, 1.0, 32768), (400, 16, 0.05, 97), (5, 4, 1.0, 32768)])
def test_exact(spark, monkeypatch, n, d, scale, block):
    monkeypatch.setattr(T, "VECTOR_BLOCK", block)
    monkeypatch.setattr(T, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(0, scale, d).astype(np.float32)]) for i in range(n)]
    rows[1:4] = [(1, rows[4][1]), (2, rows[4][1]), (3, [0.0] * d)]  # ties
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], VEC)
    assert sorted(map(tuple, T.search(df, df.filter("vec_id % 10 = 0"), 10).collect())) == brute(rows, 10, 10)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, []), (7, [-1.0, 0.5]), (10, [0.5, 0.5]), (None, [9.0, 9.0])]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], VEC)
    got = sorted(map(tuple, T.search(df, df.filter("vec_id % 10 = 0"), 10).collect()))
    assert [r[2] for r in got if r[0] == 0] == [10, 5, 6, 7] and got[0][3] == 1024 * 512 + 2048 * 512
    assert T.search(df.limit(0), df.limit(0)).count() == 0
    assert T.search(df.filter("vec_id = 0"), df.filter("vec_id = 0")).count() == 0


def test_stops_early_only_on_proof():
    rng = np.random.default_rng(1)
    v = rng.integers(-200, 200, (3000, 12))
    v[:20] += 600
    index = T.ImpactIndex(v)
    q = rng.integers(50, 300, 12)
    rows, score = index.top(q, 10, np.array([0]))
    want = np.argsort(-(v @ q)[1:], kind="stable")[:10] + 1
    assert len(rows) < 200 and set(want) <= set(rows.tolist()) and (v[rows] @ q == score).all()


def test_share_of_postings_read(spark):
    """On dense vectors without structure most postings must be read for a proof; the README states the share."""
    x = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()], np.float32)
    v = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    index, alive = T.ImpactIndex(v), 0
    for i in range(0, 2000, 100):
        rows, score = index.top(v[i], 10, np.array([i]))
        alive += len(rows)
        want = np.sort(np.delete(v @ v[i], i))[-10:]
        assert (np.sort(score)[-10:] == want).all()
    share = index.read / (20 * v.size)
    assert share < 0.9 and alive / 20 <= 125, (share, alive)


URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.NET/en/", "http://example.net/english", "http://example.net/de/1", "http://net/", "http://net", "http://xnet/", "http://x.org/fr/a?b=/", "http://org/fr/", "http://org/en/fr/", "http://example.com/de/#x",
    "http://example.com/de", "http://user@example.com:80/de/1", "no scheme", "", None, "://", "http://?x", "http://.net/", "http://EXAMPLE.com.net/de/", "http://a.net?/x/",
]


def judge(url):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, path = rest[:n].translate(low), rest[n:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(df, RULES).collect()}
    assert got == {i: judge(u) for i, u in enumerate(URLS)}
    assert U.judge_urls(df.limit(0), RULES).count() == 0


def test_precedence():
    t = U.Trie([("allow", "a.b", "/x"), ("block", "a.b", "/x"), ("allow", "a.b", "/x/y"), ("block", "b", "/x/y/z/")])
    assert t.judge("a.b", "/xx") == ("a.b/x", "block") and t.judge("q.a.b", "/x/yes") == ("a.b/x/y", "allow")
    assert t.judge("c.b", "/x/y/z/1") == ("b/x/y/z/", "block") and t.judge("c.b", "/x/y/z") is None and t.judge("b.a", "/x") is None
    with pytest.raises(ValueError):
        U.Trie([("maybe", "a", "/")])


def test_many_ends_and_long_urls(monkeypatch):
    t = U.Trie([("block", "a.b", f"/r{i}") for i in range(3000)] + [("allow", "a.b", "/r29/x")])
    assert t.judge("a.b", "/r2999z") == ("a.b/r2999", "block") and t.judge("a.b", "/r29/x" + "y" * 100_000) == ("a.b/r29/x", "allow") and t.judge("a.b", "/" + "q" * 1_000_000) is None
    monkeypatch.setattr(U, "MAX_CHARS", 5)
    with pytest.raises(ValueError):
        U.Trie([("allow", "a.b", "/long")])
