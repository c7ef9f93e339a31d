import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import bpe as B
from tallyloom.llm import chunkdedup as C
from tallyloom.llm import setjoin as J
from tallyloom.llm import spotsigs as G
from tallyloom.llm import textnum as N
from tallyloom.llm.queries import RANKS

from .conftest import ODD

PATH, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
WORD, LOW = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- BPE


def test_bpe_round_trip(make):
    docs = make(ODD + ["It's   here,  isn't it? 1234 #$%\n\n x"], ids_sha256=["x"] * 10, __text=["y"] * 10)
    enc = B.encoding(B.read_ranks(PATH), PATTERN)
    out = B.encode(docs, PATH, PATTERN, ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"))
    for r in out.collect():
        text = r.text or ""
        ids = enc.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert B.encode(docs.limit(0), PATH, PATTERN).count() == 0
    back = B.decode(out.select("doc_id", "text", "ids"), PATH, PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab Z'slt.,\n\té1 日語。、ß!  ", max_size=120))
def test_safe_cuts(text):
    enc = B.encoding(B.read_ranks(PATH), PATTERN)
    parts = list(B.parts(text, 5))
    assert "".join(parts) == text and [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_rank_file_is_bounded(monkeypatch):
    monkeypatch.setattr(B, "MAX_RANK_BYTES", 10)
    with pytest.raises(ValueError):
        B.read_ranks(PATH)


# --- words and shingles


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_words_and_sets():
    texts = [t or "" for t in ODD] + ["A b C", "a B c", "one two three four five six", "one two three four five"]
    w, first = N.words([t.encode() for t in texts])
    assert [b - a for a, b in zip(first, first[1:])] == [len(WORD.findall(t)) for t in texts]
    sets = N.shingle_sets([t.encode() for t in texts], 5)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert (sets[-4] == sets[-3]).all() and len(np.intersect1d(sets[-2], sets[-1])) == 1


# --- Jaccard join


def groups(texts):
    """component of each document, by brute force."""
    sets, root = {i: shingles(t) for i, t in texts}, {i: i for i, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(seed=3, n=160):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(words, k)) for k in (7, 9, 12, 30, 80, 200)]
    out = []
    for _ in range(n):
        t = list(base[rng.integers(len(base))])
        for _ in range(int(rng.integers(0, 1 + len(t) // 12))):
            t[rng.integers(len(t))] = words[rng.integers(400)]
        t = t[int(rng.integers(0, 2)) :] + list(rng.choice(words, int(rng.integers(0, 3))))
        out.append(" ".join(t))
    return out + out[:20]


@pytest.mark.parametrize("long,block,split,by_length", [(32, 2048, 100_000, False), (2, 5, 100_000, False), (2, 2048, 2, False), (2, 5, 2, True), (32, 2048, 100_000, True)])
def test_join_against_brute_force(make, monkeypatch, long, block, split, by_length):
    monkeypatch.setattr(J, "LONG", long)
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "SPLIT", split)
    monkeypatch.setattr(J, "OFTEN", 2)
    monkeypatch.setattr(J, "MOST_PLACES", 1 if block == 5 else 1 << 28)
    texts = family() + [t or "" for t in ODD]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(make(texts), by_length=by_length).collect()}
    assert got == groups(list(enumerate(texts)))


def test_length_partitions_hold_all_partners():
    for n in range(1, 400):
        for m in J.partners(n):
            assert m < 1 or abs(J.length_parts(n) - J.length_parts(m)) <= 1


def test_join_of_odd_rows(make):
    docs = make(["a b c d e f", "a b c d e f", "x y", None, "", "x y"], [5, 3, None, 7, 8, 9], n=["q"] * 6, c1=["q"] * 6)
    got = sorted(map(tuple, J.join(docs).collect()), key=str)
    assert got == sorted([(5, 2, 3), (3, 2, 3), (None, 1, None), (7, 0, 7), (8, 0, 8), (9, 1, 9)], key=str)
    assert J.join(docs.limit(0)).count() == 0
    same = sorted(map(tuple, J.join(make(["a b c d e f", "a b c d e f"], [4, 4])).collect()))
    assert same == [(4, 2, 4), (4, 2, 4)]


@pytest.mark.parametrize("long,block", [(32, 2048), (2, 5)])
def test_texts_of_one_id_link_their_groups(make, monkeypatch, long, block):
    monkeypatch.setattr(J, "LONG", long)
    monkeypatch.setattr(J, "BLOCK", block)
    a, b, c = ("a b c d e f g", "k l m n o p q", "u v w x y z zz")
    got = sorted(map(tuple, J.join(make([a, b, a, b, c], [1, 2, 5, 5, 3])).collect()))
    assert got == [(1, 3, 1), (2, 3, 1), (3, 3, 3), (5, 3, 1), (5, 3, 1)]  # id 5 stands for no class, yet links 1 and 2
    texts = family()
    ids = [k % 60 for k in range(len(texts))]
    single = groups(list(enumerate(texts)))
    root = {i: i for i in range(60)}
    for k, i in enumerate(ids):  # every text's component links its ids
        x, y = sorted((root[i], root[ids[single[k][1]]]))
        root = {j: x if r == y else r for j, r in root.items()}
    want = sorted((i, single[k][0], root[i]) for k, i in enumerate(ids) if single[k][0])
    assert sorted(tuple(r) for r in J.join(make(texts, ids)).collect() if r.n_shingles) == want


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, most):
    from tallyloom.llm import shared

    monkeypatch.setattr(shared, "ONE_TASK", most)
    pairs = [(i + 1, i) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (-5, 300), (300, 301)]
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(7)
    want = {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100, -5: -5, 300: -5, 301: -5}
    got = [tuple(r) for r in shared.components(edges).collect()]
    assert len(got) == len(want) and dict(got) == want and shared.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("block_bytes", [32 << 20, 4_000])
def test_last_pass_joins_with_no_more_links_than_components(spark, monkeypatch, block_bytes):
    """A list of near copies that all link, each a component: the pairs of it grow with its square, the links don't."""
    monkeypatch.setattr(J, "BLOCK_BYTES", block_bytes)
    pool, n = N.stream(4_000, 5), 120
    sets = [np.sort(np.concatenate([pool[:40], pool[100 + 2 * i : 102 + 2 * i]])) for i in range(n)]
    sets += [np.sort(pool[1000 + 40 * i : 1040 + 40 * i]) for i in range(20)]  # these link with nothing
    inside = spark.createDataFrame([(7, i, len(s), i, 0) for i, s in enumerate(sets)], "list long, id long, n long, c long, main long")
    got = J._outside(inside, spark.createDataFrame([(i, len(s), s.tobytes()) for i, s in enumerate(sets)], "id long, n long, s binary")).collect()
    blocks = 1 if block_bytes > 4_000 else 144
    assert n - 1 <= len(got) <= min(blocks * (n - 1), n * (n - 1) // 2 - (blocks == 1)) and all(J.alike(sets[u], sets[v]) for u, v in got)
    root = list(range(len(sets)))
    for u, v in got:
        root = [min(root[u], root[v]) if r in (root[u], root[v]) else r for r in root]
    assert root == [0] * n + list(range(n, n + 20))


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60), st.integers(1, 60), st.floats(0, 1))
def test_parity_never_excludes_a_link(n, m, share):
    k = int(min(n, m) * share)
    pool = N.stream(200, 77)
    a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:k], pool[100 : 100 + m - k]]))
    if 100 * k >= 80 * (n + m - k):
        assert J.may_link(n, m, J.parity(a), J.parity(b))


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 14), st.integers(0, 3), st.integers(0, 3))
def test_subsets_meet_exactly_for_links(n, lost, added):
    pool = N.stream(40, 78)
    a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[: max(0, n - lost)], pool[20 : 20 + added]]))
    if len(b):
        both = max(0, n - lost)
        link = 100 * both >= 80 * (n + len(b) - both)
        (ka, fa), (kb, fb) = J.subset_keys(a, 20), J.subset_keys(b, 20)
        meet = np.intersect1d(ka, kb) if len(a) != len(b) else np.intersect1d(ka[fa & J.LEVEL > 0], kb[fb & J.LEVEL > 0])
        assert (len(meet) > 0) == link


def test_boundary_is_the_cheapest():
    assert J.boundary({5: 10, 6: 10}) >= 6 and J.boundary({}) == 0 and J.boundary({12: 1000, 11: 1000}) <= 12


# --- chunks


def test_cuts_resist_shifts_and_keep_characters():
    text = ("".join(f"wörd{i * 7919 % 1000} " for i in range(600))).encode()
    a, b = C.cuts(text), C.cuts(b"inserted " + text)
    tail = set((b - 9).tolist()) & set(a.tolist())
    assert len(tail) > 0.95 * len(a) and np.diff(a).max() <= C.MAX_CHUNK
    for s, e in zip(a[:-1], a[1:]):
        text[s:e].decode()
    flat = C.cuts(b"x" * 5000)
    assert C.cuts(b"").tolist() == [0] and flat[0] == 0 and flat[-1] == 5000 and 0 < np.diff(flat).min() and np.diff(flat).max() == C.MAX_CHUNK


def test_long_texts_are_cut_alike(monkeypatch):
    text = "".join(f"w{i * 31 % 977} é " for i in range(20000)).encode()
    whole = C.cuts(text)
    monkeypatch.setattr(C, "SEGMENT", 1000)
    assert (C.cuts(text) == whole).all()


def brute_dedup(docs):
    """Kept text of each (doc_id, text), by walking all chunks in order."""
    chunks = {k: (k[1].encode(), np.array(plain_cuts(k[1].encode()))) for k in set(docs) if k[1]}
    seen, out = set(), {}
    for k in sorted(chunks, key=lambda k: (k[0], KEY[k])):
        raw, at = chunks[k]
        again = []
        for n, (a, b) in enumerate(zip(at, at[1:])):
            again += [n] if raw[a:b] in seen else []
            seen.add(raw[a:b])
        runs, kept = [], set(range(len(at) - 1))
        for n in again:  # runs of neighbouring repeated chunks
            runs = [*runs[:-1], [*runs[-1], n]] if runs and runs[-1][-1] == n - 1 else [*runs, [n]]
        for r in runs:
            kept -= set(r) if at[r[-1] + 1] - at[r[0]] >= C.MIN_RUN else set()
        out[k] = b"".join(raw[at[n] : at[n + 1]] for n in sorted(kept)).decode()
    return out


KEY: dict = {}


def plain_cuts(text):
    """Chunk starts by the definition, byte by byte: the smallest hash within RADIUS on either side, the first of equal ones
    on the left side, where a character starts; longer chunks are cut every MAX_CHUNK bytes."""
    gear, m = [int(x) for x in C.GEAR], 2**64
    h = [sum(gear[text[i - k]] << k for k in range(min(C.WINDOW, i + 1))) * int(C.SCRAMBLE) % m for i in range(len(text))]
    h = [m - 1 if text[i] & 0xC0 == 0x80 else x for i, x in enumerate(h)]
    at = lambda i: h[i] if 0 <= i < len(h) else m - 1
    out = [0] + [i for i in range(1, len(h)) if all(h[i] < at(i - k) for k in range(1, C.RADIUS + 1)) and all(h[i] <= at(i + k) for k in range(1, C.RADIUS + 1))] + [len(text)]
    cut = sorted({*out, *(p for a, b in zip(out, out[1:]) for p in range(a + C.MAX_CHUNK, b, C.MAX_CHUNK))})
    return [next((q for q in range(p, p - 4, -1) if q == len(text) or q >= 0 and text[q] & 0xC0 != 0x80), p) for p in cut]


def test_cuts_by_the_definition():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abc de,\nö日"), 900)), "x" * 2500, "short", "", "ab" * 700 + "the end of it"]
    for t in texts:
        raw = t.encode()
        assert sorted(set(C.cuts(raw).tolist())) == sorted(set(plain_cuts(raw)))


def test_repeated_digests_are_remembered():
    seen, e = C.Seen(), np.zeros(3, C.ENTRY)
    e["h1"], e["h2"], e["doc"], e["ord"] = [5, 6, 5 + C.Seen.SLOTS], [1, 1, 1], [0, 1, 2], [3, 0, 0]
    ids, rows = np.array([10, 20, 30]), np.array([7, 7, 7])
    assert not seen.later(e, ids, rows).any()
    seen.add(e[:2], ids, rows)
    assert seen.later(e, ids, rows).tolist() == [False, False, False]  # the same place, and another digest of the same slot
    assert seen.later(e, ids + 1, rows).tolist() == [True, True, False] and not seen.later(e, ids - 1, rows).any()


@pytest.mark.parametrize("together", [8 << 20, 3000])
def test_dedup_against_brute_force(make, monkeypatch, together):
    monkeypatch.setattr(C, "TOGETHER", together)
    rng = np.random.default_rng(5)
    words = [f"{c}{i}" for i in range(300) for c in "äbc"]
    pick = lambda n: " ".join(rng.choice(words, n))
    passage = pick(55)
    texts = [pick(40) for _ in range(30)] + [pick(20) + " " + passage + " " + pick(20) for _ in range(12)] + [pick(10) + " " + passage + " " + passage]
    texts += [texts[0], texts[3] + " tail"] + ["", "short"]
    docs = make(texts)
    KEY.update({(r.doc_id, r.text): r.k for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k")).collect()})
    want = brute_dedup(list(enumerate(texts)))
    rows = {r.doc_id: r for r in C.deduplicate(docs.repartition(3)).collect()}
    assert {i: r.text for i, r in rows.items()} == {i: want.get((i, t), t) for i, t in enumerate(texts)}
    assert all(rows[i].n_removed == 0 for i in range(31)) and all(passage not in rows[i].text for i in range(31, 43))
    assert rows[43].text == "" and rows[43].removed_bytes == len(texts[0].encode())


def test_dedup_of_odd_rows(make):
    docs = make(ODD + ["a" * 300, "a" * 300], [None] + list(range(1, len(ODD))) + [50, 50], __id=["i"] * 11, n_removed=["n"] * 11, __places=["p"] * 11)
    out = C.deduplicate(docs).collect()
    assert len(out) == 11 and sum(r.text is None for r in out) == 1 and [len(r.text) for r in out if r.doc_id == 50] == [300, 300]
    assert C.deduplicate(docs.limit(0)).count() == 0


# --- fingerprints


def brute_signatures(text):
    """Chains as words, by walking the text."""
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.translate(LOW))
    anchors, out = set(G.ANCHORS), set()
    for i, x in enumerate(w):
        chain = [y for y in w[i + 1 :] if y not in anchors][: G.CHAIN]
        if x in anchors and len(chain) == G.CHAIN:
            out.add((x, *chain))
    return out


def brute_sets(text):
    """Chains, or else runs of three words, or else the words, or else the text."""
    if chains := brute_signatures(text):
        return {("chain", *x) for x in chains}
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.translate(LOW))
    return {("run", *x) for x in zip(w, w[1:], w[2:])} or ({("words", *w)} if w else {("text", text)})


def test_likeness_against_brute_force():
    rng = np.random.default_rng(8)
    vocabulary = [*G.ANCHORS[:40], *(f"word{i}" for i in range(30)), "für", "été", "Über,", "WORD1"]
    texts = [" ".join(rng.choice(vocabulary, int(k))) for k in rng.integers(0, 60, 60)] + ["", "!", "..", "a b", "xyz", "no anchor words here whatsoever", "the", "the cat"]
    prints, sets = G.fingerprints([t.encode() for t in texts]), [brute_sets(t) for t in texts]
    assert [len(f) for f in prints] == [len(x) for x in sets]
    for i in range(len(texts)):
        for j in range(0, len(texts), 3):
            assert G.likeness(prints[i], prints[j]) == len(sets[i] & sets[j]) / len(sets[i] | sets[j])


def test_fingerprints_against_brute_force():
    texts = ["the cat sat on the mat, and The DOG ran.", "it is what it is", "Der Hund und die Katze für alle", "no anchors here whatsoever", "xyz", "!!", ""]
    prints = G.fingerprints([t.encode() for t in texts])
    for t, f in zip(texts[:3], prints):
        assert len(f) == len(brute_signatures(t) or set(zip(t.split(), t.split()[1:], t.split()[2:])))  # without chains: runs of three words
    assert all(len(f) for f in prints) and (prints[0] == G.fingerprints([texts[0].encode()])[0]).all()
    a, b = (brute_signatures(t) for t in (texts[0], texts[0] + " the bird flew over a hill"))
    f, g = G.fingerprints([texts[0].encode(), (texts[0] + " the bird flew over a hill").encode()])
    assert G.likeness(f, g) == len(a & b) / len(a | b) and G.likeness(f, g, 0.99) == 0.0


@pytest.mark.parametrize("parts", ["1", "4", "9"])
def test_next_documents(make, spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        texts = [(t or "")[:5000] for t in ODD] + [f"the word {i} and a thing{i} of note" for i in range(40)]
        ids = [i * 3 + 1 for i in range(len(texts))]
        got = {r.doc_id: r for r in G.with_next(make(texts, ids, part=["p"] * len(texts)).repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == len(texts)
    for k, (i, t) in enumerate(zip(ids, texts)):
        n = texts[(k + 1) % len(texts)]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        f, g, h = (G.fingerprints([x.encode()])[0] for x in (t, e, n))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), G.as_text(f), G.as_text(g))
        assert r.near_edited == G.likeness(f, g) and r.near_next == G.likeness(f, h)


@pytest.mark.parametrize("long", [32, 2])
def test_near_duplicate_fingerprints(make, monkeypatch, long):
    monkeypatch.setattr(J, "LONG", long)
    long = " ".join(f"the thing{i} of note{i} and more" for i in range(40))
    texts = [long, long.replace("thing7 ", "other "), long, "the cat sat there and ran off", None, "", long.replace("thing", "x")]
    rng = np.random.default_rng(9)
    for n in (4, 8, 15, 30, 60):
        words = [x for i in range(n) for x in ("the", f"n{n}w{i}", f"n{n}v{i}")]
        for _ in range(6):
            w = list(words)
            for at in rng.integers(0, len(w), int(rng.integers(0, 1 + n // 6))):
                w[at] = f"z{rng.integers(1000)}"
            texts.append(" ".join(w))
    got = {r.doc_id: (r.n_signatures, r.component_id) for r in G.near_duplicates(make(texts)).collect()}
    sets = [brute_sets(t or "") for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    assert got == {i: (len(sets[i]), root[i]) for i in range(len(texts))} and root[:7] == [0, 0, 0, 3, 4, 4, 6]
    out = {r.doc_id: r for r in G.fingerprint(make(texts)).collect()}
    assert {i: (r.n_signatures, r.component_id) for i, r in out.items()} == got


def test_fingerprints_of_odd_rows(make):
    docs = make(["a b", None, "c", "c"], [2, None, 2, 2], component_id=["x"] * 4, k=["y"] * 4)
    out = G.with_next(docs).collect()
    assert collections.Counter(r.doc_id for r in out) == {2: 3, None: 1}
    out = G.fingerprint(docs).collect()
    assert collections.Counter((r.doc_id, r.component_id) for r in out) == {(2, 2): 3, (None, None): 1}
    assert G.fingerprint(docs.limit(0)).count() == 0
    one = G.with_next(make(["abcd"], [9])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    assert G.with_next(make(["a"]).limit(0)).count() == 0
