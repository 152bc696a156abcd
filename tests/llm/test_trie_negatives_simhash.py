"""Prefix trie, hard negatives and SimHash against plain Python versions, and their edge rows."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from loopdex.llm import hard_negatives, plans, prefix_trie, simhash
from tests.llm import brute

SF = "/root/testdata/sf0.01"


# -- prefix trie ------------------------------------------------------------------------------------------------------


def trie_by_hand(rows):
    """Counter of node tuples of rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{role}\0{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)

    def below(node):
        todo = [node]
        while todo:
            x = todo.pop()
            yield x
            todo += children[x]

    out = Counter()
    for node, m in members.items():
        under = list(below(node))
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(node))))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        parent = min(members[node[:-1]]) if node else None
        leaves = sum(not children[x] for x in under)
        out[(min(m), len(node), parent, len(m), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id bigint, turn int, role string, text string"


def nodes(df):
    return Counter(tuple(r[c] for c in NODE) for r in df.collect())


def conversations(seed=5):
    """Long ones over several blocks, copies, shared prefixes of every depth, missing bases, negative ids."""
    r = np.random.default_rng(seed)
    long_ = [("user", f"t{k}") for k in range(60)]
    out = []
    for c in [*range(0, 40), *range(100, 130), 205, 206, 207, 305, -3, -100, -101, 10**12]:
        kind = r.integers(5)
        path = long_[: r.integers(0, 60)] if kind == 0 else long_[:7] if kind == 1 else [("user", "hi"), ("assistant", f"x{r.integers(3)}")]
        if kind == 3:
            path = path + [("user", "é" * int(r.integers(1, 9)))] * 3
        out += [(c, k, role, text) for k, (role, text) in enumerate(path or [("system", "s")])]
    return [out[i] for i in r.permutation(len(out))]


def test_trie_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(plans.op11_prefix_trie(spark, SF)) == trie_by_hand(rows)


def test_trie_blocks_and_collisions(spark, monkeypatch):
    rows = conversations()
    want = trie_by_hand(rows)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "RUN_BITS", 2)
    assert nodes(prefix_trie.trie(df)) == want
    tried = []
    real = prefix_trie._differ
    monkeypatch.setattr(prefix_trie, "_differ", lambda *a: tried.append(real(*a)) or tried[-1])
    assert nodes(prefix_trie.trie(df, bits=2)) == want
    assert tried[0] and not tried[-1]  # two bits a digest can't tell turns apart; the comparison found that


def test_trie_edges(spark):
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, 0, "user", "a"), (7, 0, "user", "a"), (7, 0, "user", "b"), (7, 0, "tool", "b"), (8, 1, "user", "x" * 100_000),
            (9, 1, "user", "x" * 100_000), (0, 3, "", ""), (0, None, None, None), (100, 0, "user", "y"), (-7, 0, "user", "z"), (-7, 1, "user", "z")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS + ", digest string, d int")
    assert nodes(prefix_trie.trie(df)) == trie_by_hand(rows)
    assert prefix_trie.trie(df.limit(0)).collect() == []
    assert prefix_trie.trie(df.where("conv_id IS NULL")).collect() == []


# -- hard negatives ---------------------------------------------------------------------------------------------------


def mined_by_hand(rows, every=50, n_pos=5, n_neg=3):
    """Counter of result tuples of rows (vec_id, vector, label), labels as they are."""
    rows = {(i, label, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v, label in rows
            if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = Counter()
    for i, label, v in rows:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in rows if j != i and len(w) == len(v))
        for p, j in [(-s, j) for s, j, m in scored if m == label][:n_pos]:
            window = [(-s, k) for s, k, m in scored if m != label and 50 * p <= -100 * s <= 95 * p][:n_neg]
            out.update((i, j, rank, k, p, s) for rank, (s, k) in enumerate(window, 1))
    return out


MINED = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(df):
    return Counter(tuple(r[c] for c in MINED) for r in df.collect())


def test_negatives_table(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = mined_by_hand(rows)
    assert len(want) > 100 and mined(plans.op12_hard_negatives(spark, SF)) == want


def clustered(n=1500, dim=6, seed=4):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(12, dim))
    return [(i, (centers[k := int(r.integers(12))] + 0.05 * r.normal(size=dim)).tolist(), k % 4) for i in range(n)]


def test_negatives_read_few_blocks(spark, monkeypatch):
    """On vectors in clusters, small blocks: the same result, and most blocks aren't read by the windows."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "SLICE_BYTES", 16 * 16 * 4 * 6)
    monkeypatch.setattr(hard_negatives, "GROUP_BYTES", 200)
    rows = clustered()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    zones = hard_negatives.candidates(hard_negatives.usable(df, "embedding"), 50).where("kind = 0").collect()
    assert sum(z.n for z in zones) >= 1500 // 16
    low, high = zip(*[(np.frombuffer(z.a, np.int32).reshape(z.n, -1), np.frombuffer(z.b, np.int32).reshape(z.n, -1)) for z in zones])
    anchors = np.array([hard_negatives.whole(np.array([v]))[0] for i, v, _ in rows if i % 50 == 0])
    own = (anchors.astype(np.int64) ** 2).sum(1)
    down, up = (np.concatenate(x, axis=1) for x in zip(*[hard_negatives.bounds(anchors, a, b) for a, b in zip(low, high)]))
    assert ((up * 100 >= 50 * own[:, None]) & (down * 100 <= 95 * own[:, None])).mean() < 0.5
    assert mined(hard_negatives.mine(df)) == mined_by_hand(rows)


def test_bounds_hold():
    r = np.random.default_rng(1)
    x, y = r.integers(-300, 300, (20, 5)), r.integers(-300, 300, (64, 5))
    lo, hi = (f(y.reshape(8, 8, 5), axis=1) for f in (np.min, np.max))
    down, up = hard_negatives.bounds(x, lo, hi)
    s = (x @ y.T).reshape(20, 8, 8)
    assert (down <= s.min(2)).all() and (s.max(2) <= up).all()


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 2), (5, 1)])
def test_hilbert_is_a_curve(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = hard_negatives.hilbert(cells, bits)
    walk = cells[sorted(range(len(cells)), key=lambda i: key[i].tobytes())]
    assert len({k.tobytes() for k in key}) == len(cells) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_negatives_edges(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=3).tolist(), i % 3) for i in range(120)]
    rows += [(50, [0.1, 0.2, 0.3], 0), (50, [0.1, 0.2, 0.3], 0), (51, [0.1, 0.2, 0.3], 0), (52, [0.1, 0.2, 0.3], 0)]  # ties, a repeated row, an id with two vectors
    rows += [(200, None, 1), (250, [0.1, None, 0.2], 1), (300, [0.1, float("nan"), 0.2], 1), (350, [float("inf"), 0.0, 0.0], 1), (400, [0.5, 0.5, 0.5], None), (None, [0.5, 0.5, 0.5], 1)]
    rows += [(500, [], 1), (501, [], 1), (502, [], 2), (550, [1.0], 7), (600, [2.0] * 700, 1), (601, [1.0] * 700, 1), (602, [0.7] * 700, 2), (650, [0.0, 0.0, 0.0], 2)]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "vec_id bigint, embedding array<double>, label int, score string, slice int")
    want = mined_by_hand(rows)
    assert want and mined(hard_negatives.mine(df)) == want
    assert hard_negatives.mine(df.limit(0)).collect() == []
    huge = spark.createDataFrame([(0, [1e30, 0.0], 1), (1, [1e30, 0.0], 1), (2, [-1e300, 1.0], 2)], "vec_id bigint, embedding array<double>, label int")
    assert hard_negatives.mine(huge).count() == 0


# -- SimHash ----------------------------------------------------------------------------------------------------------


def fingerprint(text, width):
    words = brute.words((text or "").translate(brute.LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_by_hand(pairs, bits):
    """{id: component} of pairs (id, fingerprint); an id may have several."""
    root = {i: i for i, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    f = np.array([p for _, p in pairs], np.uint64)
    for k in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[:k] ^ f[k]) <= bits).tolist():
            a, b = find(pairs[k][0]), find(pairs[j][0])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_simhash_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    prints = [(i, fingerprint(t, 4)) for i, t in rows]
    group = groups_by_hand(prints, 4)
    got = plans.op13_simhash(spark, SF).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{f:016x}", group[i]) for i, f in prints)
    assert len(set(group.values())) < len(rows)


@pytest.mark.parametrize("bits,parts,segment", [(4, 3, 2), (4, 2, 2), (4, 1, 8), (4, 3, 4), (7, 4, 3), (0, 3, 2), (3, 5, 1)])
def test_simhash_join(spark, monkeypatch, bits, parts, segment):
    """Clusters of fingerprints a few bits apart, some of them large, against all pairs."""
    monkeypatch.setattr(simhash, "LIST", 20)
    monkeypatch.setattr(simhash, "SMALL_CELL", 6)
    r = np.random.default_rng(bits + parts)
    f = []
    for size in (120, 25, 25, 10, 2, 2, *[1] * 60):
        base = int(r.integers(1 << 63))
        f += [base ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, max(2, bits)), replace=False)) for _ in range(size)]
    f = sorted(set(f), key=lambda x: x * 0x9E3779B97F4A7C15 % (1 << 64))
    want = groups_by_hand(list(enumerate(f)), bits)
    nodes = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)), i) for i, x in enumerate(f)], "f bigint, rep bigint")
    edges = simhash.links(nodes, bits, parts, segment).collect()
    assert all((f[e.a] ^ f[e.b]).bit_count() <= bits for e in edges)
    root = {i: i for i in range(len(f))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        a, b = find(e.a), find(e.b)
        root[max(a, b)] = min(a, b)
    assert {i: find(i) for i in root} == want


def test_simhash_edges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "STRIDE", 1000)
    r = np.random.default_rng(9)
    long_ = " ".join(f"w{r.integers(10**9)}" for _ in range(5000))
    rows = [(5, None), (3, ""), (4, " \n\t"), (6, "a b"), (7, "A  B"), (8, long_), (9, long_ + " x"), (9, long_ + " x"), (10, "one two three four five"), (None, "a b"), (11, "a b"), (11, long_), (12, "é ü ß é")]
    df = spark.createDataFrame([(*x, 1, "clash") for x in rows], "doc_id bigint, text string, f int, component_id string")
    prints = [(i, fingerprint(t, 4)) for i, t in rows]
    group = groups_by_hand([p for p in prints if p[0] is not None], 4)
    got = Counter((x.doc_id, x.fingerprint, x.component_id) for x in simhash.near_duplicates(df, width=4).collect())
    assert got == Counter((i, f"{f:016x}", group.get(i)) for i, f in prints)
    assert group[3] == group[4] == group[5] == 3 and group[6] == group[7] == group[8] == group[11] == 6
    assert simhash.near_duplicates(df.limit(0)).collect() == []
