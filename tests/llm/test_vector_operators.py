"""Centroid clustering, top-k search and whitening against brute force, with edge rows and empty tables."""
import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import top_k as K
from tessera.llm.centroids import SortedLists, cluster
from tessera.llm.top_k import Block, CoverTree, search, top_k
from tessera.llm.vectors import from_limbs, limbs
from tessera.llm.whitening import pair_squares, polarised, whiten

NAN, INF = float("nan"), float("inf")
CLASHING = ("id", "x", "no", "cell", "cluster", "rank", "score", "blob", "block", "v", "_rid", "n", "is_query")
SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    *[T.StructField(c, T.StringType()) for c in CLASHING]])


def vectors(n=230, d=6, seed=3):
    """Clustered vectors with copies, ties, repeated and null ids, and unusable ones."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(n)]
    same = rows[7][1]
    rows += [(300 + i, list(same)) for i in range(n // 2)]  # a group of copies
    rows += [(0, rows[1][1]), (0, rows[2][1]), (50, list(same)), (50, list(same)), (None, list(same)), (None, rows[3][1])]
    rows += [(600, None), (601, [None] + [0.5] * (d - 1)), (650, [NAN] * d), (603, [INF] + [0.0] * (d - 1)), (700, [0.0] * d)]
    rng.shuffle(rows)
    return rows


@pytest.fixture()
def saved_vectors(saved):
    def save(rows, parts=4):
        return saved([(i, v, *["x"] * len(CLASHING)) for i, v in rows], SCHEMA, parts)
    return save


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def ints(v, scale):
    return [math.floor(scale * float(np.float32(c))) for c in v]


# ------------------------------------------------------------------ clustering
def brute_clusters(rows, k, rounds, d, scale):
    v = [(i, ints(x, scale)) for i, x in rows if usable(x) and len(x) == d]
    packed = lambda x: np.array(x, "<i4").tobytes()
    order = sorted(v, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), packed(r[1])))
    cs = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, x in v:
            of[near(x)[1]].append(x)
        cs = [[sum(col) // len(of[j]) for col in zip(*of[j])] if j in of else c for j, c in enumerate(cs)]
    got = [(i, *near(x)) for i, x in v]
    per = Counter()
    for _, s, j in got:
        per[j] += s
    return Counter((i, j, s, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest())
                   for i, s, j in got)


@pytest.mark.parametrize("k,rounds", [(8, 10), (3, 1), (1, 2), (1000, 2)])
def test_clusters(saved_vectors, k, rounds):
    rows = vectors() + [(900, [1.0] * 5), (901, [1.0] * 7), (902, [])]  # other lengths take no part
    got, _ = cluster(saved_vectors(rows), k=k, rounds=rounds, dim=6, scale=64)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows, k, rounds, 6, 64)


def test_threshold_walk_is_exact_and_stops_early():
    rng = np.random.default_rng(1)
    c = rng.integers(-50, 50, (40, 3))
    c[5], c[9] = c[2], c[2]  # equal centroids: the smaller number
    x = np.concatenate([rng.integers(-60, 60, (500, 3)), c])
    who, far = SortedLists(c).nearest(x)
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert np.array_equal(who, d.argmin(axis=1)) and np.array_equal(far, d.min(axis=1))

    class Counted(np.ndarray):
        met = 0

        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.ndim == 1:
                Counted.met += len(at)
            return np.asarray(super().__getitem__(at))
    lists = SortedLists(c)
    lists.centroids = c.view(Counted)
    lists.nearest(x)
    assert Counted.met < 0.8 * len(x) * len(c)  # not every centroid is met


def test_clusters_of_nothing_and_of_equal_vectors(saved_vectors):
    assert cluster(saved_vectors([]), dim=2)[0].collect() == []
    assert cluster(saved_vectors([(1, None), (2, [NAN, 1.0])]), dim=2)[0].count() == 0
    got = cluster(saved_vectors([(i, [0.5, 0.5]) for i in range(20)]), dim=2)[0].collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 20


def test_too_large_a_component_is_an_error(saved_vectors):
    with pytest.raises(Exception, match="needs more than 27 bits"):
        cluster(saved_vectors([(1, [1e9, 0.0])]), dim=2)


def test_limbs_add_up_without_a_carry():
    values = [0, 1, -1, 2 ** 62, -2 ** 62, 123456789012345678]
    wide = [v * 2 ** 40 + 17 for v in values]
    for v, n in ((values, 2), (wide, 4)):
        total = sum(limbs(np.array(v, object), n) for _ in range(1000))
        assert from_limbs(total, n) == [1000 * x for x in v]


# ------------------------------------------------------------------ search
def brute_search(rows, k, scale, is_query):
    v = [(n, i, ints(x, scale)) for n, (i, x) in enumerate(rows) if usable(x)]
    out = []
    for n, i, x in v:
        if i is not None and is_query(i):
            found = sorted(((-sum(a * b for a, b in zip(x, y)), j is None, j or 0) for m, j, y in v if m != n))
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(found[:k])]
    return Counter(out)


@pytest.mark.parametrize("cell,query", [(4096, 1024), (40, 7)])
def test_search(saved_vectors, cell, query):
    rows = vectors() + [(750, [0.3, 0.2]), (751, []), (800, [9.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.5])]  # shorter: zeros follow
    got = top_k(saved_vectors(rows), F.col("vec_id") % 50 == 0, k=5, scale=64, cell_rows=cell, query_rows=query,
                max_cells=6, sample=100)
    assert got.columns == ["query_id", "rank", "id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_search(rows, 5, 64, lambda i: i % 50 == 0)


def test_search_of_few_rows(saved_vectors):
    query = F.col("vec_id") % 50 == 0
    assert top_k(saved_vectors([]), query).collect() == []
    assert top_k(saved_vectors([(1, [1.0]), (2, [2.0])]), query).collect() == []  # no query
    assert top_k(saved_vectors([(0, [1.0])]), query).collect() == []  # no candidate
    rows = [(0, [1.0]), (0, [1.0]), (None, [1.0])]
    assert Counter(map(tuple, top_k(saved_vectors(rows), query).collect())) == brute_search(
        rows, 5, 256, lambda i: i % 50 == 0)


def test_cover_tree_nodes_cover_their_points():
    rng = np.random.default_rng(2)
    x = np.unique(np.concatenate([rng.integers(-9, 9, (300, 3)) + 100 * c for c in range(4)]), axis=0)
    tree, order = CoverTree.of(x, leaf=8)
    assert np.array_equal(tree.points, x[order])
    for n in range(len(tree.start)):
        own = tree.points[tree.start[n]:tree.end[n]]
        assert np.linalg.norm(own - tree.points[tree.centre[n]], axis=1).max() <= tree.radius[n] + 1e-9
        kids = range(tree.child[n], tree.child[n] + tree.children[n])
        if tree.children[n]:
            assert tree.start[kids[0]] == tree.start[n] and tree.end[kids[-1]] == tree.end[n]
            assert all(tree.end[a] == tree.start[a + 1] for a in kids[:-1])
    assert tree.end[0] == len(x) and (tree.children > 0).any()


def test_dual_search_prunes_and_keeps_ties(monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-5, 5, (400, 4)) + 60 * np.eye(4, dtype=int)[c] for c in range(4)])
    ids = np.arange(len(x))
    block = Block.of(x, np.zeros(len(x), np.int8), ids, ids, 4)
    seen = []
    monkeypatch.setattr(K, "products", lambda a, b, real=K.products: seen.append(a.shape[0] * b.shape[0]) or real(a, b))
    monkeypatch.setattr(K, "CHUNK", 64)
    mine = Block.of(x[::40], np.zeros(40, np.int8), ids[::40], ids[::40], None, 4)
    found, reach = search(mine, block, 3, np.full(40, K.LOWEST))
    assert sum(seen) < 0.6 * 40 * len(x)
    score = x @ x.T
    for q in ids[::40]:
        want = sorted((-score[q, i], i) for i in ids if i != q)[:3]
        got = sorted((-int(f["score"]), int(f["id"])) for f in found if f["q"] == q)
        assert got == want
    assert all(reach[mine.ids["rid"] == q][0] == np.sort(np.delete(score[q], q))[-3] for q in ids[::40])


def test_products_are_exact_at_any_size():
    a = np.array([[2 ** 30, 2 ** 29 + 1], [3, -(2 ** 31) + 1]])
    assert K.products(a, a).tolist() == [[sum(int(p) * int(q) for p, q in zip(r, s)) for s in a] for r in a]
    big = np.array([[2 ** 31 - 1] * 8])
    with pytest.raises(OverflowError):
        K.products(big, big)


# ------------------------------------------------------------------ whitening
def brute_whitening(rows, components, scale):
    v = [(i, ints(x, scale)) for i, x in rows if usable(x)]
    d = max(len(x) for _, x in v)
    v = [(i, tuple(x + [0] * (d - len(x)))) for i, x in v]
    fit = sorted({x for _, x in v})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    cov = np.array([[float(Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n ** 3))
                     for j in range(d)] for i in range(d)])
    return v, n, s, np.array(fit, float), cov, *np.linalg.eigh(cov)


def test_whitening(saved_vectors):
    rows = vectors() + [(950, [0.25, -0.5]), (951, [])]
    v, n, s, fit, cov, values, vecs = brute_whitening(rows, 16, 64)
    got = whiten(saved_vectors(rows), components=4, scale=64)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    assert len(got) == 4 * len(v) and {r.component for r in got} == {1, 2, 3, 4} and {r.n for r in got} == {n}
    want = Counter((i, sum((n * a - b) ** 2 for a, b in zip(x, s))) for i, x in v)
    assert Counter((r.vec_id, int(r.deviation)) for r in got if r.component == 2) == want
    order = np.argsort(values)[::-1]
    for c in range(4):
        e = values[order[c]]
        mine = [r for r in got if r.component == c + 1]
        assert all(abs(r.explained - e / np.trace(cov)) <= 1e-9 for r in mine)
        exact = [float((np.array(x) - np.array(s) / n) @ vecs[:, order[c]] / np.sqrt(e)) for _, x in v]
        key = lambda t: (t[0] is None, t[0] or 0, abs(t[1]))
        a = sorted(((r.vec_id, r.whitened) for r in mine), key=key)
        b = sorted(((i, w) for (i, _), w in zip(v, exact)), key=key)
        a, b = np.array([w for _, w in a]), np.array([w for _, w in b])
        assert np.allclose(np.abs(a), np.abs(b), atol=1e-8)
        assert abs(abs(a @ b) - (np.abs(a) * np.abs(b)).sum()) < 1e-6  # one sign for all rows
    error, = {r.identity_error for r in got}
    assert 0 <= error < 1e-9


def test_polarisation_is_exact():
    rng = np.random.default_rng(5)
    z = rng.integers(-10 ** 9, 10 ** 9, (50, 4))
    n, r = len(z), [int(c) for c in z.sum(axis=0)]
    got = polarised(n, list(pair_squares(z)), r)
    y = n * z.astype(object) - np.array(r, object)
    assert (got == y.T @ y).all()


def test_whitening_without_variance(saved_vectors):
    assert whiten(saved_vectors([])).collect() == []
    assert whiten(saved_vectors([(1, None), (2, [NAN])])).collect() == []
    assert whiten(saved_vectors([(1, []), (2, [])])).collect() == []
    assert whiten(saved_vectors([(i, [1.0, 2.0]) for i in range(9)])).collect() == []  # one distinct vector
    got = whiten(saved_vectors([(i, [float(i % 4), 1.0, 2.0 * (i % 4)]) for i in range(12)])).collect()
    assert {r.component for r in got} == {1} and len(got) == 12  # only one direction varies
    assert {r.n for r in got} == {4} and abs(got[0].explained - 1) < 1e-12 and got[0].identity_error < 1e-9


def test_whitening_of_wide_numbers(saved_vectors):
    """Squares beyond a long: deviations stay exact."""
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1e10, 1e10) for _ in range(3)]) for i in range(40)]
    v, n, s, *_ = brute_whitening(rows, 3, 64)
    want = Counter((i, sum((n * a - b) ** 2 for a, b in zip(x, s))) for i, x in v)
    assert Counter((r.vec_id, int(r.deviation)) for r in whiten(saved_vectors(rows)).collect() if r.component == 1) == want
