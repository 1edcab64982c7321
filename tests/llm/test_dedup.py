"""The four dedup operators against brute force, with edge rows and empty tables."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from edge_rows import EDGE_ROWS, LONG

from tessera.llm import common
from tessera.llm import exact_dedup as E
from tessera.llm import line_dedup as L
from tessera.llm import simhash as N
from tessera.llm import suffix_dedup as S
from tessera.llm.common import components
from tessera.llm.exact_dedup import drop_exact_copies, exact_dedup
from tessera.llm.line_dedup import drop_repeated_lines, line_dedup
from tessera.llm.simhash import drop_near_copies, fingerprint, forest, near_dedup, near_tiles
from tessera.llm.suffix_dedup import suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def last(i):
    return (i is None, i or 0)


def shared_corpus(n=60, seed=5):
    rng = random.Random(seed)
    base = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(40)) for _ in range(8)]
    rows = []
    for i in range(n):
        words = base[rng.randrange(8)].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "new" + str(rng.randrange(50))
        lines = [" ".join(words[k:k + 5]) for k in range(0, 40, 5)]
        rows.append((i * 3 % 101, "\n".join(lines) + base[rng.randrange(8)][:rng.randint(0, 90)]))
    return rows


# ------------------------------------------------------------------ exact
def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def check_exact(docs):
    rows = docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    want = Counter((r.doc_id, min(groups[norm(r.text)], key=last), len(groups[norm(r.text)]),
                    hashlib.sha256(norm(r.text).encode()).hexdigest()) for r in rows)
    got = exact_dedup(docs, first_bytes=4, growth=2).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact(saved):
    docs = saved(EDGE_ROWS)
    check_exact(docs)
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len({norm(r[1]) for r in EDGE_ROWS})
    check_exact(saved(shared_corpus()))


@pytest.fixture()
def other_splits(spark, monkeypatch):
    """Each written table and each scan after it is planned for another number of cores."""
    key, n = "spark.sql.files.minPartitionNum", iter(range(10 ** 6))

    def flip():
        spark.conf.set(key, [1, 12, 3][next(n) % 3])

    def patched(module):
        def write(df, name, real=module.written):
            flip()
            return real(df, name)
        monkeypatch.setattr(module, "written", write)
    yield flip, patched
    spark.conf.unset(key)


def test_rows_stay_the_same_when_splits_change(saved, other_splits):
    flip, patched = other_splits
    for module in (common, E, L, N):
        patched(module)
    rows = [(i % 40, f"text {i % 50}\nsecond {i % 50}\nthird\nfourth {i}" if i % 3 else f"copy {i % 7}") for i in range(400)]
    docs = saved(rows, parts=9)
    texts = Counter(r[1] for r in rows)
    got = exact_dedup(docs)
    flip()
    got = got.collect()
    assert len(got) == len({r._rid for r in got}) == len(rows)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(norm(t).encode()).hexdigest() for t in texts)
    for drop in (drop_exact_copies, drop_near_copies):
        left = drop(docs) if drop is drop_exact_copies else drop(docs, radius=0)
        flip()
        assert Counter(r.text for r in left.collect()) == Counter(texts.keys())
    left = drop_repeated_lines(docs)
    flip()
    left = left.collect()
    assert len(left) == len(rows) and sum(r.text.count("third") for r in left) == sum("third" in t for t in {
        norm(r[1].split("fourth")[0]) for r in rows})


def test_input_that_is_no_parquet_scan(saved, spark):
    rows = shared_corpus() + [(i, "equal text") for i in range(20)]
    docs = saved(rows)
    for other in (docs.where("doc_id >= 0"), docs.union(docs), spark.createDataFrame(docs.collect(), docs.schema)):
        left = drop_exact_copies(other)
        assert left.columns == docs.columns
        assert Counter(r.text for r in left.collect()) == Counter({r[1] for r in rows})
    named = docs.withColumnRenamed("n", "_metadata")
    assert drop_exact_copies(named).count() == len({r[1] for r in rows})


def test_exact_splits_late(saved):
    check_exact(saved([(i, LONG[:3000] + "ab"[i % 2] + LONG[3000:]) for i in range(7)]))


def test_suffixes_stay_the_same_when_splits_change(saved, other_splits):
    flip, patched = other_splits
    patched(common)
    patched(S)
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=40)) for _ in range(12)]
    rows = [(i, base[i % 12][:200] + f" own {i} " + base[i % 7]) for i in range(400)]
    docs = saved(rows, parts=9)
    steady = Counter((r.doc_id, r.n_removed, bytes(r.kept)) for r in suffix_dedup(docs).collect())
    got = suffix_dedup(docs)
    flip()
    assert Counter((r.doc_id, r.n_removed, bytes(r.kept)) for r in got.collect()) == steady
    assert sum(n for _, n, _ in steady) > 100_000


def test_files_without_a_limit(spark):
    """300,000 paths with rows numbered apart; more than the numbers can tell apart is an error."""
    paths = spark.range(300_000).selectExpr("concat('s3://bucket/table/part-', id, '.parquet') AS file")
    numbers = common.free_numbers(paths, last=1_000_000)
    got = paths.select(numbers.of(paths["file"]).alias("n")).selectExpr("count(distinct n)", "max(n)", "min(n)").first()
    assert got[0] == 300_000 and got[1] < 1 << (63 - numbers.bits) and got[2] >= 0 and numbers.bits == 20
    with pytest.raises(ValueError, match="too many"):
        common.free_numbers(paths, last=1 << 50, tries=2)


# ------------------------------------------------------------------ lines
def check_lines(docs):
    got = {r._rid: r for r in line_dedup(docs).collect()}
    rows = sorted(((last(r.doc_id), rid, r.text or "") for rid, r in _with_rid(docs)), key=lambda x: x[:2])
    seen = set()
    for _, rid, text in rows:
        lines, gone = text.split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k:k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        r = got[rid]
        spans = sum(1 for k in gone if k - 1 not in gone)
        assert (r.n_lines, r.n_removed, r.n_spans) == (len(lines), len(gone), spans)
        assert r.text == "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert len(got) == len(rows)


def _with_rid(docs):
    from pyspark.sql import functions as F
    return [(r.rid, r) for r in docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid")).collect()]


def test_lines(saved):
    docs = saved(EDGE_ROWS)
    check_lines(docs)
    check_lines(saved(shared_corpus()))
    left = drop_repeated_lines(docs)
    assert left.columns == docs.columns and left.count() == docs.count()


# ------------------------------------------------------------------ simhash
def brute_fingerprint(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = WORD.findall(low)
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for _, t, *_ in EDGE_ROWS:
        assert fingerprint((t or "").encode(), 3, 42) == brute_fingerprint(t)


def check_near(docs, radius=2):
    rows = _with_rid(docs)
    fps = [brute_fingerprint(r.text) for _, r in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                top[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (rid, r) in enumerate(rows):
        groups[find(i)].append((last(r.doc_id), rid, r.doc_id))
    got = {r._rid: r for r in near_dedup(docs, radius=radius).collect()}
    for i, (rid, _) in enumerate(rows):
        first = min(groups[find(i)])
        assert got[rid].fingerprint == f"{fps[i]:016x}"
        assert got[rid].component_id == first[2] and got[rid].stays == (first[1] == rid)


def test_near(saved):
    docs = saved(EDGE_ROWS)
    check_near(docs)
    check_near(saved(shared_corpus()), radius=6)
    left = drop_near_copies(docs)
    assert left.columns == docs.columns


def test_forest_connects_what_is_linked():
    rng = np.random.default_rng(2)
    base = rng.integers(-2**63, 2**63, 20)
    for a, b, rows in ((40, 30, 8), (300, 200, 16)):
        pick = lambda n: base[rng.integers(0, 20, n)] ^ (1 << rng.integers(0, 62, n))
        left, right = pick(a), pick(b)
        u, v = forest(left, right, 2, rows=rows)
        assert (np.bitwise_count(u.view(np.uint64) ^ v.view(np.uint64)) <= 2).all()

        def classes(pairs):
            top = {}
            def find(x):
                while top.setdefault(x, x) != x:
                    x = top[x]
                return x
            for x, y in pairs:
                top[find(x)] = find(y)
            out = defaultdict(set)
            for x in list(top):
                out[find(x)].add(x)
            return sorted(map(sorted, out.values()))
        near = np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)) <= 2
        assert classes(zip(u.tolist(), v.tolist())) == classes(
            (left[i].item(), right[j].item()) for i, j in zip(*np.nonzero(near)))


def test_near_tiles_cover_half():
    tiles = near_tiles(2)
    assert [0, 0, 0, 0] in tiles and len(tiles) == (1 + 8 + 32) // 2 + 1


@pytest.mark.parametrize("radius", [0, 1, 2, 6])
def test_tile_pairs(spark, radius):
    rng = random.Random(radius)
    tiles = {tuple(min(16, max(0, 8 + rng.randint(-9, 9))) for _ in range(4)) for _ in range(30)}
    key = lambda c: sum(x * 32 ** k for k, x in enumerate(c))
    df = spark.createDataFrame([(key(c),) for c in tiles], "tile int")
    pairs = N.tile_pairs(df, radius)
    got = Counter((r.tile, r.tile2) for r in pairs.collect())
    assert max(got.values()) == 1
    one = {(a, b) for a, b in got if b in {key(c) for c in tiles}}
    assert one == {(key(a), key(b)) for a in tiles for b in tiles
                   if key(a) <= key(b) and sum(abs(x - y) for x, y in zip(a, b)) <= radius}
    inside = [d for d in near_tiles(radius)]
    middle = key((8, 8, 8, 8))
    if middle in {key(c) for c in tiles}:
        assert sum(1 for a, _ in got if a == middle) == len(inside)


def test_plan_of_links_does_not_grow_with_the_radius(spark):
    fps = spark.range(60).selectExpr("xxhash64(id) AS fp")
    sizes = [len(N.links(fps, r)._jdf.queryExecution().logical().toString()) for r in (1, 6, 12)]
    assert max(sizes) < 1.1 * min(sizes)


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, k) for k in range(6, 40)] + \
            [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(7, 7)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(top) if find(x) != x}


# ------------------------------------------------------------------ suffixes
def test_owned_strings():
    rng = random.Random(1)
    for length in (3, 5, 9):
        for _ in range(60):
            parts = list({bytes(rng.choices(b"ab\x00", k=rng.randint(length, length + 7)))
                          for _ in range(rng.randint(1, 12))})
            owner = np.array([rng.randint(0, 5) for _ in parts])
            least = {}
            for p, o in zip(parts, owner):
                for i in range(len(p) - length + 1):
                    least[p[i:i + length]] = min(least.get(p[i:i + length], 99), o)
            for p, o, mine in zip(parts, owner, S.owned_strings(parts, owner, length)):
                assert mine.tolist() == [least[p[i:i + length]] == o for i in range(len(p) - length + 1)]


def check_suffix(docs, **params):
    rows = _with_rid(docs)
    first = {}
    for _, r in rows:
        t = (r.text or "").encode()
        for k in range(len(t) - 49):
            first[t[k:k + 50]] = min(first.get(t[k:k + 50], (True, 1)), last(r.doc_id))
    got = {r._rid: r for r in suffix_dedup(docs, **params).collect()}
    assert len(got) == len(rows)
    for rid, d in rows:
        t = (d.text or "").encode()
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k:k + 50]] < last(d.doc_id):
                gone[k:k + 50] = b"\1" * 50
        r = got[rid]
        assert (r.doc_id, r.n_bytes, r.n_removed) == (d.doc_id, len(t), sum(gone))
        assert len(r.spans) == sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        assert bytes(r.kept) == bytes(c for c, g in zip(t, gone) if not g)


def test_suffix(saved):
    check_suffix(saved([(i, (t or "")[:9000] if t else t, s) for i, t, s in EDGE_ROWS]))


def test_suffix_whole_long_texts(saved, monkeypatch):
    check_suffix(saved([(i, t, s) for i, t, s in EDGE_ROWS if i in (8, 9, 10, 1, None)]))
    monkeypatch.setattr(S, "ALONE", 300)  # every longer text a group of its own
    check_suffix(saved([(i, t.replace("\n", " ")) for i, t in shared_corpus(50)]))


def test_suffix_shared_passages_and_hot_anchors(saved):
    docs = saved([(i, t.replace("\n", " ")) for i, t in shared_corpus(50)])
    check_suffix(docs)
    check_suffix(docs, hot=3, segment_bytes=2000, bucket_bytes=3000)


def test_suffix_long_text_in_parts(saved, monkeypatch):
    rng = random.Random(3)
    data = "".join(rng.choices("abcd", k=5000)) + "ab" * 300
    raw = np.frombuffer(data.encode(), np.uint8)
    ends = np.array([3000, len(raw)])
    whole = S.segments(raw, np.append(0, ends[:-1]), ends)
    monkeypatch.setattr(S, "PART", 500)
    parts = S.segments(raw, np.append(0, ends[:-1]), ends)
    span = lambda s: [(k, h) for a, b, h in zip(*map(np.ndarray.tolist, s)) for k in range(a, b + 1)]
    assert span(whole) == span(parts)


# ------------------------------------------------------------------ no rows
def test_empty_tables(saved):
    docs = saved([])
    for op in (line_dedup, exact_dedup, near_dedup, suffix_dedup):
        assert op(docs).count() == 0
    for op in (drop_repeated_lines, drop_exact_copies, drop_near_copies):
        assert op(docs).columns == docs.columns
