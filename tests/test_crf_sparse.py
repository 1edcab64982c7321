"""CRF over sparse attributes: dictionary, CSR rows, gradient, fit and paths against the dense operator."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import crf, crf_sparse as S
from tessera.operators import crf_sparse_kernels as K

SCHEMA = "article_id string, sentences array<string>, sentence_labels array<int>, attrs array<array<string>>, " \
         "vals array<array<double>>"
NAMES = ["a", "b", "c", "d", "é", "f g"]


def corpus(n=60, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        length = int(rng.integers(0, 9)) if i else 40
        names = [[NAMES[j] for j in rng.integers(0, len(NAMES), size=rng.integers(0, 5))] for _ in range(length)]
        vals = [[float(v) for v in rng.integers(-4, 5, size=len(s)) / 4] for s in names]
        labels = [int("a" in s) if rng.random() < 0.8 else int(rng.integers(0, 2)) for s in names]
        rows.append((f"x{i}", ["s"] * length, labels, names, vals))
    return rows


def dense(spark, rows, words):
    """The same rows as the dense operator reads them, one column for each attribute of the dictionary."""
    order = [r.name for r in words.table.orderBy("id").collect()]
    at = {v: i for i, v in enumerate(order)}
    out = []
    for aid, s, y, names, vals in rows:
        x = np.zeros((len(s), len(order)))
        for t, (ns, vs) in enumerate(zip(names, vals)):
            for name, v in zip(ns, vs):
                if name in at:
                    x[t, at[name]] += v
        out.append((aid, len(s), x.ravel().tolist(), y))
    return order, spark.createDataFrame(out, "article_id string, n int, x array<double>, y array<int>")


@pytest.fixture(scope="module")
def data(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).persist()
    return rows, df, S.attribute_dictionary(df)


def test_dictionary_counts_and_thresholds(spark, data):
    rows, df, words = data
    count = {}
    for r in rows:
        for s in r[3]:
            for n in s:
                count[n] = count.get(n, 0) + 1
    assert {r.name: r.n for r in words.table.collect()} == count
    assert sorted(r.id for r in words.table.collect()) == list(range(len(count)))
    least = sorted(count.values())[2]
    few = S.attribute_dictionary(df, min_count=least)
    assert {r.name for r in few.table.collect()} == {k for k, n in count.items() if n >= least}
    bound = S.attribute_dictionary(df, max_attributes=3)
    total = sum(count.values())
    assert {r.name for r in bound.table.collect()} == {k for k, n in count.items() if n * 3 >= total}
    assert bound.d <= 3


def test_names_with_one_hash_take_another_seed(spark, data, monkeypatch):
    _, df, words = data
    real = S._hash
    monkeypatch.setattr(S, "_hash", lambda name, seed: F.length(name).cast("bigint") if seed < 2 else real(name, seed))
    got = S.attribute_dictionary(df)
    assert got.seed == 2 and got.d == words.d


@pytest.mark.parametrize("small", [False, True])
def test_gradient_equals_dense(spark, data, monkeypatch, small):
    rows, df, words = data
    if small:  # several blocks and slices
        monkeypatch.setattr(K, "BLOCK", 2)
        monkeypatch.setattr(K, "SLICE", 7)
        monkeypatch.setattr(S, "BLOCK", 2)
    order, seqs = dense(spark, rows, words)
    rng = np.random.default_rng(1)
    W, A = rng.normal(size=(len(order), 2)), rng.normal(size=(2, 2))
    model = crf.CRFModel(tuple(order), (0, 1), W, A, np.ones((2, 2), dtype=bool))
    want = {r.param: r.value for r in crf.gradient_rows(seqs, model).collect()}
    sparse = S.SparseCRF(words, (0, 1), W, A, np.ones((2, 2), dtype=bool))
    csr = S.sparse_sequences(df, words, values="vals")
    got = {r.param: r.value for r in S.gradient_rows(df, sparse, values="vals").collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    monkeypatch.setattr(S, "DIRECT", 0)
    head, grad = S._summed(csr.mapInArrow(K.make_sparse_step(W, A, (0, 1)), S.PART_SCHEMA), 5, words.d, 2)
    assert abs(head[0] - want["loss"]) < 1e-9 and head[1] == len(rows)
    assert all(abs(grad[i, k] - want[f"{n}|{k}"]) < 1e-9 for i, n in enumerate(order) for k in (0, 1))


def test_fit_and_paths_equal_dense(spark, data, tmp_dir):
    rows, df, words = data
    order, seqs = dense(spark, rows, words)
    csr = S.sparse_sequences(df, words, values="vals")
    m = S.fit_sparse(csr, words, c2=0.5, max_iter=200)
    ref = crf.fit(seqs, tuple(order), c2=0.5, max_iter=200)
    assert abs(m.info["objective"] - ref.info["objective"]) < 1e-3 * ref.info["objective"]
    assert np.abs(m.W - ref.W).max() < 0.05
    exact = crf.CRFModel(tuple(order), (0, 1), m.W, m.A, m.trans_mask)
    want = {r.article_id: r.path for r in crf.decode_in_arrow(seqs, exact).collect()}
    got = {r.article_id: r.pred for r in S.decode_sparse(csr, m).collect()}
    assert got == {k: list(v) for k, v in want.items()} and len(got) == len(rows)
    m.save(spark, tmp_dir + "/m")
    again = S.SparseCRF.load(spark, tmp_dir + "/m")
    assert np.array_equal(again.W, m.W) and np.array_equal(again.A, m.A) and again.labels == m.labels
    assert np.array_equal(again.dictionary.hashes, words.hashes)


def test_gradient_parts_hold_only_touched_attributes(spark, data):
    _, df, words = data
    one = S.sparse_sequences(df.where("article_id = 'x0'"), words).coalesce(1)
    touched = {a for r in df.where("article_id = 'x0'").collect() for s in r.attrs for a in s}
    step = K.make_sparse_step(np.zeros((words.d, 2)), np.zeros((2, 2)), (0, 1))
    parts = [r for r in one.mapInArrow(step, S.PART_SCHEMA).collect() if r.block >= 0 and len(r.idx)]
    assert sum(len(r.idx) // 4 for r in parts) <= len(touched)


def test_maps_nulls_and_empty_articles(spark):
    df = spark.createDataFrame([
        ("m", ["s", "t"], [1, 0], [{"a": 2.0, "b": None}, None]), ("none", [], [], []), ("null", ["s"], [0], None)],
        "article_id string, sentences array<string>, sentence_labels array<int>, maps array<map<string,double>>")
    names, values = S.attribute_maps(F.col("maps"))
    df = df.withColumn("attrs", names).withColumn("vals", values)
    words = S.attribute_dictionary(df)
    assert {(r.name, r.n) for r in words.table.collect()} == {("a", 1), ("b", 1)}
    got = {r.article_id: r for r in S.sparse_sequences(df, words, values="vals").collect()}
    assert got["none"].m == [] and got["null"].m == [0] and got["m"].m == [2, 0]
    assert sorted(got["m"].val) == [0.0, 2.0]
    g = {r.param: r.value for r in S.gradient_rows(df, S.zero_model(words), values="vals").collect()}
    assert abs(g["loss"] - 3 * math.log(2)) < 1e-12 and g["a|1"] == -1.0 and g["b|0"] == 0.0


def test_empty_corpus(spark):
    df = spark.createDataFrame([], SCHEMA)
    words = S.attribute_dictionary(df)
    assert words.d == 0 and words.table.count() == 0
    assert S.sparse_sequences(df, words).count() == 0
    with pytest.raises(ValueError, match="no training labels"):
        S.fit_sparse(S.sparse_sequences(df, words), words)


def test_token_attributes(spark):
    df = spark.createDataFrame([([["x", "y"], [], ["z"]],), ([],)], "t array<array<string>>")
    got = [r[0] for r in df.select(S.token_attributes(F.col("t"))).collect()]
    assert got == [[["w=x", "w=y"], ["p=x", "p=y"], ["w=z"]], []]


def test_null_names_and_wrong_number_of_arrays(spark):
    rows = [("n", ["s", "t"], [1, 0], [["a", None, "b"], [None]], [[1.0, 5.0, 3.0], [2.0]])]
    df = spark.createDataFrame(rows, SCHEMA)
    words = S.attribute_dictionary(df)
    ids = {r.name: r.id for r in words.table.collect()}
    r = S.sparse_sequences(df, words, values="vals").first()
    assert r.m == [2, 0] and dict(zip(r.idx, r.val)) == {ids["a"]: 1.0, ids["b"]: 3.0}
    assert S.sparse_sequences(df, words).first().m == [2, 0]
    few = spark.createDataFrame([("n", ["s", "t"], [1, 0], [["a"]], None)], SCHEMA)
    with pytest.raises(Exception, match="one array of attributes"):
        S.sparse_sequences(few, words).collect()
