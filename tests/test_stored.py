"""Stored layouts: articles bucketed by id (B1, C3) and the states of a fit that goes on."""
import numpy as np
import pytest

from tessera.operators import crf, fit_state, lbfgs
from tessera.operators.vectors import article_matrices, attach_vectors
from tessera.plans.catalog import queries
from tessera.plans.catalog_models import stored_articles_with_vectors
from tessera.sources.articles import split_filter
from tessera.sources.sinks import buckets_for, store_by_article

SMALL = "/root/testdata/sf0.001"


def test_stored_articles_join_without_exchange(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = stored_articles_with_vectors(spark, SMALL, "test")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert "PartitionFilters: [isnotnull(split" in plan or "PartitionFilters: [(split" in plan
        got = sorted(map(tuple, rows.select("article_id", "sentences", "vecs").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    stored = queries()["stored_lookup"](spark, SMALL).drop("split")
    plain = queries()["embed_lookup"](spark, SMALL)
    ids = {r[0] for r in got}
    assert sorted(map(tuple, stored.collect())) == sorted(tuple(r) for r in plain.collect() if r.article_id in ids)


def test_stored_rows_are_the_same(spark, tmp_dir):
    schema = ("article_id string, domain string, split string, sentences array<string>, "
              "sentence_labels array<int>, subtypes array<string>")
    rows = [(f"a{i}", "D", "train" if i % 3 else "test", [f"s{j}" for j in range(i % 4)], [0] * (i % 4), None)
            for i in range(200)] + [(None, "D", "test", ["x"], [1], None), ("a1", "D", "test", ["again"], [1], ["t"])]
    arts = spark.createDataFrame(rows, schema)
    vecs = spark.createDataFrame([(f"a{i}", j, [float(i), float(j)]) for i in range(0, 200, 2) for j in range(i % 4 + 1)],
                                 "article_id string, pos int, vec array<double>")
    stored = store_by_article(arts, "stored_arts_test", f"{tmp_dir}/arts", 4)
    matrices = store_by_article(article_matrices(vecs), "stored_vecs_test", f"{tmp_dir}/vecs", 4, by_split=False)
    cols = arts.columns
    assert sorted(map(str, stored.select(cols).collect())) == sorted(map(str, arts.collect()))
    for split in ("train", "test", None):
        a = attach_vectors(split_filter(stored, split), matrices).select(*cols, "vecs")
        b = attach_vectors(split_filter(arts, split), article_matrices(vecs)).select(*cols, "vecs")
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    empty = store_by_article(arts.where("false"), "stored_empty_test", f"{tmp_dir}/empty", 4)
    assert empty.count() == 0
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert buckets_for(docs) == spark.sparkContext.defaultParallelism
    assert buckets_for(docs, bucket_bytes=1_000) > 20 and buckets_for(docs, 4, 1_000) > 80


def test_steps_go_on_bit_for_bit(spark, tmp_dir):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 12))

    def fg(w):
        r = a @ w - 1
        return float(np.log1p(r * r).sum()), a.T @ (2 * r / (1 + r * r))

    kept = []
    whole = lbfgs.minimize(fg, np.zeros(12), max_iter=40, each_round=kept.append)
    assert whole.iterations > 15 and [s.iterations for s in kept][:3] == [1, 2, 3]
    for at in (1, 7, len(kept) - 1):
        fit_state.save_state(spark, f"{tmp_dir}/states{at}", "k", kept[at])
        state = fit_state.load_state(spark, f"{tmp_dir}/states{at}", "k", 40)
        rest = lbfgs.minimize(fg, np.zeros(12), max_iter=40, resume=state)
        assert np.array_equal(rest.w, whole.w) and rest.f == whole.f and rest.history == whole.history
        assert (rest.iterations, rest.evaluations, rest.converged) == (
            whole.iterations, whole.evaluations, whole.converged)
    assert fit_state.load_state(spark, f"{tmp_dir}/states7", "other", 40) is None
    assert fit_state.load_state(spark, f"{tmp_dir}/states7", "k", 3) is None  # a state past the rounds asked for
    assert fit_state.load_state(spark, f"{tmp_dir}/nothing", "k", 40) is None


def test_crf_fit_goes_on(spark, tmp_dir, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):  # values in eighths and one partition: sums do not depend on their order
        n = int(rng.integers(1, 9))
        x = rng.integers(-16, 17, size=(n, 3)) / 8
        rows.append((f"a{i}", n, x.ravel().tolist(), (x[:, 0] + rng.integers(-4, 5, size=n) / 8 > 0).astype(int).tolist()))
    seqs = spark.createDataFrame(rows, "article_id string, n int, x array<double>, y array<int>").coalesce(1)
    args = dict(partitions=1, max_iter=24, state_every=10)
    whole = crf.fit(seqs, ("f", "g", "h"), partitions=1, max_iter=24)
    path = f"{tmp_dir}/states"

    class Lost(Exception):
        pass

    save = fit_state.save_state

    def save_and_die(*state):
        save(*state)
        raise Lost

    monkeypatch.setattr(fit_state, "save_state", save_and_die)
    with pytest.raises(Lost):
        crf.fit(seqs, ("f", "g", "h"), state_path=path, **args)
    monkeypatch.setattr(fit_state, "save_state", save)
    assert [r.iterations for r in spark.read.parquet(path).collect()] == [10]
    counts = []
    gradient = crf.CRFObjective.__call__
    monkeypatch.setattr(crf.CRFObjective, "__call__", lambda self, w: counts.append(1) or gradient(self, w))
    rest = crf.fit(seqs, ("f", "g", "h"), state_path=path, **args)
    assert np.array_equal(rest.W, whole.W) and np.array_equal(rest.A, whole.A) and rest.info == whole.info
    assert len(counts) < whole.info["evaluations"] - 8  # the first ten rounds are not run again
    # another fit does not take these states
    other = crf.fit(seqs, ("f", "g", "h"), state_path=path, c2=0.5, **args)
    assert np.array_equal(other.W, crf.fit(seqs, ("f", "g", "h"), c2=0.5, partitions=1, max_iter=24).W)
