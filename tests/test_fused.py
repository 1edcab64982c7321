"""Models fitted together: same weights as separate fits, the jobs of one."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import crf, crf_fused, lbfgs
from tessera.operators.features import FeatureContext
from tessera.plans import experiments as X
from tessera.sources.lexicons import testdata_bias_lexicon as bias_lexicon
from tessera.sources.lexicons import testdata_subjectivity_lexicon as subjectivity_lexicon
from tessera.sources.synthetic import synthetic_articles


@pytest.fixture(scope="module")
def corpus(spark):
    arts = synthetic_articles(spark, n_per_domain=45).cache()
    ctx = FeatureContext(bias_lexicon(spark), subjectivity_lexicon(spark))
    # no vectors for some articles, none for the last sentence of others
    vecs = (arts.filter("article_id NOT LIKE '%7'")
            .select("article_id", F.posexplode("sentences").alias("pos", "s"), F.size("sentences").alias("n"))
            .filter("NOT (article_id LIKE '%5' AND pos = n - 1)")
            .select("article_id", "pos", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: (F.pmod(F.xxhash64(
                "s", k), F.lit(1000)) / 1000.0 + F.length("s") * k / 40.0)).alias("vec"))).cache()
    return arts, ctx, vecs


def jobs_of(spark, work):
    """How many Spark jobs ``work`` starts."""
    name = f"count-{id(work)}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def near(a, b, tol=1e-9):
    return a.feature_names == b.feature_names and a.labels == b.labels and \
        np.abs(a.W - b.W).max() < tol and np.abs(a.A - b.A).max() < tol


def test_ablation_equals_separate_fits(spark, corpus):
    arts, ctx, vecs = corpus
    base = X.CRFConfig(max_iter=12, pca_dim=3, partitions=3)
    variants = [(X.replace(base, **c), 0) for c in X.ABLATIONS.values()]
    models, got = X._score_together(spark, arts, ctx, vecs, [F.col("split") == "train"], variants, F.col("split") == "val")
    for i, (cfg, _) in enumerate(variants):
        run = X.train(spark, arts, ctx, cfg, vecs)
        assert np.abs(np.abs(run.model.W) - np.abs(models[i].W)).max() < 1e-7  # a component's sign is free
        if run.proj is None:
            assert near(run.model, models[i])
        m = X.article_metrics(X.predict(run, arts.filter("split = 'val'"), ctx, vecs)).first()
        mine = next(r for r in got if r.model == i)
        assert (mine.tp, mine.fp, mine.fn, mine.tn, mine.n) == (m.tp, m.fp, m.fn, m.tn, m.n)
        assert models[i].trans_mask.tolist() == run.model.trans_mask.tolist()


def test_row_groups_equal_separate_fits(spark, corpus):
    arts, ctx, _ = corpus
    cfg = X.CRFConfig(use_vectors=False, max_iter=15, partitions=3)
    bucket = X.hash_bucket(F.col("article_id"), 100, "curve")
    groups = [(F.col("split") == "train") & (bucket < p) for p in (25, 50, 100)]
    models, _ = X._score_together(spark, arts, ctx, None, groups, [(cfg, g) for g in range(3)], F.col("split") == "test")
    for p, model in zip((25, 50, 100), models):
        run = X.train(spark, X.nested_sample(arts.filter("split = 'train'"), p), ctx, cfg, split=None)
        assert near(run.model, model)


def test_jobs_are_those_of_one_fit(spark, corpus, monkeypatch):
    """Passes follow the longest fit, whatever the number of models; the other jobs are a fixed few."""
    arts, ctx, vecs = corpus
    cfg = X.CRFConfig(max_iter=12, pca_dim=3, partitions=3)
    fitted = []
    monkeypatch.setattr(crf_fused, "fit_together", lambda *a, real=crf_fused.fit_together, **k: fitted.append(real(*a, **k)) or fitted[-1])
    domains = sorted(r.domain for r in arts.select("domain").distinct().collect())
    jobs = [jobs_of(spark, lambda: X.cross_domain(spark, arts, ctx, domains, cfg, vecs).collect()),
            jobs_of(spark, lambda: X.ablation(spark, arts, ctx, vecs, cfg).collect())]
    assert [len(f) for f in fitted] == [3, 5]
    for models, n in zip(fitted, jobs):
        each = [m.info["evaluations"] for m in models]
        assert models[0].info["passes"] == max(each)
        assert n <= max(each) + 40 < sum(each) + 40, (n, each)


def test_long_sequences_and_more_partitions_than_are_collected(spark, corpus, monkeypatch):
    arts, ctx, _ = corpus
    fa = X.featurise(arts.filter("split = 'train'"), ctx, X.CRFConfig(use_vectors=False), None, None)
    names = X.feature_names(True)
    seqs = crf.sequences(fa, names)
    whole = crf.fit(seqs, names, max_iter=8, partitions=3)
    spec = [crf_fused.Spec(names, np.eye(len(names)), 0, max_iter=8)]
    rows = seqs.withColumn("member", F.lit(1).cast("long"))
    assert near(crf_fused.fit_together(rows, spec, 3, hot_len=6, segment_len=2)[0], whole, 1e-6)
    monkeypatch.setattr(crf_fused, "COLLECT_MAX_PARTITIONS", 1)
    assert near(crf_fused.fit_together(rows, spec, 3)[0], whole)


def test_fits_leave_when_done():
    """Quadratics of different sizes: each evaluated only while it runs, with the result of its own run."""
    rng = np.random.default_rng(0)
    problems = [(rng.normal(size=n), rng.uniform(0.5, 30, size=n)) for n in (1, 3, 8)]
    fg = [lambda w, c=c, s=s: (float((s * (w - c) ** 2).sum()), 2 * s * (w - c)) for c, s in problems]
    asked = []

    def evaluate(at):
        asked.append(set(at))
        return {k: fg[k](w) for k, w in at.items()}
    done = lbfgs.minimize_together(evaluate, {k: lbfgs.steps(np.zeros(len(c))) for k, (c, _) in enumerate(problems)})
    for k, (c, _) in enumerate(problems):
        alone = lbfgs.minimize(fg[k], np.zeros(len(c)))
        assert np.array_equal(alone.w, done[k].w) and alone.evaluations == done[k].evaluations
    assert asked[0] == {0, 1, 2} and len(asked[-1]) < 3 and len(asked) == max(d.evaluations for d in done.values())
