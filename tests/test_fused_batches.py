"""H1 for H9, H11, H12: the training rows of a partition, which a Python worker may be sent at once, are bounded."""
from pyspark.sql import functions as F

from tessera.operators import crf_fused
from tessera.plans import experiments as X
from tessera.operators.features import FeatureContext
from tessera.sources.lexicons import testdata_bias_lexicon as bias_lexicon
from tessera.sources.lexicons import testdata_subjectivity_lexicon as subjectivity_lexicon
from tessera.sources.synthetic import synthetic_articles


def test_partitions_follow_the_rows_bytes(spark, monkeypatch):
    arts = synthetic_articles(spark, n_per_domain=30)
    ctx = FeatureContext(bias_lexicon(spark), subjectivity_lexicon(spark))
    vecs = arts.select("article_id", F.posexplode("sentences").alias("pos", "s")).select(
        "article_id", "pos", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: (F.pmod(F.xxhash64(
            "s", k), F.lit(1000)) / 1000.0).cast("float")).alias("vec"))
    seen, real = [], crf_fused.fit_together

    def fit(rows, *a, **k):
        seen.append(rows.rdd.getNumPartitions())
        return real(rows, *a, **k)
    monkeypatch.setattr(crf_fused, "fit_together", fit)
    cfg = X.CRFConfig(max_iter=2, pca_dim=3, partitions=2)
    few = sorted(X.cross_domain(spark, arts, ctx, ["BASIL", "WIKI"], cfg, vecs).collect())
    monkeypatch.setattr(crf_fused, "PART_BYTES", 4 << 10)
    assert sorted(X.cross_domain(spark, arts, ctx, ["BASIL", "WIKI"], cfg, vecs).collect()) == few
    assert seen[0] == 2 and seen[1] >= 8, seen
