"""H7, H9, H11 at size: texts are tokenised once for all fits, and Word2Vec is not one task."""
from pyspark.sql import functions as F

from tessera.operators import baseline as B
from tessera.sources.synthetic import synthetic_articles


def test_texts_are_tokenised_once_for_all_fits(spark, monkeypatch):
    arts = synthetic_articles(spark, n_per_domain=20)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text
    real = B.article_text_frame
    # a text is read when it is tokenised
    monkeypatch.setattr(B, "article_text_frame", lambda a: real(a).withColumn("text", counted("text")))
    domains = sorted(r.domain for r in arts.select("domain").distinct().collect())
    assert B.cross_domain(spark, arts, domains, iters=2).count() == 6
    assert seen.value == 60
    assert B.learning_curve(spark, arts, iters=2).count() == 3
    assert seen.value == 120


def test_word2vec_learns_in_tasks_by_training_texts(spark, monkeypatch):
    assert B._learned("word2vec_lr", 19_999).getNumPartitions() == 1
    assert B._learned("word2vec_lr", 256_410).getNumPartitions() == 13
    monkeypatch.setattr(B, "WORD2VEC_TEXTS", 10)
    frame = B.article_text_frame(synthetic_articles(spark, n_per_domain=20))
    model, table = B.fit_with_validation(frame, frame, "word2vec_lr", candidates=((0.0, 5),))
    assert table.first().n_val == 60 and len(B.predict(model, frame).collect()) == 60
