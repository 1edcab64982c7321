"""H7, H8 as runs: an experiment cuts each text into tokens once, and its models still take texts."""
from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.operators import baseline as B
from tessera.sources.synthetic import synthetic_articles


def test_experiment_reads_each_text_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text
    real = B.article_text_frame
    monkeypatch.setattr(B, "article_text_frame", lambda a: real(a).withColumn("text", counted("text")))
    assert E.queries()["classifier_experiment"](spark, E.SMOKE_DIR).count() == 4
    assert seen.value == spark.read.parquet(f"{E.SMOKE_DIR}/documents.parquet").count()


def test_model_fitted_on_tokens_takes_texts(spark, tmp_dir):
    arts = synthetic_articles(spark, n_per_domain=20)
    cut = B.tokenised(arts)
    for variant in ("tfidf_lr", "word2vec_lr"):
        a, b = (B.fit_with_validation(t, t, variant, candidates=((0.01, 5),))[0] for t in (B.article_text_frame(arts), cut))
        assert [type(s) for s in a.stages] == [type(s) for s in b.stages]
        B.save_model(b, f"{tmp_dir}/{variant}")
        loaded = B.load_model(f"{tmp_dir}/{variant}")
        on_texts = B.predict(loaded, B.article_text_frame(arts)).orderBy("article_id").collect()
        assert on_texts == B.predict(loaded, cut).orderBy("article_id").collect()
        if variant == "tfidf_lr":
            assert on_texts == B.predict(a, B.article_text_frame(arts)).orderBy("article_id").collect()
