"""Structured Streaming scoring with a fitted model."""
from tessera.plans import experiments as X
from tessera.sources import sinks
from tessera.sources.synthetic import synthetic_articles
from tessera.streaming.scoring import read_article_stream, scored_stream, write_predictions
from tessera.operators.features import FeatureContext
from tessera.sources.lexicons import lines_from_list, parse_bias_lexicon, parse_subjectivity_lexicon


def test_stream_scoring(spark, tmp_dir):
    arts = synthetic_articles(spark, n_per_domain=20)
    sinks.write_jsonl(arts, f"{tmp_dir}/in")
    ctx = FeatureContext(parse_bias_lexicon(lines_from_list(spark, ["draconian"])),
                         parse_subjectivity_lexicon(lines_from_list(spark, [])))
    run = X.train(spark, arts, ctx, X.CRFConfig(use_vectors=False, max_iter=10))
    q = write_predictions(scored_stream(read_article_stream(spark, f"{tmp_dir}/in"), run, ctx),
                          f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    q.awaitTermination(300)
    out = spark.read.parquet(f"{tmp_dir}/out")
    assert out.count() == 60
    assert out.filter("y_true = y_pred").count() >= 55


def test_running_confusion_stream(spark, tmp_dir):
    from tessera.streaming.scoring import running_confusion
    arts = synthetic_articles(spark, n_per_domain=10)
    sinks.write_jsonl(arts, f"{tmp_dir}/in2")
    ctx = FeatureContext(parse_bias_lexicon(lines_from_list(spark, ["draconian"])),
                         parse_subjectivity_lexicon(lines_from_list(spark, [])))
    run = X.train(spark, arts, ctx, X.CRFConfig(use_vectors=False, max_iter=10))
    agg = running_confusion(scored_stream(read_article_stream(spark, f"{tmp_dir}/in2"), run, ctx))
    q = (agg.writeStream.format("memory").queryName("tessera_conf").outputMode("complete")
         .option("checkpointLocation", f"{tmp_dir}/ckpt2").trigger(availableNow=True).start())
    q.awaitTermination(300)
    rows = spark.sql("SELECT * FROM tessera_conf").collect()
    assert {r.domain for r in rows} == {"BASIL", "WIKI", "MFC"}
    assert sum(r.tp + r.fp + r.fn + r.tn for r in rows) == 30
