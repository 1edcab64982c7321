"""End-to-end: synthetic corpus -> JSONL -> train/eval -> results -> charts."""
from pyspark.sql import functions as F

from tessera.operators.features import FeatureContext
from tessera.plans import experiments as X
from tessera.plans.reports import aggregate_results, chart_curve, chart_main
from tessera.sources import sinks
from tessera.sources.articles import read_articles_jsonl
from tessera.sources.lexicons import lines_from_list, parse_bias_lexicon, parse_subjectivity_lexicon
from tessera.sources.results import read_predictions
from tessera.sources.synthetic import synthetic_articles


def _ctx(spark):
    return FeatureContext(parse_bias_lexicon(lines_from_list(spark, ["draconian", "reckless", "heartless"])),
                          parse_subjectivity_lexicon(lines_from_list(spark, [])))


def test_end_to_end(spark, tmp_dir):
    sinks.write_jsonl(synthetic_articles(spark), f"{tmp_dir}/data/all")
    arts = read_articles_jsonl(spark, f"{tmp_dir}/data/all").cache()
    assert arts.count() == 180
    ctx = _ctx(spark)
    cfg = X.CRFConfig(use_vectors=False, use_lexicons=True)
    X.run_train(spark, arts, ctx, f"{tmp_dir}/results/crf", cfg)
    pred = X.run_eval(spark, arts, ctx, f"{tmp_dir}/results/crf", f"{tmp_dir}/results/crf_eval")
    m = X.article_metrics(pred).first()
    assert m.f1 > 0.9
    preds = read_predictions(spark, f"{tmp_dir}/results/crf_eval/crf_preds")
    assert preds.count() == 60
    main, sub = aggregate_results(spark, f"{tmp_dir}/results", f"{tmp_dir}/summary")
    rows = {(r.split, r.source_dir.split("/")[-1]) for r in main.collect()}
    assert rows == {("val", "crf"), ("test", "crf_eval")}
    assert {r.model for r in sub.collect()} == {"CRF_EVAL"}
    chart = chart_main(main).collect()
    assert len(chart) == 6 and {r.metric for r in chart} == {"f1", "precision", "recall"}
    curve = spark.createDataFrame([("CRF", 50.0, 0.5), ("CRF", 25.0, 0.2), (None, 10.0, 0.1)],
                                  "model string, train_pct double, f1 double")
    pts = [(r.point, r.train_pct) for r in chart_curve(curve).orderBy("point").collect()]
    assert pts == [(0, 25.0), (1, 50.0)]


def test_cross_domain_ablation_curve(spark):
    arts = synthetic_articles(spark).cache()
    ctx = _ctx(spark)
    cd = X.cross_domain(spark, arts, ctx, ["BASIL", "WIKI"], X.CRFConfig(use_vectors=False, max_iter=15))
    notes = {r.notes for r in cd.collect()}
    assert notes == {"BASIL->WIKI", "WIKI->BASIL"}
    ab = {r.variant: r for r in X.ablation(spark, arts, ctx, None, X.CRFConfig(max_iter=15),
                                           {"full": {}, "no_lex": {"use_lexicons": False}}).collect()}
    assert ab["full"].delta_f1 == 0.0 and ab["no_lex"].f1 <= ab["full"].f1
    lc = X.learning_curve(spark, arts, ctx, pcts=(50.0, 100.0), cfg=X.CRFConfig(use_vectors=False, max_iter=15))
    assert [r.train_pct for r in lc.collect()] == [50.0, 100.0]


def test_vectors_run_and_reload(spark, tmp_dir):
    arts = synthetic_articles(spark).filter(F.col("domain") == "BASIL").cache()
    vecs = (arts.select("article_id", F.posexplode("sentences").alias("pos", "s"))
            .filter("pos < 3")
            .select("article_id", "pos", F.array(F.length("s").cast("double"),
                                                 F.col("pos").cast("double"), F.lit(1.0)).alias("vec")))
    ctx = _ctx(spark)
    run = X.run_train(spark, arts, ctx, f"{tmp_dir}/r", X.CRFConfig(max_iter=10, pca_dim=2), vecs)
    assert run.proj is not None and run.proj.k == 2 and run.model.d == 11
    back = X.load_run(spark, f"{tmp_dir}/r")
    assert back.model.toggles["use_vectors"] and back.proj.k == 2
    p = X.predict(back, arts, ctx, vecs)
    assert p.count() == 60


def test_predict_agrees_with_the_catalyst_decoder(spark):
    from pyspark.sql import functions as F

    from tessera.operators import crf
    arts = synthetic_articles(spark, n_per_domain=10).cache()
    ctx = _ctx(spark)
    run = X.train(spark, arts, ctx, X.CRFConfig(use_vectors=False, max_iter=15))
    a = {r.article_id: list(r.pred) for r in X.predict(run, arts, ctx).collect()}
    fa = X.featurise(arts, ctx, run.config, None, None)
    b = {r.article_id: list(r.pred) for r in fa.select(
        "article_id", crf.decode(F.col("feats"), run.model).alias("pred")).collect()}
    assert a == b and len(a) == 30


def test_toggles_saved_with_model(spark, tmp_dir):
    arts = synthetic_articles(spark, n_per_domain=20).cache()
    ctx = _ctx(spark)
    X.run_train(spark, arts, ctx, f"{tmp_dir}/nolex", X.CRFConfig(use_lexicons=False, use_vectors=False,
                                                                   max_iter=5))
    run = X.load_run(spark, f"{tmp_dir}/nolex")
    assert run.model.feature_names == ("position", "lead") and not run.config.use_lexicons  # X3
    assert X.predict(run, arts, ctx).count() == 60


def test_unknown_baseline_variant_raises(spark):
    import pytest
    from tessera.operators.baseline import _featurizer
    with pytest.raises(ValueError):
        _featurizer("roberta_da")  # X12


def test_baselines_fit_predict_save_load(spark, tmp_dir):
    from tessera.operators import baseline as B
    frame = B.article_text_frame(synthetic_articles(spark)).cache()
    tr, va, te = (frame.filter(f"split = '{s}'") for s in ("train", "val", "test"))
    for variant in ("tfidf_lr", "word2vec_lr"):
        model, table = B.fit_with_validation(tr, va, variant, candidates=((0.0, 10), (0.1, 10)))
        assert table.count() == 2
        B.save_model(model, f"{tmp_dir}/{variant}")
        preds = B.predict(B.load_model(f"{tmp_dir}/{variant}"), te)
        m = X.article_metrics(preds).first()
        assert m.n == 60 and m.accuracy is not None
        if variant == "tfidf_lr":
            assert m.f1 > 0.8  # the positive template's words separate the classes


def test_result_scan_ignores_other_tables(spark, tmp_dir):
    from tessera.sources.results import read_main_results
    m = spark.createDataFrame([("CRF", "all", "val", 0.5, 0.5, 0.5, 0.5, "v")],
                              "model string, domain string, split string, accuracy double, precision double, "
                              "recall double, f1 double, notes string")
    sinks.dump_result_row(m, f"{tmp_dir}/root/run1")
    # another table under the same root with a clashing column type
    spark.createDataFrame([("x", "not a number")], "model string, f1 string") \
        .write.parquet(f"{tmp_dir}/root/run1/model/other")
    rows = read_main_results(spark, f"{tmp_dir}/root").collect()
    assert len(rows) == 1 and rows[0].f1 == 0.5 and rows[0].source_dir.endswith("/run1")


def test_csv_results_of_any_width_and_quoted_line_ends(spark, tmp_dir):
    """More columns than any fixed number, a record over two lines, a short record, a nameless and a repeated column."""
    import os

    from tessera.sources.results import read_main_results
    os.makedirs(f"{tmp_dir}/a")
    os.makedirs(f"{tmp_dir}/b")
    wide = [f"x{i}" for i in range(90)]
    with open(f"{tmp_dir}/a/metrics.csv", "w") as f:
        f.write("model,f1,notes," + ",".join(wide) + "\n")
        f.write('M,0.5,"two\nlines, one cell",' + ",".join(str(i) for i in range(90)) + "\n\n")
    with open(f"{tmp_dir}/b/metrics.csv", "wb") as f:
        f.write(b"\xef\xbb\xbfmodel,f1,,twice,twice\r\nN,0.25,skipped,1,2\r\nO,\r\n")
    rows = {r.model: r for r in read_main_results(spark, tmp_dir).collect()}
    assert rows["M"].notes == "two\nlines, one cell" and rows["M"].x89 == "89" and rows["M"].f1 == 0.5
    assert rows["N"].twice == "2" and rows["N"].x0 is None and rows["O"].f1 is None
    assert rows["N"].source_dir.endswith("/b")
