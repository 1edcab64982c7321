"""Whole inputs, one pass, and the same answer by every path."""
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import baseline as B
from tessera.operators import crf
from tessera.operators import features as FT
from tessera.operators.sentences import explode_sentences
from tessera.operators.vectors import article_matrices, fit_pca_articles, training_rows
from tessera.sources.lexicons import lines_from_list, parse_bias_lexicon, parse_subjectivity_lexicon

ART = ("article_id string, domain string, split string, sentences array<string>, "
       "sentence_labels array<int>, subtypes array<string>")
SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _context(spark, terms=("bad", "awful"), clues=("word1=good priorpolarity=positive",)):
    return FT.FeatureContext(parse_bias_lexicon(lines_from_list(spark, list(terms))),
                             parse_subjectivity_lexicon(lines_from_list(spark, list(clues))))


def test_repeated_article_ids_count_the_same_in_every_tier(spark):
    arts = spark.createDataFrame([
        ("a", "D", "train", ["bad good", "x bad awful bad"], [0, 0], None),
        ("a", "D", "train", ["good good bad bad bad", ""], [0, 0], None),
        ("a", "D", "train", [], [], None), ("b", "D", "train", ["x bad awful bad"], [1], None),
        ("b", "D", "train", ["x bad awful bad"], [1], None)], ART)
    ctx = _context(spark)
    answers = []
    for tier in ("inline", "arrow", "broadcast", "salted"):
        f = FT.sentence_features(explode_sentences(arts, keep=()), ctx, True, tier)
        rows = sorted((r.article_id, r.pos, r.sentence, r.sent_pos, r.bias_lex, r.len) for r in f.collect())
        w = FT.with_feature_arrays(arts, ctx, True, tier)
        assert w.columns == [*arts.columns, "feats"]
        whole = sorted((r.article_id, tuple(tuple(x) for x in r.feats)) for r in w.collect())
        answers.append((rows, whole))
    assert all(a == answers[0] for a in answers)
    assert len(answers[0][0]) == 6 and len(answers[0][1]) == 5


def test_large_lexicon_plans_quickly(spark):
    ctx = _context(spark)
    ctx.bias_terms = spark.range(100_000).select(F.concat(F.lit("t"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("term"))
    sents = spark.createDataFrame([("a", 0, "tf and tjjjjj x")], "article_id string, pos int, sentence string")
    ctx.sizes()
    began = time.time()
    f = FT.sentence_features(sents, ctx)
    assert time.time() - began < 10 and ctx.strategy() == "arrow"
    assert f.first().bias_lex == 2.0


def test_broadcast_join_checks_the_size(spark, monkeypatch):
    monkeypatch.setattr(FT, "BROADCAST_MAX_TERMS", 1)
    sents = spark.createDataFrame([("a", 0, "bad")], "article_id string, pos int, sentence string")
    with pytest.raises(ValueError):
        FT.sentence_features(sents, _context(spark), True, "broadcast")


def test_baseline_reads_whole_texts(spark):
    filler = " ".join(["filler"] * 600)
    rows = [(str(i), "d", "train", f"{filler} {'scum' if i % 2 else 'fine'}", float(i % 2)) for i in range(40)]
    frame = spark.createDataFrame(rows, "article_id string, domain string, split string, text string, label double")
    model, _ = B.fit_with_validation(frame, frame, candidates=((0.0, 20),))
    assert all(r.y_true == r.y_pred for r in B.predict(model, frame).collect())
    cut, _ = B.fit_with_validation(frame, frame, candidates=((0.0, 20),), max_len=512)
    assert any(r.y_true != r.y_pred for r in B.predict(cut, frame).collect())


def test_vector_positions(spark):
    schema = "article_id string, pos int, vec array<double>, ordinal int"
    v = spark.createDataFrame([("a", 0, [1.0], 1), ("a", 0, [2.0], 2), ("a", 1, [3.0], 1)], schema)
    assert article_matrices(v).first().vrows == [[2.0], [3.0]]  # the last wins
    bad = spark.createDataFrame([("a", 0, [1.0], 1), ("a", 0, [2.0], 2), ("a", 2, [3.0], 3)], schema)
    for df in (bad, bad.drop("ordinal"), v.drop("ordinal")):
        with pytest.raises(Exception, match="dense"):
            article_matrices(df).collect()


def test_pca_counts_missing_rows_as_zero_and_moves_no_text(spark):
    arts = spark.createDataFrame([("a", "D", "train", ["s0", "s1", "s2"], [0, 0, 0], None),
                                  ("b", "D", "train", ["s0"], [0], None), ("c", "D", "train", ["s0"], [0], None)], ART)
    v = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 1.0]), ("a", 7, [9.0, 9.0]), ("c", 0, [0.0, 5.0])],
                              "article_id string, pos int, vec array<double>")
    rows, zeros = training_rows(arts, v)
    assert zeros == 1 and rows.count() == 3
    x = np.array([[1, 2], [3, 1], [0, 0], [0, 5]], float)
    p = fit_pca_articles(arts, v)
    assert np.allclose(p.mean, x.mean(0))
    assert np.allclose(np.sort(p.variances), np.sort(np.linalg.eigvalsh(np.cov(x.T))))
    assert not [c for c in rows.columns if c == "sentences"]


def test_one_kernel_run_per_partition_and_evaluation(spark, monkeypatch):
    monkeypatch.setattr(crf, "COLLECT_MAX_PARTITIONS", 1)
    runs = spark.sparkContext.accumulator(0)

    def kernel(batches):
        import pyarrow as pa
        runs.add(1)
        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_pydict({"loss": pa.array([1.5]), "grad": pa.array([[1.0, 2.0]]),
                                          "nseq": pa.array([n])})
    parts = spark.range(80, numPartitions=8).mapInArrow(kernel, crf.STEP_SCHEMA)
    loss, grad, n = crf.CRFObjective._sum_rows(parts, 8, 2)
    assert (loss, grad.tolist(), n) == (12.0, [8.0, 16.0], 80) and runs.value == 8


def test_too_few_labels_and_unknown_labels_raise(spark):
    arts = spark.createDataFrame([("a", "D", "train", ["s0", "s1"], [0], None)], ART)
    fa = FT.with_feature_arrays(arts, None, False)
    with pytest.raises(Exception, match="fewer sentence_labels"):
        crf.sequences(fa, FT.feature_names(False)).collect()
    odd = spark.createDataFrame([("a", "D", "train", ["s0"], [5], None)], ART)
    m = crf.fixed_model(FT.feature_names(False), {}, np.zeros((2, 2)))
    seqs = crf.sequences(FT.with_feature_arrays(odd, None, False), FT.feature_names(False))
    with pytest.raises(Exception, match="unknown to the model"):
        crf.sequence_nll(seqs, m).collect()


def test_predict_scans_documents_once(spark):
    import os
    if not os.path.isdir(SF):
        pytest.skip("testdata not present")
    import __spark_entry__ as E
    for q in ("crf_predict", "crf_decode_arrow", "crf_grad0"):
        plan = _plan(E.queries()[q](spark, SF)).split("== Initial Plan ==")[0]
        assert plan.count("FileScan parquet") == 1 and plan.count("MapInArrow") == 1, q
