"""D1-D6, R12-R14, X9-X11."""
import math

from pyspark.sql import functions as F

from tessera.functions.stats import chi2_1_sf
from tessera.operators import metrics as M


def test_zero_safe_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y_true int, y_pred int")
    m = M.global_binary_metrics(df).first()
    assert (m.tp, m.fp, m.fn, m.tn, m.n) == (0, 0, 1, 2, 3)
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)
    assert abs(m.accuracy - 2 / 3) < 1e-15
    empty = M.global_binary_metrics(df.filter("false")).first()
    assert empty.accuracy is None and (empty.precision, empty.recall, empty.f1, empty.n) == (0.0, 0.0, 0.0, 0)


def test_metrics_values(spark):
    rows = [(1, 1), (1, 1), (1, 0), (0, 1), (0, 0), (2, 1)]
    m = M.global_binary_metrics(spark.createDataFrame(rows, "y_true int, y_pred int")).first()
    assert (m.tp, m.fp, m.fn) == (2, 2, 1)
    assert abs(m.precision - 0.5) < 1e-15 and abs(m.recall - 2 / 3) < 1e-15
    assert abs(m.f1 - 2 * 0.5 * (2 / 3) / (0.5 + 2 / 3)) < 1e-12


def test_subtype_breakdown_rules(spark):
    df = spark.createDataFrame([
        ("a", [1, 0, 1, 0], [1, 1, 0], ["loaded", "none", "emotive", "none"]),
        ("b", [1], [1], None),
        ("c", [1], [0], []),
        ("d", [0, 1], [1, 1], ["none", "loaded"]),
    ], "article_id string, sentence_labels array<int>, pred array<int>, subtypes array<string>")
    r = {x.subtype: x for x in M.subtype_breakdown(df).collect()}
    assert set(r) == {"loaded", "none", "emotive"}
    assert r["loaded"].support == 2 and r["loaded"].precision == 1.0 and r["loaded"].recall == 1.0
    assert r["none"].support == 2 and r["none"].precision == 0.0 and r["none"].f1 == 0.0
    assert r["emotive"].support == 1 and r["emotive"].recall == 0.0


def test_mcnemar_and_pvalue(spark):
    a = spark.createDataFrame([("x", 1, 1), ("y", 0, 1), ("z", 1, 0), ("w", 0, 0)], "article_id string, y_true int, y_pred int")
    b = spark.createDataFrame([("x", 1, 0), ("y", 0, 0), ("z", 1, 1), ("v", 0, 0)], "article_id string, y_true int, y_pred int")
    r = M.mcnemar(a, b).first()
    assert (r.n_pairs, r.n01, r.n10) == (3, 2, 1)
    assert abs(r.statistic - (abs(2 - 1) - 1) ** 2 / 3) < 1e-15
    assert abs(r.p_value - math.erfc(math.sqrt(r.statistic / 2))) < 1e-12
    same = M.mcnemar(a, a).first()
    assert (same.n01, same.n10, same.statistic, same.p_value) == (0, 0, 0.0, 1.0)
    dup = M.mcnemar(a.unionByName(a.filter("article_id = 'x'")), b).first()
    assert dup.n_pairs == 4  # duplicates multiply (X11)
    assert M.check_unique_keys(a.unionByName(a)).count() == 4


def test_chi2_tail_matches_erfc(spark):
    xs = [0.0, 1e-9, 0.01, 0.5, 1.0, 2.5, 3.841458820694124, 7.5, 10.0, 25.0, 50.0, 71.9, 72.1, 200.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.p for r in df.select(chi2_1_sf(F.col("x")).alias("p")).collect()]
    for x, p in zip(xs, got):
        assert abs(p - math.erfc(math.sqrt(x / 2))) < 1e-12, (x, p)


def test_aggregated_discordance_equals_join(spark):
    rows_a = [("k", 1, 1), ("k", 1, 0), ("k", 0, 0), ("m", 1, 0), ("n", 0, 1)]
    rows_b = [("k", 1, 0), ("k", 0, 0), ("m", 1, 1), ("m", 1, 0), ("z", 1, 1)]
    a = spark.createDataFrame(rows_a, "article_id string, y_true int, y_pred int")
    b = spark.createDataFrame(rows_b, "article_id string, y_true int, y_pred int")
    j = M.discordant_counts(M.paired_predictions(a, b)).first()
    g = M.discordant_counts_aggregated(a, b).first()
    assert (j.n_pairs, j.n01, j.n10) == (g.n_pairs, g.n01, g.n10) == (8, 2, 2)


def test_grouped_any_on_long_rows(spark):
    from tessera.functions.labels import article_labels_from_rows
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2)], "article_id string, label int")
    assert {r.article_id: r.label for r in article_labels_from_rows(rows).collect()} == {"a": 1, "b": 0}


def test_predictions_csv_roundtrip(spark, tmp_dir):
    from tessera.sources.results import read_predictions
    from tessera.sources.sinks import export_csv, write_predictions
    preds = spark.createDataFrame([("a", 1, 0), ("b", 0, 0)], "article_id string, y_true int, y_pred int")
    write_predictions(preds, tmp_dir, "p")
    export_csv(preds, f"{tmp_dir}/p.csv")
    for path in (f"{tmp_dir}/p", f"{tmp_dir}/p.csv"):
        assert sorted(tuple(r) for r in read_predictions(spark, path).collect()) == [("a", 1, 0), ("b", 0, 0)]
