"""Plan-level checks (no execution): pruning, no duplicated feature work,
partial aggregation, no cross joins."""
import re

import pytest

SF = "/root/testdata/sf0.001"
HEAVY = {"crf_fit", "baseline_fit", "baseline_predict", "ablation", "learning_curve", "pca_fit",
         "results_main", "results_subtype", "chart_main", "chart_curve", "mcnemar", "results_csv",
         "results_subtype_csv", "crf_experiment", "cross_domain_crf", "classifier_experiment",
         "cross_domain_classifier", "pca_project", "articles_jsonl", "label_transitions", "pipeline",
         "round_training", "baseline_rounds"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    import __spark_entry__ as E
    return {k: _plan(fn(spark, SF)) for k, fn in E.queries().items() 
            if k not in HEAVY and not re.match(r"op\d+_", k)}


def test_no_tokenisation_inside_pushed_filters(plans):
    bad = [k for k, p in plans.items()
           if any(("Filter" in ln or "DataFilters" in ln) and "regexp_extract_all" in ln
                  for ln in p.splitlines())]
    assert not bad, bad


def test_no_cartesian_products(plans):
    assert not [k for k, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]


def test_documents_scan_is_pruned(plans):
    for k in ("features", "metrics_by_domain", "crf_decode"):
        scans = [ln for ln in plans[k].splitlines() if "FileScan parquet" in ln and "documents" in ln]
        assert scans and all("n_chars" not in ln and "source" not in ln for ln in scans), k


def test_metric_aggregates_are_partial(plans):
    for k in ("metrics_by_domain", "subtype_breakdown"):
        assert "partial_" in plans[k], k
    # packed sums: what crosses the first exchange are a partition's sums, made by the kernel above the scan
    below = plans["pool_mean"].rpartition("Exchange")[2]
    assert below.count("MapInArrow") == 1 and "Generate" not in plans["pool_mean"]
