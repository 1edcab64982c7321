"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 1; the median is reported; queries under 8 s run 3 times).
Each query is fully executed through Spark's ``noop`` sink (no driver
collect), except the CRF fit, whose product is the fitted model.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEAT = int(os.environ.get("BENCH_REPEAT", "1"))
QUICK_SEC = 8.0

HEADLINE = ["features", "metrics_by_domain", "subtype_breakdown", "mcnemar", "crf_decode",
            "crf_decode_arrow", "crf_loglik", "embed_lookup", "sentence_vectors", "cross_domain",
            "crf_fit", "baseline_fit"]


def _commit() -> str | None:
    """Short hash of the code that produced the numbers (None outside git)."""
    import subprocess
    try:
        out = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True,
                             cwd=os.path.dirname(os.path.abspath(__file__)), timeout=10)
        return out.stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def _sf_value(path: str) -> float | str:
    base = os.path.basename(path.rstrip("/"))
    try:
        return float(base.replace("sf", ""))
    except ValueError:
        return base


def main() -> None:
    spark = build_session(CPUS, app="tessera-bench")
    from tessera.plans.catalog import queries

    qs = queries()
    # warm-up on the smallest data: JVM JIT, Python workers, codegen caches
    warm_dir = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir) and warm_dir != SF_DIR:
        for name in HEADLINE:
            if name not in ("crf_fit", "baseline_fit"):
                qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    qs["articles"](spark, SF_DIR).write.format("noop").mode("overwrite").save()

    def run_once(name: str) -> float:
        t0 = time.perf_counter()
        qs[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    def run_crf_fit() -> float:
        """Same work as the ``crf_fit`` query, through the library so the
        number of distributed evaluations is known (seconds per round)."""
        from pyspark.sql import functions as F
        from tessera.operators import crf
        from tessera.operators.features import FEATURE_NAMES
        from tessera.plans.common import scored_articles
        t0 = time.perf_counter()
        s = scored_articles(spark, SF_DIR).filter(F.col("split") == "train")
        model = crf.fit(crf.sequences(s, FEATURE_NAMES), FEATURE_NAMES)
        total = time.perf_counter() - t0
        extra["crf_fit_evaluations"] = model.info["evaluations"]
        extra["crf_fit_iterations"] = model.info["iterations"]
        extra["crf_fit_sec_per_evaluation"] = round(total / max(model.info["evaluations"], 1), 3)
        return total

    times: dict[str, float] = {}
    extra: dict[str, float] = {}
    for name in HEADLINE:
        if name == "crf_fit":
            times[name] = round(run_crf_fit(), 3)
            continue
        runs = [run_once(name) for _ in range(REPEAT)]
        if runs[0] < QUICK_SEC:  # quick queries: median of three
            runs += [run_once(name) for _ in range(max(0, 3 - len(runs)))]
        times[name] = round(statistics.median(runs), 3)
    from pyspark.sql import functions as F
    from tessera.operators import crf
    from tessera.operators.features import FEATURE_NAMES
    from tessera.plans.common import scored_articles
    seqs = crf.sequences(scored_articles(spark, SF_DIR).filter(F.col("split") == "train"), FEATURE_NAMES)
    for p in (1, 2, 4):
        t0 = time.perf_counter()
        m = crf.fit(seqs, FEATURE_NAMES, max_iter=10, partitions=p)
        extra[f"crf_sec_per_evaluation_p{p}"] = round((time.perf_counter() - t0) / max(m.info["evaluations"], 1), 3)
    n_sent = qs["sentences"](spark, SF_DIR).count()
    n_art = qs["articles"](spark, SF_DIR).count()
    extra["features_sentences_per_sec"] = round(n_sent / times["features"], 1)
    extra["crf_decode_articles_per_sec"] = round(n_art / times["crf_decode"], 1)
    extra["crf_decode_arrow_articles_per_sec"] = round(n_art / times["crf_decode_arrow"], 1)
    extra["n_sentences"] = n_sent
    extra["n_articles"] = n_art
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "throughput": extra,
                      "sf": _sf_value(SF_DIR), "cpus": CPUS, "commit": _commit()}))
    spark.stop()


if __name__ == "__main__":
    main()
