"""Summary and chart tables (G1, G2, F1, F2, D13, H13). No image drawing:
the chart *tables* are the product; any plotting tool can draw them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import results, sinks

CHART_METRICS = ("f1", "precision", "recall")


def aggregate_results(spark: SparkSession, root: str, out_dir: str | None = None):
    """A4 + A5 + A12: collect every run's tables under ``root``."""
    main = results.read_main_results(spark, root)
    sub = results.read_subtype_results(spark, root)
    if out_dir is not None:
        if main is not None:
            sinks.write_summary(main, f"{out_dir}/main_results")
        if sub is not None:
            sinks.write_summary(sub, f"{out_dir}/subtype")
    return main, sub


def chart_main(main: DataFrame, order=("model", "source_dir")) -> DataFrame:
    """H13 + F1: grouped-bar table ``(model, source_dir, metric, value)``
    sorted by model (source folder breaks ties)."""
    stacked = main.select(*order, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in CHART_METRICS])).alias("s"))
    return stacked.select(*order, "s.metric", "s.value").orderBy(*order, "metric")


def chart_curve(curve: DataFrame) -> DataFrame:
    """D13 + F2: one series per model (null models dropped), points sorted by
    train_pct; long output ``(model, point, train_pct, f1)``."""
    series = (curve.filter(F.col("model").isNotNull())
              .groupBy("model")
              .agg(F.sort_array(F.collect_list(F.struct("train_pct", "f1"))).alias("pts")))
    return series.select("model", F.posexplode("pts").alias("point", "p")).select(
        "model", "point", F.col("p.train_pct").alias("train_pct"), F.col("p.f1").alias("f1"))
