"""Structured Streaming: score arriving articles with a fitted CRF.

Features and Viterbi decoding are row-local expressions, so the batch plan
runs unchanged on a ``readStream`` source. Running article metrics are a
streaming aggregate (partial + state store), exactly-once into the sink via
the checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.features import FeatureContext
from ..plans import experiments
from ..schemas import ARTICLE_JSON_SCHEMA
from ..session import shared_path
from ..sources.articles import normalise_articles


def read_article_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    raw = (spark.readStream.schema(ARTICLE_JSON_SCHEMA)
           .option("maxFilesPerTrigger", max_files_per_trigger)
           .json(path))
    return normalise_articles(raw)


def scored_stream(articles: DataFrame, run: experiments.CRFRun, ctx: FeatureContext) -> DataFrame:
    """Per-article predictions for a streaming article source (no vectors:
    a stream-static join would attach them the same way)."""
    pred = experiments.predict(run, articles, ctx)  # row-local plan
    return pred.select("article_id", "domain", "split", "y_true", "y_pred", "pred")


def write_predictions(scored: DataFrame, out_path: str, checkpoint: str | None = None,
                      available_now: bool = True) -> StreamingQuery:
    spark = scored.sparkSession
    writer = (scored.select("article_id", "domain", "split", "y_true", "y_pred")
              .writeStream.format("parquet")
              .option("checkpointLocation", checkpoint or shared_path(spark, "stream-preds-ckpt"))
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start(out_path)


def running_confusion(scored: DataFrame) -> DataFrame:
    """Confusion counts per domain, updated as articles arrive."""
    t, p = F.col("y_true"), F.col("y_pred")
    return scored.groupBy("domain").agg(
        F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t != 1) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p != 1)).alias("fn"), F.count_if((t != 1) & (p != 1)).alias("tn"))
