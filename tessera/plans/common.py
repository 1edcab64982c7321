"""Shared building blocks for the query catalogue on the driver's testdata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import any_positive
from ..operators.features import FeatureContext, rule_predictions, with_feature_arrays
from ..sources.articles import testdata_articles
from ..sources.lexicons import testdata_bias_lexicon, testdata_subjectivity_lexicon

# rule models used as stand-in predictors on the testdata
RULE_A = ("bias_lex", "RULE_BIAS")
RULE_B = ("sent_neg", "RULE_NEG")


def feature_context(spark: SparkSession) -> FeatureContext:
    return FeatureContext(testdata_bias_lexicon(spark), testdata_subjectivity_lexicon(spark))


def scored_articles(spark: SparkSession, sf_dir: str, ctx: FeatureContext | None = None,
                    use_lexicons: bool = True) -> DataFrame:
    """Article rows + ``feats`` + rule predictions (arrays) + article labels.

    Narrow end to end: no shuffle before the caller's aggregate.
    """
    ctx = ctx or feature_context(spark)
    arts = with_feature_arrays(testdata_articles(spark, sf_dir), ctx, use_lexicons)
    return (arts
            .withColumn("pred_a", rule_predictions(F.col("feats"), RULE_A[0]))
            .withColumn("pred_b", rule_predictions(F.col("feats"), RULE_B[0]))
            .withColumn("y_true", any_positive("sentence_labels"))
            .withColumn("y_pred_a", any_positive("pred_a"))
            .withColumn("y_pred_b", any_positive("pred_b")))


def rule_prediction_table(scored: DataFrame, which: str = "a") -> DataFrame:
    """Per-article prediction rows ``(article_id, y_true, y_pred)``."""
    return scored.select("article_id", "y_true", F.col(f"y_pred_{which}").alias("y_pred"))
