"""Evaluation: confusion counts, binary metrics, subtype breakdown, McNemar.

All aggregates are ``count_if``/``sum`` over integer flags, so Spark runs
them as partial (map-side) + final hash aggregates: a group that holds a
third of all rows costs one partial row per task, not one hot reducer.
Ratios are computed from the exact integer counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import is_correct
from ..functions.stats import chi2_1_sf


def _ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 when den == 0."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def confusion_counts(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                     keys: Sequence[str] = ()) -> DataFrame:
    """Tp, fp, fn, tn, n per group (class 1 is positive; labels other than 0/1
    count in n but in none of the cells, as in the reference)."""
    t, p = F.col(y_true), F.col(y_pred)
    aggs = [F.count_if((t == 1) & (p == 1)).alias("tp"),
            F.count_if((t != 1) & (p == 1)).alias("fp"),
            F.count_if((t == 1) & (p != 1)).alias("fn"),
            F.count_if((t != 1) & (p != 1)).alias("tn"),
            F.count_if(t == p).alias("n_correct"),
            F.count(F.lit(1)).alias("n")]
    return df.groupBy(*keys).agg(*aggs)


def metrics_from_counts(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 from confusion counts.

    Empty group: accuracy null, P/R/F1 0.0 (X10).
    """
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *keys, "n", "tp", "fp", "fn", "tn",
        F.when(F.col("n") > 0, F.col("n_correct") / F.col("n")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def binary_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                   keys: Sequence[str] = ()) -> DataFrame:
    return metrics_from_counts(confusion_counts(df, y_true, y_pred, keys), keys)


def global_binary_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One row even for an empty input (global aggregate)."""
    return binary_metrics(df, y_true, y_pred, keys=())


# ------------------------------------------------------------------ subtypes
def aligned_sentence_rows(df: DataFrame, gold: str = "sentence_labels",
                          pred: str = "pred", subtypes: str = "subtypes",
                          keys: Sequence[str] = ()) -> DataFrame:
    """Zip gold, prediction and subtype arrays by position, cut to the
    shortest; articles with null or empty subtypes are skipped (R13, X1)."""
    # skipping is a zero-length slice inside the generator, not a filter that
    # Catalyst would push below the exchange and evaluate on its own
    n = F.when(F.col(subtypes).isNull(), F.lit(0)).otherwise(
        F.least(F.size(gold), F.size(pred), F.size(subtypes)))
    zipped = F.arrays_zip(F.slice(gold, 1, n).alias("g"), F.slice(pred, 1, n).alias("p"),
                          F.slice(F.coalesce(subtypes, F.array().cast("array<string>")), 1, n).alias("s"))
    return (df.select(*keys, F.explode(zipped).alias("z"))
            .select(*keys, F.col("z.g").alias("gold"), F.col("z.p").alias("pred"),
                    F.col("z.s").alias("subtype")))


def subtype_breakdown(df: DataFrame, gold: str = "sentence_labels", pred: str = "pred",
                      subtypes: str = "subtypes", keys: Sequence[str] = ()) -> DataFrame:
    """D3: per subtype precision, recall, F1 and support (= aligned sentences)."""
    rows = aligned_sentence_rows(df, gold, pred, subtypes, keys)
    g, p = F.col("gold"), F.col("pred")
    counts = rows.groupBy(*keys, "subtype").agg(
        F.count_if((p == 1) & (g == 1)).alias("tp"),
        F.count_if((p == 1) & (g == 0)).alias("fp"),
        F.count_if((p == 0) & (g == 1)).alias("fn"),
        F.count(F.lit(1)).alias("support"))
    prec = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    staged = counts.select(*keys, "subtype", "support", prec.alias("precision"), rec.alias("recall"))
    pr = F.col("precision") + F.col("recall")
    return staged.select(
        *keys, "subtype", "precision", "recall",
        F.when(pr > 0, 2 * F.col("precision") * F.col("recall") / pr).otherwise(F.lit(0.0)).alias("f1"),
        F.col("support").cast("bigint").alias("support"))


# ------------------------------------------------------------------ McNemar
def paired_predictions(a: DataFrame, b: DataFrame, key: str = "article_id") -> DataFrame:
    """C4: inner equi-join with ``_a``/``_b`` suffixes (duplicates multiply, X11)."""
    ra = a.select(key, *[F.col(c).alias(f"{c}_a") for c in a.columns if c != key])
    rb = b.select(key, *[F.col(c).alias(f"{c}_b") for c in b.columns if c != key])
    return ra.join(rb, key, "inner")


def discordant_counts(paired: DataFrame) -> DataFrame:
    """B21 + D5 on joined pairs: n01 = a wrong and b right; n10 = a right and b wrong."""
    ca = is_correct("y_true_a", "y_pred_a")
    cb = is_correct("y_true_b", "y_pred_b")
    return paired.agg(F.count(F.lit(1)).alias("n_pairs"),
                      F.count_if((ca == 0) & (cb == 1)).alias("n01"),
                      F.count_if((ca == 1) & (cb == 0)).alias("n10"))


def _per_key_correctness(df: DataFrame, key: str, side: str) -> DataFrame:
    c = is_correct("y_true", "y_pred")
    return df.groupBy(key).agg(F.count_if(c == 1).alias(f"r_{side}"),
                               F.count_if(c != 1).alias(f"w_{side}"))


def discordant_counts_aggregated(a: DataFrame, b: DataFrame, key: str = "article_id") -> DataFrame:
    """Same counts as ``discordant_counts(paired_predictions(a, b))`` without
    materialising pairs: each side is pre-aggregated per key (right / wrong
    counts, partial aggregation) and the per-key products are summed. A key
    repeated on both sides contributes the product of its counts, exactly as
    the inner join would, but costs one row per key instead of all pairs."""
    j = _per_key_correctness(a, key, "a").join(_per_key_correctness(b, key, "b"), key)
    ra, wa, rb, wb = (F.col(c) for c in ("r_a", "w_a", "r_b", "w_b"))
    return j.agg(F.coalesce(F.sum((ra + wa) * (rb + wb)), F.lit(0)).cast("bigint").alias("n_pairs"),
                 F.coalesce(F.sum(wa * rb), F.lit(0)).cast("bigint").alias("n01"),
                 F.coalesce(F.sum(ra * wb), F.lit(0)).cast("bigint").alias("n10"))


def mcnemar(a: DataFrame, b: DataFrame, key: str = "article_id") -> DataFrame:
    """Continuity-corrected McNemar statistic and chi-square(1) p-value.

    statistic = (|n01 - n10| - 1)^2 / (n01 + n10); no discordant pairs gives
    statistic 0 and p 1 (X9).
    """
    c = discordant_counts_aggregated(a, b, key)
    n01, n10 = F.col("n01"), F.col("n10")
    d = n01 + n10
    stat = F.when(d > 0, F.pow(F.abs(n01 - n10) - 1, 2) / d).otherwise(F.lit(0.0))
    return (c.withColumn("statistic", stat)
            .withColumn("p_value", F.when(d > 0, chi2_1_sf(F.col("statistic"))).otherwise(F.lit(1.0))))


def check_unique_keys(df: DataFrame, key: str = "article_id") -> DataFrame:
    """Keys that occur more than once (X11 option): partial-aggregated count."""
    return df.groupBy(key).count().filter(F.col("count") > 1)
