"""Label expressions: casts, roll-ups, arg-max."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col


def label_to_int(x: Column) -> Column:
    """Element cast of a label read as text: ``"1"``, ``1``, ``true``, ``1.7``.

    ``true``/``false`` map to 1/0, numbers are truncated toward zero like
    Python's ``int``; anything else fails the job (ANSI cast), as the
    reference raises.
    """
    t = F.lower(F.trim(x))
    return (F.when(t == "true", F.lit(1))
            .when(t == "false", F.lit(0))
            .otherwise(x.cast("double").cast("int")))


def labels_to_int(arr: Column | str) -> Column:
    return F.transform(as_col(arr), label_to_int)


def any_positive(arr: Column | str) -> Column:
    """Article label: 1 when any element equals 1; empty or null gives 0."""
    return F.coalesce(F.exists(as_col(arr), lambda x: x == 1), F.lit(False)).cast("int")


def argmax(scores: Column | str) -> Column:
    """0-based index of the largest score; the first index wins ties."""
    s = as_col(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def threshold(score: Column | str) -> Column:
    """One-column scores: positive when the score is above 0."""
    return F.when(as_col(score) > 0, F.lit(1)).otherwise(F.lit(0))


def is_correct(y_true: Column | str, y_pred: Column | str) -> Column:
    return (as_col(y_true) == as_col(y_pred)).cast("int")


def article_labels_from_rows(rows, key: str = "article_id", label: str = "label"):
    """D4 on long rows: ``groupBy(key)`` with any label == 1 (partial aggregate).

    Articles without sentence rows do not appear here; take the article label
    from the article row (``any_positive``) when they must be kept (R11)."""
    return rows.groupBy(key).agg(
        F.coalesce(F.bool_or(F.col(label) == 1), F.lit(False)).cast("int").alias("label"))
