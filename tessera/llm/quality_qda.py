"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance of the transformed statistics, shrunk
towards the diagonal of the covariance of all rows. The score is the logistic
function of the difference of the class log densities plus log shares, computed
from Mahalanobis distances with Cholesky factors that are inverted once.
Moments are summed by Spark: one row per class comes back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import FileNumbers, file_seed, in_files, map_arrow, rows_with, written
from tessera.llm.stats import FEATURES, document_stats


@dataclass
class QDA:
    """mean, inverse Cholesky factor and log share minus half log determinant of classes 0 and 1."""

    parts: list[tuple[np.ndarray, np.ndarray, float]]
    constant: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of class 1, in 0..1; ``constant`` if a class was too small to fit."""
        if not self.parts:
            return np.full(len(x), self.constant)
        log = [c - 0.5 * (((x - m) @ inv.T) ** 2).sum(axis=1) for m, inv, c in self.parts]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit_moments(n: dict[int, float], sums: dict[int, np.ndarray], outer: dict[int, np.ndarray],
                shrinkage: float = 0.15, ridge: float = 1e-3) -> QDA:
    """The classifier from each class's count, sum and sum of outer products."""
    d = len(FEATURES)
    total = n.get(0, 0) + n.get(1, 0)
    if min(n.get(0, 0), n.get(1, 0)) <= 1:
        return QDA([], (n.get(1, 0) + 1.0) / (total + 2.0) if total else 0.5)
    mean = (sums[0] + sums[1]) / total
    spread = np.diag((outer[0] + outer[1]) / total) - mean ** 2 + 1e-9
    parts = []
    for c in (0, 1):
        m = sums[c] / n[c]
        cov = (outer[c] / n[c] - np.outer(m, m)) * n[c] / (n[c] - 1)
        cov = (1 - shrinkage) * cov + np.diag((shrinkage + ridge) * spread)
        factor = np.linalg.cholesky(cov)
        parts.append((m, np.linalg.solve(factor, np.eye(d)),
                      float(np.log(n[c] / total) - np.log(np.diag(factor)).sum())))
    return QDA(parts)


def clean_labels(labels: DataFrame, column: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """(id, y): 0 or 1; nulls, other values and ids whose labels disagree are left out."""
    y = F.col(column).cast("int")
    return (labels.where(F.col(id_col).isNotNull() & y.isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id"))
            .agg(F.min(y).alias("y"), F.max(y).alias("most")).where("y = most").select("id", "y"))


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, **params) -> QDA:
    """Fit on the rows of ``stats`` (id, features) that have a label in ``labels`` (id, y)."""
    d = len(FEATURES)

    def moments(batches):
        for batch in batches:
            x = batch["features"].flatten().to_numpy().reshape(-1, d)
            y = batch["y"].to_numpy()
            for c in (0, 1):
                own = x[y == c]
                if len(own):
                    row = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                    yield pa.RecordBatch.from_pydict({"y": pa.array([c], pa.int32()),
                                                      "m": pa.array([row.tolist()])})

    rows = map_arrow(stats.join(labels, "id").select("features", "y"), moments, "y int, m array<double>")
    size = 1 + d + d * d
    got = {r["y"]: np.array(r[1:]) for r in rows.groupBy("y").agg(
        *[F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(size)]).collect()}
    return fit_moments({c: m[0] for c, m in got.items()}, {c: m[1:1 + d] for c, m in got.items()},
                       {c: m[1 + d:].reshape(d, d) for c, m in got.items()}, **params)


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id",
                   text_col: str = "text", file_no: FileNumbers | None = None, **params) -> DataFrame:
    """One row per input row: ``_rid``, id, held_out, score, predicted (1 if score >= 0.5).

    Learnt from labelled rows that aren't held out. Null and empty texts get the
    score of their statistics (all counts zero). Without two labelled rows of either
    class all rows get the share of label 1 (0.5 without labels). Rows that
    repeat an id are scored, and learnt from, each for itself; other columns are ignored.
    ``_rid`` holds for one scan, or with ``file_no`` from ``common.file_seed`` for all.
    """
    stats = written(document_stats(docs, (), id_col=id_col, text_col=text_col, file_no=file_no), "quality_stats")
    model = fit(stats.where(~held_out(F.col("id"))), clean_labels(labels), **params)
    d = len(FEATURES)

    def score(batches):
        for batch in batches:
            x = batch["features"].flatten().to_numpy().reshape(-1, d)
            yield pa.RecordBatch.from_pydict({"_rid": batch["_rid"], "id": batch["id"],
                                              "score": pa.array(model.score(x))})

    return map_arrow(stats, score, "_rid long, id long, score double").select(
        "_rid", F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts as 1, with all their columns."""
    docs = in_files(docs)
    seed = file_seed(docs)
    kept = quality_scores(docs, labels, file_no=seed, **params).where("predicted = 1").select("_rid")
    return rows_with(docs, kept, seed).select("row.*")
