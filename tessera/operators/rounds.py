"""Round-wise training of a linear classifier, the best round kept.

Mini-batch gradient descent as Spark jobs. Rows are sparse vectors, spread once and persisted. In each epoch
a hash of (epoch, id) deals them into mini-batches; a step is one ``mapInArrow`` pass over one batch, which
sums the gradient of the log loss by index before anything is shuffled. The rate rises over the warm-up share
of all steps and then falls to zero; weights decay by their own rate. After every epoch the model is scored
on the validation rows, and the weights of the epoch with the best F1 (the earliest of equals) are kept,
whatever came after it.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.articles import hash_bucket
from . import metrics as M
from .vector_sums import block_rows, summed

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pyarrow only

# fixed values of the reference's classifier configuration
DEFAULT_EPOCHS = 3
DEFAULT_WARMUP = 0.06
DEFAULT_DECAY = 0.01


@dataclass
class RoundModel:
    """Weights of a linear model, the last one the intercept, and the rounds they were chosen from."""
    weights: np.ndarray
    rounds: list        # (epoch, val_f1, val_accuracy, n, is_best)

    @property
    def f1(self) -> float:
        return next(r[1] for r in self.rounds if r[4])

    def rounds_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.rounds, "epoch int, val_f1 double, val_accuracy double, n bigint, is_best boolean")

    def save(self, spark: SparkSession, path: str) -> None:
        """Non-zero weights and the rounds as tables."""
        at = np.flatnonzero(self.weights)
        size = [(-1, float(len(self.weights)))]
        spark.createDataFrame(size + [(int(i), float(self.weights[i])) for i in at], "i int, weight double") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
        self.rounds_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/rounds")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RoundModel:
        rows = spark.read.parquet(f"{path}/weights").collect()  # the model itself
        w = np.zeros(int(next(r.weight for r in rows if r.i < 0)))
        for r in rows:
            if r.i >= 0:
                w[r.i] = r.weight
        rounds = [tuple(r) for r in spark.read.parquet(f"{path}/rounds").orderBy("epoch").collect()]
        return cls(w, rounds)


def sparse_rows(frame: DataFrame, features: str, label: str = "label", id_col: str = "article_id") -> DataFrame:
    """``(article_id, idx array<int>, val array<double>, label double)`` of an ``array<double>`` column; zeros are left out."""
    at = F.filter(F.transform(features, lambda v, i: F.struct(i.cast("int").alias("i"), v.cast("double").alias("v"))),
                  lambda z: z["v"] != 0)
    return frame.select(F.col(id_col).alias("article_id"), at.alias("z"), F.col(label).cast("double").alias("label")).select(
        "article_id", F.transform("z", lambda z: z["i"]).alias("idx"), F.transform("z", lambda z: z["v"]).alias("val"),
        "label")


def hashed_rows(frame: DataFrame, text: str = "text", size: int = 1 << 18, label: str = "label") -> DataFrame:
    """Sparse rows of a text: the share of each token bucket (64-bit hash modulo ``size``) among its tokens."""
    from ..functions.text import tokens
    ids = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    n = F.greatest(F.size("ids"), F.lit(1)).cast("double")
    return frame.select("article_id", F.coalesce(ids, F.array().cast("array<int>")).alias("ids"),
                        F.col(label).cast("double").alias("label")).select(
        "article_id", F.col("ids").alias("idx"), F.transform("ids", lambda i: F.lit(1.0) / n).alias("val"), "label")


def _margins(batch, w: np.ndarray):
    """(margins, indices, values, row of each entry) of a batch of sparse rows; repeated indices add up."""
    lists = batch.column("idx")
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    idx = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    val = batch.column("val").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    of = np.repeat(np.arange(len(n)), n)
    return np.bincount(of, w[idx] * val, minlength=len(n)) + w[-1], idx, val, of


def _probability(m: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(m))
    return np.where(m >= 0, 1.0, e) / (1.0 + e)


def make_batch_gradient(shared, size: int):
    """Batches -> per partition the rows, then the summed gradient of the log loss, packed."""
    def step(batches):
        w, total = shared.value, None
        for batch in batches:
            if not batch.num_rows:
                continue
            m, idx, val, of = _margins(batch, w)
            left = _probability(m) - batch.column("label").to_numpy(zero_copy_only=False)
            if total is None:
                total = np.zeros(size + 1)
            total[0] += len(m)
            total[1:] += np.bincount(idx, left[of] * val, minlength=size)
            total[-1] += left.sum()
        if total is not None:
            yield block_rows({(): total}, {}, "<f8")
    return step


def predict_rows(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(article_id, y_true, y_pred, margin)``; 1 where the margin is above 0."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                m = _margins(batch, shared.value)[0]
                yield pa.RecordBatch.from_pydict({
                    "article_id": batch.column("article_id"), "margin": pa.array(m),
                    "y_true": batch.column("label").cast(pa.int32()), "y_pred": pa.array((m > 0).astype(np.int32))})
    return rows.mapInArrow(score, "article_id string, margin double, y_true int, y_pred int")


def rate(step: int, steps: int, peak: float, warmup: float) -> float:
    """Rate of step 0, 1, ...: linear to ``peak`` over the warm-up, then linear to zero."""
    first = int(np.ceil(warmup * steps))
    if step < first:
        return peak * (step + 1) / first
    return peak * (steps - step) / max(steps - first, 1)


def train_rounds(train: DataFrame, val: DataFrame, size: int, *, epochs: int = DEFAULT_EPOCHS, batches: int = 8,
                 peak: float = 1.0, warmup: float = DEFAULT_WARMUP, decay: float = DEFAULT_DECAY, seed: str = "round",
                 partitions: int | None = None) -> RoundModel:
    """Train on sparse rows with indices below ``size - 1`` (the last weight is the intercept).

    ``epochs * batches`` passes over a batch each and one scoring pass an epoch. A batch without rows changes
    nothing. Weights are broadcast for each step and destroyed after it. No training rows: ValueError."""
    spark = train.sparkSession
    spread = partitions or spark.sparkContext.defaultParallelism
    tr = train.repartition(spread).persist(StorageLevel.MEMORY_AND_DISK)
    va = val.persist(StorageLevel.MEMORY_AND_DISK)
    w, best, rounds = np.zeros(size), None, []
    steps = epochs * batches
    try:
        if not tr.limit(1).count():
            raise ValueError("no training rows")
        for epoch in range(epochs):
            bucket = hash_bucket(F.col("article_id"), batches, f"{seed}|{epoch}")
            for b in range(batches):
                shared = spark.sparkContext.broadcast(w)
                try:
                    parts = tr.filter(bucket == b).mapInArrow(make_batch_gradient(shared, size), "block int, blob binary")
                    g = summed(parts, spread, size + 1)
                finally:
                    shared.destroy()
                if g is None:
                    continue
                lr = rate(epoch * batches + b, steps, peak, warmup)
                shrink = np.append(w[:-1], 0.0) * decay  # the intercept doesn't decay
                w = w - lr * (g[1:] / g[0] + shrink)
            m = M.global_binary_metrics(predict_rows(va, w)).first()
            rounds.append((epoch, float(m.f1), m.accuracy, m.n, False))
            if best is None or m.f1 > rounds[best][1]:
                best, kept = epoch, w
    finally:
        tr.unpersist()
        va.unpersist()
    return RoundModel(kept, [(*r[:4], r[0] == best) for r in rounds])
