"""States of an optimiser in the shared folder, so that a fit whose driver is lost can go on.

A state is one row in a Parquet table that is only ever appended to: one file, written by one task, so
it is there as a whole or not at all. A table may hold the states of many fits, told apart by a key.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.results import read_optional
from .lbfgs import State

SCHEMA = ("fit string, iterations int, evaluations int, f double, w array<double>, g array<double>, "
          "s_hist array<array<double>>, y_hist array<array<double>>, f_hist array<double>")


def fit_key(scale: np.ndarray, *parts) -> str:
    """Key of a fit from what defines it. ``scale`` (a number per weight, taken from the training data)
    counts to 9 digits: its last bits depend on the order in which partitions are summed."""
    text = json.dumps([[f"{v:.9g}" for v in scale], *parts], default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def save_state(spark: SparkSession, path: str, key: str, state: State) -> None:
    row = (key, state.iterations, state.evaluations, float(state.f), state.w.tolist(), state.g.tolist(),
           [s.tolist() for s in state.s_hist], [y.tolist() for y in state.y_hist], list(map(float, state.f_hist)))
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_state(spark: SparkSession, path: str, key: str, max_iter: int) -> State | None:
    """The latest state of this fit with at most ``max_iter`` rounds; None if there is none."""
    states = read_optional(spark, path)
    if states is None:
        return None
    row = states.where((F.col("fit") == key) & (F.col("iterations") <= max_iter)).orderBy(
        F.col("iterations").desc()).first()
    if row is None:
        return None
    return State(row.iterations, row.evaluations, np.array(row.w), row.f, np.array(row.g),
                 [np.array(s) for s in row.s_hist], [np.array(y) for y in row.y_hist], list(row.f_hist))
