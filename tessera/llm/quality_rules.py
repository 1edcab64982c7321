"""Quality rules: base rules, then gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows, on histograms of
quantile bins, with monotonic constraints: more symbols, shouting, repeats or repeated
lines never raise a score. All trees have the same depth and are flattened into
arrays, so a batch is scored by a few numpy steps per level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, written
from tessera.llm.quality_qda import clean_labels
from tessera.llm.stats import FEATURES, document_stats

#: -1: the score never rises with the statistic; 0: free.
MONOTONE = {"symbols": -1, "shouts": -1, "same_next": -1, "repeats": -1, "dup_lines": -1}
MIN_WORDS, MAX_REPEATED = 20, 30
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Trees:
    """Complete trees as arrays (tree, node); node i has the children 2i + 1 and 2i + 2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray  # (tree, leaf)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(len(v).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - len(f)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, *, n_trees: int = 60, depth: int = 3, rate: float = 0.2,
              bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees for log-loss. Without both classes: no trees, all scores on one side."""
    share = np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    sign = np.array([MONOTONE.get(f, 0) for f in FEATURES])
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = [np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)]  # bin <= k: v <= cuts[k]
    margin = np.full(len(y), base)
    trees = []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            local = node - first
            best = np.full(width, 1e-6)
            g_all = np.bincount(local, grad, width)
            h_all = np.bincount(local, hess, width)
            split = [None] * width
            for f, (b, c) in enumerate(zip(binned, cuts)):
                n = len(c) + 1
                g = np.bincount(local * n + b, grad, width * n).reshape(width, n).cumsum(1)[:, :-1]
                h = np.bincount(local * n + b, hess, width * n).reshape(width, n).cumsum(1)[:, :-1]
                lo, hi = low[first:first + width, None], high[first:first + width, None]
                wl = np.clip(-g / (h + l2), lo, hi)
                wr = np.clip(-(g_all[:, None] - g) / (h_all[:, None] - h + l2), lo, hi)
                gain = (g ** 2 / (h + l2) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + l2)
                        - (g_all ** 2 / (h_all + l2))[:, None])
                ok = (h >= least) & (h_all[:, None] - h >= least) & (sign[f] * (wr - wl) >= 0)
                gain = np.where(ok, gain, -np.inf)
                for k in range(width):
                    if n > 1 and gain[k].max() > best[k]:
                        j = int(gain[k].argmax())
                        best[k], split[k] = gain[k, j], (f, c[j], wl[k, j], wr[k, j])
            for k, s in enumerate(split):
                i = first + k
                for child in (2 * i + 1, 2 * i + 2):
                    low[child], high[child] = low[i], high[i]
                if s is None:
                    continue
                feature[i], threshold[i] = s[0], s[1]
                if sign[s[0]]:
                    middle = (s[2] + s[3]) / 2
                    up, down = (2 * i + 1, 2 * i + 2) if sign[s[0]] < 0 else (2 * i + 2, 2 * i + 1)
                    low[up], high[down] = middle, middle
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        value = rate * np.clip(-g / (h + l2), low[inner:], high[inner:])
        trees.append((feature, threshold, value))
        margin += value[leaf]
    return Trees(base, *map(np.array, zip(*trees)))


def fit(stats: DataFrame, labels: DataFrame, *, max_rows_per_class: int = 30_000, **params) -> Trees:
    """Fit on about ``max_rows_per_class`` labelled rows of each class, or all if there are fewer.

    A class's rows are taken by a hash of the id and the row below the share that the bound is of the class, so
    no task sends more than its part of the sample and rows that repeat an id are taken one by one."""
    rows = stats.join(labels, "id").where(~base_failed()).select("id", "features", "y")
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    share = F.lit(0.0)
    for c, n in sizes.items():
        share = F.when(F.col("y") == c, F.lit(min(1.0, max_rows_per_class / n))).otherwise(share)
    got = rows.where(F.pmod(F.xxhash64("id", "_rid"), F.lit(1 << 20)) < share * (1 << 20)).orderBy("y", "id", "_rid").collect()
    x = np.array([r["features"] for r in got]).reshape(-1, len(FEATURES))
    return fit_trees(x, np.array([r["y"] for r in got], float), **params)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  **params) -> DataFrame:
    """One row per input row: ``_rid``, id, the base counts, base_failed, score, kept.

    Null and empty texts have no words and fail the base rules. ``kept`` is false
    if these fail, else whether the trees' score is 0.5 or more. Without labels of
    both classes the base rules decide alone (unless all labels are 0). Rows that
    repeat an id are judged each for itself; other columns are ignored.
    """
    stats = written(document_stats(docs, BASE, id_col=id_col, text_col=text_col), "rule_stats")
    model = fit(stats, clean_labels(labels), **params)
    d = len(FEATURES)

    def score(batches):
        for batch in batches:
            x = batch["features"].flatten().to_numpy().reshape(-1, d)
            p = 1 / (1 + np.exp(-model.margin(x)))
            yield batch.drop_columns(["features"]).append_column("score", pa.array(p))

    schema = "_rid long, id long, " + "".join(f"{n} long, " for n in BASE) + "score double"
    res = map_arrow(stats, score, schema).withColumn("base_failed", base_failed())
    return res.select("_rid", F.col("id").alias(id_col), *BASE, "base_failed", "score",
                      (~F.col("base_failed") & (F.col("score") >= 0.5)).alias("kept"))
