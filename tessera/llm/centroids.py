"""Centroid clustering; the nearest centroid is found by the threshold algorithm.

For each dimension the centroids are kept as a list sorted by that component. From a vector's
own value the list is walked outward, the nearer side first. Each step meets one
more centroid in every dimension; a centroid met for the first time gets its exact distance.
A centroid not yet met is at least as far in each dimension as that dimension's frontier, so the
walk ends when the sum of squared frontier distances strictly exceeds the best exact
distance (strictly, for an equal distance may belong to a smaller number).

A round is one pass over packed integer vectors; each partition sends a count and component sums
for each centroid, as limbs that add up exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, written
from tessera.llm.vectors import from_limbs, integer_rows, limbs, matrix, slices
from tessera.operators.vector_sums import block_rows, merged_blocks

FAR = np.int64(1) << 62  # beyond all distances: integers have at most 28 bits
PAIRS = 1 << 16  # exact distances at a time


class SortedLists:
    """Per dimension, the centroids' values in rising order and their numbers."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.number = np.argsort(centroids.T, axis=1, kind="stable")
        self.value = np.take_along_axis(centroids.T, self.number, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row; ties go to the smaller number."""
        k, d = self.centroids.shape
        dims = np.arange(d)
        high = np.empty(x.shape, np.int64)
        for j in range(d):
            high[:, j] = np.searchsorted(self.value[j], x[:, j])
        low = high - 1
        best, who = np.full(len(x), FAR), np.zeros(len(x), np.int64)
        met = np.zeros((len(x), k), bool)
        rows = np.arange(len(x))
        while len(rows):
            v, lo, hi = x[rows], low[rows], high[rows]
            below = np.where(lo >= 0, v - self.value[dims, np.maximum(lo, 0)], FAR)
            above = np.where(hi < k, self.value[dims, np.minimum(hi, k - 1)] - v, FAR)
            down = below <= above
            at = np.where(down, lo, hi)
            frontier = np.where(down, below, above)
            low[rows], high[rows] = lo - down, hi + ~down
            now = np.zeros((len(rows), k), bool)
            now[np.arange(len(rows))[:, None], self.number[dims, at]] = True
            new = now & ~met[rows]
            met[rows] |= now
            i, c = np.nonzero(new)
            exact = np.full((len(rows), k), FAR)
            for a in range(0, len(i), PAIRS):
                p, q = i[a:a + PAIRS], c[a:a + PAIRS]
                exact[p, q] = ((v[p] - self.centroids[q]) ** 2).sum(axis=1)
            first = exact.argmin(axis=1)
            least = exact[np.arange(len(rows)), first]
            better = (least < best[rows]) | (least == best[rows]) & (first < who[rows])
            best[rows[better]], who[rows[better]] = least[better], first[better]
            bound = (frontier ** 2).sum(axis=1)
            rows = rows[~((bound > best[rows]) | met[rows].all(axis=1))]
        return who, best


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``; ties by the vector, null ids last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    got = rows.orderBy(digest.asc_nulls_last(), "x").limit(k).select("x").collect()
    return matrix(pa.array([bytes(r.x) for r in got], pa.binary())) if got else np.empty((0, 0), np.int64)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: componentwise floor of the mean of each centroid's vectors; empty ones stay."""
    k, d = centroids.shape

    def sums(batches):
        lists = SortedLists(centroids)
        total = np.zeros((k, 1 + d), np.int64)
        for batch in slices(batches, 4096):
            x = matrix(batch["x"], width=d)
            who = lists.nearest(x)[0]
            total[:, 0] += np.bincount(who, minlength=k)
            for c in np.unique(who):
                total[c, 1:] += x[who == c].sum(axis=0)
        used = {(int(c),): limbs(total[c]) for c in np.flatnonzero(total[:, 0])}
        if used:
            yield block_rows(used, {"cluster": pa.int32()}, "<i8")

    parts = map_arrow(rows.select("x"), sums, "cluster int, block int, blob binary")
    blobs: dict[int, list] = {}
    for r in merged_blocks(parts, "<i8").orderBy("block").collect():  # k * (d + 1) numbers
        blobs.setdefault(r.cluster, []).append(np.frombuffer(bytes(r.blob), "<i8"))
    out = centroids.copy()
    for c, got in blobs.items():
        n, *total = from_limbs(np.concatenate(got))
        out[c] = [t // n for t in total]
    return out


def cluster(df: DataFrame, *, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3,
            id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(rows (id, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256), centroids).

    Vectors are those with exactly ``dim`` components, none null or non-finite, as integers
    floor(scale * component) of at most 27 bits (a larger one fails the job: squared distances
    would not fit a long). The rest give no rows. The first centroids are the ``k`` vectors with the smallest
    sha256 of ``seed:id``: of equal hashes the smaller packed vector, null ids last; with fewer
    vectors than ``k`` all are centroids. Rows that repeat an id are separate vectors. Other columns
    are ignored; no vectors give no rows. Inertia is exact; one that doesn't fit a long fails the job.
    ``k`` * ``dim`` numbers are held by the driver and each task.
    """
    rows = written(integer_rows(df, scale, id_col=id_col, vec_col=vec_col, dim=dim, bits=27), "integer_vectors")
    centroids = first_centroids(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        new = _moved(rows, centroids)
        if (new == centroids).all():
            break  # all later rounds are the same
        centroids = new

    def assign(batches):
        lists = SortedLists(centroids)
        for batch in slices(batches, 4096):
            who, distance = lists.nearest(matrix(batch["x"], width=centroids.shape[1]))
            yield pa.RecordBatch.from_pydict({
                "id": batch["id"], "cluster": pa.array(who, pa.int32()), "distance": pa.array(distance)})

    found = written(map_arrow(rows, assign, "id long, cluster int, distance long"), "clusters")
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total = sum(int(r.s) for r in per)
    known = found.sparkSession.createDataFrame([
        (r.cluster, int(r.s), total, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode())
         .hexdigest()) for r in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select(  # k rows
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
