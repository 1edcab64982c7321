"""Embedding whitening with covariances by polarisation.

Over the distinct integer vectors, the sum of squares of every centred component and of every
sum of two centred components is aggregated exactly. Since
Q(i + j) = Q(i) + Q(j) + 2 C(i, j), the differences of these variances are all
cross-covariances; they are assembled into one matrix for ``eigh``.

Values are centred in the tasks by the whole number next to the mean, so squares are exact and small; what
the mean lies off it, a fraction r / n, is taken out of the sums exactly: for z with sum r, the sum of
(n z - r) ** 2 is n ** 2 times the sum of z ** 2, less n r ** 2.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, written
from tessera.llm.vectors import from_limbs, integer_rows, limbs, matrix, slices
from tessera.operators.vector_sums import block_rows, collected, merged_blocks

LIMBS = 4
KIND = "<i8"
BITS = 53  # floor(scale * component) is exact in a double


def _exact_sum(v: np.ndarray) -> np.ndarray:
    """Column sums of longs as Python integers."""
    low = (v & 0xFFFFFFFF).sum(axis=0)
    return (v >> 32).sum(axis=0).astype(object) * (1 << 32) + low.astype(object)


def pair_squares(z: np.ndarray) -> np.ndarray:
    """Exact sums of squares of the columns, then of z_i + z_j for i < j, row by row, as Python integers."""
    small = 4 * int(np.abs(z).max(initial=0)) ** 2 * max(len(z), 1) < 1 << 62

    def squares(v):
        if small:
            return np.einsum("ij,ij->j", v, v).astype(object)
        v = v.astype(object)
        return (v * v).sum(axis=0)

    return np.concatenate([squares(z), *[squares(z[:, i:i + 1] + z[:, i + 1:]) for i in range(z.shape[1] - 1)]])


def _total(rows: DataFrame, width: int, make) -> list[int]:
    """Exact sums over all rows of what ``make(matrix)`` gives for each batch."""
    def run(batches):
        total = None
        for batch in slices(batches, 2048):
            got = make(matrix(batch["x"], KIND, width))
            total = got if total is None else total + got
        if total is not None:
            yield block_rows({(): limbs(total, LIMBS)}, {}, "<i8")

    got = collected(merged_blocks(map_arrow(rows.select("x"), run, "block int, blob binary"), "<i8"), "<i8")
    return from_limbs(got, LIMBS) if got is not None else []


def polarised(n: int, squares: list[int], r: list[int]) -> np.ndarray:
    """The matrix n ** 3 * covariance as exact Python integers, from the sums of ``pair_squares``."""
    d = len(r)
    q = np.zeros((d, d), object)
    q[np.diag_indices(d)] = squares[:d]
    q[np.triu_indices(d, 1)] = squares[d:]
    r = np.array(r, object)
    both = r[:, None] + r[None, :]
    both[np.diag_indices(d)] = r
    q = n * n * q - n * both * both  # the mean taken out of each variance; the lower half isn't used
    own = np.diag(q)
    upper = np.triu((q - own[:, None] - own[None, :]) // 2, 1)
    return upper + upper.T + np.diag(own)


def _double(v: np.ndarray, by: int) -> np.ndarray:
    return np.array([[float(Fraction(int(c), by)) for c in row] for row in v], float).reshape(v.shape)


def whiten(df: DataFrame, *, components: int = 16, scale: int = 64,
           id_col: str = "vec_id", vec_col: str = "embedding", max_width: int = 4096) -> DataFrame:
    """One row for each usable row and component up to ``components``.

    Columns: id, component int (from 1, by falling eigenvalue), n long, deviation decimal(38,0) (sum over
    dimensions of (n x - S) ** 2), whitened double, explained double, identity_error double.

    Rows whose vector is null or holds null or non-finite entries give none. x is
    floor(scale * entry) of at most 53 bits (a larger one fails the job); a constant added to all x changes
    no result. Each distinct x counts once in the fit; S are its sums. A vector with fewer entries than the longest counts as followed by zeros
    (an empty one is all zeros). Components without variance, where there are fewer distinct
    vectors or independent dimensions than components, are left out, so equal vectors alone give no rows.
    Rows that repeat an id are separate rows; other columns are ignored; no rows give no rows. Fewer than
    ``max_width`` dimensions: the driver decomposes a width x width matrix.
    """
    spark = df.sparkSession
    schema = (f"`{id_col}` long, component int, n long, deviation decimal(38,0), whitened double, "
              "explained double, identity_error double")
    rows = written(integer_rows(df, scale, id_col=id_col, vec_col=vec_col, bits=BITS), "whitening_rows")
    width = (rows.agg(F.max(F.octet_length("x"))).first()[0] or 0) // np.dtype(KIND).itemsize
    if width > max_width:
        raise ValueError(f"{width} dimensions; at most {max_width}")
    if not width:
        return spark.createDataFrame([], schema)
    # trailing zeros don't tell vectors apart
    padded = F.rpad("x", width * np.dtype(KIND).itemsize, F.lit(b"\0"))
    fit = written(rows.select(padded.alias("x")).distinct(), "whitening_fit")

    n, *sums = _total(fit, width, lambda z: np.append(len(z), _exact_sum(z)))
    middle = [(2 * s + n) // (2 * n) for s in sums]  # the whole number next to the mean
    r = [s - n * m for s, m in zip(sums, middle)]
    centre = np.array(middle, np.int64)
    cov = _double(polarised(n, _total(fit, width, lambda z: pair_squares(z - centre)), r), n ** 3)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values, kind="stable")[::-1][:components]
    values, vectors = values[order], vectors[:, order]
    some = values > max(len(cov), 8) * np.finfo(float).eps * max(values[0], 0.0)
    values, vectors = values[some], vectors[:, some]
    if not len(values):
        return spark.createDataFrame([], schema)
    explained = values / np.trace(cov)
    project = vectors / np.sqrt(values)
    off = np.array([float(Fraction(a, n)) for a in r])  # mean less the whole number next to it

    def whitened(z):
        return ((z - centre) - off) @ project

    def moments(batches):
        total = 0
        for batch in slices(batches, 4096):
            w = whitened(matrix(batch["x"], KIND, width))
            total = total + np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        if not np.isscalar(total):
            yield block_rows({(): total}, {}, "<f8")

    k = len(values)
    got = collected(merged_blocks(map_arrow(fit, moments, "block int, blob binary")))
    mean = got[:k] / n
    error = float(np.abs(got[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    exact_off = np.array(r, object)

    def finish(batches):
        import decimal

        for batch in slices(batches, 2048):
            x = matrix(batch["x"], KIND, width)
            w = whitened(x)
            y = x - centre
            top = max(int(np.abs(y).max(initial=0)) * n + n, 1)
            if top * top * width < 1 << 62:
                y = y * n - exact_off.astype(np.int64)
                deviation = (y * y).sum(axis=1).tolist()
            else:
                y = y.astype(object) * n - exact_off
                deviation = (y * y).sum(axis=1).tolist()
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(np.repeat(batch["id"].to_numpy(zero_copy_only=False), k)) if not batch["id"].null_count
                else batch["id"].take(pa.array(np.repeat(np.arange(len(x)), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                "deviation": pa.array([decimal.Decimal(v) for v in deviation for _ in range(k)], pa.decimal128(38, 0)),
                "whitened": pa.array(w.ravel())})

    out = map_arrow(rows, finish, "id long, component int, deviation decimal(38,0), whitened double")
    share = F.element_at(F.array(*[F.lit(float(e)) for e in explained]), F.col("component"))
    return out.select(F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation",
                      "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
