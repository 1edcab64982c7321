"""Arrow kernels for vector rows: moments and projection (pickled by value)."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from .vector_sums import BLOCK, HELD, block_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pyarrow only


ROWS_AT_ONCE = 1 << 16  # sentences projected at once


def _matrix(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def make_moments(vec: str, groups: int = 0):
    """Batches -> per partition the count, sum and sum of outer products, as packed blocks.

    With ``groups`` one such sum per row group, by the bits of the column ``member``."""
    def run(batches):
        import pyarrow as pa

        total = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _matrix(batch.column(vec))
            parts = {(): x}
            if groups:
                member = batch.column("member").to_numpy(zero_copy_only=False)
                parts = {(g,): x[(member >> g & 1) > 0] for g in range(groups)}
            for key, v in parts.items():
                if len(v):
                    m = np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).ravel()])
                    total[key] = total.get(key, 0.0) + m
        if total:
            yield block_rows(total, {"model": pa.int32()} if groups else {}, "<f8")

    return run


def make_projector(components: np.ndarray, mean: np.ndarray, keep: list, vec: str, out: str):
    """Batches -> the kept columns and the scores ``(x - mean) . c_j``."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows == 0:
                continue
            scores = (_matrix(batch.column(vec)) - mean) @ components.T
            col = pa.FixedSizeListArray.from_arrays(pa.array(scores.ravel()), scores.shape[1])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], col.cast(pa.list_(pa.float64()))],
                                             names=[*keep, out])

    return run


def make_row_projector(components: np.ndarray, offset: np.ndarray, keep: list, vecs: str, count: str, out: str):
    """Article rows -> the kept columns and per sentence the scores of its vector in ``vecs``; zeros for each
    of the ``count`` sentences of an article whose ``vecs`` is null. A slice of the batch is projected at a time."""
    k, d = components.shape

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = np.maximum(np.nan_to_num(batch.column(count).to_numpy(zero_copy_only=False)), 0).astype(np.int64)
            ends, start = np.cumsum(n), 0
            while start < batch.num_rows:
                first = ends[start] - n[start]
                end = max(start + 1, int(np.searchsorted(ends, first + ROWS_AT_ONCE, side="right")))
                part, m = batch.slice(start, end - start), n[start:end]
                lists = part.column(vecs)
                has = np.repeat(~lists.is_null().to_numpy(zero_copy_only=False), m)
                scores = np.zeros((int(m.sum()), k))
                if has.any():
                    x = lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    scores[has] = x.astype(np.float64) @ components.T - offset
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(scores) + 1) * k, k, dtype=np.int32)),
                                                pa.array(scores.ravel()))
                offs = np.concatenate([[0], np.cumsum(m)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.ListArray.from_arrays(pa.array(offs), rows)], names=[*keep, out])
                start = end

    return run


def make_mean_sums(keys: int):
    """Batches (k0.., m, v) -> per partition and group the sums of m * v and of m, element by element.

    Sent as pairs (sum, weight); what a partition holds is sent on beyond ``HELD`` bytes."""
    def run(batches):
        held, fields = {}, None
        for batch in batches:
            fields = {f"k{i}": batch.schema.field(f"k{i}").type for i in range(keys)}
            groups = list(zip(*[batch.column(f"k{i}").to_pylist() for i in range(keys)])) or [()] * batch.num_rows
            weight = batch.column("m").to_numpy(zero_copy_only=False)
            for key, m, v in zip(groups, weight.tolist(), batch.column("v")):
                x = v.values.fill_null(0.0).to_numpy()
                pair = np.stack([x * m, np.full(len(x), m)], axis=1).ravel()
                old = held.get(key)
                if old is None:
                    held[key] = pair
                elif len(old) >= len(pair):
                    old[:len(pair)] += pair
                else:
                    pair[:len(old)] += old
                    held[key] = pair
            if sum(v.nbytes for v in held.values()) > HELD:
                yield block_rows(held, fields, "<f8")
                held = {}
        if held:
            yield block_rows(held, fields, "<f8")
    return run


def make_means(keys: int):
    """Summed pairs -> rows (k0.., dim, value): the means, with a denominator of 1 at least."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                pair = np.frombuffer(batch.column("blob")[r].as_buffer(), "<f8").reshape(-1, 2)
                first = batch.column("block")[r].as_py() * (BLOCK // 2)
                cols = [pa.array([batch.column(f"k{i}")[r].as_py()] * len(pair), batch.schema.field(f"k{i}").type)
                        for i in range(keys)]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(np.arange(first, first + len(pair), dtype=np.int32)),
                     pa.array(pair[:, 0] / np.maximum(pair[:, 1], 1.0))],
                    names=[*[f"k{i}" for i in range(keys)], "dim", "value"])
    return run


def make_distances(components: np.ndarray, mean: np.ndarray, keep: list, vec: str, scores: str, out: str):
    """Batches -> the kept columns and sqrt(|scores|^2 + |vector - mean - scores . components|^2)."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows == 0:
                continue
            p = _matrix(batch.column(scores))
            left = _matrix(batch.column(vec)) - mean - p @ components
            far = np.sqrt((p * p).sum(axis=1) + (left * left).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(far)], names=[*keep, out])
    return run


def make_encoder(buckets: str, keep: list, dim: int, pools: dict):
    """Batches with each row's token buckets -> the kept columns and, per output name, the bucket shares
    (``mean``, denominator at least 1) or the first token's bucket (``cls``)."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(buckets)
            n = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            cols = []
            for pool in pools.values():
                if pool == "mean":
                    v = np.bincount(row * dim + flat, minlength=len(n) * dim) / np.repeat(np.maximum(n, 1), dim)
                else:
                    first = (np.cumsum(n) - n)[n > 0]
                    v = np.zeros(len(n) * dim)
                    v[np.flatnonzero(n > 0) * dim + flat[first]] = 1.0
                cols.append(pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (len(n) + 1) * dim, dim, dtype=np.int32)), pa.array(v, pa.float64())))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *cols], names=[*keep, *pools])
    return run


# ------------------------------------------------------------------ wide PCA
def make_spreads(vec: str):
    """Batches -> per partition the count, sums and sums of squares, as packed blocks."""
    def run(batches):
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(vec))
                total = total + np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
        if np.ndim(total):
            yield block_rows({(): total}, {}, "<f8")
    return run


def _r(*rows) -> np.ndarray:
    return np.linalg.qr(np.vstack(rows), mode="r")


def make_local_r(vec: str, mean: np.ndarray, basis: np.ndarray):
    """Batches -> per partition the R factor of its rows of ``(x - mean) @ basis``."""
    def run(batches):
        import pyarrow as pa

        r = np.zeros((0, basis.shape[1]))
        for batch in batches:
            if batch.num_rows:
                r = _r(r, (_matrix(batch.column(vec)) - mean) @ basis)
        yield pa.RecordBatch.from_pydict({"blob": pa.array([r.tobytes()], pa.binary())})
    return run


def make_r_merger(width: int):
    """R factors -> one R factor of all of them."""
    def run(batches):
        import pyarrow as pa

        r = np.zeros((0, width))
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                r = _r(r, np.frombuffer(blob, "<f8").reshape(-1, width))
        yield pa.RecordBatch.from_pydict({"blob": pa.array([r.tobytes()], pa.binary())})
    return run


def make_back_products(vec: str, mean: np.ndarray, basis: np.ndarray):
    """Batches -> per partition the sum of ``(x - mean)^T ((x - mean) @ basis)``, as packed blocks."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(vec)) - mean
                m = x.T @ (x @ basis)
                total = m if total is None else total + m
        if total is not None:
            yield block_rows({(): total.ravel()}, {}, "<f8")
    return run
