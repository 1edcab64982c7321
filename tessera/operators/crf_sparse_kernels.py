"""Arrow kernels of the CRF over sparse attributes (pickled by value).

A sentence's attributes are positions ``idx`` in the dictionary with values ``val``; ``m`` holds
their number for each sentence of an article, so a batch is one matrix in CSR form.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from .crf_kernels import _flat, _offsets, chunks, nll_and_residuals_flat, pad, viterbi

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pyarrow only

BLOCK = 8_192       # attributes of a block of the gradient
STEPS = 1 << 16     # sentences whose recursions run together
SLICE = 1 << 20     # attributes handled at a time, or one article's if those are more


def slices(batch, weight: str):
    """Cut a batch so that the lists of ``weight`` in a slice have at most ``SLICE`` elements, or it is one row."""
    ends = np.cumsum(np.nan_to_num(batch.column(weight).value_lengths().to_numpy(zero_copy_only=False)))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        yield batch.slice(start, end - start)
        start = end


def make_encoder(hashes: np.ndarray, keep: tuple):
    """Rows with ``names`` (hashes of all attributes of an article, sentence by sentence), ``vals`` and ``m`` (how
    many each sentence has) -> CSR rows with what the sorted dictionary ``hashes`` has of them."""
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in slices(whole, "names"):
                names = _flat(b.column("names")).astype(np.int64)
                m = _flat(b.column("m")).astype(np.int64)
                n = b.column("m").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.searchsorted(hashes, names)
                at[at == len(hashes)] = 0
                known = hashes[at] == names if len(hashes) else np.zeros(len(names), bool)
                sentence = np.repeat(np.arange(len(m)), m)
                kept = np.bincount(sentence[known], minlength=len(m))
                rows = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                cells = np.concatenate([[0], np.cumsum(kept)])[rows].astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(rows), pa.array(kept.astype(np.int32))),
                         pa.ListArray.from_arrays(pa.array(cells), pa.array(at[known].astype(np.int32)))]
                out = ["m", "idx"]
                if "vals" in b.schema.names:
                    lists.append(pa.ListArray.from_arrays(pa.array(cells), pa.array(
                        _flat(b.column("vals"))[known].astype(np.float64))))
                    out.append("val")
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *lists], names=[*keep, *out])
    return run


def _csr(batch):
    """(cells of each sentence, dictionary position and value of each cell, sentences of each article); values are None if
    all are 1."""
    m = _flat(batch.column("m")).astype(np.int64)
    n = batch.column("m").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return m, _flat(batch.column("idx")), _flat(batch.column("val")) if "val" in batch.schema.names else None, n


def chained(first, second):
    """Two kernels as one, so that a task has one Python worker and nothing passes the JVM in between."""
    return lambda batches: second(first(batches))


def _scores(m, idx, val, W: np.ndarray) -> np.ndarray:
    """Emissions: for each sentence the sum of its cells' weights. Cells lie sentence by sentence, so a sum is one of
    neighbours; two labels' weights are looked up together, as one complex number."""
    W = np.ascontiguousarray(W, dtype=np.float64)
    E = np.zeros((len(m), W.shape[1]))
    some = np.flatnonzero(m)
    if len(some):
        starts = (np.cumsum(m) - m)[some]
        columns = [W.view(np.complex128)[:, 0]] if W.shape[1] == 2 else list(W.T)
        for k, w in enumerate(columns):
            cells = np.take(w, idx)
            sums = np.add.reduceat(cells if val is None else cells * val, starts)
            if len(columns) < W.shape[1]:
                E[some] = sums.view(np.float64).reshape(-1, 2)
            else:
                E[some, k] = sums
    return E


def _add_gradient(gW: np.ndarray, m, idx, val, R: np.ndarray) -> None:
    """Adds the cells' residuals by attribute. A sentence's residuals add up to 0, so the last label's are not summed."""
    for k in range(gW.shape[1] - 1):
        cells = np.repeat(R[:, k], m)
        g = np.bincount(idx, cells if val is None else cells * val, minlength=len(gW))
        gW[:, k] += g
        gW[:, -1] -= g


def _by_sentences(n: np.ndarray):
    """Ranges of articles (first, last + 1) with ``STEPS`` sentences at most, or of one article."""
    ends, start = np.cumsum(n), 0
    while start < len(n):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEPS, side="right")))
        yield start, end
        start = end


def _blocks(grad: np.ndarray, head: np.ndarray):
    """Record batch of a gradient's non-zero rows as blocks of (index, value), and ``head`` as block -1."""
    import pyarrow as pa

    at = np.flatnonzero((grad != 0).any(axis=1))
    cuts = np.searchsorted(at, np.arange(0, len(grad) + BLOCK, BLOCK))
    nos, idxs, vals = [-1], [b""], [head.tobytes()]
    for no, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            nos.append(no)
            idxs.append((at[a:b] - no * BLOCK).astype("<i4").tobytes())
            vals.append(grad[at[a:b]].tobytes())
    return pa.RecordBatch.from_pydict({"block": pa.array(nos, pa.int32()), "idx": pa.array(idxs, pa.binary()),
                                       "val": pa.array(vals, pa.binary())})


def make_sparse_step(W: np.ndarray, A: np.ndarray, labels):
    """CSR batches -> a partition's gradient: its non-zero rows as blocks of (index, value); block -1 holds
    the loss, the number of sequences and the transition gradient."""
    d, K = W.shape
    lab = np.asarray(labels, dtype=np.int64)

    def step(batches):
        gW, gA, loss, count = np.zeros((d, K)), np.zeros((K, K)), 0.0, 0
        for whole in batches:
            for batch in slices(whole, "idx"):
                m, idx, val, n = _csr(batch)
                count += batch.num_rows
                if not n.sum():
                    continue
                E = _scores(m, idx, val, W)
                given = _flat(batch.column("y")).astype(np.int64)
                ys = np.minimum(np.searchsorted(lab, given), K - 1)
                if (lab[ys] != given).any():
                    raise ValueError("label unknown to the model")
                ends = np.concatenate([[0], np.cumsum(n)])
                for a, b in _by_sentences(n):
                    at = slice(ends[a], ends[b])
                    if ends[a] == ends[b]:
                        continue
                    nll, R, g = nll_and_residuals_flat(E[at, None], n[a:b], ys[at], [A])
                    loss += float(nll[0])
                    gA += g[0]
                    E[at] = R[:, 0]
                _add_gradient(gW, m, idx, val, E)
        yield _blocks(gW, np.concatenate([[loss, count], gA.ravel()]))
    return step


def make_squares_step(d: int):
    """CSR batches -> the sum of squares of each attribute's values and, in block -1, the number of sentences."""
    def step(batches):
        squares, n = np.zeros((d, 1)), 0
        for batch in batches:
            _, idx, val, lengths = _csr(batch)
            squares[:, 0] += np.bincount(idx, None if val is None else val * val, minlength=d)
            n += int(lengths.sum())
        yield _blocks(squares, np.array([float(n)]))
    return step


def add_block(total: np.ndarray, idx: bytes, val: bytes, width: int) -> None:
    """Add (index, value) rows of one block to its dense form."""
    total[np.frombuffer(idx, "<i4")] += np.frombuffer(val, "<f8").reshape(-1, width)


def make_block_merger(keys: tuple, width: int):
    """Rows sorted by ``keys`` (``block`` among them) -> one row per key with the sum of its (index, value) rows."""
    def run(batches):
        import pyarrow as pa

        schema, current, total, head = None, None, None, None

        def row():
            cols = [pa.array([v], schema.field(k).type) for k, v in zip(keys, current)]
            at = np.flatnonzero((total != 0).any(axis=1))
            idx, val = (b"", head.tobytes()) if head is not None else (at.astype("<i4").tobytes(), total[at].tobytes())
            return pa.RecordBatch.from_arrays([*cols, pa.array([idx], pa.binary()), pa.array([val], pa.binary())],
                                              names=[*keys, "idx", "val"])

        for batch in batches:
            schema = batch.schema
            for key, idx, val in zip(zip(*[batch.column(k).to_pylist() for k in keys]),
                                     batch.column("idx").to_pylist(), batch.column("val").to_pylist()):
                if key != current:
                    if current is not None:
                        yield row()
                    current, total, head = key, np.zeros((BLOCK, width)), None
                if key[keys.index("block")] < 0:
                    v = np.frombuffer(val, "<f8")
                    head = v if head is None else head + v
                else:
                    add_block(total, idx, val, width)
        if current is not None:
            yield row()
    return run


def make_block_rows(width: int):
    """Merged blocks -> rows (id, k, value) of what isn't the head."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for no, idx, val in zip(batch.column("block").to_pylist(), batch.column("idx").to_pylist(),
                                    batch.column("val").to_pylist()):
                if no < 0:
                    continue
                ids = np.frombuffer(idx, "<i4").astype(np.int32) + no * BLOCK
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(np.repeat(ids, width), pa.int32()),
                    "k": pa.array(np.tile(np.arange(width, dtype=np.int32), len(ids))),
                    "value": pa.array(np.frombuffer(val, "<f8"))})
    return run


def make_sparse_decoder(W: np.ndarray, A: np.ndarray, keep: tuple):
    """CSR batches -> the kept columns and the best path as label positions."""
    K = W.shape[1]

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, "idx"):
                m, idx, val, n = _csr(batch)
                total = int(n.sum())
                E = _scores(m, idx, val, W)
                first = _offsets(n, 1)
                out = np.zeros(total, dtype=np.int32)
                for rows in chunks(n, K):
                    if n[rows].max() == 0:
                        continue
                    X, M = pad(E.ravel(), first * K, n, rows, K)
                    out[(first[rows][:, None] + np.arange(M.shape[1]))[M]] = viterbi(X, M, np.eye(K), A)[M]
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], pa.ListArray.from_arrays(pa.array(ends), pa.array(out))],
                    names=[*keep, "path"])
    return run
