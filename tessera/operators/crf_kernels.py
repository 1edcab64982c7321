"""Vectorised linear-chain CRF kernels (numpy) used inside Arrow batches.

A batch of sequences arrives as flat Arrow buffers: ``n`` (lengths), ``x``
(row-major n*d values per sequence) and ``yi`` (label indices). Sequences
are sorted by length and padded in chunks so every time step is one numpy
operation over the whole chunk; there is no per-row Python.

Model: score(y|x) = sum_t W[:, y_t] . x_t + sum_{t>=1} A[y_{t-1}, y_t].
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

# Functions of this module run on executors inside ``mapInArrow``. Pickling
# them by value ships the code with each task, so executors need numpy and
# pyarrow but not this package on their Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_CELLS = 1 << 21  # padded (sequence x step x feature) cells per chunk


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True)), axis=axis)


def chunks(lengths: np.ndarray, d: int):
    """Index groups of sequences (sorted by length) whose padded size is bounded."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    N = len(order)
    while start < N:
        end = start + 1
        while end < N and (end + 1 - start) * lengths[order[end]] * max(d, 1) <= CHUNK_CELLS:
            end += 1
        yield order[start:end]
        start = end


def pad(flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, idx: np.ndarray,
        width: int) -> tuple[np.ndarray, np.ndarray]:
    """Gather sequences ``idx`` from a flat buffer into a (B, T, width) block + mask."""
    L = lengths[idx]
    T = int(L.max()) if len(L) else 0
    mask = np.arange(T)[None, :] < L[:, None]
    block = np.zeros((len(idx), T, width), dtype=flat.dtype)
    total = int(L.sum())
    if total:
        rows = flat.reshape(-1, width)
        starts = offsets[idx] // width
        # row index of every (sequence, step) in mask order
        src = np.repeat(starts - np.concatenate([[0], np.cumsum(L[:-1])]), L) + np.arange(total)
        block[mask] = rows[src]
    return block, mask


SCALED_MAX_ABS_TRANSITION = 50.0


def nll_and_grad(X: np.ndarray, M: np.ndarray, Y: np.ndarray, W: np.ndarray, A: np.ndarray,
                 want_grad: bool = True):
    """Negative log-likelihood per sequence and summed gradients for one block of feature rows."""
    nll, R, gA = nll_and_residuals(X @ W, M, Y, A, want_grad)
    if not want_grad:
        return nll, None, None
    return nll, X.reshape(-1, X.shape[2]).T @ R.reshape(-1, W.shape[1]), gA


def nll_and_residuals(E: np.ndarray, M: np.ndarray, Y: np.ndarray, A: np.ndarray, want_grad: bool = True):
    """Negative log-likelihood per sequence, its derivative by each emission (marginal
    minus truth, zero on padding) and the summed transition gradient, for one block.

    Rows of a block are sorted by length (``chunks``), so at step t the rows
    still running are a suffix of the block and each step works on a slice.
    Uses the scaled forward-backward in probability space (per-step
    normalisers c_t, emissions shifted by their per-step maximum); falls back
    to log space when transition weights are extreme.
    """
    if np.abs(A).max(initial=0.0) > SCALED_MAX_ABS_TRANSITION:
        return _residuals_log(E, M, Y, A, want_grad)
    L = M.sum(axis=1)
    if np.any(L[1:] < L[:-1]):  # callers outside ``chunks`` may pass unsorted rows
        order = np.argsort(L, kind="stable")
        nll, R, gA = nll_and_residuals(E[order], M[order], Y[order], A, want_grad)
        out = np.empty_like(nll)
        out[order] = nll
        if want_grad:
            back = np.empty_like(R)
            back[order] = R
            R = back
        return out, R, gA
    # label by label and step by step in memory, so that each operation runs over one long row of sequences
    B, T, K = E.shape
    S = np.ascontiguousarray(E.transpose(2, 1, 0))  # (K, T, B)
    Mt = np.ascontiguousarray(M.T)
    Emax = S.max(axis=0)
    PE = np.exp(S - Emax)
    EA = np.exp(A)
    lo = np.searchsorted(L, np.arange(T), side="right")  # first row still running at t
    alpha = np.zeros((K, T, B))
    c = np.ones((T, B))
    r = lo[0]  # rows with at least one step
    c[0, r:] = PE[:, 0, r:].sum(axis=0)
    alpha[:, 0, r:] = PE[:, 0, r:] / c[0, r:]
    for t in range(1, T):
        r = lo[t]
        a = (EA.T @ alpha[:, t - 1, r:]) * PE[:, t, r:]
        c[t, r:] = st = a.sum(axis=0)
        alpha[:, t, r:] = a / st
    logZ = np.log(c).sum(axis=0) + (Emax * Mt).sum(axis=0)
    Yb = np.where(M, Y, 0)
    emis = (np.take_along_axis(E, Yb[..., None], axis=2)[..., 0] * M).sum(axis=1)
    trans = (A[Yb[:, :-1], Yb[:, 1:]] * M[:, 1:]).sum(axis=1) if T > 1 else np.zeros(B)
    nll = logZ - emis - trans
    if not want_grad:
        return nll, None, None
    P = alpha  # times beta, from the last step on; zero on padding
    beta = np.ones((K, B))
    gA = np.zeros((K, K))
    for t in range(T - 1, 0, -1):
        r = lo[t]
        back = PE[:, t, r:] * beta[:, r:] / c[t, r:]  # what a step sends to the one before
        P[:, t, r:] *= beta[:, r:]
        gA += alpha[:, t - 1, r:] @ back.T
        beta[:, r:] = EA @ back
    P[:, 0] *= beta
    gA *= EA
    R = np.ascontiguousarray(P.transpose(2, 1, 0))
    R -= (Yb[..., None] == np.arange(K)) * M[..., None]
    if T > 1:
        v = M[:, 1:]
        gA -= np.bincount(Yb[:, :-1][v] * K + Yb[:, 1:][v], minlength=K * K).reshape(K, K)
    return nll, R, gA


def _added(terms):
    """Sum over the first axis, or of a few arrays; faster than a reduction along a short axis."""
    it = iter(terms)
    out = next(it)
    for x in it:
        out = out + x
    return out


SCAN_STEPS = 64  # steps of a sequence that ``nll_and_residuals_flat`` takes one by one


def nll_and_residuals_flat(E: np.ndarray, lengths: np.ndarray, y: np.ndarray, A: list):
    """``nll_and_residuals`` of several models on the same sequences, one after the other as they lie: emissions ``E``
    (sentences, models, K), label indices ``y`` (sentences). Per model the summed negative log-likelihood and transition
    gradient, and the residuals like ``E``.

    Sequences are cut into segments of ``SCAN_STEPS``, and all segments of all models take a step together, so the number of
    steps doesn't grow with the longest sequence: a segment's transfer matrix first, then what enters each segment from
    either side by a scan over the matrices of a sequence, then the scaled forward-backward inside."""
    N, n, K = E.shape
    A = np.asarray(A, dtype=np.float64).reshape(n, K, K)
    first_of = np.cumsum(lengths) - lengths
    inner = np.ones(N, dtype=bool)
    inner[first_of[lengths > 0]] = False
    inner = np.flatnonzero(inner)
    seen = np.bincount(y[inner - 1] * K + y[inner], minlength=K * K).reshape(K, K)
    truth = np.arange(N)
    loss = -E[truth, :, y].sum(axis=0) - (A * seen).sum(axis=(1, 2))
    if np.abs(A).max(initial=0.0) > SCALED_MAX_ABS_TRANSITION:
        R, gA = np.empty((N, n, K)), np.zeros((n, K, K))
        for idx in chunks(lengths, K):
            if lengths[idx].max() == 0:
                continue
            at = first_of[idx][:, None] + np.arange(lengths[idx].max())
            M = np.arange(lengths[idx].max()) < lengths[idx][:, None]
            for m in range(n):
                X, Y = np.zeros((*M.shape, K)), np.zeros(M.shape, dtype=np.int64)
                X[M], Y[M] = E[at[M], m], y[at[M]]
                nll, r, g = _residuals_log(X, M, Y, A[m])
                true = E[at[M], m, y[at[M]]].sum() + (A[m][Y[:, :-1], Y[:, 1:]] * M[:, 1:]).sum()
                loss[m] += nll.sum() + true
                R[at[M], m] = r[M]
                gA[m] += g
        return loss, R, gA
    # segments, shortest first: at step t those still running are the last ones
    parts = -(-lengths // SCAN_STEPS)
    head = np.cumsum(parts) - parts
    G = int(parts.sum())
    seq = np.repeat(np.arange(len(lengths)), parts)
    nth = np.arange(G) - head[seq]
    size = np.minimum(SCAN_STEPS, lengths[seq] - nth * SCAN_STEPS)
    order = np.argsort(size, kind="stable")
    rank = np.empty(G, dtype=np.int64)
    rank[order] = np.arange(G)
    own = np.repeat(np.arange(G), size)
    t_of, g_of = truth - (np.cumsum(size) - size)[own], rank[own]
    T = int(size.max())
    lo = n * np.searchsorted(size[order], np.arange(T), side="right")
    S = np.zeros((K, T, G, n))
    S[:, t_of, g_of] = E.transpose(2, 0, 1)
    S = S.reshape(K, T, G * n)
    Emax = S.max(axis=0)
    PE = np.exp(S - Emax)
    EA = np.tile(np.exp(A).transpose(1, 2, 0), (1, 1, G))  # a segment's models stand side by side
    first = np.repeat(nth[order] == 0, n)
    entry = np.zeros((K, G, n))  # forward message into a segment; 0 for a sequence's first
    beta = np.ones((K, G, n))    # backward message at its last step
    long = np.flatnonzero(parts > 1)
    long = long[np.argsort(-parts[long], kind="stable")]
    running = [long[:int((parts[long] > q).sum())] for q in range(1, parts.max(initial=1))]  # with a q-th segment
    if len(long):
        many = (parts > 1)[seq][order]
        place, cols = np.cumsum(many) - 1, np.repeat(many, n)
        lo_many = n * np.searchsorted(size[order][many], np.arange(T), side="right")
        pe, ea = PE[:, :, cols], EA[:, :, cols]
        V = np.where(first[cols], 1.0, ea) * pe[:, 0]
        V /= V.sum(axis=(0, 1))
        for t in range(1, T):
            r = lo_many[t]
            v = _added(V[:, k, None, r:] * ea[k, :, r:] for k in range(K)) * pe[:, t, r:]
            V[:, :, r:] = v / _added(v.reshape(K * K, -1))
        V = V.reshape(K, K, -1, n)
        a = V[0][:, place[rank[head[long]]]]
        for q, ids in enumerate(running, 1):
            g = rank[head[ids] + q]
            a = a[:, :len(ids)]
            entry[:, g] = a = a / a.sum(axis=0)
            a = (a[:, None] * V[:, :, place[g]]).sum(axis=0)
    entry = entry.reshape(K, G * n)
    alpha = np.zeros((K, T, G * n))
    c = np.ones((T, G * n))
    a = np.where(first, 1.0, _added(EA * entry[:, None])) * PE[:, 0]
    c[0] = _added(a)
    alpha[:, 0] = a / c[0]
    for t in range(1, T):
        r = lo[t]
        a = _added(EA[k, :, r:] * alpha[k, t - 1, r:] for k in range(K)) * PE[:, t, r:]
        c[t, r:] = st = _added(a)
        np.divide(a, st, out=alpha[:, t, r:])
    loss += (np.log(c).sum(axis=0) + Emax.sum(axis=0)).reshape(G, n).sum(axis=0)
    if len(long):
        b = np.ones((K, len(long), n))
        into = entry.reshape(K, G, n)
        for q in range(len(running), 0, -1):
            ids = running[q - 1]
            g = rank[head[ids] + q]
            back = (V[:, :, place[g]] * b[:, :len(ids)]).sum(axis=1)
            b[:, :len(ids)] = beta[:, rank[head[ids] + q - 1]] = back / (into[:, g] * back).sum(axis=0)
    beta = beta.reshape(K, G * n)
    P = alpha  # times beta, from the last step on
    pairs = np.zeros((K, K, G * n))
    for t in range(T - 1, 0, -1):
        r = lo[t]
        back = PE[:, t, r:] * beta[:, r:] / c[t, r:]
        P[:, t, r:] *= beta[:, r:]
        pairs[:, :, r:] += alpha[:, t - 1, None, r:] * back
        beta[:, r:] = _added(EA[:, k, r:] * back[k] for k in range(K))
    P[:, 0] *= beta
    pairs += entry[:, None] * (PE[:, 0] * beta / c[0])
    R = np.ascontiguousarray(P.reshape(K, T, G, n)[:, t_of, g_of].transpose(1, 2, 0))
    R[truth, :, y] -= 1.0
    return loss, R, (pairs * EA).reshape(K, K, G, n).sum(axis=2).transpose(2, 0, 1) - seen


def nll_and_grad_log(X: np.ndarray, M: np.ndarray, Y: np.ndarray, W: np.ndarray, A: np.ndarray,
                     want_grad: bool = True):
    """``nll_and_grad`` in log space."""
    nll, R, gA = _residuals_log(X @ W, M, Y, A, want_grad)
    return nll, np.einsum("btd,btk->dk", X, R) if want_grad else None, gA


def _residuals_log(E: np.ndarray, M: np.ndarray, Y: np.ndarray, A: np.ndarray, want_grad: bool = True):
    """Log-space forward-backward (reference implementation and fallback)."""
    B, T, K = E.shape
    alpha = np.empty((B, T, K))
    alpha[:, 0] = E[:, 0]
    for t in range(1, T):
        a = _lse(alpha[:, t - 1, :, None] + A[None], axis=1) + E[:, t]
        alpha[:, t] = np.where(M[:, t, None], a, alpha[:, t - 1])
    logZ = _lse(alpha[:, T - 1], axis=1)
    Yb = np.where(M, Y, 0)
    emis = (np.take_along_axis(E, Yb[..., None], axis=2)[..., 0] * M).sum(axis=1)
    trans = (A[Yb[:, :-1], Yb[:, 1:]] * M[:, 1:]).sum(axis=1) if T > 1 else np.zeros(B)
    nll = np.where(M[:, 0], logZ - emis - trans, 0.0)  # an empty sequence has likelihood 1
    if not want_grad:
        return nll, None, None
    beta = np.zeros((B, T, K))
    for t in range(T - 2, -1, -1):
        b = _lse(A[None] + (E[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
        beta[:, t] = np.where(M[:, t + 1, None], b, 0.0)
    P = np.exp(alpha + beta - logZ[:, None, None]) * M[..., None]
    onehot = (Yb[..., None] == np.arange(K)) * M[..., None]
    gA = np.zeros((K, K))
    if T > 1:
        Q = np.exp(alpha[:, :-1, :, None] + A[None, None]
                   + (E[:, 1:] + beta[:, 1:])[:, :, None, :]
                   - logZ[:, None, None, None]) * M[:, 1:, None, None]
        gA += Q.sum(axis=(0, 1))
        v = M[:, 1:]
        np.add.at(gA, (Yb[:, :-1][v], Yb[:, 1:][v]), -1.0)
    return nll, P - onehot, gA


def viterbi(X: np.ndarray, M: np.ndarray, W: np.ndarray, A: np.ndarray) -> np.ndarray:
    """Best label-index path per sequence (ties go to the lower index)."""
    B, T, _ = X.shape
    K = W.shape[1]
    E = X @ W
    L = M.sum(axis=1)
    delta = E[:, 0].copy()
    bp = np.zeros((B, T, K), dtype=np.int64)
    for t in range(1, T):
        cand = delta[:, :, None] + A[None]
        best = cand.argmax(axis=1)
        nd = np.take_along_axis(cand, best[:, None, :], axis=1)[:, 0] + E[:, t]
        valid = M[:, t, None]
        delta = np.where(valid, nd, delta)
        bp[:, t] = best
    cur = delta.argmax(axis=1)
    paths = np.zeros((B, T), dtype=np.int64)
    rows = np.arange(B)
    for t in range(T - 1, -1, -1):
        inside = t <= L - 1
        paths[:, t] = np.where(inside, cur, 0)
        if t > 0:
            cur = np.where(inside, bp[rows, t, cur], cur)
    return paths


def _flat(col) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False)


def _offsets(lengths: np.ndarray, width: int) -> np.ndarray:
    off = np.zeros(len(lengths), dtype=np.int64)
    if len(lengths) > 1:
        off[1:] = np.cumsum(lengths[:-1] * width)
    return off


def make_gradient_step(W: np.ndarray, A: np.ndarray, labels=None):
    """Arrow batch iterator -> one row ``(loss, grad, nseq)`` per partition.

    Reads ``n``, ``x`` and either ``yi`` (label indices) or ``y`` (label
    values, mapped with the sorted ``labels``)."""
    d, K = W.shape
    lab = None if labels is None else np.asarray(labels, dtype=np.int64)

    def step(batches):
        import pyarrow as pa

        loss = 0.0
        gW = np.zeros((d, K))
        gA = np.zeros((K, K))
        nseq = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lengths = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            xs = _flat(batch.column("x"))
            if lab is None:
                ys = _flat(batch.column("yi")).astype(np.int64)
            else:
                ys = np.searchsorted(lab, _flat(batch.column("y")).astype(np.int64))
            xo, yo = _offsets(lengths, d), _offsets(lengths, 1)
            for idx in chunks(lengths, d):
                if lengths[idx].max() == 0:
                    continue
                X, M = pad(xs, xo, lengths, idx, d)
                Yb, _ = pad(ys, yo, lengths, idx, 1)
                nll, g1, g2 = nll_and_grad(X, M, Yb[..., 0].astype(np.int64), W, A)
                loss += float(nll.sum())
                gW += g1
                gA += g2
            nseq += batch.num_rows
        grad = np.concatenate([gW.ravel(), gA.ravel()])
        yield pa.RecordBatch.from_pydict({
            "loss": pa.array([loss], pa.float64()),
            "grad": pa.array([grad.tolist()], pa.list_(pa.float64())),
            "nseq": pa.array([nseq], pa.int64()),
        })

    return step


def make_sequence_scorer(W: np.ndarray, A: np.ndarray, mode: str, keep=("article_id",), n="n", x="x"):
    """Arrow batches -> per sequence ``nll`` (mode 'nll') or ``path`` (mode 'viterbi').

    The columns in ``keep`` pass through; ``n`` and ``x`` name the sequence."""
    d, K = W.shape

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows == 0:
                continue
            kept = [batch.column(c) for c in keep]
            lengths = batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)
            xs = _flat(batch.column(x))
            xo = _offsets(lengths, d)
            yo = _offsets(lengths, 1)
            if mode == "nll":
                ys = _flat(batch.column("yi")).astype(np.int64)
                out = np.zeros(batch.num_rows)
            else:
                out = np.zeros(int(lengths.sum()), dtype=np.int32)
            for idx in chunks(lengths, d):
                if lengths[idx].max() == 0:
                    continue
                X, M = pad(xs, xo, lengths, idx, d)
                if mode == "nll":
                    Yb, _ = pad(ys, yo, lengths, idx, 1)
                    nll, _, _ = nll_and_grad(X, M, Yb[..., 0].astype(np.int64), W, A, False)
                    out[idx] = nll
                else:
                    paths = viterbi(X, M, W, A)
                    dest = yo[idx][:, None] + np.arange(M.shape[1])[None, :]
                    out[dest[M]] = paths[M]
            if mode == "nll":
                yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.float64())], names=[*keep, "nll"])
            else:
                offs = np.concatenate([yo, [int(lengths.sum())]]).astype(np.int32)
                paths = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(out, pa.int32()))
                yield pa.RecordBatch.from_arrays([*kept, paths], names=[*keep, "path"])

    return run


# --------------------------------------------------------------------------
# Segment-parallel forward-backward for very long sequences. A sequence is
# cut into segments; each segment is summarised by a K x K log transfer
# matrix, the matrices are scanned per sequence to give every segment its
# incoming forward message and outgoing backward message, and each segment
# then computes its exact share of the loss and gradient. Same result as the
# whole-sequence kernel; the work of one long sequence spreads over tasks.

def _lse_vec(a: np.ndarray, axis: int) -> np.ndarray:
    m = np.max(a, axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0.0)
    return np.squeeze(m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True)), axis=axis)


def segment_transfer(X: np.ndarray, W: np.ndarray, A: np.ndarray, first: bool) -> np.ndarray:
    """log transfer L[i, j]: all label paths through the segment that enter
    from label i (at the previous position) and end in label j. For the
    first segment there is no entering label and every row is the same."""
    E = X @ W
    K = W.shape[1]
    if first:
        v = E[0].copy()
        for t in range(1, len(E)):
            v = _lse_vec(v[:, None] + A, axis=0) + E[t]
        return np.tile(v, (K, 1))
    M = A + E[0][None, :]
    for t in range(1, len(E)):
        M = _lse_vec(M[:, :, None] + A[None], axis=1) + E[t][None, :]
    return M


def scan_messages(Ls: list[np.ndarray]) -> tuple[list, list, float]:
    """Per sequence: forward message entering each segment, backward message
    leaving each segment, and log Z (segments in order)."""
    K = Ls[0].shape[0]
    alpha_in = [None]
    fwd = Ls[0][0]
    for L in Ls[1:]:
        alpha_in.append(fwd)
        fwd = _lse_vec(fwd[:, None] + L, axis=0)
    logZ = float(_lse_vec(fwd, axis=0))
    beta_out = [None] * len(Ls)
    beta_out[-1] = np.zeros(K)
    for g in range(len(Ls) - 1, 0, -1):
        beta_out[g - 1] = _lse_vec(Ls[g] + beta_out[g][None, :], axis=1)
    return alpha_in, beta_out, logZ


def segment_share(X, y, y_prev, alpha_in, beta_out, logZ, W, A, first: bool):
    """Loss share (minus the gold path score of the segment, plus log Z on
    the first segment) and gradient share of one segment."""
    E = X @ W
    n, K = E.shape
    alpha = np.empty((n, K))
    alpha[0] = E[0] if first else _lse_vec(alpha_in[:, None] + A, axis=0) + E[0]
    for t in range(1, n):
        alpha[t] = _lse_vec(alpha[t - 1][:, None] + A, axis=0) + E[t]
    beta = np.empty((n, K))
    beta[n - 1] = beta_out
    for t in range(n - 2, -1, -1):
        beta[t] = _lse_vec(A + (E[t + 1] + beta[t + 1])[None, :], axis=1)
    P = np.exp(alpha + beta - logZ)
    onehot = (y[:, None] == np.arange(K)).astype(float)
    gW = X.T @ (P - onehot)
    gA = np.zeros((K, K))
    for t in range(1, n):
        gA += np.exp(alpha[t - 1][:, None] + A + (E[t] + beta[t])[None, :] - logZ)
        gA[y[t - 1], y[t]] -= 1.0
    gold = float(E[np.arange(n), y].sum() + A[y[:-1], y[1:]].sum())
    if not first:
        gA += np.exp(alpha_in[:, None] + A + (E[0] + beta[0])[None, :] - logZ)
        gA[y_prev, y[0]] -= 1.0
        gold += float(A[y_prev, y[0]])
    loss = (logZ if first else 0.0) - gold
    return loss, gW, gA


def _rows_of(batch, d: int, lab: np.ndarray):
    """(article_id, seg, X, y_index, y_prev_index, first) per segment row."""
    ids = batch.column("article_id").to_pylist()
    segs = batch.column("seg").to_numpy(zero_copy_only=False)
    lengths = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
    xs = _flat(batch.column("x")).astype(np.float64)
    ys = np.searchsorted(lab, _flat(batch.column("y")).astype(np.int64))
    prev = batch.column("y_prev").to_pylist()
    xo, yo = _offsets(lengths, d), _offsets(lengths, 1)
    for r in range(batch.num_rows):
        n = int(lengths[r])
        X = xs[xo[r]:xo[r] + n * d].reshape(n, d)
        y = ys[yo[r]:yo[r] + n]
        yp = None if prev[r] is None else int(np.searchsorted(lab, prev[r]))
        yield ids[r], int(segs[r]), X, y, yp, int(segs[r]) == 0


def make_transfer_step(W: np.ndarray, A: np.ndarray, labels):
    """Segment rows -> ``(article_id, seg, L)`` log transfer matrices."""
    d, K = W.shape
    lab = np.asarray(labels, dtype=np.int64)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out_id, out_seg, out_L = [], [], []
            for aid, seg, X, _, _, first in _rows_of(b, d, lab):
                out_id.append(aid)
                out_seg.append(seg)
                out_L.append(segment_transfer(X, W, A, first).ravel().tolist())
            yield pa.RecordBatch.from_pydict({"article_id": pa.array(out_id, pa.string()),
                                              "seg": pa.array(out_seg, pa.int32()),
                                              "L": pa.array(out_L, pa.list_(pa.float64()))})

    return run


def make_message_scan(K: int):
    """One sequence's segment matrices (pandas group) -> messages per segment."""

    def scan(pdf):
        import pandas as pd

        pdf = pdf.sort_values("seg")
        Ls = [np.asarray(v, dtype=np.float64).reshape(K, K) for v in pdf["L"]]
        alpha_in, beta_out, logZ = scan_messages(Ls)
        return pd.DataFrame({
            "article_id": pdf["article_id"].to_numpy(),
            "seg": pdf["seg"].to_numpy(),
            "alpha_in": [None if a is None else a.tolist() for a in alpha_in],
            "beta_out": [b.tolist() for b in beta_out],
            "logz": logZ})

    return scan


def make_segment_step(W: np.ndarray, A: np.ndarray, labels):
    """Segment rows with their messages -> one ``(loss, grad, nseq)`` row per partition."""
    d, K = W.shape
    lab = np.asarray(labels, dtype=np.int64)

    def run(batches):
        import pyarrow as pa

        loss, gW, gA, nseq = 0.0, np.zeros((d, K)), np.zeros((K, K)), 0
        for b in batches:
            alphas = b.column("alpha_in").to_pylist()
            betas = b.column("beta_out").to_pylist()
            logz = b.column("logz").to_pylist()
            for r, (_, _, X, y, yp, first) in enumerate(_rows_of(b, d, lab)):
                a_in = None if alphas[r] is None else np.asarray(alphas[r])
                l, g1, g2 = segment_share(X, y, yp, a_in, np.asarray(betas[r]), logz[r], W, A, first)
                loss += l
                gW += g1
                gA += g2
                nseq += int(first)
        grad = np.concatenate([gW.ravel(), gA.ravel()])
        yield pa.RecordBatch.from_pydict({"loss": pa.array([loss], pa.float64()),
                                          "grad": pa.array([grad.tolist()], pa.list_(pa.float64())),
                                          "nseq": pa.array([nseq], pa.int64())})

    return run


# ---- segment-parallel Viterbi (max-plus analogue of the above)
def segment_max_transfer(X: np.ndarray, W: np.ndarray, A: np.ndarray, first: bool) -> np.ndarray:
    """V[i, j]: best path score through the segment entering from label i
    and ending in label j (rows equal for the first segment)."""
    E = X @ W
    K = W.shape[1]
    if first:
        v = E[0].copy()
        for t in range(1, len(E)):
            v = (v[:, None] + A).max(axis=0) + E[t]
        return np.tile(v, (K, 1))
    M = A + E[0][None, :]
    for t in range(1, len(E)):
        M = (M[:, :, None] + A[None]).max(axis=1) + E[t][None, :]
    return M


def scan_viterbi(Vs: list[np.ndarray]) -> tuple[list, list]:
    """Best label entering and ending each segment (first maximum wins)."""
    m_in = [None]
    m = Vs[0][0]
    for V in Vs[1:]:
        m_in.append(m)
        m = (m[:, None] + V).max(axis=0)
    ends = [None] * len(Vs)
    enters = [None] * len(Vs)
    ends[-1] = int(np.argmax(m))
    for g in range(len(Vs) - 1, 0, -1):
        enters[g] = int(np.argmax(m_in[g] + Vs[g][:, ends[g]]))
        ends[g - 1] = enters[g]
    return enters, ends


def segment_decode(X: np.ndarray, W: np.ndarray, A: np.ndarray, enter, end: int) -> np.ndarray:
    """Best label path inside a segment with its entering and final labels fixed."""
    E = X @ W
    n, K = E.shape
    delta = E[0].copy() if enter is None else A[enter] + E[0]
    bp = np.zeros((n, K), dtype=np.int64)
    for t in range(1, n):
        cand = delta[:, None] + A
        bp[t] = cand.argmax(axis=0)
        delta = cand.max(axis=0) + E[t]
    path = np.empty(n, dtype=np.int64)
    path[-1] = end
    for t in range(n - 1, 0, -1):
        path[t - 1] = bp[t, path[t]]
    return path


def _x_rows(batch, d: int):
    ids = batch.column("article_id").to_pylist()
    segs = batch.column("seg").to_numpy(zero_copy_only=False)
    lengths = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
    xs = _flat(batch.column("x")).astype(np.float64)
    xo = _offsets(lengths, d)
    for r in range(batch.num_rows):
        n = int(lengths[r])
        yield r, ids[r], int(segs[r]), xs[xo[r]:xo[r] + n * d].reshape(n, d)


def make_max_transfer_step(W: np.ndarray, A: np.ndarray):
    d, K = W.shape

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, segs, Vs = [], [], []
            for _, aid, seg, X in _x_rows(b, d):
                ids.append(aid)
                segs.append(seg)
                Vs.append(segment_max_transfer(X, W, A, seg == 0).ravel().tolist())
            yield pa.RecordBatch.from_pydict({"article_id": pa.array(ids, pa.string()),
                                              "seg": pa.array(segs, pa.int32()),
                                              "V": pa.array(Vs, pa.list_(pa.float64()))})

    return run


def make_viterbi_scan(K: int):
    def scan(pdf):
        import pandas as pd

        pdf = pdf.sort_values("seg")
        enters, ends = scan_viterbi([np.asarray(v, dtype=np.float64).reshape(K, K) for v in pdf["V"]])
        return pd.DataFrame({"article_id": pdf["article_id"].to_numpy(), "seg": pdf["seg"].to_numpy(),
                             "enter": pd.array(enters, dtype="Int32"), "end": np.asarray(ends, dtype=np.int32)})

    return scan


def make_segment_decode_step(W: np.ndarray, A: np.ndarray):
    d, K = W.shape

    def run(batches):
        import pyarrow as pa

        for b in batches:
            enters = b.column("enter").to_pylist()
            ends = b.column("end").to_pylist()
            ids, segs, paths = [], [], []
            for r, aid, seg, X in _x_rows(b, d):
                ids.append(aid)
                segs.append(seg)
                paths.append(segment_decode(X, W, A, enters[r], ends[r]).astype(np.int32).tolist())
            yield pa.RecordBatch.from_pydict({"article_id": pa.array(ids, pa.string()),
                                              "seg": pa.array(segs, pa.int32()),
                                              "path": pa.array(paths, pa.list_(pa.int32()))})

    return run
