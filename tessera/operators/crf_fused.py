"""Many sequence models fitted and scored in the passes of one (H1, H2 for H9, H11, H12).

The runs of an ablation, a learning curve or a cross-domain table differ in the attributes they
use, the training rows they see and the transitions they may weigh, not in the data. So the rows are
kept once, with all attributes (named features, the raw sentence vector and a flag that there is
one), next to a bit mask of the row groups each article belongs to. A model's own
attributes are a linear map of them, ``x @ P``: it picks columns, and projects the vector by the
model's own PCA. Since ``(x @ P) @ W = x @ (P @ W)``, a model is a weight matrix over the common
attributes, and its gradient is ``P.T`` times the common one.

One ``mapInArrow`` pass then evaluates all models that still run: the emissions of all come from one product with
the attributes as they lie, and only these are padded by sequence. A partition returns one block a model. The L-BFGS
states advance in step on the driver, and a fit that has converged leaves the pass.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lbfgs
from .crf import (COLLECT_MAX_PARTITIONS, DEFAULT_C2, DEFAULT_MAX_ITER, HOT_SEQUENCE_LEN, SEGMENT_LEN, CRFModel,
                  CRFObjective, build_segments, observed_labels, training_partitions, transition_mask)
from .crf_kernels import _flat, _offsets, chunks, nll_and_residuals_flat, viterbi
from .vector_sums import block_rows, merged_blocks
from .vector_table import VectorTable

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pyarrow only

MAX_GROUPS = 62  # bits of a member mask
ZERO = -2         # in place of a row of a table: a zero vector
SLAB = 4_096      # sentences made of doubles at a time
STEP_CELLS = 32   # numbers that a padded step of a sequence counts as, see ``chunks``
PART_BYTES = 48 << 20  # of training rows in a partition: a task that joins, keeps or reads rows holds much of one


@dataclass
class Spec:
    """One model: its attribute names, their map from the common attributes, its row group and options."""
    feature_names: tuple
    P: np.ndarray                    # (common, own)
    group: int = 0
    transitions: str = "all"
    c2: float = DEFAULT_C2
    max_iter: int = DEFAULT_MAX_ITER
    toggles: dict = field(default_factory=dict)


def member_mask(groups: list[Column]) -> Column:
    """The row groups an article belongs to, as bits; a null condition is false."""
    if len(groups) > MAX_GROUPS:
        raise ValueError(f"{len(groups)} row groups; at most {MAX_GROUPS} in one pass")
    mask = F.lit(0).cast("long")
    for k, condition in enumerate(groups):
        mask = mask + F.when(condition, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return mask


def bounded_partitions(spark, sentences: int, named: int, width: int, partitions: int | None = None) -> int:
    """Partitions for training rows of so many sentences, each of ``named`` doubles and ``width`` floats: one for each
    core at least, and none of much more than ``PART_BYTES``, which bounds what a task holds."""
    return max(training_partitions(spark, partitions), -(-sentences * (8 * named + 4 * width + 8) // PART_BYTES))


def _lengths(batch) -> np.ndarray:
    return batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)


class _Rows:
    """A batch's sentences with the common attributes: ``x``, and with ``width`` the raw vectors in ``v`` (null: none)
    and a flag that there are some. With the ``vecs`` of a table ``v`` has rows of it (-1: a zero vector). Sentences stay in rows as they lie, and ``SLAB`` of them at a time are made of
    doubles, so nothing wider than emissions is padded."""

    def __init__(self, batch, lengths: np.ndarray, width: int, vecs: np.ndarray | None = None):
        total = int(lengths.sum())
        self.width, self.starts = width, _offsets(lengths, 1)
        self.x = _flat(batch.column("x")).reshape(total, -1) if total else np.zeros((0, 1))
        if width:
            column = batch.column("v")
            has = np.repeat(~column.is_null().to_numpy(zero_copy_only=False), lengths)
            if vecs is None:
                self.v, self.at = _flat(column).reshape(-1, width), np.where(has, np.cumsum(has) - 1, -1)
            else:
                self.v, self.at = vecs, np.full(total, -1)
                at = _flat(column)
                self.at[has] = np.where(at < 0, ZERO, at)

    def _slabs(self, s: np.ndarray):
        """(part of ``s``, its rows of x, which of them have vectors, these)."""
        for start in range(0, len(s), SLAB):
            part = slice(start, start + SLAB)
            x = self.x[s[part]]
            if not self.width:
                yield part, x, None, None
                continue
            at = self.at[s[part]]
            has = slice(None) if (at != -1).all() else np.flatnonzero(at != -1)
            v = self.v[np.maximum(at[has], 0)].astype(np.float64)
            v[at[has] == ZERO] = 0.0
            yield part, x, has, v

    def times(self, s: np.ndarray, W: np.ndarray) -> np.ndarray:
        """``attributes @ W`` of the sentences ``s``."""
        out = np.empty((len(s), W.shape[1]))
        for part, x, has, v in self._slabs(s):
            k = x.shape[1]
            e = x @ W[:k]
            if has is not None:
                e[has] += v @ W[k:-1] + W[-1]
            out[part] = e
        return out

    def back(self, s: np.ndarray, R: np.ndarray, out: np.ndarray) -> None:
        """Adds ``attributes.T @ R`` of the sentences ``s``."""
        for part, x, has, v in self._slabs(s):
            k, r = x.shape[1], R[part]
            out[:k] += x.T @ r
            if has is not None:
                out[k:-1] += v.T @ r[has]
                out[-1] += r[has].sum(axis=0)

    def moments(self, s: np.ndarray, d: int) -> np.ndarray:
        total = np.zeros((d, d))
        for _, x, has, v in self._slabs(s):
            z = np.zeros((len(x), d))
            z[:, :x.shape[1]] = x
            if has is not None:
                z[has, x.shape[1]:-1] = v
                z[has, -1] = 1.0
            total += z.T @ z
        return total

    def sentences(self, lengths: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the sentences of the sequences ``idx`` one after the other, their places in a padded block as a mask)."""
        L = lengths[idx]
        ends = np.cumsum(L)
        return (np.repeat(self.starts[idx] - (ends - L), L) + np.arange(ends[-1] if len(ends) else 0),
                np.arange(L.max(initial=0)) < L[:, None])


def _by_mask(member: np.ndarray, lengths: np.ndarray):
    """(mask, indices of a chunk of sequences that have it, sorted by length)."""
    for mask in np.unique(member):
        rows = np.flatnonzero(member == mask)
        for idx in chunks(lengths[rows], STEP_CELLS):
            if lengths[rows[idx]].max() > 0:
                yield int(mask), rows[idx]


def make_group_stats(d: int, labels: tuple, groups: int, width: int = 0, table: VectorTable | None = None):
    """Batches -> per row group: sequences, sentences, label and transition counts, second moments of x."""
    lab, K = np.asarray(labels, dtype=np.int64), len(labels)

    def step(batches):
        import pyarrow as pa

        total, vecs = {}, table and table.open()[2]
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = _lengths(batch)
            member = batch.column("member").to_numpy(zero_copy_only=False)
            ys = np.searchsorted(lab, _flat(batch.column("y")).astype(np.int64))
            rows = _Rows(batch, lengths, width, vecs)
            for mask, idx in _by_mask(member, lengths):
                s, M = rows.sentences(lengths, idx)
                y = np.zeros(M.shape, dtype=np.int64)
                y[M] = ys[s]
                pairs = M[:, 1:]
                trans = np.bincount(y[:, :-1][pairs] * K + y[:, 1:][pairs], minlength=K * K)
                v = np.concatenate([[len(idx), M.sum()], np.bincount(ys[s], minlength=K), trans, rows.moments(s, d).ravel()])
                for g in range(groups):
                    if mask >> g & 1:
                        total[(g,)] = total.get((g,), 0.0) + v
        if total:
            yield block_rows(total, {"model": pa.int32()}, "<f8")
    return step


def make_fused_step(models: list[tuple], d: int, width: int = 0, table: VectorTable | None = None):
    """Batches -> per model (key, group, W, A, labels): loss, sequences and gradient over the common attributes."""
    def step(batches):
        import pyarrow as pa

        total = {(key,): np.zeros(2 + W.size + A.size) for key, _, W, A, _ in models}
        seen, vecs = False, table and table.open()[2]
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            lengths = _lengths(batch)
            member = batch.column("member").to_numpy(zero_copy_only=False)
            ys = _flat(batch.column("y")).astype(np.int64)
            rows = _Rows(batch, lengths, width, vecs)
            for key, group, *_ in models:
                total[(key,)][1] += int((member >> group & 1).sum())
            for mask, idx in _by_mask(member, lengths):
                mine = [m for m in models if mask >> m[1] & 1]
                if not mine:
                    continue
                s, _ = rows.sentences(lengths, idx)
                E = rows.times(s, np.hstack([W for _, _, W, _, _ in mine]))
                ends = np.cumsum([W.shape[1] for _, _, W, _, _ in mine])
                R, grads = np.empty_like(E), []
                for labels in dict.fromkeys(m[4] for m in mine):  # models of the same labels go together
                    same = [i for i, m in enumerate(mine) if m[4] == labels]
                    at = np.concatenate([np.arange(ends[i] - len(labels), ends[i]) for i in same])
                    Y = np.searchsorted(np.asarray(labels, dtype=np.int64), ys[s])
                    nll, res, gA = nll_and_residuals_flat(E[:, at].reshape(len(s), len(same), -1), lengths[idx], Y,
                                                          [mine[i][3] for i in same])
                    R[:, at] = res.reshape(len(s), -1)
                    grads += [(i, nll[j], gA[j]) for j, i in enumerate(same)]
                gW = np.zeros((d, R.shape[1]))
                rows.back(s, R, gW)
                for i, loss, gA in grads:
                    key, _, W, _, _ = mine[i]
                    t = total[(key,)]
                    t[0] += loss
                    t[2:2 + W.size] += gW[:, ends[i] - W.shape[1]:ends[i]].ravel()
                    t[2 + W.size:] += gA.ravel()
        if seen:
            yield block_rows(total, {"model": pa.int32()}, "<f8")
    return step


def _sums(parts: DataFrame, partitions: int) -> dict[int, np.ndarray]:
    """The summed vector of each model: partitions' rows as they are when few, else merged in a tree."""
    rows = (parts if partitions <= COLLECT_MAX_PARTITIONS else merged_blocks(parts)).collect()
    blocks: dict = {}
    for r in rows:
        v = np.frombuffer(bytes(r.blob), "<f8")
        own = blocks.setdefault(r.model, {})
        own[r.block] = own[r.block] + v if r.block in own else v
    return {m: np.concatenate([own[b] for b in sorted(own)]) for m, own in blocks.items()}


SUM_SCHEMA = "model int, block int, blob binary"


def fit_together(rows: DataFrame, specs: list[Spec], partitions: int | None = None, precondition: bool = True,
                 hot_len: int = HOT_SEQUENCE_LEN, segment_len: int = SEGMENT_LEN, width: int = 0,
                 table: VectorTable | None = None) -> list[CRFModel]:
    """H1 for every spec on rows ``(article_id, n, x, y, member)``, x row-major over the common attributes; with
    ``width`` these are x, the raw vectors of that width in a column ``v`` and a flag that v is not null; with ``table`` column ``v`` has its rows (``placed``). Rows that are persisted already are
    read as they lie, others are spread and kept first.

    The same objective, scaling, optimiser and stopping rule as ``crf.fit``, and the same weights
    up to the order in which floats are added. The number of Spark jobs is that of the longest fit.
    """
    spark, d = rows.sparkSession, specs[0].P.shape[0]
    vector = ["v"] if width else []
    data = rows.filter("n > 0 AND member <> 0").select("article_id", "n", "x", *vector, "y", "member")
    kept = rows.storageLevel.useMemory
    spread = rows.rdd.getNumPartitions() if kept else training_partitions(spark, partitions)
    if not kept:
        data = data.repartition(spread).persist(StorageLevel.MEMORY_AND_DISK)
    segments = None
    groups = 1 + max(s.group for s in specs)
    try:
        labels = observed_labels(data)
        if not labels:
            raise ValueError("no training labels")
        K, longest = len(labels), data.agg(F.max("n")).first()[0]
        stats = _sums(data.mapInArrow(make_group_stats(d, labels, groups, width, table), SUM_SCHEMA), spread)
        if longest > hot_len:  # one sequence must not be one task: long ones go segment-parallel
            hot = data.filter(F.col("n") > hot_len)
            if table:
                hot = table.resolve(hot, "v", placed=True).withColumn("v", F.flatten("v"))
            if vector:
                hot = hot.withColumn("x", _whole(width))
            segments = build_segments(hot, d, segment_len, keep=("member",)).persist(StorageLevel.MEMORY_AND_DISK)
            n_segments = segments.count()
            data_short = data.filter(F.col("n") <= hot_len)
        else:
            data_short = data
        own, masks, scale, fits, models = [], [], [], {}, [None] * len(specs)
        for i, s in enumerate(specs):
            if s.group not in stats:
                raise ValueError(f"row group {s.group} has no training rows")
            v = stats[s.group]
            seen, trans = v[2:2 + K] > 0, v[2 + K:2 + K + K * K].reshape(K, K)
            lab = tuple(x for x, k in zip(labels, seen) if k)
            observed = {(labels[a], labels[b]) for a, b in zip(*np.nonzero(trans))}
            mask = transition_mask(s.transitions, lab, observed)
            size, k = s.P.shape[1], len(lab)
            own.append(lab)
            masks.append(mask)
            sv = np.ones(size * k + k * k)
            if precondition:
                moments = v[2 + K + K * K:].reshape(d, d)
                rms = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", s.P, moments, s.P), 0.0) / v[1])
                sv[:size * k] = np.repeat(np.where(rms > 0, rms, 1.0), k)
            scale.append(sv)
            if k == 1:
                models[i] = CRFModel(s.feature_names, lab, np.zeros((size, 1)), np.zeros((1, 1)), mask, s.c2,
                                     s.transitions, dict(s.toggles), {"iterations": 0})
            else:
                free = np.concatenate([np.ones(size * k, bool), mask.ravel()])
                fits[i] = lbfgs.steps(np.zeros(len(sv)), max_iter=s.max_iter, free=free)
        passes = [0]

        def weights(i, w):
            s, k = specs[i], len(own[i])
            at = s.P.shape[1] * k
            return w[:at].reshape(-1, k), w[at:].reshape(k, k) * masks[i]

        def evaluate(asked):
            passes[0] += 1
            run = []
            for i, v in asked.items():
                W, A = weights(i, v / scale[i])
                run.append((i, specs[i].group, specs[i].P @ W, A, own[i]))
            got = _sums(data_short.mapInArrow(make_fused_step(run, d, width, table), SUM_SCHEMA), spread)
            out = {}
            for i, group, W, A, lab in run:
                v = got.get(i, np.zeros(2 + W.size + A.size))
                loss, gW, gA = v[0], v[2:2 + W.size].reshape(W.shape), v[2 + W.size:]
                if segments is not None:
                    obj = CRFObjective(data_short, d, len(lab), 0.0, np.ones_like(A, bool), lab,
                                       segments.filter((F.shiftright("member", group).bitwiseAND(F.lit(1))) > 0),
                                       n_segments, spread)
                    more, g = obj.segment_term(np.concatenate([W.ravel(), A.ravel()]))
                    loss, gW, gA = loss + more, gW + g[:W.size].reshape(W.shape), gA + g[W.size:]
                w = np.concatenate([x.ravel() for x in weights(i, asked[i] / scale[i])])
                free = np.concatenate([np.ones(specs[i].P.shape[1] * len(lab), bool), masks[i].ravel()])
                grad = np.concatenate([(specs[i].P.T @ gW).ravel(), gA]) + 2.0 * specs[i].c2 * w
                out[i] = (float(loss) + specs[i].c2 * float(w @ w), np.where(free, grad, 0.0) / scale[i])
            return out

        done = lbfgs.minimize_together(evaluate, fits)
    finally:
        if not kept:
            data.unpersist()
        if segments is not None:
            segments.unpersist()
    for i, res in done.items():
        W, A = weights(i, res.w / scale[i])
        s = specs[i]
        models[i] = CRFModel(s.feature_names, own[i], W, A, masks[i], s.c2, s.transitions, dict(s.toggles),
                             {"iterations": res.iterations, "evaluations": res.evaluations, "objective": res.f,
                              "stop": res.converged, "passes": passes[0]})
    return models


def _whole(width: int) -> Column:
    """``x`` and the vectors in ``v`` as one row-major array over the common attributes."""
    zeros = F.array_repeat(F.lit(0.0), width + 1)
    own = F.size("x") / F.col("n")
    return F.flatten(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(
        F.slice("x", (i * own).cast("int") + 1, own.cast("int")),
        F.when(F.col("v").isNull(), zeros).otherwise(F.concat(
            F.slice("v", i * width + 1, F.lit(width)).cast("array<double>"), F.array(F.lit(1.0)))))))


def make_fused_decoder(models: list[tuple], d: int, keep: tuple, width: int = 0, table: VectorTable | None = None):
    """Batches -> the kept columns and ``y_preds``: per model, whether its best path has label 1."""
    def run(batches):
        import pyarrow as pa

        vecs = table and table.open()[2]
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = _lengths(batch)
            out = np.zeros((batch.num_rows, len(models)), dtype=np.int32)
            rows = _Rows(batch, lengths, width, vecs)
            for idx in chunks(lengths, STEP_CELLS):
                if lengths[idx].max() == 0:
                    continue
                s, M = rows.sentences(lengths, idx)
                for j, (W, A, labels) in enumerate(models):
                    E = np.zeros((*M.shape, W.shape[1]))
                    E[M] = rows.times(s, W)
                    path = np.asarray(labels, dtype=np.int64)[viterbi(E, M, np.eye(W.shape[1]), A)]
                    out[idx, j] = ((path == 1) & M).any(axis=1)
            preds = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), len(models)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], preds], names=[*keep, "y_preds"])
    return run


def predict_together(rows: DataFrame, models: list[CRFModel], specs: list[Spec], keep: tuple, width: int = 0,
                     table: VectorTable | None = None) -> DataFrame:
    """H2 and B20 for every model in one pass over rows ``(*keep, n, x)`` and, with ``width`` numbers a vector, ``v``:
    ``(*keep, model, y_pred)``."""
    fields = [f for f in rows.schema.fields if f.name in keep]
    names = tuple(f.name for f in fields)
    schema = T.StructType([*fields, T.StructField("y_preds", T.ArrayType(T.IntegerType()))])
    run = [(s.P @ m.W, m.A * m.trans_mask, m.labels) for s, m in zip(specs, models)]
    d, vector = specs[0].P.shape[0], ["v"] if width else []
    scored = rows.select(*names, "n", "x", *vector).mapInArrow(make_fused_decoder(run, d, names, width, table), schema)
    return scored.select(*names, F.posexplode("y_preds").alias("model", "y_pred"))
