"""Linear-chain CRF as Spark jobs (H1-H4).

* Sequences: one row per article ``(article_id, n, x, y)`` with ``x`` the
  row-major ``n*d`` feature values, built row-locally from the feature
  arrays (no shuffle).
* Fit (H1): L-BFGS on the driver over ~10^2 weights; every function
  evaluation is one ``mapInArrow`` pass over the persisted sequences
  returning one ``(loss, grad)`` row per partition. Articles never reach
  the driver; lineage does not grow across rounds (same cached plan).
* Decode (H2): Viterbi as one Catalyst ``aggregate`` over the emission
  array (no Python), or the vectorised numpy kernel through ``mapInArrow``
  for very long articles.
* Emissions (H4): a linear expression over the feature struct per sentence.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fit_state, lbfgs
from .sentences import checked_length
from .crf_kernels import (make_gradient_step, make_max_transfer_step, make_message_scan,
                          make_segment_decode_step, make_segment_step, make_sequence_scorer,
                          make_transfer_step, make_viterbi_scan)
from .vector_sums import block_rows, collected, merged_blocks

# fixed values of the reference's sequence model
DEFAULT_C2 = 0.01
DEFAULT_MAX_ITER = 50

COLLECT_MAX_PARTITIONS = 256
HOT_SEQUENCE_LEN = 50_000      # longer sequences are trained segment-parallel
SEGMENT_LEN = 8_192            # sentences per segment
MESSAGE_BROADCAST_MAX = 1_000_000  # segments whose messages may be broadcast
STEP_SCHEMA = "loss double, grad array<double>, nseq bigint"


@dataclass
class CRFModel:
    feature_names: tuple            # d attribute names (named features, then emb0..)
    labels: tuple                   # K label values, sorted
    W: np.ndarray                   # (d, K) state weights
    A: np.ndarray                   # (K, K) transition weights
    trans_mask: np.ndarray          # (K, K) bool: transition has a weight
    c2: float = DEFAULT_C2
    transitions: str = "all"
    toggles: dict = field(default_factory=dict)   # use_lexicons / use_vectors (X3)
    info: dict = field(default_factory=dict)

    @property
    def d(self) -> int:
        return len(self.feature_names)

    @property
    def K(self) -> int:
        return len(self.labels)

    # ---------------------------------------------------------------- save/load
    def to_rows(self) -> list[tuple]:
        rows = [("state", n, None, int(lab), float(self.W[j, k]))
                for j, n in enumerate(self.feature_names) for k, lab in enumerate(self.labels)]
        rows += [("trans", None, int(a), int(b), float(self.A[i, j]))
                 for i, a in enumerate(self.labels) for j, b in enumerate(self.labels)
                 if self.trans_mask[i, j]]
        params = {"feature_names": list(self.feature_names), "labels": list(self.labels),
                  "c2": self.c2, "transitions": self.transitions, "toggles": self.toggles,
                  "trans_mask": self.trans_mask.astype(int).tolist(), "info": self.info}
        rows.append(("params", json.dumps(params), None, None, None))
        return rows

    def save(self, spark: SparkSession, path: str) -> None:
        schema = "kind string, name string, label_from int, label_to int, weight double"
        spark.createDataFrame(self.to_rows(), schema).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CRFModel:
        rows = spark.read.parquet(path).collect()  # ~10^2 rows: the model itself
        params = json.loads(next(r.name for r in rows if r.kind == "params"))
        names, labels = tuple(params["feature_names"]), tuple(params["labels"])
        li = {lab: i for i, lab in enumerate(labels)}
        fi = {n: j for j, n in enumerate(names)}
        W = np.zeros((len(names), len(labels)))
        A = np.zeros((len(labels), len(labels)))
        for r in rows:
            if r.kind == "state":
                W[fi[r.name], li[r.label_to]] = r.weight
            elif r.kind == "trans":
                A[li[r.label_from], li[r.label_to]] = r.weight
        return cls(names, labels, W, A, np.array(params["trans_mask"], dtype=bool),
                   params["c2"], params["transitions"], params["toggles"], params["info"])

    def weights_frame(self, spark: SparkSession) -> DataFrame:
        schema = "kind string, name string, label_from int, label_to int, weight double"
        return spark.createDataFrame([r for r in self.to_rows() if r[0] != "params"], schema)


# --------------------------------------------------------------------- sequences
def sequences(articles: DataFrame, feature_names: tuple, feats: str = "feats",
              emb: str | None = None, labels: str = "sentence_labels") -> DataFrame:
    """``(article_id, n, x, y)`` per article; ``x`` row-major ``n*d``.

    ``emb`` (optional) is an ``array<array<double>>`` aligned with the
    sentences whose rows are appended to the named features.
    """
    # the sentence count equals size(feats) and is cheap: a filter on ``n``
    # that Catalyst pushes towards the scan does not re-run the features
    n = F.size("sentences") if "sentences" in articles.columns else F.size(feats)
    return articles.select("article_id", n.alias("n"), sequence_values(feature_names, feats, emb).alias("x"),
                           F.slice(labels, 1, checked_length(labels=labels) if "sentences" in articles.columns
                                   else n).alias("y"))


def sequence_values(feature_names: tuple, feats: str = "feats", emb: str | None = None) -> Column:
    """Row-major feature values of an article row."""
    plain = [n for n in feature_names if not n.startswith("emb")]
    named = lambda f: [f[n].cast("double") for n in plain]
    if emb is None:
        rows = F.transform(feats, lambda f: F.array(*named(f)))
    else:
        rows = F.transform(F.arrays_zip(F.col(feats).alias("f"), F.col(emb).alias("e")),
                           lambda z: F.concat(F.array(*named(z["f"])), z["e"]))
    return F.flatten(rows)


def transition_counts(df: DataFrame, y: str = "y", keys=()) -> DataFrame:
    """Adjacent label pairs counted, row-local pairs + partial aggregate."""
    n = F.size(y)
    pairs = F.arrays_zip(F.slice(y, 1, F.greatest(n - 1, F.lit(0))).alias("prev_label"),
                         F.slice(y, 2, F.greatest(n - 1, F.lit(0))).alias("label"))
    return (df.select(*keys, F.explode(pairs).alias("z"))  # length <= 1: no pairs
            .groupBy(*keys, F.col("z.prev_label").alias("prev_label"), F.col("z.label").alias("label"))
            .agg(F.count(F.lit(1)).alias("n")))


def transition_mask(policy: str, labels: tuple, observed: set | None = None) -> np.ndarray:
    """H3/X4: 'all' = every pair has a weight; 'observed' = pairs seen in
    training; 'none' = no transition weights at all."""
    K = len(labels)
    if policy == "all":
        return np.ones((K, K), dtype=bool)
    if policy == "none":
        return np.zeros((K, K), dtype=bool)
    if policy == "observed":
        m = np.zeros((K, K), dtype=bool)
        li = {lab: i for i, lab in enumerate(labels)}
        for a, b in observed or ():
            if a in li and b in li:
                m[li[a], li[b]] = True
        return m
    raise ValueError(f"unknown transitions policy {policy!r}")


def _label_index(labels: tuple, y: Column) -> Column:
    lit = F.array(*[F.lit(int(v)) for v in labels])
    at = lambda v: F.array_position(lit, v)
    return F.transform(y, lambda v: F.when(at(v) > 0, (at(v) - 1).cast("int")).otherwise(
        F.raise_error(F.lit("label unknown to the model")).cast("int")))


def _summed(parts: DataFrame) -> np.ndarray:
    """Loss (0), sequences (1) and gradient (from 2) summed over ``parts`` as packed blocks, in a tree."""
    def pack(batches):
        import pyarrow as pa

        for b in batches:
            for loss, grad, n in zip(b.column("loss").to_pylist(), b.column("grad"), b.column("nseq").to_pylist()):
                v = np.concatenate([[loss, n], grad.values.to_numpy()])
                yield block_rows({(): v}, {}, "<f8")
    return collected(merged_blocks(parts.mapInArrow(pack, "block int, blob binary")))


# --------------------------------------------------------------------------- fit
class CRFObjective:
    """Loss and gradient of the regularised negative log-likelihood."""

    def __init__(self, data: DataFrame, d: int, K: int, c2: float, mask: np.ndarray,
                 labels: tuple, segments: DataFrame | None = None, n_segments: int = 0,
                 partitions: int | None = None):
        self.data, self.d, self.K, self.c2, self.mask = data, d, K, c2, mask
        self.labels = labels
        self.segments, self.n_segments = segments, n_segments
        self.partitions = partitions or data.rdd.getNumPartitions()
        self.evaluations = 0

    def split(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d, K = self.d, self.K
        return w[:d * K].reshape(d, K), w[d * K:].reshape(K, K) * self.mask

    @staticmethod
    def _sum_rows(parts: DataFrame, partitions: int, size: int) -> tuple[float, np.ndarray, int]:
        """Sum the per-partition ``(loss, grad, nseq)`` rows: collected when
        there are few (one ~1 kB row each), else a grouped aggregate."""
        if partitions <= COLLECT_MAX_PARTITIONS:
            rows = parts.collect()
            loss = float(sum(r.loss for r in rows))
            grad = np.sum([np.asarray(r.grad) for r in rows], axis=0) if rows else np.zeros(size)
            return loss, grad, int(sum(r.nseq for r in rows))
        total = _summed(parts)
        total = np.zeros(size + 2) if total is None else total
        return float(total[0]), total[2:], int(total[1])

    def data_term(self, w: np.ndarray) -> tuple[float, np.ndarray, int]:
        W, A = self.split(w)
        parts = self.data.mapInArrow(make_gradient_step(W, A, self.labels), STEP_SCHEMA)
        self.evaluations += 1
        return self._sum_rows(parts, self.partitions, len(w))

    def segment_term(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Loss and gradient of the hot sequences, segment-parallel: transfer
        matrices per segment, a message scan per sequence over those K x K
        matrices, then each segment's exact share."""
        W, A = self.split(w)
        msg_schema = "article_id string, seg int, alpha_in array<double>, beta_out array<double>, logz double"
        trans = self.segments.mapInArrow(make_transfer_step(W, A, self.labels),
                                         "article_id string, seg int, L array<double>")
        msgs = trans.groupBy("article_id").applyInPandas(make_message_scan(self.K), msg_schema)
        if self.n_segments <= MESSAGE_BROADCAST_MAX:  # counted when the segments were built
            msgs = F.broadcast(msgs)
        joined = self.segments.join(msgs, ["article_id", "seg"])
        parts = joined.mapInArrow(make_segment_step(W, A, self.labels), STEP_SCHEMA)
        loss, grad, _ = self._sum_rows(parts, self.segments.rdd.getNumPartitions(), len(w))
        return loss, grad

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, grad, _ = self.data_term(w)
        if self.segments is not None:
            seg_loss, seg_grad = self.segment_term(w)
            loss, grad = loss + seg_loss, grad + seg_grad
        free = self.free_vector()
        wf = np.where(free, w, 0.0)
        loss += self.c2 * float(wf @ wf)
        grad = grad + 2.0 * self.c2 * wf
        return loss, np.where(free, grad, 0.0)

    def free_vector(self) -> np.ndarray:
        return np.concatenate([np.ones(self.d * self.K, dtype=bool), self.mask.ravel()])


def prepare_training_data(seqs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Training rows ``(article_id, n, x, y)``, spread once over the cluster's cores
    (or ``partitions``) before they are persisted: each round then runs one
    Python task per core, however many splits the input has."""
    data = seqs.filter(F.col("n") > 0).select("article_id", "n", "x", "y")
    return data.repartition(training_partitions(data.sparkSession, partitions))


def training_partitions(spark: SparkSession, partitions: int | None = None) -> int:
    return partitions or spark.sparkContext.defaultParallelism


def build_segments(hot: DataFrame, d: int, segment_len: int = SEGMENT_LEN, keep: tuple = ()) -> DataFrame:
    """Cut long sequences into segments ``(article_id, seg, n, x, y, y_prev, *keep)``
    and spread the segments over tasks by (article_id, seg)."""
    S = segment_len
    with_y = "y" in hot.columns
    n_seg = F.ceil(F.col("n") / F.lit(S)).cast("int")
    rows = hot.select("article_id", "n", "x", *(["y"] if with_y else []), *keep,
                      F.explode(F.sequence(F.lit(0), n_seg - 1)).alias("seg"))
    start = F.col("seg") * S
    length = F.least(F.lit(S), F.col("n") - start)
    labels = ([F.slice("y", start + 1, length).alias("y"),
               F.when(F.col("seg") > 0, F.element_at("y", start)).alias("y_prev")] if with_y else [])
    return (rows.select(
        "article_id", F.col("seg").cast("int").alias("seg"), length.cast("int").alias("n"),
        F.slice("x", start * d + 1, length * d).alias("x"), *labels, *keep)
        .repartition("article_id", "seg"))


def observed_labels(seqs: DataFrame) -> tuple:
    """Distinct training labels (bounded by the label vocabulary)."""
    return tuple(sorted(int(r[0]) for r in
                        seqs.select(F.explode("y")).distinct().collect() if r[0] is not None))


def feature_rms(data: DataFrame, d: int) -> np.ndarray:
    """Root mean square of every feature over all training sentences
    (partial aggregate over d keys; zeros become 1)."""
    rows = (data.select(F.posexplode("x").alias("i", "v"))
            .groupBy(F.pmod("i", F.lit(d)).alias("j"))
            .agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("r")).collect())
    scale = np.ones(d)
    for r in rows:
        if r.r is not None and r.r > 0:
            scale[r.j] = r.r
    return scale


def fit(seqs: DataFrame, feature_names: tuple, transitions: str = "all",
        c2: float = DEFAULT_C2, max_iter: int = DEFAULT_MAX_ITER,
        partitions: int | None = None, toggles: dict | None = None,
        hot_len: int = HOT_SEQUENCE_LEN, segment_len: int = SEGMENT_LEN,
        precondition: bool = True, state_path: str | None = None, state_every: int = 10) -> CRFModel:
    """H1: fit weights on ``sequences(...)`` rows of the training split.

    The training rows are persisted first; the label set and observed
    transitions are then read from the cache (no extra feature passes).
    ``precondition``: L-BFGS runs in coordinates scaled by each feature's RMS
    (raw positions and lengths are in the hundreds, which makes the problem
    badly conditioned). The objective and its minimiser are unchanged; within
    the same rounds it gets much closer to the optimum with fewer distributed
    evaluations.
    ``state_path``: a table in the shared folder to which the optimiser's state is appended every
    ``state_every`` rounds; the same call over the same rows goes on from the latest state there."""
    data = prepare_training_data(seqs, partitions).persist(StorageLevel.MEMORY_AND_DISK)
    cached, segments = data, None
    try:
        labels = observed_labels(data)
        if not labels:
            raise ValueError("no training labels")
        K, d = len(labels), len(feature_names)
        observed = None
        if transitions == "observed":
            observed = {(r.prev_label, r.label) for r in transition_counts(data).collect()}
        mask = transition_mask(transitions, labels, observed)
        if K == 1:
            return CRFModel(tuple(feature_names), labels, np.zeros((d, 1)), np.zeros((1, 1)),
                            mask, c2, transitions, dict(toggles or {}), {"iterations": 0})
        n_segments = 0
        hot = data.filter(F.col("n") > hot_len)
        if hot.limit(1).count():
            # one sequence must not be one task: long ones go segment-parallel
            segments = build_segments(hot, d, segment_len).persist(StorageLevel.MEMORY_AND_DISK)
            n_segments = segments.count()
            data = data.filter(F.col("n") <= hot_len)
        obj = CRFObjective(data, d, K, c2, mask, labels, segments, n_segments,
                           training_partitions(data.sparkSession, partitions))
        sv = np.ones(d * K + K * K)
        if precondition:
            sv[:d * K] = np.repeat(feature_rms(cached, d), K)  # W is (d, K) row-major

        def scaled(v):
            f, g = obj(v / sv)
            return f, g / sv

        resume = each_round = None
        if state_path:
            spark = data.sparkSession
            key = fit_state.fit_key(sv, feature_names, labels, mask.tolist(), c2, transitions)
            resume = fit_state.load_state(spark, state_path, key, max_iter)

            def each_round(state):
                if state.iterations % state_every == 0:
                    fit_state.save_state(spark, state_path, key, state)

        res = lbfgs.minimize(scaled, np.zeros(d * K + K * K), max_iter=max_iter, free=obj.free_vector(),
                             resume=resume, each_round=each_round)
        res.w = res.w / sv
        W, A = obj.split(res.w)
    finally:
        cached.unpersist()
        if segments is not None:
            segments.unpersist()
    info = {"iterations": res.iterations, "evaluations": res.evaluations,
            "objective": res.f, "stop": res.converged}
    return CRFModel(tuple(feature_names), labels, W, A, mask, c2, transitions,
                    dict(toggles or {}), info)


def gradient_rows(seqs: DataFrame, model: CRFModel) -> DataFrame:
    """One distributed evaluation of the data term at the model's weights,
    as ``(param, value)`` rows (loss first). Used to check H1 numerically."""
    data = prepare_training_data(seqs)
    W, A = model.W, model.A * model.trans_mask
    parts = data.mapInArrow(make_gradient_step(W, A, model.labels), STEP_SCHEMA)
    names = [f"{n}|{lab}" for n in model.feature_names for lab in model.labels]
    names += [f"trans|{a}|{b}" for a in model.labels for b in model.labels]
    name_map = F.array(*[F.lit(n) for n in ["loss", *names]])
    row = F.concat(F.array("loss"), "grad")
    total = parts.select(F.posexplode(row).alias("i", "value")).groupBy("i").agg(F.sum("value").alias("value"))
    return total.select(F.element_at(name_map, F.col("i") + 1).alias("param"), "value")


# ------------------------------------------------------------------------ decode
def emissions(feats: Column, model: CRFModel, emb: Column | None = None) -> Column:
    """H4: per sentence ``array<double>`` of K label scores ``W[:,k] . x``."""
    names = [n for n in model.feature_names if not n.startswith("emb")]
    n_named = len(names)
    Wn, We = model.W[:n_named], model.W[n_named:]

    def score(f, e, k):
        s = F.lit(0.0)
        for j, n in enumerate(names):
            s = s + F.lit(float(Wn[j, k])) * f[n]
        if e is not None and We.shape[0]:
            w = F.array(*[F.lit(float(v)) for v in We[:, k]])
            s = s + F.aggregate(F.zip_with(e, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        return s

    if emb is None:
        return F.transform(feats, lambda f: F.array(*[score(f, None, k) for k in range(model.K)]))
    return F.transform(F.arrays_zip(feats.alias("f"), emb.alias("e")),
                       lambda z: F.array(*[score(z["f"], z["e"], k) for k in range(model.K)]))


def viterbi_indices(emis: Column, A: np.ndarray) -> Column:
    """H2 in Catalyst for K = 2: best label-index path; ties go to index 0."""
    a = [[F.lit(float(A[i, j])) for j in range(2)] for i in range(2)]
    first = F.try_element_at(emis, F.lit(1))
    init = F.struct(first[0].alias("s0"), first[1].alias("s1"),
                    F.array(F.lit(0)).alias("p0"), F.array(F.lit(1)).alias("p1"))

    def merge(acc, e):
        c00, c10 = acc["s0"] + a[0][0], acc["s1"] + a[1][0]
        c01, c11 = acc["s0"] + a[0][1], acc["s1"] + a[1][1]
        return F.struct(
            (F.greatest(c00, c10) + e[0]).alias("s0"),
            (F.greatest(c01, c11) + e[1]).alias("s1"),
            F.concat(F.when(c00 >= c10, acc["p0"]).otherwise(acc["p1"]), F.array(F.lit(0))).alias("p0"),
            F.concat(F.when(c01 >= c11, acc["p0"]).otherwise(acc["p1"]), F.array(F.lit(1))).alias("p1"))

    path = F.aggregate(F.slice(emis, 2, F.greatest(F.size(emis) - 1, F.lit(0))), init, merge,
                       lambda acc: F.when(acc["s0"] >= acc["s1"], acc["p0"]).otherwise(acc["p1"]))
    return F.when(F.size(emis) == 0, F.array().cast("array<int>")).otherwise(path)


def decode(feats: Column, model: CRFModel, emb: Column | None = None) -> Column:
    """Predicted label sequence (label values) for an article row."""
    if model.K == 1:
        return F.transform(feats, lambda f: F.lit(int(model.labels[0])))
    if model.K != 2:
        raise ValueError("Catalyst decoder handles two labels; use decode_in_arrow")
    idx = viterbi_indices(emissions(feats, model, emb), model.A * model.trans_mask)
    lab = F.array(*[F.lit(int(v)) for v in model.labels])
    return F.transform(idx, lambda i: F.element_at(lab, i + 1))


def decode_in_arrow(seqs: DataFrame, model: CRFModel) -> DataFrame:
    """H2 through the numpy kernel: ``(article_id, path array<int>)`` in label values."""
    run = make_sequence_scorer(model.W, model.A * model.trans_mask, "viterbi")
    out = seqs.select("article_id", "n", "x").mapInArrow(run, "article_id string, path array<int>")
    lab = F.array(*[F.lit(int(v)) for v in model.labels])
    return out.select("article_id", F.transform("path", lambda i: F.element_at(lab, i + 1)).alias("path"))


def decode_rows(fa: DataFrame, model: CRFModel, emb: str | None = None, out: str = "pred") -> DataFrame:
    """H2 on featurised article rows in one pass: all columns but the features pass
    through the numpy kernel, which adds the path in label values as ``out``.

    Linear in the article's length and the same for every length and number of
    labels, so nothing is split off, joined back or scanned twice."""
    keep = [f for f in fa.schema.fields if f.name not in ("feats", "emb")]
    names = [f.name for f in keep]
    staged = fa.select(*names, F.size("feats").alias("_n"), sequence_values(model.feature_names, emb=emb).alias("_x"))
    run = make_sequence_scorer(model.W, model.A * model.trans_mask, "viterbi", tuple(names), "_n", "_x")
    schema = T.StructType([*keep, T.StructField("path", T.ArrayType(T.IntegerType()))])
    lab = F.array(*[F.lit(int(v)) for v in model.labels])
    return staged.mapInArrow(run, schema).select(
        *names, F.transform("path", lambda i: F.element_at(lab, i + 1)).alias(out))


def decode_segmented(seqs: DataFrame, model: CRFModel, segment_len: int = SEGMENT_LEN) -> DataFrame:
    """H2 for very long articles, segment-parallel: max-plus transfer matrix
    per segment, a per-article scan fixing the best label at every segment
    boundary, then each segment decodes between its fixed labels. Same path
    as whole-sequence Viterbi. Returns ``(article_id, path)`` in label values."""
    W, A = model.W, model.A * model.trans_mask
    segs = build_segments(seqs.filter(F.col("n") > 0).select("article_id", "n", "x"),
                          model.d, segment_len)
    trans = segs.mapInArrow(make_max_transfer_step(W, A), "article_id string, seg int, V array<double>")
    plan = trans.groupBy("article_id").applyInPandas(
        make_viterbi_scan(model.K), "article_id string, seg int, enter int, end int")
    parts = segs.join(plan, ["article_id", "seg"]).mapInArrow(
        make_segment_decode_step(W, A), "article_id string, seg int, path array<int>")
    lab = F.array(*[F.lit(int(v)) for v in model.labels])
    whole = (parts.groupBy("article_id")
             .agg(F.sort_array(F.collect_list(F.struct("seg", "path"))).alias("_p")))
    return whole.select("article_id", F.transform(F.flatten(F.transform("_p", lambda p: p["path"])),
                                                  lambda i: F.element_at(lab, i + 1)).alias("path"))


def sequence_nll(seqs: DataFrame, model: CRFModel) -> DataFrame:
    """Negative log-likelihood per article at the model's weights."""
    run = make_sequence_scorer(model.W, model.A * model.trans_mask, "nll")
    data = seqs.select("article_id", "n", "x", _label_index(model.labels, F.col("y")).alias("yi"))
    return data.mapInArrow(run, "article_id string, nll double")


def fixed_model(feature_names: tuple, state: dict, trans: list, labels=(0, 1)) -> CRFModel:
    """A model with given weights (``state[name] = (w_label0, w_label1)``)."""
    W = np.array([state.get(n, (0.0, 0.0)) for n in feature_names], dtype=float)
    A = np.array(trans, dtype=float)
    return CRFModel(tuple(feature_names), tuple(labels), W, A, np.ones_like(A, dtype=bool))

