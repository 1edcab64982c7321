"""Linear-chain CRF over open, sparse attributes.

A sentence carries any number of named attributes with values; no list of names is
given beforehand. Names are counted and those frequent enough form the dictionary; an article becomes one
row in CSR form. An evaluation is one pass over these rows; a partition sends only the rows of the
gradient that it touched, as blocks of (index, value), which are merged in a tree.

Names are told apart by a 64-bit hash. The dictionary's hashes (8 bytes an attribute) are all that executors
look names up in; that no other name of the corpus shares one of them is checked on the counted names, else
another seed is taken.

An article is read whole by one task, however long it is.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import written
from . import lbfgs
from .crf import (DEFAULT_C2, DEFAULT_MAX_ITER, observed_labels, training_partitions, transition_counts,
                  transition_mask)
from .crf_sparse_kernels import (BLOCK, add_block, chained, make_block_merger, make_block_rows, make_encoder,
                                 make_sparse_decoder, make_sparse_step, make_squares_step)
from .sentences import checked_length
from .vector_sums import DIRECT, LANES

MAX_ATTRIBUTES = 1 << 20   # most attributes of a dictionary
PART_SCHEMA = "block int, idx binary, val binary"


# -------------------------------------------------------------------- dictionary
@dataclass
class AttributeDictionary:
    """``table`` (id, name, n) and the sorted hashes; an attribute's id is its hash's rank."""

    table: DataFrame
    hashes: np.ndarray
    seed: int

    @property
    def d(self) -> int:
        return len(self.hashes)


def _hash(name: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), name)


def attribute_dictionary(articles: DataFrame, attrs: str = "attrs", min_count: int = 1,
                         max_attributes: int = MAX_ATTRIBUTES) -> AttributeDictionary:
    """Attributes that occur at least ``min_count`` times and make up at least one in ``max_attributes`` of
    all occurrences, so there are ``max_attributes`` at most whatever the corpus. ``attrs`` holds an array of names
    for each sentence. Null names don't count.

    Counts combine in each task before they are shuffled; the counted names are written once."""
    spark = articles.sparkSession
    names = articles.select(F.explode(F.flatten(attrs)).alias("name")).where(F.col("name").isNotNull())
    counts = written(names.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "attribute_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(min_count, -(-total // max_attributes))
    for seed in range(16):
        hashed = counts.withColumn("hash", _hash(F.col("name"), seed))
        shared = (hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("names"), F.max("n").alias("most"))
                  .where((F.col("names") > 1) & (F.col("most") >= least)))
        if shared.isEmpty():
            break
    else:
        raise ValueError("no seed tells the attribute names apart")
    kept = hashed.where(F.col("n") >= least)
    got = kept.select("hash").toArrow().column("hash").to_numpy()  # 8 bytes an attribute, at most max_attributes
    hashes = np.sort(np.asarray(got, dtype=np.int64))
    ids = spark.createDataFrame(_arrow(hash=hashes, id=np.arange(len(hashes), dtype=np.int32)))
    return AttributeDictionary(kept.join(ids, "hash").select("id", "name", "n"), hashes, seed)


def _arrow(**columns):
    import pyarrow as pa
    return pa.table(columns)


def token_attributes(tokens: Column) -> Column:
    """Names for each sentence: ``w=`` and a token of its own, ``p=`` and a token of the sentence before.

    ``tokens``: an array of tokens for each sentence."""
    before = F.slice(F.concat(F.array(F.array().cast("array<string>")), tokens), 1, F.size(tokens))
    return F.zip_with(tokens, before, lambda own, old: F.concat(
        F.transform(own, lambda t: F.concat(F.lit("w="), t)), F.transform(old, lambda t: F.concat(F.lit("p="), t))))


def attribute_maps(maps: Column) -> tuple[Column, Column]:
    """Names and values of sentences that carry a map name -> value each."""
    return (F.transform(maps, lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))),
            F.transform(maps, lambda m: F.coalesce(F.map_values(m), F.array().cast("array<double>"))))


def _staged(articles: DataFrame, dictionary: AttributeDictionary, attrs: str, values: str | None, labels: str | None,
            keep) -> tuple[DataFrame, list]:
    """What the encoder reads, and its columns that pass through."""
    empty = F.array().cast("array<string>")
    given = F.coalesce(F.col(attrs), F.transform("sentences", lambda s: empty), F.array().cast("array<array<string>>"))
    lists = F.transform(given, lambda s: F.coalesce(s, empty))
    fits = F.size(lists) == F.coalesce(F.size("sentences"), F.lit(0))
    sizes = F.when(fits, F.transform(lists, lambda s: F.size(s))).otherwise(
        F.raise_error(F.lit("one array of attributes is needed for each sentence")).cast("array<int>"))
    hashed = F.flatten(F.transform(lists, lambda s: F.transform(F.filter(s, lambda a: a.isNotNull()),
                                                                lambda a: _hash(a, dictionary.seed))))
    known = F.transform(lists, lambda s: F.size(F.filter(s, lambda a: a.isNotNull())))
    extra = []
    if values is not None:
        pairs = F.transform(F.arrays_zip(lists.alias("a"), F.col(values).alias("v")), lambda z: F.filter(
            F.transform(z["a"], lambda a, i: F.struct(a.alias("a"), F.coalesce(F.get(z["v"], i), F.lit(0.0)).alias("v"))),
            lambda p: p["a"].isNotNull()))
        extra = [F.transform(F.flatten(pairs), lambda p: p["v"]).alias("vals")]
    y = [F.slice(labels, 1, checked_length(labels=labels)).alias("y")] if labels else []
    staged = articles.select(*keep, *y, hashed.alias("names"), *extra,
                             F.when(F.size(sizes) >= 0, known).alias("m"))
    return staged, [*keep, *(["y"] if labels else [])]


def sparse_sequences(articles: DataFrame, dictionary: AttributeDictionary, attrs: str = "attrs",
                     values: str | None = None, labels: str | None = "sentence_labels", keep=("article_id",)) -> DataFrame:
    """CSR rows (*keep, y, m, idx and, with ``values``, val). ``values`` (aligned with ``attrs``) are 1 if not given;
    null names are absent, null values 0, names outside the dictionary have no weight, a name that a sentence has twice
    counts with the sum of its values. A null array of a sentence is an empty one, a null ``attrs`` has one for each
    sentence. An article with more or fewer arrays than sentences fails the job."""
    staged, columns = _staged(articles, dictionary, attrs, values, labels, keep)
    schema = T.StructType([*[staged.schema[c] for c in columns], T.StructField("m", T.ArrayType(T.IntegerType())),
                           T.StructField("idx", T.ArrayType(T.IntegerType())),
                           *([T.StructField("val", T.ArrayType(T.DoubleType()))] if values else [])])
    return staged.mapInArrow(make_encoder(dictionary.hashes, tuple(columns)), schema)


# -------------------------------------------------------------------------- sums
def merged_sparse(parts: DataFrame, width: int, lanes: int = LANES) -> DataFrame:
    """Add up partitions' (index, value) blocks in a tree of two levels; a task holds one block."""
    def level(df, by):
        kinds = ", ".join(f"`{c}` int" for c in by)
        spread = df.select(*by, "idx", "val").repartition(*by).sortWithinPartitions(*by)
        return spread.mapInArrow(make_block_merger(tuple(by), width), f"{kinds}, idx binary, val binary")

    first = parts.withColumn("_lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
    return level(level(first, ("block", "_lane")), ("block",))


def _summed(parts: DataFrame, partitions: int, d: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(head, dense d x width sum); few bytes are added on the driver, more are merged on executors first."""
    if partitions * d * (4 + 8 * width) > DIRECT:
        parts = merged_sparse(parts, width)
    total, head = np.zeros((-(-d // BLOCK) * BLOCK, width)), 0.0
    for r in parts.select("block", "idx", "val").collect():
        if r.block < 0:
            head = head + np.frombuffer(bytes(r.val), "<f8")
        else:
            add_block(total[r.block * BLOCK:(r.block + 1) * BLOCK], bytes(r.idx), bytes(r.val), width)
    return head, total[:d]


# --------------------------------------------------------------------------- fit
@dataclass
class SparseCRF:
    dictionary: AttributeDictionary
    labels: tuple
    W: np.ndarray
    A: np.ndarray
    trans_mask: np.ndarray
    c2: float = DEFAULT_C2
    transitions: str = "all"
    info: dict = field(default_factory=dict)

    def weights_frame(self, spark: SparkSession) -> DataFrame:
        """(kind, name, label_from, label_to, weight): names come from the dictionary by a join."""
        d, K = self.W.shape
        lab = np.asarray(self.labels, dtype=np.int32)
        rows = spark.createDataFrame(_arrow(id=np.repeat(np.arange(d, dtype=np.int32), K), label_to=np.tile(lab, d),
                                            weight=self.W.ravel()))
        state = rows.join(self.dictionary.table, "id").select(
            F.lit("state").alias("kind"), "name", F.lit(None).cast("int").alias("label_from"), "label_to", "weight")
        trans = [("trans", None, int(a), int(b), float(self.A[i, j])) for i, a in enumerate(self.labels)
                 for j, b in enumerate(self.labels) if self.trans_mask[i, j]]
        return state.unionByName(spark.createDataFrame(trans, state.schema))

    def save(self, spark: SparkSession, path: str) -> None:
        """Two tables under ``path``: weights with their names, and one row of parameters."""
        self.weights_frame(spark).write.mode("overwrite").parquet(f"{path}/weights")
        params = json.dumps({"labels": list(self.labels), "c2": self.c2, "transitions": self.transitions,
                             "trans_mask": self.trans_mask.astype(int).tolist(), "info": self.info,
                             "seed": self.dictionary.seed})
        self.dictionary.table.write.mode("overwrite").parquet(f"{path}/dictionary")
        spark.createDataFrame([(params,)], "params string").write.mode("overwrite").parquet(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SparseCRF:
        p = json.loads(spark.read.parquet(f"{path}/params").first().params)
        labels = tuple(p["labels"])
        at = {v: k for k, v in enumerate(labels)}
        K = len(labels)
        table = spark.read.parquet(f"{path}/dictionary")
        hashes = np.sort(table.select(_hash(F.col("name"), p["seed"]).alias("h")).toArrow().column("h").to_numpy())
        rows = spark.read.parquet(f"{path}/weights")
        W, A = np.zeros((len(hashes), K)), np.zeros((K, K))
        state = rows.where("kind = 'state'").join(table.select("name", "id"), "name").select(
            "id", "label_to", "weight").toArrow()
        W[state["id"].to_numpy(), np.searchsorted(np.asarray(labels), state["label_to"].to_numpy())] = \
            state["weight"].to_numpy()
        for r in rows.where("kind = 'trans'").collect():
            A[at[r.label_from], at[r.label_to]] = r.weight
        return cls(AttributeDictionary(table, hashes, p["seed"]), labels, W, A, np.array(p["trans_mask"], dtype=bool),
                   p["c2"], p["transitions"], p["info"])


def gradient_rows(articles: DataFrame, model: SparseCRF, attrs: str = "attrs", values: str | None = None,
                  labels: str = "sentence_labels") -> DataFrame:
    """One evaluation of the data term over articles at the model's weights as rows (param, value): the loss, every
    attribute of the dictionary by label, every transition. Nothing but the head reaches the driver."""
    spark, K = articles.sparkSession, len(model.labels)
    staged, columns = _staged(articles, model.dictionary, attrs, values, labels, ())
    step = make_sparse_step(model.W, model.A * model.trans_mask, model.labels)
    parts = staged.mapInArrow(chained(make_encoder(model.dictionary.hashes, tuple(columns)), step), PART_SCHEMA)
    merged = written(merged_sparse(parts, K), "sparse_gradient")
    head = np.frombuffer(bytes(merged.where("block < 0").first().val), "<f8")
    lab = F.array(*[F.lit(int(v)) for v in model.labels])
    every = model.dictionary.table.select("id", "name", F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("k"))
    values = merged.mapInArrow(make_block_rows(K), "id int, k int, value double")
    state = every.join(values, ["id", "k"], "left").select(
        F.concat("name", F.lit("|"), F.element_at(lab, F.col("k") + 1)).alias("param"),
        F.coalesce("value", F.lit(0.0)).alias("value"))
    rest = [("loss", float(head[0]))] + [
        (f"trans|{a}|{b}", float(head[2 + i * K + j])) for i, a in enumerate(model.labels)
        for j, b in enumerate(model.labels)]
    return state.unionByName(spark.createDataFrame(rest, "param string, value double"))


def zero_model(dictionary: AttributeDictionary, labels=(0, 1)) -> SparseCRF:
    K = len(labels)
    return SparseCRF(dictionary, tuple(labels), np.zeros((dictionary.d, K)), np.zeros((K, K)), np.ones((K, K), dtype=bool))


def fit_sparse(seqs: DataFrame, dictionary: AttributeDictionary, transitions: str = "all", c2: float = DEFAULT_C2,
               max_iter: int = DEFAULT_MAX_ITER, partitions: int | None = None) -> SparseCRF:
    """H1 on ``sparse_sequences`` rows of the training split: the objective of ``crf.fit``.

    The optimiser's vectors (``d * K`` numbers, ``d`` at most the dictionary's bound) are on the driver. Its
    coordinates are scaled by the curvature that an attribute's mean square and the penalty give, since
    attributes differ in frequency by orders of magnitude."""
    spark = seqs.sparkSession
    tasks = training_partitions(spark, partitions)
    data = seqs.where(F.size("m") > 0).repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        labels = observed_labels(data)
        if not labels:
            raise ValueError("no training labels")
        d, K = dictionary.d, len(labels)
        observed = None
        if transitions == "observed":
            observed = {(r.prev_label, r.label) for r in transition_counts(data).collect()}
        mask = transition_mask(transitions, labels, observed)
        free = np.concatenate([np.ones(d * K, dtype=bool), mask.ravel()])
        head, squares = _summed(data.mapInArrow(make_squares_step(d), PART_SCHEMA), tasks, d, 1)
        scale = np.ones(d * K + K * K)
        scale[:d * K] = np.repeat(np.sqrt((0.25 * squares[:, 0] + 2.0 * c2) / max(float(head[0]), 1.0)), K)

        def objective(v):
            w = np.where(free, v / scale, 0.0)
            step = make_sparse_step(w[:d * K].reshape(d, K), w[d * K:].reshape(K, K), labels)
            head, grad = _summed(data.mapInArrow(step, PART_SCHEMA), tasks, d, K)
            g = np.concatenate([grad.ravel(), head[2:]]) + 2.0 * c2 * w
            return float(head[0]) + c2 * float(w @ w), np.where(free, g / scale, 0.0)

        res = lbfgs.minimize(objective, np.zeros(d * K + K * K), max_iter=max_iter, free=free)
    finally:
        data.unpersist()
    w = res.w / scale
    info = {"iterations": res.iterations, "evaluations": res.evaluations, "objective": res.f, "stop": res.converged}
    return SparseCRF(dictionary, labels, w[:d * K].reshape(d, K), w[d * K:].reshape(K, K) * mask, mask, c2,
                     transitions, info)


def decode_sparse(seqs: DataFrame, model: SparseCRF, out: str = "pred") -> DataFrame:
    """H2: rows of ``sparse_sequences`` with the best path in label values in place of the attributes."""
    keep = [f for f in seqs.schema.fields if f.name not in ("m", "idx", "val")]
    names = tuple(f.name for f in keep)
    schema = T.StructType([*keep, T.StructField("path", T.ArrayType(T.IntegerType()))])
    lab = F.array(*[F.lit(int(v)) for v in model.labels])
    return seqs.mapInArrow(make_sparse_decoder(model.W, model.A * model.trans_mask, names), schema).select(
        *names, F.transform("path", lambda i: F.element_at(lab, i + 1)).alias(out))
