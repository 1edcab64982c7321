"""Experiment runs (H5, H6, H9, H11, H12) as plain functions over DataFrames."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import any_positive
from ..functions.text import DEFAULT_DOMAIN
from ..operators import crf, crf_fused
from ..operators import metrics as M
from ..operators.features import FeatureContext, feature_names, with_feature_arrays
from ..operators.sentences import checked_length
from ..operators.vectors import (PCAProjection, article_matrices, attach_vectors, embedding_features, fit_pca_articles,
                                 fit_pca_groups, positions, vectors_of)
from ..operators.vector_table import VectorsById
from ..sources import sinks
from ..sources.articles import hash_bucket, split_filter


@dataclass(frozen=True)
class CRFConfig:
    use_lexicons: bool = True
    use_vectors: bool = True
    transitions: str = "all"        # 'all' | 'observed' | 'none' (X4)
    pca_dim: int = 50
    c2: float = crf.DEFAULT_C2
    max_iter: int = crf.DEFAULT_MAX_ITER
    embed_scope: str = "all"        # 'all' | 'train' (X2)
    partitions: int | None = None


@dataclass
class CRFRun:
    model: crf.CRFModel
    proj: PCAProjection | None
    config: CRFConfig


def _rows(vectors: DataFrame | VectorsById | None) -> DataFrame | None:
    """Sentence vectors as rows, where a step reads each once and moves none."""
    return vectors.rows() if isinstance(vectors, VectorsById) else vectors


def _table(vectors):
    return vectors.table if isinstance(vectors, VectorsById) else None


def _emb_dim_names(proj: PCAProjection | None) -> tuple:
    return tuple(f"emb{i}" for i in range(proj.k)) if proj is not None else ()


def featurise(articles: DataFrame, ctx: FeatureContext, cfg: CRFConfig,
              proj: PCAProjection | None, vectors: DataFrame | None) -> DataFrame:
    """Feature arrays (+ PCA'd vector rows in ``emb``) on the article rows."""
    a = with_feature_arrays(articles, ctx, cfg.use_lexicons)
    if cfg.use_vectors and vectors is not None and proj is not None:
        a = embedding_features(a, vectors, proj)
    return a


def train(spark: SparkSession, articles: DataFrame, ctx: FeatureContext,
          cfg: CRFConfig = CRFConfig(), vectors: DataFrame | None = None,
          split: str | None = "train") -> CRFRun:
    """H1 + D9 on the training split."""
    tr = split_filter(articles, split)
    proj = None
    if cfg.use_vectors and vectors is not None:
        proj = fit_pca_articles(tr, _rows(vectors), k=cfg.pca_dim)
    named = feature_names(cfg.use_lexicons)
    if proj is not None:  # one copy of the rows, with vectors as the table has them; their scores are made in the passes
        width = len(proj.mean)
        a = with_feature_arrays(tr, ctx, cfg.use_lexicons).withColumn("member", F.lit(1).cast("long"))
        own = replace(vectors, ids=vectors_of(tr, vectors.ids)) if _table(vectors) else vectors_of(tr, vectors)
        rows = _training_rows(spark, a, named, own, width, cfg.partitions).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return CRFRun(crf_fused.fit_together(rows, [_spec(cfg, 0, named, proj, width)], cfg.partitions, width=width,
                                                 table=_table(vectors))[0], proj, cfg)
        finally:
            rows.unpersist()
    names = named
    seqs = crf.sequences(featurise(tr, ctx, cfg, None, None), names)
    toggles = {"use_lexicons": cfg.use_lexicons, "use_vectors": proj is not None}
    model = crf.fit(seqs, names, cfg.transitions, cfg.c2, cfg.max_iter, cfg.partitions, toggles)
    return CRFRun(model, proj, cfg)


def predict(run: CRFRun, articles: DataFrame, ctx: FeatureContext,
            vectors: DataFrame | None = None) -> DataFrame:
    """H2 on every article: adds ``pred`` (sentence labels), ``y_true``, ``y_pred``.

    One pass over the articles with one decoder for every length; without
    vectors the plan is row-local, as a streaming source needs."""
    vectors = _rows(vectors)
    use_emb = run.proj is not None and vectors is not None
    if use_emb:
        run = _label_scores(run)
    fa = featurise(articles, ctx, run.config, run.proj if use_emb else None, vectors if use_emb else None)
    return decode_frame(run, fa, use_emb)


def _label_scores(run: CRFRun) -> CRFRun:
    """The run with the PCA scores' weights folded into the projection: an attribute for each label, of weight 1 for it,
    so a lookup moves a number for each label and no vector. The same emissions."""
    m = run.model
    k = len(m.feature_names) - run.proj.k
    model = replace(m, feature_names=(*m.feature_names[:k], *(f"emb{i}" for i in range(m.K))),
                    W=np.vstack([m.W[:k], np.eye(m.K)]))
    return replace(run, model=model, proj=run.proj.mapped(m.W[k:]))


def decode_frame(run: CRFRun, fa: DataFrame, use_emb: bool) -> DataFrame:
    """Decode already featurised article rows (``feats`` [+ ``emb``])."""
    model = run.model if use_emb else _without_embeddings(run.model)
    return (crf.decode_rows(fa, model, "emb" if use_emb else None)
            .withColumn("y_true", any_positive("sentence_labels"))
            .withColumn("y_pred", any_positive("pred")))


def _without_embeddings(model: crf.CRFModel) -> crf.CRFModel:
    """The model restricted to named features (vectors absent contribute 0)."""
    keep = [i for i, n in enumerate(model.feature_names) if not n.startswith("emb")]
    return crf.CRFModel(tuple(model.feature_names[i] for i in keep), model.labels, model.W[keep],
                        model.A, model.trans_mask, model.c2, model.transitions, model.toggles, model.info)


def article_metrics(pred: DataFrame, keys=()) -> DataFrame:
    return M.binary_metrics(pred, "y_true", "y_pred", keys=list(keys))


def save_run(spark: SparkSession, run: CRFRun, out_dir: str) -> None:
    """Weights table, config, and the PCA models when vectors are used."""
    run.model.save(spark, f"{out_dir}/model/crf")
    spark.createDataFrame([(json.dumps(asdict(run.config)),)], "config string") \
        .coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/model/config")
    if run.proj is not None:
        run.proj.save(spark, f"{out_dir}/model/pca")


def load_run(spark: SparkSession, model_dir: str) -> CRFRun:
    model = crf.CRFModel.load(spark, f"{model_dir}/model/crf")
    cfg = CRFConfig(**json.loads(spark.read.parquet(f"{model_dir}/model/config").first().config))
    proj = None
    if model.toggles.get("use_vectors"):
        proj = PCAProjection.load(spark, f"{model_dir}/model/pca")
    return CRFRun(model, proj, cfg)


def run_train(spark: SparkSession, articles: DataFrame, ctx: FeatureContext, out_dir: str,
              cfg: CRFConfig = CRFConfig(), vectors: DataFrame | None = None,
              domain: str = DEFAULT_DOMAIN, name: str = "CRF") -> CRFRun:
    """H5: train -> validate -> record -> save."""
    run = train(spark, articles, ctx, cfg, vectors)
    # embed_scope='train' reproduces vectors being looked up for training
    # articles only, so validation articles have none
    val_vectors = None if cfg.embed_scope == "train" else vectors
    pred = predict(run, split_filter(articles, "val"), ctx, val_vectors)
    row = sinks.metrics_row(M.global_binary_metrics(pred, "y_true", "y_pred"), name, domain, "val", "validation",
                            counts=True)
    sinks.dump_result_row(row, out_dir)
    save_run(spark, run, out_dir)
    return run


def run_eval(spark: SparkSession, articles: DataFrame, ctx: FeatureContext, model_dir: str,
             out_dir: str, vectors: DataFrame | None = None, domain: str = DEFAULT_DOMAIN,
             name: str = "CRF") -> DataFrame:
    """H6: load -> test -> record -> predictions -> subtypes. The saved
    toggles are reused (X3)."""
    run = load_run(spark, model_dir)
    pred = predict(run, split_filter(articles, "test"), ctx, vectors).select(
        "article_id", "domain", "split", "sentence_labels", "subtypes", "pred", "y_true", "y_pred")
    pred.persist(StorageLevel.MEMORY_AND_DISK)  # decoded once for the three results
    try:
        row = sinks.metrics_row(M.global_binary_metrics(pred, "y_true", "y_pred"), name, domain, "test", "test",
                                counts=True)
        sinks.dump_result_row(row, out_dir)
        sinks.write_predictions(pred, out_dir, f"{name.lower()}_preds")
        sinks.write_subtypes(M.subtype_breakdown(pred, "sentence_labels", "pred", "subtypes"),
                             out_dir, name.lower())
    finally:
        pred.unpersist()
    return pred


def _score_together(spark: SparkSession, articles: DataFrame, ctx: FeatureContext, vectors: DataFrame | None,
                    groups: list, variants: list, scored, keys: tuple = ()) -> tuple[list, list]:
    """Fit ``variants`` (config, index of a row group) together, then score all of them on the rows that ``scored``
    selects. Returns (models, metric rows with ``model`` and ``keys``).

    The attributes are computed once, for all articles of a group or to be scored, and kept: named features,
    raw sentence vectors, a flag that an article has them. Fitting takes the passes of the longest fit
    (``crf_fused``), decoding one. Each group's PCA comes from one pass over the vectors."""
    use_vectors = vectors is not None and any(c.use_vectors for c, _ in variants)
    member = crf_fused.member_mask(groups)
    a = with_feature_arrays(articles, ctx, any(c.use_lexicons for c, _ in variants)).withColumn("member", member)
    a = a.withColumn("_scored", F.coalesce(scored, F.lit(False))).filter("member <> 0 OR _scored")
    named = feature_names(any(c.use_lexicons for c, _ in variants))
    projections, width = [None] * len(groups), 0
    if use_vectors:
        dims = {c.pca_dim for c, _ in variants if c.use_vectors}
        if len(dims) != 1:
            raise ValueError("models fitted together need one pca_dim")
        projections = fit_pca_groups(articles.withColumn("member", member).filter("member <> 0"), _rows(vectors), len(groups),
                                     dims.pop())
        width = next((len(p.mean) for p in projections if p is not None), 0)
    train_only = F.lit(any(c.embed_scope == "train" for c, _ in variants)) & (F.col("member") == 0)  # X2
    rows = _training_rows(spark, a, named, vectors, width, variants[0][0].partitions, (*keys, "_scored"), train_only)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    specs = [_spec(c, g, named, projections[g] if c.use_vectors and vectors is not None else None, width)
             for c, g in variants]
    try:
        table = _table(vectors) if width else None
        models = crf_fused.fit_together(rows, specs, variants[0][0].partitions, width=width, table=table)
        pred = crf_fused.predict_together(rows.filter("_scored"), models, specs, (*keys, "y_true"), width, table)
        return models, article_metrics(pred, keys=["model", *keys]).collect()  # a few rows a model
    finally:
        rows.unpersist()


def _training_rows(spark: SparkSession, a: DataFrame, named: tuple, vectors: DataFrame | None, width: int,
                   partitions: int | None, keep: tuple = (), without=None) -> DataFrame:
    """Rows for ``crf_fused`` of featurised articles, in partitions of bounded bytes: named features ``x`` and, with
    ``width``, the raw vectors ``v`` (null where the condition ``without`` holds), or their rows in the table of vectors by id."""
    table = _table(vectors)
    sentences = a.agg(F.sum(F.size("sentences"))).first()[0] or 0
    spread = crf_fused.bounded_partitions(spark, sentences, len(named), 1 if table and width else width, partitions)
    rows = a.select("article_id", *keep, F.size("sentences").alias("n"), crf.sequence_values(named).alias("x"),
                    F.slice("sentence_labels", 1, checked_length()).alias("y"), "member",
                    any_positive("sentence_labels").alias("y_true"), positions().alias("sentences"))
    if not width:  # no join spreads them
        return rows.drop("sentences").repartition(spread)
    # numbers cross the exchange, no text
    rows = rows.repartition(spread, "article_id")
    if table:
        ids = attach_vectors(rows, article_matrices(vectors.ids, partitions=spread), missing=F.lit(None).cast("bigint"))
        rows, v = table.placed(ids, "vecs"), F.col("vecs")
        return rows.withColumn("v", v if without is None else F.when(~without, v)).drop("sentences", "vecs")
    rows = attach_vectors(rows, article_matrices(vectors, partitions=spread))
    v = F.flatten("vecs")  # of the table's type: floats stay floats
    return rows.withColumn("v", v if without is None else F.when(~without, v)).drop("sentences", "vecs")


def _spec(cfg: CRFConfig, group: int, named: tuple, proj: PCAProjection | None, width: int) -> crf_fused.Spec:
    """A config's attributes as a map of the common ones: chosen features, and its own PCA scores, which are
    ``vector @ components.T - mean @ components.T`` where the article has vectors."""
    names = feature_names(cfg.use_lexicons) + _emb_dim_names(proj)
    common = len(named) + (width + 1 if width else 0)
    P = np.zeros((common, len(names)))
    plain = [n for n in names if not n.startswith("emb")]
    for j, n in enumerate(plain):
        P[named.index(n), j] = 1.0
    if proj is not None:
        P[len(named):len(named) + width, len(plain):] = proj.components.T
        P[len(named) + width, len(plain):] = -proj.offset
    toggles = {"use_lexicons": cfg.use_lexicons, "use_vectors": proj is not None}
    return crf_fused.Spec(names, P, group, cfg.transitions, cfg.c2, cfg.max_iter, toggles)


def cross_domain(spark: SparkSession, articles: DataFrame, ctx: FeatureContext,
                 domains: list[str], cfg: CRFConfig = CRFConfig(use_vectors=False),
                 vectors: DataFrame | None = None) -> DataFrame:
    """H11 with the CRF: for every ordered pair of distinct domains, fit on
    all of A (X6) and test on all of B. The domains' models are fitted together, a domain being
    a row group, and score the corpus in one pass. Only the
    metric rows (a few per pair) come back to the driver."""
    from ..schemas import METRICS_SCHEMA, counted
    own = [F.col("domain").eqNullSafe(F.lit(a)) for a in domains]  # a null domain is a domain
    rows = []
    size = crf_fused.MAX_GROUPS
    for at in range(0, len(domains), size):
        part = domains[at:at + size]
        _, got = _score_together(spark, articles, ctx, vectors, own[at:at + size],
                                 [(cfg, g) for g in range(len(part))], in_domains(domains), ("domain",))
        rows += [("CRF", "cross", "test", r.accuracy, r.precision, r.recall, r.f1, f"{part[r.model]}->{r.domain}",
                  r.n, r.tp + r.fn) for r in got if r.domain != part[r.model]]
    return spark.createDataFrame(rows, counted(METRICS_SCHEMA))


def in_domains(domains) -> F.Column:
    """Rows of the listed domains; null may be one."""
    return F.coalesce(F.col("domain").isin([d for d in domains if d is not None]), F.lit(None in domains))


ABLATIONS = {
    "full": {},
    "no_trans": {"transitions": "observed"},
    "no_lex": {"use_lexicons": False},
    "no_emb": {"use_vectors": False},
    "trans_none": {"transitions": "none"},
}


def ablation(spark: SparkSession, articles: DataFrame, ctx: FeatureContext,
             vectors: DataFrame | None = None, base: CRFConfig = CRFConfig(),
             variants: dict = ABLATIONS, eval_split: str = "val", record_dir: str | None = None) -> DataFrame:
    """Each toggle set trained and evaluated, plus F1 change vs 'full'.

    The variants are one fit: each is a map of the same attributes (``_score_together``)."""
    configs = [(replace(base, **c), 0) for c in variants.values()]
    models, got = _score_together(spark, articles, ctx, vectors, [F.col("split") == "train"], configs,
                                  F.col("split") == eval_split)
    found = {r.model: r for r in got}
    rows = []
    for i, name in enumerate(variants):
        if (m := found.get(i)) is None:
            continue  # nothing to evaluate on
        if record_dir:  # a result row per variant, as other runs leave
            sinks.dump_result_row(sinks.metrics_row(
                spark.createDataFrame([m]), "CRF", "all", eval_split, name, counts=True), f"{record_dir}/{name}")
        rows.append((name, eval_split, m.n, m.accuracy, m.precision, m.recall, m.f1,
                     models[i].info.get("iterations"), m.tp + m.fn))
    df = spark.createDataFrame(rows, "variant string, split string, n bigint, accuracy double, "
                                     "precision double, recall double, f1 double, iterations int, n_pos bigint")
    full_f1 = next((r[6] for r in rows if r[0] == "full"), None)
    return df.withColumn("delta_f1", F.col("f1") - F.lit(full_f1) if full_f1 is not None else F.lit(None))


def nested_sample(articles: DataFrame, pct: float, seed: str = "curve") -> DataFrame:
    """Deterministic nested sample: bucket(article_id) < pct (of 100)."""
    return articles.filter(hash_bucket(F.col("article_id"), 100, seed) < F.lit(pct))


def learning_curve(spark: SparkSession, articles: DataFrame, ctx: FeatureContext,
                   pcts=(25.0, 50.0, 100.0), cfg: CRFConfig = CRFConfig(use_vectors=False),
                   vectors: DataFrame | None = None, model: str = "CRF") -> DataFrame:
    """H9: refit on nested training samples, F1 on the full test split.

    A sample is a row group: all are fitted together, with a PCA of each group's own, and score test in one pass."""
    bucket = hash_bucket(F.col("article_id"), 100, "curve")
    groups = [(F.col("split") == "train") & (bucket < F.lit(p)) for p in pcts]
    _, got = _score_together(spark, articles, ctx, vectors, groups, [(cfg, g) for g in range(len(pcts))],
                             F.col("split") == "test")
    rows = [(model, float(pcts[r.model]), float(r.f1), r.n, r.tp + r.fn) for r in got]
    return spark.createDataFrame(rows, "model string, train_pct double, f1 double, n bigint, n_pos bigint")
