"""Article-level classifiers (H7, H8) and candidate selection.

Two Spark ML baselines stand in for the fine-tuned text classifiers:
``tfidf_lr`` (token hashing -> IDF -> logistic regression) and
``word2vec_lr`` (averaged Word2Vec vectors -> logistic regression).
Each candidate hyper-parameter set is a distributed fit; the best is picked
by F1 on the validation split (X5: never on test).

A cheap rule family (feature > threshold) is also provided; it is fully
SQL-expressible and is used for cross-domain runs and learning curves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import any_positive, argmax
from ..functions.text import DEFAULT_DOMAIN, TOKEN_PATTERN
from ..schemas import METRICS_SCHEMA, counted
from ..sources import sinks
from . import metrics as M

def article_text_frame(articles: DataFrame) -> DataFrame:
    """``(article_id, domain, split, text, label)``; B15 + B17."""
    return articles.select("article_id", "domain", "split",
                           F.array_join("sentences", " ").alias("text"),
                           any_positive("sentence_labels").cast("double").alias("label"))


def tokenised(articles: DataFrame) -> DataFrame:
    """``article_text_frame`` with the tokens of a text in its place. Texts are cut once, and the rows written: all fits and
    predictions of ``fit_with_validation``, ``predict`` and the runs take them as they are."""
    cut = _tokenizer().transform(article_text_frame(articles))
    return sinks.written(cut.select("article_id", "domain", "split", "label", "tokens"), "tokens")


def _to_run(stages: Sequence, frame: DataFrame) -> list:
    """The stages without the one that cuts texts, if the frame has its tokens."""
    return [s for s in stages if not (isinstance(s, RegexTokenizer) and s.getOutputCol() in frame.columns)]


WORD2VEC_TEXTS = 20_000  # training texts of a Word2Vec task


def _tokenizer(out: str = "tokens") -> RegexTokenizer:
    return RegexTokenizer(inputCol="text", outputCol=out, pattern=TOKEN_PATTERN, gaps=False, toLowercase=True,
                          minTokenLength=1)


def _tokenized(variant: str, num_features: int = 1 << 18, max_len: int | None = None) -> list:
    """Stages that learn nothing: tokens, and for ``tfidf_lr`` their hashed counts. All tokens of a text are used; a
    caller may cut its own texts to the first ``max_len`` tokens (B16)."""
    start = [_tokenizer()] if max_len is None else [_tokenizer("tokens_all"), SQLTransformer(
        statement=f"SELECT *, slice(tokens_all, 1, {int(max_len)}) AS tokens FROM __THIS__")]
    if variant == "tfidf_lr":
        return [*start, HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features)]
    if variant == "word2vec_lr":
        return start
    raise ValueError(f"unknown baseline variant {variant!r}")


def _learned(variant: str, texts: int, seed: int = 42):
    """The feature stage that is fitted. Word2Vec learns in one task by default, so it gets one per ``WORD2VEC_TEXTS``
    training texts, whatever the cluster, and Spark averages what the tasks learn."""
    if variant == "tfidf_lr":
        return IDF(inputCol="tf", outputCol="features")
    return Word2Vec(inputCol="tokens", outputCol="features", vectorSize=64, minCount=2, maxIter=1, seed=seed,
                    numPartitions=max(1, -(-texts // WORD2VEC_TEXTS)))


def _featurizer(variant: str, texts: int = 0, max_len: int | None = None) -> Pipeline:
    """All feature stages, for ``texts`` training texts."""
    return Pipeline(stages=[*_tokenized(variant, max_len=max_len), _learned(variant, texts)])


def _texts(variant: str, train: DataFrame) -> int:
    return train.count() if variant == "word2vec_lr" else 0


DEFAULT_CANDIDATES = ((0.0, 20), (0.01, 20), (0.1, 20))


def predict(model: PipelineModel, frame: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """H8: ``(article_id, *keep, y_true, y_pred)``; y_pred = arg-max of raw scores."""
    stages = _to_run(model.stages, frame) if isinstance(model, PipelineModel) else [model]
    out = PipelineModel(stages=stages).transform(frame)
    return out.select("article_id", *keep, F.col("label").cast("int").alias("y_true"),
                      argmax(vector_to_array("rawPrediction")).alias("y_pred"))


def fit_with_validation(train: DataFrame, val: DataFrame, variant: str = "tfidf_lr",
                        candidates: Sequence[tuple] = DEFAULT_CANDIDATES, parallelism: int = 3,
                        max_len: int | None = None):
    """H7 + D12: fit every candidate on train, score on val, keep the best F1
    (earliest candidate on ties). Returns (best model, candidate table)."""
    spark = train.sparkSession
    stages = _featurizer(variant, _texts(variant, train), max_len).getStages()
    own = _to_run(stages, train)
    feat = Pipeline(stages=own).fit(train)  # fitted once for all candidates
    tr = feat.transform(train).select("article_id", "label", "features").cache()
    va = feat.transform(val).select("article_id", "label", "features").cache()
    n_train, n_train_pos = tr.agg(F.count("*"), F.sum("label").cast("bigint")).first()

    def fit_one(i, reg, iters):
        lr = LogisticRegression(featuresCol="features", labelCol="label",
                                regParam=reg, maxIter=iters).fit(tr)
        m = M.global_binary_metrics(predict(lr, va)).first()
        return (i, variant, float(reg), int(iters), float(m.f1), m.accuracy, m.n, m.tp + m.fn,
                n_train, n_train_pos), lr

    from concurrent.futures import ThreadPoolExecutor
    try:
        # candidates are independent jobs: submit them concurrently (as Spark
        # ML's tuning ``parallelism`` does) so small fits share the cluster
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(candidates)))) as pool:
            done = list(pool.map(lambda c: fit_one(c[0], *c[1]), enumerate(candidates)))
        rows = [r for r, _ in done]
        models = [lr for _, lr in done]
    finally:
        tr.unpersist()
        va.unpersist()
    table = spark.createDataFrame(
        rows, "candidate int, variant string, reg_param double, max_iter int, val_f1 double, val_accuracy double, "
              "n_val bigint, n_val_pos bigint, n_train bigint, n_train_pos bigint")
    best = max(rows, key=lambda r: (r[4], -r[0]))[0]
    cut = [s for s in stages if s not in own]  # the model takes texts, whatever it was fitted on
    return PipelineModel(stages=[*cut, *feat.stages, models[best]]), table


# ------------------------------------------------------------------ rule family
RULE_FEATURES = ("bias_lex", "sent_neg", "sent_pos")
RULE_THRESHOLDS = (0, 1, 2)
RULE_CANDIDATES = tuple((f"{f}>{t}", f, t) for f in RULE_FEATURES for t in RULE_THRESHOLDS)


def _field(name: str):
    return lambda s: s[name]


def rule_candidate_rows(scored: DataFrame, keys: Sequence[str] = ("article_id", "domain", "split"),
                        candidates=RULE_CANDIDATES) -> DataFrame:
    """One row per (article, candidate): ``y_pred`` = any sentence with
    ``feature > threshold``. Candidates are a literal array exploded per row
    (a narrow generator, no join)."""
    feats = sorted({f for _, f, _ in candidates})
    staged = scored.select(*keys, "y_true", *[
        F.coalesce(F.array_max(F.transform("feats", _field(f))), F.lit(-1.0)).alias(f"_mx_{f}")
        for f in feats])
    cand = F.array(*[F.struct(F.lit(i).alias("cand_idx"), F.lit(name).alias("candidate"),
                              (F.col(f"_mx_{f}") > t).cast("int").alias("y_pred"))
                     for i, (name, f, t) in enumerate(candidates)])
    return staged.select(*keys, "y_true", F.explode(cand).alias("c")).select(
        *keys, "y_true", "c.cand_idx", "c.candidate", "c.y_pred")


def candidate_metrics(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return M.binary_metrics(rows, "y_true", "y_pred", keys=[*keys, "cand_idx", "candidate"])


def best_candidates(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Highest F1 per group; the earliest candidate wins ties."""
    order = F.struct(F.col("f1"), (-F.col("cand_idx")).alias("neg_idx"))
    return (metrics.groupBy(*keys)
            .agg(F.max_by(F.struct("cand_idx", "candidate"), order).alias("best"))
            .select(*keys, F.col("best.cand_idx").alias("cand_idx"), F.col("best.candidate").alias("candidate")))


def save_model(model: PipelineModel, path: str) -> None:
    """The fitted classifier (tokeniser, features, regression) as one folder."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ------------------------------------------------------------------ runs
def _split(frame: DataFrame, name: str) -> DataFrame:
    return frame.filter(F.col("split") == name)


def _frame(articles: DataFrame) -> DataFrame:
    return articles if "tokens" in articles.columns else article_text_frame(articles)


def run_train(spark: SparkSession, articles: DataFrame, out_dir: str, variant: str = "tfidf_lr",
              domain: str = DEFAULT_DOMAIN, candidates: Sequence[tuple] = DEFAULT_CANDIDATES) -> PipelineModel:
    """H7 as a run: fit the candidates, keep the best on val, record its row, save it. ``articles``: or ``tokenised`` ones."""
    frame = _frame(articles)
    model, _ = fit_with_validation(_split(frame, "train"), _split(frame, "val"), variant, candidates)
    m = M.global_binary_metrics(predict(model, _split(frame, "val")))
    sinks.dump_result_row(sinks.metrics_row(m, variant, domain, "val", "validation", counts=True), out_dir)
    save_model(model, f"{out_dir}/model/classifier")
    return model


def run_eval(spark: SparkSession, articles: DataFrame, model_dir: str, out_dir: str, variant: str = "tfidf_lr",
             domain: str = DEFAULT_DOMAIN) -> DataFrame:
    """H8 as a run: load, predict test once, record its row, write the prediction file."""
    model = load_model(f"{model_dir}/model/classifier")
    pred = predict(model, _split(_frame(articles), "test"))
    sinks.write_predictions(pred, out_dir, f"{variant}_preds")
    pred = spark.read.parquet(f"{out_dir}/{variant}_preds")
    m = M.global_binary_metrics(pred)
    sinks.dump_result_row(sinks.metrics_row(m, variant, domain, "test", "test", counts=True), out_dir)
    return pred


def _staged(articles: DataFrame, variant: str) -> DataFrame:
    """Article rows with what the stages that learn nothing make of their texts, without the texts."""
    out = PipelineModel(stages=_tokenized(variant)).transform(article_text_frame(articles))
    return out.select("article_id", "domain", "split", "label", "tf" if variant == "tfidf_lr" else "tokens")


def _fit_staged(train: DataFrame, variant: str, reg: float, iters: int) -> PipelineModel:
    feat = _learned(variant, _texts(variant, train)).fit(train)
    features = feat.transform(train).select("label", "features").persist()  # read by the summary and the blocks
    try:
        lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=reg, maxIter=iters).fit(features)
    finally:
        features.unpersist()
    return PipelineModel(stages=[feat, lr])


def cross_domain(spark: SparkSession, articles: DataFrame, domains: Sequence[str], variant: str = "tfidf_lr",
                 reg: float = 0.01, iters: int = 20) -> DataFrame:
    """H11 with the classifier: fit on all of A (X6), test on all of every other domain.

    A null domain is a domain. One pass scores all test domains of a fit; texts are tokenised once for all fits."""
    frame = _staged(articles, variant).persist()
    rows = []
    try:
        for a in domains:
            own = F.col("domain").eqNullSafe(F.lit(a))
            model = _fit_staged(frame.filter(own), variant, reg, iters)
            listed = F.coalesce(F.col("domain").isin([d for d in domains if d is not None]), F.lit(None in domains))
            scored = predict(model, frame.filter(~own & listed), keep=("domain",))
            for r in M.binary_metrics(scored, "y_true", "y_pred", keys=["domain"]).collect():
                rows.append((variant, "cross", "test", r.accuracy, r.precision, r.recall, r.f1,
                             f"{a}->{r.domain}", r.n, r.tp + r.fn))
    finally:
        frame.unpersist()
    return spark.createDataFrame(rows, counted(METRICS_SCHEMA))


def learning_curve(spark: SparkSession, articles: DataFrame, pcts=(25.0, 50.0, 100.0), variant: str = "tfidf_lr",
                   reg: float = 0.01, iters: int = 20) -> DataFrame:
    """H9 with the classifier: refit on nested training samples, F1 on the full test split."""
    from ..sources.articles import hash_bucket
    frame = _staged(articles, variant).persist()
    rows = []
    try:
        for pct in pcts:
            tr = _split(frame, "train").filter(hash_bucket(F.col("article_id"), 100, "curve") < F.lit(pct))
            model = _fit_staged(tr, variant, reg, iters)
            m = M.global_binary_metrics(predict(model, _split(frame, "test"))).first()
            rows.append((variant, float(pct), float(m.f1), m.n, m.tp + m.fn))
    finally:
        frame.unpersist()
    return spark.createDataFrame(rows, "model string, train_pct double, f1 double, n bigint, n_pos bigint")
