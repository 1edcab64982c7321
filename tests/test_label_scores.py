"""H2 with vectors: a lookup for decoding moves a number for each label, no vector, and the paths are those of the scores."""
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import crf
from tessera.operators.features import FeatureContext
from tessera.operators.vectors import PCAProjection, article_matrices, attach_vectors, embedding_features
from tessera.plans import experiments as X
from tessera.sources.lexicons import testdata_bias_lexicon as bias_lexicon
from tessera.sources.lexicons import testdata_subjectivity_lexicon as subjectivity_lexicon
from tessera.sources.synthetic import synthetic_articles


def test_paths_without_shuffled_vectors(spark):
    arts = synthetic_articles(spark, n_per_domain=12)
    ctx = FeatureContext(bias_lexicon(spark), subjectivity_lexicon(spark))
    rows = [(r.article_id, i, [float(np.sin(j + 3 * i + len(s))) for j in range(6)])
            for r in arts.collect() for i, s in enumerate(r.sentences)
            if r.article_id[-1] != "7" and not (r.article_id[-1] == "5" and i + 1 == len(r.sentences))]
    vecs = spark.createDataFrame(rows, "article_id string, pos int, vec array<float>")
    rng = np.random.default_rng(2)
    proj = PCAProjection(rng.normal(size=6), np.linalg.qr(rng.normal(size=(6, 4)))[0].T, np.ones(4), 6.0)
    names = X.feature_names(True) + tuple(f"emb{i}" for i in range(4))
    model = crf.CRFModel(names, (0, 1), rng.normal(size=(len(names), 2)), rng.normal(size=(2, 2)), np.ones((2, 2), bool))
    run = X.CRFRun(model, proj, X.CRFConfig())
    pred = X.predict(run, arts, ctx, vecs)
    whole = attach_vectors(X.with_feature_arrays(arts, ctx, True), article_matrices(vecs))
    want = X.decode_frame(run, embedding_features(whole, vecs, proj), True)
    paths = [{r.article_id: list(r.pred) for r in p.select("article_id", "pred").collect()} for p in (pred, want)]
    assert paths[0] == paths[1] and {x for p in paths[0].values() for x in p} == {0, 1}
    plan = pred._sc._jvm.PythonSQLUtils.explainString(pred._jdf.queryExecution(), "formatted")
    inputs = re.findall(r"\) Exchange\s+Input \[\d+\]: \[(.*)\]", plan)
    assert inputs and not any("vec#" in x or "vecs#" in x or "vrows#" in x for x in inputs), inputs
