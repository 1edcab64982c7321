"""H1, H2, H11 with vectors by id: equal to vectors joined to the rows, which hold none of them."""
import numpy as np
import pytest

from tessera.operators import crf_fused, vector_table
from tessera.plans import experiments
from tessera.plans.catalog import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("hot", [50_000, 2])
def test_fit_and_scores_by_place_equal_joined_vectors(spark, hot):
    rng = np.random.default_rng(4)
    emb = [(i * 3, rng.normal(size=2).astype(np.float32).tolist()) for i in range(20)]
    rows = []
    for a in range(40):
        n = int(rng.integers(1, 6))
        ids = [None if rng.random() < 0.1 else int(i) for i in rng.integers(0, 70, n)]  # two of three are not in the table
        v = [dict(emb).get(i) for i in ids]
        flat = None if all(x is None for x in v) else [z for x in v for z in (x or [0.0, 0.0])]
        rows.append((f"a{a}", n, rng.normal(size=n * 2).tolist(), rng.integers(0, 2, n).tolist(), 1, ids, flat))
    assert any(r[6] is None for r in rows)
    df = spark.createDataFrame(rows, "article_id string, n int, x array<double>, y array<int>, member bigint, "
                                     "ids array<bigint>, v array<float>")
    table = vector_table.shipped(spark.createDataFrame(emb, "vec_id bigint, embedding array<float>"), "vec_id", "embedding")
    spec = [crf_fused.Spec(tuple("abcde"), np.eye(5), 0, max_iter=6)]
    placed = table.placed(df.drop("v").withColumnRenamed("ids", "v"), "v").select(*df.drop("ids").columns)
    want = crf_fused.fit_together(df.drop("ids"), spec, 2, hot_len=hot, segment_len=2, width=2)[0]
    got = crf_fused.fit_together(placed, spec, 2, hot_len=hot, segment_len=2, width=2, table=table)[0]
    assert np.allclose(got.W, want.W, atol=1e-9) and np.allclose(got.A, want.A, atol=1e-9)
    scores = [sorted(map(tuple, crf_fused.predict_together(d, [want], spec, ("article_id",), 2, t).collect()))
              for d, t in ((df, None), (placed, table))]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("query", ["cross_domain_crf", "ablation", "crf_experiment"])
def test_training_rows_hold_no_vectors(spark, monkeypatch, query):
    kinds, real = [], experiments._training_rows

    def seen(*a, **k):
        rows = real(*a, **k)
        kinds.append(rows.schema["v"].dataType.elementType.simpleString())
        return rows
    monkeypatch.setattr(experiments, "_training_rows", seen)
    monkeypatch.setattr(experiments.CRFConfig.__init__, "__defaults__", tuple(
        6 if d == experiments.crf.DEFAULT_MAX_ITER else d for d in experiments.CRFConfig.__init__.__defaults__))
    by_id = sorted(map(str, queries()[query](spark, SMALL).collect()))
    from tessera.operators import vectors
    monkeypatch.setattr(vectors, "shipped", lambda *a: None)
    assert by_id == sorted(map(str, queries()[query](spark, SMALL).collect())) and by_id
    assert kinds == ["int", "float"]
