"""R10 on the testdata adapter: vector ids that the table lacks, and vectors that move once, as floats."""
import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from tessera.operators import crf_fused
from tessera.operators import vectors as V


@pytest.fixture(scope="module")
def gaps(spark, tmp_path_factory):
    """Documents of 1 to 6 sentences; every third vector id is absent, one vector is null, one document has none."""
    path = str(tmp_path_factory.mktemp("gaps"))
    docs = [(i, " ".join(f"word{i} and s{k}." for k in range(1 + i % 6)), "en") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    rng = np.random.default_rng(5)
    emb = [(i, None if i == 31 else [float(x) for x in rng.normal(size=4)]) for i in range(200) if i % 3 and i not in (62, 124)]
    spark.createDataFrame(emb, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", ["embed_lookup", "pca_fit"])
def test_sentences_without_a_vector_stay(spark, gaps, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{gaps}/{t}.parquet/*.parquet')")
    cur = con.execute(E.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(cur.fetchall(), key=repr)
    df = E.queries()[name](spark, gaps)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == want
    if name == "embed_lookup":
        assert len(want) == sum(1 + i % 6 for i in range(60))
        at = cols.index("has_vec"), cols.index("v_max"), cols.index("v_min")
        assert {r[at[0]] for r in want} == {0, 1}
        assert any((r[at[0]], r[at[1]], r[at[2]]) == (1, 0.0, 0.0) for r in want)


def test_vectors_are_shuffled_once_as_floats(spark, gaps):
    vecs = V.testdata_vectors(spark, gaps)
    assert V.article_matrices(vecs).schema["vrows"].dataType.elementType.elementType.simpleString() == "float"
    from tessera.sources.articles import testdata_articles
    arts = testdata_articles(spark, gaps)
    proj = V.fit_pca_articles(arts.filter("split = 'train'"), vecs, 2)
    a = V.attach_vectors(arts, V.article_matrices(vecs))
    e = V.embedding_features(a, vecs, proj)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(e).count("Exchange hashpartitioning") == plan(a).count("Exchange hashpartitioning")
    for r in e.collect():
        want = np.zeros((len(r.sentences), 2)) if r.vecs is None else np.array(r.vecs) @ proj.components.T - proj.offset
        assert np.allclose(np.array(r.emb).reshape(-1, 2), want.reshape(-1, 2), atol=1e-6)


def test_training_rows_move_no_vector(spark, gaps, monkeypatch):
    from tessera.sources.articles import testdata_articles
    arts, vecs = testdata_articles(spark, gaps).filter("split = 'train'"), V.testdata_vectors(spark, gaps)
    rows, zeros = V.training_rows(arts, vecs)
    assert "Exchange hashpartitioning(article_id" not in rows._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(V, "BROADCAST_MAX_IDS", 0)  # too many ids: the same rows by a shuffled join
    more, same = V.training_rows(arts, vecs)
    key = lambda df: sorted((r.article_id, r.pos) for r in df.collect())
    assert zeros == same > 0 and key(rows) == key(more)


def test_fused_rows_are_kept_once(spark, monkeypatch):
    """Rows that are persisted are not spread and kept again, and raw vectors beside x give the weights of whole rows."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(40):
        n = 1 + i % 5
        v = None if i % 7 == 0 else [float(np.float32(x)) for x in rng.normal(size=n * 3)]
        rows.append((f"a{i}", n, [float(x) for x in rng.normal(size=n * 2)], v, [int(x) for x in rng.integers(0, 2, n)], 1))
    df = spark.createDataFrame(rows, "article_id string, n int, x array<double>, v array<float>, y array<int>, member long")
    spec = [crf_fused.Spec(tuple("abcdef"), np.eye(6), 0, max_iter=6)]
    whole = df.withColumn("x", crf_fused._whole(3)).drop("v")
    want = crf_fused.fit_together(whole, spec, 2)[0]
    kept = df.persist()
    monkeypatch.setattr(type(df), "repartition", lambda *a, **k: pytest.fail("spread again"))
    got = crf_fused.fit_together(kept, spec, 2, width=3)[0]
    monkeypatch.undo()
    assert np.abs(got.W - want.W).max() < 1e-9 and np.abs(got.A - want.A).max() < 1e-9
    hot = crf_fused.fit_together(kept, spec, 2, hot_len=2, segment_len=2, width=3)[0]
    assert np.abs(hot.W - want.W).max() < 1e-6
    kept.unpersist()
