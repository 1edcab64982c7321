"""C3 by id: a table of vectors on the executors, and stored articles that hold ids in place of vectors."""
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import vector_table
from tessera.operators.vectors import article_matrices, attach_vectors
from tessera.plans.catalog_models import stored_articles_with_vectors

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["float", "double"])
def test_resolve_equals_the_join(spark, kind):
    emb = spark.createDataFrame([(9, [1.0, 2.0]), (-4, [3.0, 4.0]), (7, None), (None, [5.0, 6.0])],
                                f"vec_id bigint, embedding array<{kind}>")
    refs = [("a", [9, -4, 9]), ("b", [7, 9, None]), ("c", [7, 5]), ("d", []), ("e", [-4])]
    arts = spark.createDataFrame([(a, ["s"] * (len(r) + (a == "e"))) for a, r in refs], "article_id string, sentences array<string>")
    ids = spark.createDataFrame([(a, p, v) for a, r in refs for p, v in enumerate(r)], "article_id string, pos int, vec bigint")
    joined = ids.join(emb, F.col("vec") == F.col("vec_id"), "left").select("article_id", "pos", F.col("embedding").alias("vec"))
    want = attach_vectors(arts, article_matrices(joined))
    table = vector_table.shipped(emb, "vec_id", "embedding")
    got = table.resolve(attach_vectors(arts, article_matrices(ids), missing=F.lit(None).cast("bigint")), "vecs")
    assert got.schema["vecs"].dataType == want.schema["vecs"].dataType
    assert got.orderBy("article_id").collect() == want.orderBy("article_id").collect()


def test_what_is_no_bounded_table_is_not_shipped(spark):
    def made(rows):
        return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert vector_table.shipped(made([(1, [1.0]), (1, [2.0])]), "vec_id", "embedding") is None
    assert vector_table.shipped(made([(1, [1.0]), (2, [2.0, 3.0])]), "vec_id", "embedding") is None
    assert vector_table.shipped(made([(1, [1.0]), (2, [None])]), "vec_id", "embedding") is None
    assert vector_table.shipped(made([(1, [1.0])]), "vec_id", "embedding", max_bytes=8) is None
    assert vector_table.shipped(made([]), "vec_id", "embedding") is None


def test_stored_vectors_are_small(spark, monkeypatch):
    def stored(split):
        before = set(map(str, base.glob("stored_vectors-*")))
        rows = stored_articles_with_vectors(spark, SMALL, split).select("article_id", "sentences", "vecs")
        new, = set(map(str, base.glob("stored_vectors-*"))) - before
        return sorted(map(tuple, rows.collect())), sum(os.path.getsize(f) for f in Path(new).glob("*.parquet"))
    from tessera.session import ensure_checkpoint_dir
    base = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    rows, size = stored("test")
    monkeypatch.setattr(vector_table, "shipped", lambda *a: None)
    same, whole = stored("test")
    assert rows == same and size * 5 < whole
