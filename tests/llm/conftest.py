import os
import sys
import uuid

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # columns whose names operators use for themselves
    *[T.StructField(c, T.StringType()) for c in (
        "_rid", "id", "row", "keep", "n", "fp", "digit", "rest", "copies", "score", "kept", "span", "rank")]])


@pytest.fixture()
def saved(spark, tmp_path):
    """rows of (doc_id, text[, source]) -> a table of documents read from files, with clashing columns."""
    def save(rows, schema=DOCS, parts=3):
        path = str(tmp_path / f"t{uuid.uuid4().hex}")
        if schema is DOCS:
            rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *["x"] * 13) for r in rows]
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)
    return save

