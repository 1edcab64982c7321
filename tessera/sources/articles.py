"""Article sources: JSON lines (A1) and the documents-table adapter.

An article row is ``(article_id, domain, split, sentences array<string>,
sentence_labels array<int>, subtypes array<string>)``; one row per article
keeps every per-article computation row-local (no shuffle) downstream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import labels_to_int
from ..functions.text import (DEFAULT_DOMAIN, DEFAULT_SPLIT, any_in,
                              split_sentences, tokens)
from ..schemas import ARTICLE_JSON_SCHEMA

ARTICLE_COLUMNS = ("article_id", "domain", "split", "sentences",
                   "sentence_labels", "subtypes")


def _require(df: DataFrame, what: str, missing: Column) -> DataFrame:
    """Fail the job on the first row where ``missing`` holds (not a silent drop)."""
    return df.filter(F.when(missing, F.raise_error(F.lit(what))).otherwise(F.lit(True)))


def normalise_articles(raw: DataFrame) -> DataFrame:
    """Defaults (B2), required fields and element-wise label cast."""
    df = _require(raw, "article record without article_id, sentences or sentence_labels",
                  F.col("article_id").isNull() | F.col("sentences").isNull()
                  | F.col("sentence_labels").isNull())
    return df.select(
        "article_id",
        F.coalesce("domain", F.lit(DEFAULT_DOMAIN)).alias("domain"),
        F.coalesce("split", F.lit(DEFAULT_SPLIT)).alias("split"),
        "sentences",
        labels_to_int("sentence_labels").alias("sentence_labels"),
        "subtypes",
    )


def read_articles_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A1: one JSON object per non-blank line, explicit schema, FAILFAST."""
    raw = (spark.read.schema(ARTICLE_JSON_SCHEMA)
           .option("mode", "FAILFAST")
           .json(path))
    return normalise_articles(raw)


def split_filter(articles: DataFrame, split: str | None) -> DataFrame:
    """B1 (pushed to the scan when the source is Parquet partitioned by split)."""
    return articles if split is None else articles.filter(F.col("split") == split)


# ---------------------------------------------------------------------------
# Adapter for the driver's ``documents`` table (FIXTURES.md section 3).
# These word lists are this repo's own stand-ins, not reference values.
GOLD_LOADED = ("trash", "scum", "worthless", "pathetic")
GOLD_EMOTIVE = ("idiot", "clown", "moron")
GOLD_TERMS = GOLD_LOADED + GOLD_EMOTIVE
SPLIT_SEED = "42"
# ---------------------------------------------------------------------------


def hash_bucket(key: Column, buckets: int, seed: str = SPLIT_SEED) -> Column:
    """Deterministic bucket from md5 (same value in any engine with md5)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), key.cast("string"))), 1, 8), 16, 10)
    return F.pmod(h.cast("bigint"), F.lit(buckets))


def documents_to_articles(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text, lang, ...) -> article rows, row-local.

    Sentences are split on ``[.!?\\n]+``; a sentence is labelled 1 when one
    of its tokens is a gold term; subtype ``loaded``/``emotive``/``none``.
    The split is a hash bucket of doc_id (3/6 train, 1/6 val, 2/6 test).
    """
    b = hash_bucket(F.col("doc_id"), 6)
    arts = docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("article_id"),
        F.col("lang").alias("domain"),
        F.when(b < 3, "train").when(b == 3, "val").otherwise("test").alias("split"),
        F.coalesce(split_sentences("text"), F.array().cast("array<string>")).alias("sentences"),
    )
    toks = arts.withColumn("_toks", F.transform("sentences", tokens))
    return toks.select(
        "article_id", "domain", "split", "sentences",
        F.transform("_toks", lambda t: any_in(t, GOLD_TERMS).cast("int")).alias("sentence_labels"),
        F.transform("_toks", lambda t: F.when(any_in(t, GOLD_LOADED), "loaded")
                    .when(any_in(t, GOLD_EMOTIVE), "emotive")
                    .otherwise("none")).alias("subtypes"),
    )


def balanced(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan over at least ``min_partitions`` tasks (default: the
    cluster's parallelism). A large input already has more splits than that
    and is returned unchanged; a small file with one row group would
    otherwise run every row-local stage in a single task."""
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


def testdata_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_to_articles(read_documents(spark, sf_dir))
