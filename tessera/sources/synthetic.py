"""Synthetic labelled corpus, generated by Spark from ``spark.range``.

Every random choice is a hash of (seed, domain, index, position), so the
corpus is identical under any partitioning or retry (no ``rand()``), and it
scales by ``n_per_domain``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the reference's synthetic corpus
POSITIVE_TEMPLATE = "The administration's draconian policy was reckless according to sources (%s-%d-%d)."
NEGATIVE_TEMPLATE = "The government announced a funding reduction in %s-%d-%d."
POSITIVE_SUBTYPES = ("loaded", "emotive")
NEGATIVE_SUBTYPE = "none"
DOMAINS = ("basil", "wiki", "mfc")
ARTICLES_PER_DOMAIN = 60
MIN_SENTENCES, MAX_SENTENCES = 5, 8
MAX_POSITIVES = 2
TRAIN_BELOW, VAL_BELOW = 30, 40


def _h(seed: int, *parts) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def synthetic_articles(spark: SparkSession, seed: int = 13, domains=DOMAINS,
                       n_per_domain: int = ARTICLES_PER_DOMAIN) -> DataFrame:
    """Article rows for every domain (the merged corpus = all rows; G3)."""
    base = spark.range(n_per_domain).select(F.col("id").alias("idx"))
    dom = F.explode(F.array(*[F.lit(d) for d in domains])).alias("prefix")
    rows = base.select("idx", dom)
    key = (F.col("prefix"), F.col("idx"))
    n = (F.lit(MIN_SENTENCES) + F.pmod(_h(seed, *key, F.lit("n")), F.lit(MAX_SENTENCES - MIN_SENTENCES + 1))).cast("int")
    k = F.pmod(_h(seed, *key, F.lit("k")), F.lit(MAX_POSITIVES + 1)).cast("int")
    rows = rows.withColumn("n", n).withColumn("k", k)
    # sample k positions without replacement: the k smallest hashes
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                                     lambda i: F.struct(_h(seed, *key, i).alias("h"), i.alias("i"))))
    rows = rows.withColumn("chosen", F.transform(F.slice(order, 1, F.col("k")), lambda s: s["i"]))
    positions = F.sequence(F.lit(0), F.col("n") - 1)
    is_pos = lambda i: F.array_contains(F.col("chosen"), i)
    sentences = F.transform(positions, lambda i: F.when(
        is_pos(i), F.format_string(POSITIVE_TEMPLATE, F.col("prefix"), F.col("idx"), i))
        .otherwise(F.format_string(NEGATIVE_TEMPLATE, F.col("prefix"), F.col("idx"), i)))
    subtypes = F.transform(positions, lambda i: F.when(
        is_pos(i), F.element_at(F.array(*[F.lit(s) for s in POSITIVE_SUBTYPES]),
                                (F.pmod(_h(seed, *key, i, F.lit("s")), F.lit(2)) + 1).cast("int")))
        .otherwise(F.lit(NEGATIVE_SUBTYPE)))
    return rows.select(
        F.format_string("%s_%05d", F.col("prefix"), F.col("idx")).alias("article_id"),
        F.upper("prefix").alias("domain"),
        F.when(F.col("idx") < TRAIN_BELOW, "train").when(F.col("idx") < VAL_BELOW, "val")
        .otherwise("test").alias("split"),
        sentences.alias("sentences"),
        F.transform(positions, lambda i: is_pos(i).cast("int")).alias("sentence_labels"),
        subtypes.alias("subtypes"))
