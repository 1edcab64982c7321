"""Article -> sentence rows (B5) and article text (B15, B16). All row-local."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def checked_length(sentences: str = "sentences", labels: str = "sentence_labels"):
    """Sentence count; fails the job when there are fewer labels.

    Evaluated inside the projection that uses it (not as a filter, which
    Catalyst would push below the scan-side exchange and evaluate twice)."""
    n = F.size(sentences)
    return F.when(F.size(labels) < n, F.raise_error(
        F.lit("article has fewer sentence_labels than sentences")).cast("int")).otherwise(n)


def explode_sentences(articles: DataFrame, keep=("domain", "split")) -> DataFrame:
    """One row per sentence: ``(article_id, *keep, pos, sentence, label, subtype)``.

    The arrays are zipped and sliced to the sentence count first so the
    generator copies only scalar outer columns per output row. Articles with
    no sentences produce no rows (their article label comes from the article
    row, see ``functions.labels.any_positive``).
    """
    n = checked_length()
    zipped = F.arrays_zip(
        F.col("sentences").alias("sentence"),
        F.slice("sentence_labels", 1, n).alias("label"),
        F.slice(F.coalesce("subtypes", F.array().cast("array<string>")), 1, n).alias("subtype"),
    )
    return (articles
            .select("article_id", *keep, F.posexplode(zipped).alias("pos", "z"))
            .select("article_id", *keep, "pos",
                    F.col("z.sentence").alias("sentence"),
                    F.col("z.label").alias("label"),
                    F.col("z.subtype").alias("subtype")))


def article_text(articles: DataFrame, max_len: int = 512) -> DataFrame:
    """B15 + B16: sentences joined by a space, word tokens cut to ``max_len``."""
    text = F.array_join("sentences", " ")
    return (articles
            .withColumn("text", text)
            .withColumn("tokens", tokens("text"))
            .withColumn("tokens_kept", F.slice("tokens", 1, max_len)))
