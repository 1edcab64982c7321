"""Exact dedup by distributed most-significant-digit radix partitioning.

A document's key is its length followed by the bytes of its normalised text.
Each round splits every group by the next bytes of the key, as a grouped count
and a join on (group, bytes). Groups of one document and groups whose bytes have
ended are final and leave; only the others carry their remaining bytes into the
next round, whose digit is longer. No digest decides equality.

Skew: the counts combine before the shuffle. Groups of two or more are written, one
row each, so that the join has nothing but shuffles below it and AQE can split a group
that holds a third of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import FileNumbers, SPACES, file_seed, in_files, row_key, rows_with, whole_text, with_rid, written


def normalised(col: str = "text"):
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(whole_text(col), f"{SPACES}+", " ")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                first_bytes: int = 56, growth: int = 8, file_no: FileNumbers | None = None) -> DataFrame:
    """One row per input row: ``_rid``, id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other. Of equal texts the smallest id
    stays (null ids last); of rows that also repeat the id the first in the
    table stays, so exactly one row of each group is kept. Other columns of
    ``docs`` are ignored, whatever their names. An empty table gives no rows.
    ``text_sha256`` is output only. ``_rid`` is the row's place in the table
    (see ``common.with_rid``; ``file_no`` are its numbers, if the caller has them).
    """
    docs = in_files(docs)
    file_no = file_seed(docs) if file_no is None else file_no
    rows = with_rid(docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm")), file_no)
    rows = rows.select(
        "id", "_rid", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
        F.octet_length("norm").alias("group_no"), F.col("norm").cast("binary").alias("rest"))
    # the length is the key's first digit: all texts of a group end together
    done, size, first = [], first_bytes, True
    while True:
        cut = rows.withColumn("digit", F.substring("rest", 1, size)).withColumn(
            "rest", F.expr(f"substring(rest, {size + 1})"))
        keys = ["group_no", "digit"] if first else ["group_id", "digit"]
        groups = cut.groupBy(*keys).agg(F.min(row_key("id")).alias("keep"), F.count("*").alias("n"))
        groups = written(groups.where("n > 1"), "exact_groups")
        alone = F.col("n").isNull()
        ended = alone | (F.octet_length("rest") == 0)
        out = cut.join(groups.hint("merge"), keys, "left").select(  # one plan at every size
            "id", "_rid", "sha", F.coalesce("n", F.lit(1)).alias("n"),
            F.coalesce("keep", row_key("id")).alias("group_id"),
            F.when(~ended, F.col("rest")).alias("rest"))
        out = written(out, "exact_dedup")
        done.append(out.where("rest IS NULL").drop("rest"))
        rows = out.where("rest IS NOT NULL").drop("n")
        if rows.isEmpty():
            break
        first, size = False, size * growth
    res = done[0]
    for x in done[1:]:
        res = res.unionByName(x)
    return res.select(
        "_rid", F.col("id").alias(id_col), F.col("group_id.id").alias("keep_id"),
        F.col("n").alias("group_size"), (F.col("group_id.rid") == F.col("_rid")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = in_files(docs)
    seed = file_seed(docs)
    kept = exact_dedup(docs, file_no=seed, **params).where("kept").select("_rid")
    return rows_with(docs, kept, seed).select("row.*")
