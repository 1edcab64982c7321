"""Line dedup: repeated windows of three lines, later occurrences removed.

Only DataFrame functions. Every three consecutive lines are hashed (two 64-bit
hashes with different seeds, 128 bits). A grouped minimum gives each repeated
window's first occurrence in the whole table; a join marks the later ones; the
positions that these cover are merged into spans for each document and cut out.

Skew: the minimum combines before the shuffle; repeated windows are written, one row
each, so that AQE can split the join at a window that is in a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import FileNumbers, file_seed, in_files, row_key, rows_with, whole_text, with_rid, written

WIDTH = 3


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               file_no: FileNumbers | None = None) -> DataFrame:
    """One row per input row: ``_rid``, id, n_lines, n_removed, n_spans, text (what is left).

    Lines are split at \\n and compared as they are, empty ones too. Occurrences
    are ordered by id (nulls last), the row's place, then position; all but
    the first are removed, also within one document, and spans that overlap or
    touch count as one. Null text is empty: one empty line. A text of fewer
    than three lines stays whole. Other columns are ignored. No rows give no
    rows. ``_rid`` holds for one scan, or with ``file_no`` from ``common.file_seed`` for all.
    """
    docs = in_files(docs)
    seed = file_seed(docs) if file_no is None else file_no
    base = with_rid(docs.select(F.col(id_col).alias("id"), F.split(whole_text(text_col), "\n").alias("lines")), seed)

    def at(arr, i, k):
        return F.get(arr, i + k)

    hashed = base.select(
        "id", "_rid", F.transform("lines", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(7), x)).alias("b"))
    windows = hashed.where(F.size("a") >= WIDTH).select("id", "_rid", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("a") - WIDTH),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(at(F.col("a"), i, 0), at(F.col("a"), i, 1), at(F.col("a"), i, 2)).alias("h1"),
            F.xxhash64(at(F.col("b"), i, 0), at(F.col("b"), i, 1), at(F.col("b"), i, 2)).alias("h2"),
        ))).alias("w")).select("id", "_rid", "w.pos", "w.h1", "w.h2")
    windows = written(windows, "line_windows")

    place = F.struct(row_key("id").alias("row"), F.col("pos"))
    first = (windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("h1", "h2", "first"))
    first = written(first, "line_repeats")
    later = windows.join(first.hint("merge"), ["h1", "h2"]).where(  # one plan at every size
        (F.col("first.row.rid") != F.col("_rid")) | (F.col("first.pos") != F.col("pos")))

    in_doc = Window.partitionBy("_rid").orderBy("pos")
    spans = later.select("_rid", "pos").withColumn(
        "new", F.coalesce(F.col("pos") > F.lag("pos").over(in_doc) + WIDTH, F.lit(True)).cast("int"))
    spans = spans.withColumn("span", F.sum("new").over(
        in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("_rid", "span").agg(
        F.min("pos").alias("lo"), (F.max("pos") + WIDTH).alias("hi"))
    spans = spans.groupBy("_rid").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))

    given = base.withColumn("given", F.monotonically_increasing_id() if file_no is None else F.col("_rid"))
    out = given.join(spans, "_rid", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")))
    gaps = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.col("spans.hi")).alias("lo"),
        F.concat(F.col("spans.lo"), F.array(F.size("lines"))).alias("hi"))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(
        F.col("lines"), g["lo"] + 1, g["hi"] - g["lo"])))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + (s["hi"] - s["lo"]))
    return out.select(
        F.col("given").alias("_rid"), F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"),
        removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.array_join(kept, "\n").alias(text_col))


def drop_repeated_lines(docs: DataFrame, *, text_col: str = "text", **params) -> DataFrame:
    """``docs`` with all columns, the text replaced by what is left of it."""
    docs = in_files(docs)
    seed = file_seed(docs)
    left = line_dedup(docs, text_col=text_col, file_no=seed, **params).select("_rid", F.col(text_col).alias("left"))
    return rows_with(docs, left, seed, "inner").select(*[
        F.col("left").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
