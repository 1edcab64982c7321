"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Only DataFrame functions. Sizes and sampling keys are computed once and
written as a narrow table. A source's target gives its number of complete
epochs (every document once each) and a rest, which a weighted sample without
replacement fills: documents in ascending order of -ln(u)/w, prefix-summed to the
budget. Instead of sorting a whole source, its keys are cut into ranges; the
ranges' sizes are prefix-summed and only the range where the budget ends is
looked into. Rows that repeat a key (a repeated id) are cut once more, by a hash of the
row's number, so neither a source nor an id with a third of all rows is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import FileNumbers, WORD, file_seed, in_files, rows_with, whole_text, with_rid, written


def word_count(col: str = "text") -> Column:
    return F.regexp_count(whole_text(col), F.lit(WORD)).cast("long")


def quality_weight(size: Column, n_chars: Column) -> Column:
    """Weight in (0, 1]: near 1 for texts with words of usual length that are not tiny."""
    mean = n_chars / F.greatest(size, F.lit(1))
    near = F.lit(6.0) / (F.lit(6.0) + F.abs(mean - F.lit(6.0)))
    return F.greatest(near * (size / (size + F.lit(20.0))), F.lit(0.01))


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) from md5 of the seed and the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    whole = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return (whole + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in order of code points, null last, take the weights in turn. The
    targets share the total; a target stops at ``cap`` times the source's size
    and the excess goes to the others by weight. In order of cap / weight the
    sources that stop come first, so one prefix sum finds the level. This
    table has a row per source; its windows are over those rows only.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("most", F.col("source_size") * float(cap))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding,
                                                      Window.unboundedFollowing)
    per = per.withColumns({
        "total": F.sum("source_size").over(everything),
        "left_size": F.sum("source_size").over(everything)
        - F.coalesce(F.sum("most").over(below), F.lit(0.0)),
        "left_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0.0))})
    # the level if this source and all after it are not capped; it holds from the first that isn't
    level = F.when(F.col("left_size") / F.col("left_w") * F.col("w") <= F.col("most"),
                   F.col("left_size") / F.col("left_w"))
    per = per.withColumn("level", F.max(level).over(everything))
    return per.select("source", "source_size", F.coalesce(
        F.least(F.col("most"), F.col("level") * F.col("w")), F.col("most")).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights=(5, 2, 1), cap: int = 3, seed: int = 17,
        rows_per_range: int = 2_000, broadcast_sources: int = 5_000, file_no: FileNumbers | None = None) -> DataFrame:
    """One row per document: ``_rid``, id, size, source_size, target, copies, taken, weight, key.

    ``copies`` is how often the mix takes the document whole, ``taken`` its words
    counted so often (at most ``cap`` times its size). A null text has size 0;
    a null source is a source; null ids share one sampling key. Documents with
    equal keys are ordered by id, then size, then a hash of their place in the table (see
    ``common.with_rid``), so reruns with ``file_no`` give the same rows. A source's taken words differ from its target by
    half a document at most. Other columns are ignored. No rows give no rows.
    ``rows_per_range`` sets how many key ranges a source gets; the join is
    broadcast only if there are at most ``broadcast_sources`` sources. ``_rid`` holds
    for one scan, or with ``file_no`` from ``common.file_seed`` for all.
    """
    size = word_count(text_col)
    narrow = with_rid(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"),
        F.length(whole_text(text_col)).alias("n_chars")), file_no)
    narrow = narrow.withColumn("weight", quality_weight(F.col("size"), F.col("n_chars")))
    narrow = narrow.withColumn("u", uniform(F.col("id"), seed))
    narrow = written(narrow.select("_rid", "id", "source", "size", "weight",
                                   (-F.log("u") / F.col("weight")).alias("key")), "mix_sizes")
    small = narrow.select("source").distinct().limit(broadcast_sources + 1).count() <= broadcast_sources
    hint = F.broadcast if small else (lambda df: df)

    per = source_targets(narrow, weights, cap)
    rows = narrow.groupBy("source").agg(F.count("*").alias("n"), F.avg("weight").alias("mean_w"))
    per = per.join(rows, per.source.eqNullSafe(rows.source)).drop(rows.source)
    per = per.withColumns({
        "epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(F.lit(0)).cast("long"),
        "n_ranges": F.ceil(F.col("n") / F.lit(rows_per_range)).cast("long")})
    per = written(per.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")),
                  "mix_sources")

    def beside(df, other):
        return df.join(hint(other.withColumnRenamed("source", "_s")),
                       F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    # keys are about exponential with rate mean_w; ranges of equal probability
    place = F.floor(F.col("n_ranges") * (F.lit(1.0) - F.exp(-F.col("key") * F.col("mean_w"))))
    rows = beside(narrow, per).withColumn("range", F.least(place, F.col("n_ranges") - 1))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"), F.count("*").alias("range_rows"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    ends = beside(sums, per.select("source", "budget")).where(
        "before <= budget AND budget < before + range_size")
    ends = ends.select("source", F.col("range").alias("end_range"), F.col("before").alias("end_before"),
                       F.ceil(F.col("range_rows") / F.lit(rows_per_range)).alias("n_slots"))
    per = written(per.join(ends.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")),
                           "left").drop("_s"), "mix_ends")
    rows = beside(narrow, per).withColumn("range", F.least(place, F.col("n_ranges") - 1))

    # in the end range, rows equal in key, id and size are cut into slots by a hash of their number
    tie = F.pmod(F.xxhash64("_rid", F.lit(seed)), F.lit(1 << 30))
    cut = rows.where("range = end_range").withColumn("tie", tie).withColumn(
        "part", F.struct("key", "id", "size", F.floor(F.col("tie") * F.col("n_slots") / F.lit(1 << 30)).alias("slot")))
    parts = cut.groupBy("source", "part", "end_before", "budget").agg(F.sum("size").alias("part_size"))
    so_far = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.col("end_before") + F.coalesce(F.sum("part_size").over(so_far), F.lit(0)))
    last = written(parts.where("before <= budget AND budget < before + part_size").select(
        "source", F.col("part").alias("end_part"), F.col("before").alias("part_before")), "mix_parts")
    cut = beside(cut, last)
    whole = rows.where("end_range IS NULL OR range <> end_range").withColumn(
        "more", F.when(F.col("end_range").isNull(), F.lit(0)).otherwise(
            (F.col("range") < F.col("end_range")).cast("int")))
    in_order = Window.partitionBy("source").orderBy("tie", "_rid").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("part_before") + F.coalesce(F.sum("size").over(in_order), F.lit(0))
    at_end = cut.where("part = end_part").withColumn(
        "more", (ahead + F.col("size") / 2 <= F.col("budget")).cast("int"))
    others = cut.where("part <> end_part").withColumn("more", (F.col("part") < F.col("end_part")).cast("int"))
    cut = others.unionByName(at_end).drop("tie", "part", "end_part", "part_before")
    out = whole.unionByName(cut).withColumn(
        "copies", F.least(F.col("epochs") + F.col("more"), F.lit(cap)).cast("long"))
    return out.select("_rid", F.col("id").alias(id_col), "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"), "weight", "key")


def mixed(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with all columns, each row as often as the mix takes it."""
    docs = in_files(docs)
    file_no = file_seed(docs)
    taken = mix(docs, file_no=file_no, **params).where("copies > 0").select("_rid", "copies")
    rows = rows_with(docs, taken, file_no, "inner")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
