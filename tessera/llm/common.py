"""Helpers shared by the operators: written tables, row ids, words and edges."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_path

#: Characters that separate words, as a Java regular expression class.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    It cuts the lineage: a lost executor costs a read of the table, not a
    second run of what made it, and each later job sees the same rows.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package's sources, once per Spark context.

    So kernels are imported there by name (a worker keeps its memo between
    tasks) and nothing needs to be installed on the workers.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    files = sorted(os.path.join(d, n) for d, _, names in os.walk(root) for n in names if n.endswith(".py"))
    digest = hashlib.sha256()
    for f in files:
        with open(f, "rb") as src:
            digest.update(f.encode() + src.read())
    name = f"tessera_{digest.hexdigest()[:12]}.zip"
    if name in spark.sparkContext._python_includes:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), name)
    with zipfile.ZipFile(path, "w") as z:
        for f in files:
            z.write(f, os.path.relpath(f, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)


def map_arrow(df: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with a kernel of this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(kernel, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def row_key(id_col: str, rid: str = "_rid") -> Column:
    """Order of rows: id, nulls last, then the row's place in the table.

    ``_rid`` (see ``with_rid``) is unique, so rows that repeat an id stay apart.
    """
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"),
                    F.col(rid).alias("rid"))


def _scans_parquet(df: DataFrame) -> bool:
    """Whether ``df`` is a Parquet scan with columns chosen or computed, one row per stored row."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return (plan.nodeName() == "LogicalRelation" and not plan.isStreaming()
            and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"
            and plan.relation().fileFormat().toString() == "Parquet")


def in_files(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` if it is a scan of Parquet files, else what is written of it once.

    For operators that scan their input more than once: ``file_seed`` needs files.
    """
    return df if _scans_parquet(df) else written(df, name)


class FileNumbers(NamedTuple):
    """How rows are numbered: a hash of the file's path, then ``bits`` bits of the row's place in the file."""
    seed: int
    bits: int

    def of(self, path: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), path), self.bits + 1)


def free_numbers(paths: DataFrame, last: int, tries: int = 64) -> FileNumbers:
    """Numbers with which no two of ``paths`` (column file, each once) meet, for files whose last row is ``last``.

    What the rows' places leave of 63 bits tells files apart, so a seed is found at once: a million files of
    128 MB with up to a million rows each have 43 bits. Numbers are counted by Spark, none is collected.
    """
    bits = max(10, int(last).bit_length())
    for seed in range(tries):
        numbers = FileNumbers(seed, bits)
        files = paths.select(numbers.of(F.col("file")).alias("no")).agg(
            F.count("*"), F.count_distinct("no")).first()
        if files[0] == files[1]:
            return numbers
    raise ValueError(f"{files[0]} files with up to {last + 1} rows are too many to number their rows in 63 bits")


def file_seed(docs: DataFrame) -> FileNumbers:
    """Numbers for ``with_rid`` with which no two rows of ``docs``, a table from ``in_files``, share one."""
    meta = docs.metadataColumn("_metadata")
    files = docs.groupBy(meta["file_path"].alias("file")).agg(F.max(meta["row_index"]).alias("last"))
    files = written(files, "files")
    return free_numbers(files, files.agg(F.max("last")).first()[0] or 0)


def with_rid(df: DataFrame, numbers: FileNumbers | None = None, rid: str = "_rid") -> DataFrame:
    """``df`` with a unique number of each row.

    With ``numbers`` from ``file_seed`` it is the file's number and the row's place in the file: the
    same in each scan. Without, it is ``monotonically_increasing_id()`` and holds for one scan only: how
    files are split follows the cores that are registered when a job is planned.
    """
    if numbers is None:
        return df.withColumn(rid, F.monotonically_increasing_id())
    meta = df.metadataColumn("_metadata")
    return df.withColumn(rid, F.shiftleft(numbers.of(meta["file_path"]), numbers.bits) + meta["row_index"])


def rows_with(docs: DataFrame, rids: DataFrame, seed: FileNumbers, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` joined with ``rids`` on ``_rid``: (row, and the columns of ``rids``).

    ``row`` holds all columns of ``docs``, so none can clash; ``rids`` has each ``_rid`` once, made
    with the same numbers from the same table (see ``in_files``).
    """
    return with_rid(docs.select(F.struct("*").alias("row")), seed).join(rids, "_rid", how)


def text_batches(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20,
                 col: str = "text") -> Iterable[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text (a row at least)."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(col)).nbytes
        if sizes <= limit:
            if batch.num_rows:
                yield batch
            continue
        import numpy as np
        import pyarrow.compute as pc
        n = pc.binary_length(batch.column(batch.schema.get_field_index(col))).fill_null(0)
        block = np.cumsum(n.to_numpy(zero_copy_only=False)) // limit
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (u long, v long): (node, root), root the smallest node.

    Alternating large-star and small-star steps. Each is a grouped minimum and
    a join on the node; no node's neighbours are collected. Each round is
    written to the shared folder; the number of rounds is logarithmic.
    Nodes without an edge to another node are not returned.
    """
    cur = written(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)

    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(cur)
    while before[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        large = written(large.distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v > m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        cur = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        after = state(cur)
        if tuple(after) == tuple(before):
            break
        before = after
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
