"""Sinks (A8-A13). Result tables are Parquet directories; CSV is an export.

Layout under a results root, one folder per run::

    <root>/<run>/metrics/                 A9  (appended, one row per record)
    <root>/<run>/predictions/             A10 (overwritten)
    <root>/<run>/<model>_by_subtype/      A11 (only when rows exist)
    <root>/<run>/model/                   A13
    <root>/main_results/, subtype/        A12

Articles and their vectors can be stored for later runs: a folder per split, and in it rows bucketed by
article id, so a split filter reads one folder and joins on the id need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import METRICS_SCHEMA
from ..session import shared_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it: what comes after it, however
    often it is used, computes it no second time and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_by_article(df: DataFrame, table: str, path: str, buckets: int, by_split: bool = True) -> DataFrame:
    """Write rows with an ``article_id`` as an external table in ``path``, bucketed by it (and in a folder for each
    ``split``), and read it. Tables with equally many buckets join on ``article_id`` without an exchange.

    Rows go to their bucket's task first, so a bucket has one file for each split, not one for each task."""
    out = df.repartition(buckets, "article_id").write.bucketBy(buckets, "article_id").sortBy("article_id")
    out = out.partitionBy("split") if by_split else out
    out.format("parquet").option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def buckets_for(source: DataFrame, growth: float = 1.0, bucket_bytes: int = 256 << 20) -> int:
    """Buckets of about ``bucket_bytes`` each, at least one for each core, for what is made of a scan of files
    and is ``growth`` times as large. Reads the files' sizes, no columns."""
    meta = source.metadataColumn("_metadata")
    files = source.select(meta["file_path"].alias("file"), meta["file_size"].alias("size")).distinct()
    n_bytes = files.agg(F.sum("size")).first()[0] or 0
    return max(source.sparkSession.sparkContext.defaultParallelism, int(-(-n_bytes * growth // bucket_bytes)))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, UTF-8 (not ASCII-escaped)."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def metrics_row(metrics: DataFrame, model: str, domain: str, split: str, notes: str,
                counts: bool = False) -> DataFrame:
    """Metrics with provenance columns in the fixed order (B24); ``counts`` adds the
    number of rows and of gold positives."""
    return metrics.select(
        F.lit(model).alias("model"), F.lit(domain).alias("domain"), F.lit(split).alias("split"),
        "accuracy", "precision", "recall", "f1", F.lit(notes).alias("notes"),
        *[F.col("n"), (F.col("tp") + F.col("fn")).alias("n_pos")] * counts)


def dump_result_row(row: DataFrame, out_dir: str, name: str = "metrics", fmt: str = "parquet") -> None:
    """Append; the schema is fixed so appends never corrupt the table.
    A metrics row is one tiny row, hence a single file per append. ``fmt="csv"``
    appends to ``<name>.csv`` with a header in each file."""
    cols = [c.name for c in METRICS_SCHEMA.fields]
    extra = [c for c in row.columns if c not in cols]
    out = row.select(*[c for c in cols if c in row.columns], *extra).coalesce(1).write.mode("append")
    path = f"{out_dir.rstrip('/')}/{name}"
    out.option("header", True).csv(f"{path}.csv") if fmt == "csv" else out.parquet(path)


def write_predictions(preds: DataFrame, out_dir: str, name: str = "predictions") -> None:
    """A10: ``(article_id, y_true, y_pred)``, overwritten; stays partitioned."""
    preds.select("article_id", F.col("y_true").cast("int"), F.col("y_pred").cast("int")) \
        .write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{name}")


def write_subtypes(rows: DataFrame, out_dir: str, model: str, fmt: str = "parquet") -> bool:
    """Per-subtype table, written only when it has rows."""
    rows = rows.persist()  # one row per subtype; computed once for both steps
    try:
        if rows.isEmpty():
            return False
        out = rows.coalesce(1).write.mode("overwrite")
        path = f"{out_dir.rstrip('/')}/{model}_by_subtype"
        out.option("header", True).csv(f"{path}.csv") if fmt == "csv" else out.parquet(path)
        return True
    finally:
        rows.unpersist()


def write_summary(df: DataFrame, path: str) -> None:
    """Overwrite a summary table (small: one row per result)."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Optional CSV export with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
