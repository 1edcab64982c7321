"""Lexicon sources: bias term list (A2) and subjectivity clues (A3).

Both parse a table of ``(line_no, value)`` text lines. Files are read line by
line in as many splits as Spark makes; ``line_no`` orders lines by file, split
and row for the last-wins rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import py_strip

LINES_SCHEMA = "line_no int, value string"


def lines_from_text(spark: SparkSession, path: str) -> DataFrame:
    """Text file -> (line_no, value); a missing path gives no lines."""
    try:
        lines = spark.read.text(path)
        lines.schema  # resolve now so a missing path is caught here
    except AnalysisException:
        return spark.createDataFrame([], LINES_SCHEMA)
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("row"))
    return lines.select(order.alias("line_no"), "value")


def lines_from_list(spark: SparkSession, lines: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), LINES_SCHEMA)


def _not_blank(v: Column) -> Column:
    return F.length(py_strip(v)) > 0


def parse_bias_lexicon(lines: DataFrame) -> DataFrame:
    """Strip + lower; blank dropped; ``#`` tested on the raw line."""
    v = F.col("value")
    return (lines.filter(_not_blank(v) & ~v.startswith("#"))
            .select(F.lower(py_strip(v)).alias("term"))
            .distinct())


def _last_value(pieces: Column, key: str) -> Column:
    """Value of the last ``key=value`` piece for ``key`` (dict update order)."""
    hits = F.filter(pieces, lambda p: F.substring_index(p, "=", 1) == key)
    last = F.try_element_at(hits, F.lit(-1))
    return F.substring_index(last, "=", -1)


def parse_subjectivity_lexicon(lines: DataFrame) -> DataFrame:
    """``word1`` lower-cased -> ``priorpolarity`` (default
    neutral); comment and blank lines skipped; a piece with two ``=`` fails
    the job; rows without a word dropped; a later line wins (R8)."""
    v = F.col("value")
    pieces = F.filter(F.split(py_strip(v), r"\s+"), lambda p: F.instr(p, "=") > 0)
    parsed = (lines.filter(_not_blank(v) & ~v.startswith("#"))
              .select("line_no", pieces.alias("kv")))
    bad = F.exists("kv", lambda p: F.size(F.split(p, "=")) != 2)
    parsed = parsed.filter(F.when(bad, F.raise_error(F.lit("malformed key=value piece in lexicon line")))
                           .otherwise(F.lit(True)))
    rows = parsed.select(
        "line_no",
        F.lower(F.coalesce(_last_value(F.col("kv"), "word1"), F.lit(""))).alias("word"),
        F.coalesce(_last_value(F.col("kv"), "priorpolarity"), F.lit("neutral")).alias("polarity"),
    ).filter(F.col("word") != "")
    # last wins: partial aggregate, no window sort needed
    return rows.groupBy("word").agg(F.max_by("polarity", "line_no").alias("polarity"))


def load_bias_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return parse_bias_lexicon(lines_from_text(spark, path))


def load_subjectivity_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return parse_subjectivity_lexicon(lines_from_text(spark, path))


# ---------------------------------------------------------------------------
# Stand-in lexicons for the driver's documents table (FIXTURES.md section 3);
# this repo's own choice. The bias lines also exercise the parsing rules
# (comment, blank, upper case, duplicate, indented '#', multi-word entry).
TESTDATA_BIAS_LINES = (
    "# stand-in bias terms",
    "trash",
    "  Scum  ",
    "",
    "idiot",
    "clown",
    "CLOWN",
    "   ",
    " #x",
    "so-called",
    "freedom fighter",
)
TESTDATA_SUBJECTIVITY_LINES = (
    "# stand-in subjectivity clues",
    "type=weaksubj len=1 word1=with pos1=prep stemmed1=n priorpolarity=positive",
    "type=weaksubj len=1 word1=for pos1=prep stemmed1=n priorpolarity=negative",
    "type=weaksubj len=1 word1=for pos1=prep stemmed1=n priorpolarity=positive",
    "type=weaksubj len=1 word1=That pos1=pron stemmed1=n priorpolarity=positive",
    "type=strongsubj len=1 word1=was pos1=verb stemmed1=n priorpolarity=negative",
    "type=strongsubj len=1 word1=worthless pos1=adj stemmed1=n priorpolarity=negative",
    "type=strongsubj len=1 word1=pathetic pos1=adj stemmed1=n priorpolarity=negative",
    "type=weaksubj len=1 word1=on pos1=prep stemmed1=n priorpolarity=neutral",
    "type=weaksubj len=1 word1=the pos1=det stemmed1=n priorpolarity=both",
    "type=weaksubj len=1 pos1=adj stemmed1=n priorpolarity=negative",
    "",
)
# ---------------------------------------------------------------------------


def testdata_bias_lexicon(spark: SparkSession) -> DataFrame:
    return parse_bias_lexicon(lines_from_list(spark, TESTDATA_BIAS_LINES))


def testdata_subjectivity_lexicon(spark: SparkSession) -> DataFrame:
    return parse_subjectivity_lexicon(lines_from_list(spark, TESTDATA_SUBJECTIVITY_LINES))


def write_lexicon_file(spark: SparkSession, lines: Sequence[str], path: str) -> str:
    """Write lines as one text file (one small part file) and return the folder."""
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1) \
        .write.mode("overwrite").text(path)
    return path
