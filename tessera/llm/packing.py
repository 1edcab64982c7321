"""Packing documents into fixed-length sequences, shortest pack first.

Documents are tokenised and cut into full pieces and a rest. The histogram of
piece lengths (one row per length) is packed on the driver: lengths go longest
first, each into the pattern with the most room; what fits nowhere opens new
sequences of as many pieces of that length as fit. Counts of patterns are
updated, never single documents. Pieces get a gapless rank within their length,
and a slot table (length, rank range) turns the rank into a sequence and offset.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, text_batches, with_rid, written
from tessera.llm.tokens import Encoder

#: A slot's key is its length times this, plus its first rank.
RANKS = 1 << 40


def pieces(docs: DataFrame, tokenizer: str, *, end_id: int, max_tokens: int, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(_rid, id, start, length, ids_crc32, doc_tokens[, ids]): consecutive pieces of each document."""
    schema = ("_rid long, id long, start long, length long, ids_crc32 long, doc_tokens long"
              + ", ids array<int>" * with_ids)
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches):
        enc = Encoder.of(tokenizer)
        for batch in text_batches(batches):
            cols = {n: [] for n in names}
            for rid, doc, ids in zip(batch["_rid"].to_pylist(), batch["id"].to_pylist(),
                                     enc.encode(batch["text"])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for a in range(0, len(ids), max_tokens):
                    part = ids[a:a + max_tokens]
                    row = (rid, doc, a, len(part), zlib.crc32(part), len(ids), part.astype(np.int32))
                    for n, v in zip(names, row):
                        cols[n].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[n], pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n in names], names)

    rows = with_rid(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return map_arrow(rows.select("_rid", "id", "text"), cut, schema)


def pack_histogram(counts: dict[int, int], max_tokens: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern of lengths, how often), for a histogram {length: count}."""
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(max_tokens + 1)]
    for length in sorted(counts, reverse=True):
        left, space = counts[length], max_tokens
        while left:
            while space >= length and not room[space]:
                space -= 1
            if space < length:
                each = max_tokens // length  # a new sequence takes the next of its length while they fit
                for k, n in ((each, left // each), (left % each, 1)):
                    if k and n:
                        room[max_tokens - k * length].append(((length,) * k, n))
                break
            pattern, n = room[space].pop()
            used = min(n, left)
            if n > used:
                room[space].append((pattern, n - used))
            room[space - length].append(((*pattern, length), used))
            left -= used
    return [p for open_ in room for p in open_]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (key, first sequence, offset), sorted by key = length * RANKS + first rank."""
    out, rank, sequence = [], {}, 0
    for pattern, n in patterns:
        at = 0
        for length in pattern:
            r = rank.get(length, 0)
            out.append((length * RANKS + r, sequence, at))
            rank[length] = r + n
            at += length
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def ranked(cut: DataFrame, rows_per_bucket: int = 20_000) -> DataFrame:
    """Adds ``rank``: gapless from 0 within each length.

    Pieces of a length go to buckets by hash; a bucket's first rank is the prefix
    sum of the counts, so the many pieces of full length never meet in one task.
    """
    buckets = max(1, -(-cut.count() // rows_per_bucket))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("_rid", "start"), F.lit(buckets)))
    base = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    base = base.select("length", "bucket", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("_rid", "start"))
    return (cut.withColumn("own", own).join(base, ["length", "bucket"])
            .withColumn("rank", F.col("base") + F.col("own") - 1).drop("own", "base", "bucket"))


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 1, max_tokens: int = 2048,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    Each token of each document (its ids, then ``end_id``) lies in one piece. A
    null or empty text is one piece of ``end_id``. Rows that repeat an id, and null
    ids, are documents of their own. Other columns are ignored. No rows
    give no rows. The slot table that tasks get has a row per slot of a pattern;
    patterns follow the number of lengths, not the number of documents.
    """
    cut = written(pieces(docs, tokenizer, end_id=end_id, max_tokens=max_tokens, id_col=id_col,
                         text_col=text_col, with_ids=with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    table = cut.sparkSession.sparkContext.broadcast(slots(pack_histogram(counts, max_tokens)))

    def place(batches):
        at = table.value
        for batch in batches:
            key = (batch["length"].to_numpy() * RANKS + batch["rank"].to_numpy())
            k = np.searchsorted(at[:, 0], key, "right") - 1
            yield (batch.append_column("sequence_id", pa.array(at[k, 1] + key - at[k, 0]))
                   .append_column("offset", pa.array(at[k, 2])))

    cols = [c for c in cut.columns if c != "length"]
    res = ranked(cut).select("length", "rank", *cols)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in res.schema),
                        "sequence_id long", "offset long"])
    return map_arrow(res, place, schema).select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
        *["ids"] * with_ids)
