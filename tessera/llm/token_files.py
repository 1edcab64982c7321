"""Token-id files: ids in id order with Elias-Fano document boundaries.

A file set is a folder of Parquet parts, which any store that Spark writes can
hold. A row is one block: documents in ascending id order, ``payload`` in the
binary layout below. Blocks are ordered by (shard, block).

Payload, little-endian: magic ``TKEF``, u8 bytes per id, u8 low bits, u16 zero,
u64 documents, u64 ids, u64 words of the upper part; the lower bits of all
boundaries (bit-packed, padded to 8 bytes), the upper part (u64 words), the
positions of every 64th set bit (u32), the ids.

Boundary i is the number of ids up to and with document i. Its low bits are stored
as they are; its high part h_i sets bit h_i + i of the upper part. ``select``
finds the i-th set bit from the nearest sample. That takes about
2 + log2(ids / documents) bits a document instead of 64.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, text_batches, whole_text
from tessera.llm.tokens import Encoder

HEAD = struct.Struct("<4sBBHQQQ")
MAGIC, SAMPLE = b"TKEF", 64


def _padded(n: int) -> int:
    return -(-n // 8) * 8


class EliasFano:
    """A monotone sequence in near-minimal space."""

    def __init__(self, n: int, low_bits: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.lower, self.upper, self.samples = n, low_bits, lower, upper, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = np.asarray(values, np.uint64)
        most = int(values[-1]) if n else 0
        low = max(0, (most // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        lower = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        flags = np.zeros(_padded((most >> low) + n + 1) * 8, np.uint8)
        flags[at] = 1
        upper = np.packbits(flags, bitorder="little").view("<u8")
        return cls(n, low, np.append(lower, np.zeros(_padded(len(lower)) - len(lower), np.uint8)),
                   upper, at[::SAMPLE].astype("<u4"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bits = np.unpackbits(self.lower, bitorder="little")
        grid = bits[i[:, None] * self.low_bits + np.arange(self.low_bits)]
        return grid.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits))

    def select(self, i: int) -> int:
        """Value i: from the sample at or before it, words are skipped by their bit counts."""
        at = int(self.samples[i // SAMPLE])
        word, left = at >> 6, i % SAMPLE
        bits = int(self.upper[word]) >> (at & 63) << (at & 63)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            word += 1
            bits = int(self.upper[word])
        for _ in range(left):
            bits &= bits - 1
        at = (word << 6) + (bits & -bits).bit_length() - 1
        first = i * self.low_bits
        span = self.lower[first >> 3:(first + self.low_bits + 7) >> 3].tobytes()
        low = int.from_bytes(span, "little") >> (first & 7) & ((1 << self.low_bits) - 1)
        return (at - i) << self.low_bits | low

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """Values ``i``, as ``select`` finds them, for many at a time."""
        i = np.asarray(i, np.int64)
        at = self.samples[i // SAMPLE].astype(np.int64)
        word, left = at >> 6, i % SAMPLE
        cut = (at & 63).astype(np.uint64)
        bits = self.upper[word] >> cut << cut
        todo = np.arange(len(i))
        while len(todo):  # words are skipped by their bit counts
            ones = np.bitwise_count(bits[todo]).astype(np.int64)
            far = ones <= left[todo]
            todo = todo[far]
            left[todo] -= ones[far]
            word[todo] += 1
            bits[todo] = self.upper[word[todo]]
        at = word << 6
        for half in (32, 16, 8, 4, 2, 1):  # the set bit wanted in its word
            part = bits & np.uint64((1 << half) - 1)
            ones = np.bitwise_count(part).astype(np.int64)
            up = ones <= left
            left -= np.where(up, ones, 0)
            at += np.where(up, half, 0)
            bits = np.where(up, bits >> np.uint64(half), part)
        return (at - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.upper.view(np.uint8), bitorder="little"))
        i = np.arange(self.n)
        return (at - i) << self.low_bits | self._low(i)


def encode_block(docs: list[np.ndarray], width: int) -> bytes:
    ends = EliasFano.of(np.cumsum([len(d) for d in docs]))
    ids = np.concatenate(docs).astype(f"<u{width}")
    head = HEAD.pack(MAGIC, width, ends.low_bits, 0, ends.n, len(ids), len(ends.upper))
    return b"".join([head, ends.lower.tobytes(), ends.upper.tobytes(), ends.samples.tobytes(), ids.tobytes()])


def decode_block(payload: bytes) -> tuple[EliasFano, np.ndarray]:
    magic, width, low, _, n, n_ids, words = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = HEAD.size

    def take(count, kind):
        nonlocal at
        got = np.frombuffer(payload, kind, count, at)
        at += got.nbytes
        return got

    lower = take(_padded(-(-n * low // 8)), np.uint8)
    upper = take(words, "<u8")
    samples = take(-(-n // SAMPLE), "<u4")
    return EliasFano(n, low, lower, upper, samples), take(n_ids, f"<u{width}")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2,
                      id_col: str = "doc_id", text_col: str = "text",
                      ids_per_block: int = 1 << 20, width: int = 2) -> None:
    """Encode ``docs`` and write them at ``path`` in ascending id order (nulls last).

    A null text is empty: its ids are ``end_id`` alone. Rows that repeat an id stay apart,
    ordered by a hash of their text. Other columns are ignored; no rows give an
    empty file set. A block has ``ids_per_block`` ids or one document at least.
    """
    def blocks(batches):
        from pyspark import TaskContext
        shard, block = TaskContext.get().partitionId(), 0
        enc, names, held, size = Encoder.of(tokenizer), [], [], 0

        def row():
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()),
                "doc_ids": pa.array([names], pa.list_(pa.int64())),
                "n_ids": pa.array([size], pa.int64()),
                "payload": pa.array([encode_block(held, width)], pa.binary())})

        for batch in text_batches(batches):
            for name, ids in zip(batch["id"].to_pylist(), enc.encode(batch["text"])):
                if len(ids) and int(ids.max()) >> (8 * width):
                    raise ValueError(f"an id needs more than {width} bytes")
                names.append(name)
                held.append(np.append(ids, np.uint32(end_id)).astype(f"<u{width}"))
                size += len(ids) + 1
                if size >= ids_per_block:
                    yield row()
                    names, held, size, block = [], [], 0, block + 1
        if names:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the row's number lets equal rows, which may be a third of all, be dealt to several tasks
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    order = [F.col("id").isNull(), F.col("id"), F.xxhash64(whole_text("text")), F.col("row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    (map_arrow(rows.drop("row"), blocks, "shard int, block int, doc_ids array<long>, n_ids long, payload binary")
     .write.option("compression", "zstd").parquet(path))


def read_token_files(spark: SparkSession, path: str, *, id_col: str = "doc_id",
                     with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of each document, from the files alone."""
    files = spark.read.parquet(path)
    schema = ("shard int, block int, id long, at long, n_tokens long, ids_crc32 long"
              + ", ids array<int>" * with_ids)

    def documents(batches):
        for batch in batches:
            for shard, block, names, payload in zip(*(batch[c].to_pylist() for c in (
                    "shard", "block", "doc_ids", "payload"))):
                ends, ids = decode_block(payload)
                end = ends.select_many(np.arange(ends.n))
                start = np.append(0, end[:-1])
                wide = ids.astype("<u4")
                parts = [wide[a:b] for a, b in zip(start.tolist(), end.tolist())]
                cols = {"shard": pa.array([shard] * len(names), pa.int32()),
                        "block": pa.array([block] * len(names), pa.int32()),
                        "id": pa.array(names, pa.int64()), "at": pa.array(start, pa.int64()),
                        "n_tokens": pa.array(end - start, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    # where each block begins: blocks are summed within their shard, shards over the set
    sizes = files.select("shard", "block", "n_ids")
    whole = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("shard_at"))
    own = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("shard", "block", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias(
        "block_at")).join(shards, "shard")
    rows = map_arrow(files.select("shard", "block", "doc_ids", "payload"), documents, schema)
    return rows.join(begins, ["shard", "block"]).select(
        F.col("id").alias(id_col), (F.col("shard_at") + F.col("block_at") + F.col("at")).alias("start"),
        "n_tokens", "ids_crc32", *["ids"] * with_ids)
