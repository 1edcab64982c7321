"""SimHash near-dedup by exact comparison in tiles.

Fingerprints are made per document in Arrow batches, then made distinct. A
fingerprint's tile is the vector of the bit counts of its four 16-bit words.
Two fingerprints within ``radius`` bits have tiles whose counts differ by
``radius`` in sum at most, so all other tile pairs are skipped; the rest are compared
in full with numpy exclusive-or and bit counts. A large tile is cut into blocks of
bounded size. From a pair of blocks only a spanning forest of its links leaves,
so a dense group of g fingerprints gives about g rows for each pair of blocks.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import FileNumbers, components, file_seed, in_files, map_arrow, row_key, rows_with, text_batches, with_rid, written

WORDS = 4  # 16-bit words of a fingerprint
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """A bit is 1 if it is set in more than half of the shingles' XXH64 values."""
    text = b" ".join(text.translate(_LOWER).split())  # bytes split at ASCII white space only
    if not text:
        return 0
    space = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    n = len(space) + 2 - shingle
    if n <= 1:
        hashes = np.array([xxhash.xxh64_intdigest(text, seed)], np.uint64)
    else:
        begin = [0, *(space[:n - 1] + 1).tolist()]
        end = [*space[shingle - 1:].tolist(), len(text)]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(text[a:b], seed) for a, b in zip(begin, end)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k:k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8),
                             axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, shingle: int = 3, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text", file_no: FileNumbers | None = None) -> DataFrame:
    """(_rid, id, fp long): fp is the fingerprint's 64 bits as a signed long."""
    def make(batches):
        for batch in text_batches(batches):
            fps = [fingerprint(t or b"", shingle, seed)
                   for t in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "_rid": batch["_rid"], "id": batch["id"],
                "fp": pa.array(np.array(fps, np.uint64).view(np.int64))})

    rows = with_rid(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")),
                    file_no)
    return map_arrow(rows.select("_rid", "id", "text"), make, "_rid long, id long, fp long")


def tile_of(fp: Column) -> Column:
    """Bit counts of the four 16-bit words, as one number in base 32."""
    key = F.lit(0)
    for k in range(WORDS):
        word = F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))
        key = key + F.bit_count(word) * F.lit(32 ** k)
    return key.cast("int")


def near_tiles(radius: int) -> list[list[int]]:
    """Differences of bit counts with a sum of at most ``radius``; of each and its negative, one."""
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=WORDS)
             if sum(map(abs, d)) <= radius]
    return [list(d) for d in steps if d >= tuple(-x for x in d)]


def forest(left: np.ndarray, right: np.ndarray, radius: int, rows: int = 256):
    """Links between two blocks, reduced to a spanning forest: (u, v) arrays.

    A strip of ``rows`` rows is compared at a time. If it has many links, each
    row and column is joined by its first one, and only links between
    fingerprints that are still apart are then looked at.
    """
    nodes = np.concatenate([left, right])
    parent = list(range(len(nodes)))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    u, v = [], []

    def join(xs, ys):
        for x, y in zip(xs.tolist(), ys.tolist()):
            p, q = top(x), top(y)
            if p != q:
                parent[p] = q
                u.append(x)
                v.append(y)

    a, b = left.view(np.uint64), right.view(np.uint64)
    for k in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[k:k + rows, None] ^ b[None, :]) <= radius)
        i, j = i + k, j + len(a)
        if len(i) > 2 * (rows + len(b)):
            for side in (i, j):
                one = np.unique(side, return_index=True)[1]
                join(i[one], j[one])
            label = np.fromiter(map(top, range(len(nodes))), np.int64, len(nodes))
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
        join(i, j)
    return nodes[np.array(u, np.int64)], nodes[np.array(v, np.int64)]


def tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """(tile, tile2): all tiles whose bit counts differ by at most ``radius`` in sum, each pair once, some of them empty.

    A word's count is shifted at a time, by what is left of the radius, so the plan is the same for every radius.
    """
    out = tiles.select("tile", F.lit(0).alias("tile2"), F.lit(radius).alias("left"))
    for k in range(WORDS):
        count = F.shiftright(F.col("tile"), 5 * k).bitwiseAND(F.lit(31))
        out = out.select("*", F.explode(F.sequence(F.greatest(-F.col("left"), -count),
                                                   F.least(F.col("left"), F.lit(16) - count))).alias("d"))
        out = out.select("tile", (F.col("tile2") + (count + F.col("d")) * F.lit(32 ** k)).alias("tile2"),
                         (F.col("left") - F.abs("d")).alias("left"))
    return out.where("tile2 >= tile").select("tile", "tile2")


def links(fps: DataFrame, radius: int, block: int = 8192) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp), enough to connect all that are linked."""
    fps = fps.select("fp").withColumn("tile", tile_of(F.col("fp")))
    # a tile number is below 32 ** 4 and at most 17 ** 4 occur: a table of bounded size
    tiles = fps.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n"))
    near = tile_pairs(tiles.select("tile"), radius)
    tiles = F.broadcast(tiles)
    blocks = fps.join(tiles, "tile").withColumn(
        "no", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    blocks = written(blocks.groupBy("tile", "no").agg(F.collect_list("fp").alias("fps")), "simhash_tiles")

    near = near.join(tiles, "tile").join(tiles.select(F.col("tile").alias("tile2"), F.col("n").alias("n2")), "tile2")
    # block numbers first, fingerprints last: a block travels once for each block it is compared with
    first = F.when(F.col("tile") == F.col("tile2"), F.col("no")).otherwise(F.lit(0))
    near = near.withColumn("no", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn(
        "no2", F.explode(F.sequence(first, F.col("n2") - 1)))
    left = blocks.select("tile", "no", F.col("fps").alias("a")).hint("merge")
    right = blocks.select(F.col("tile").alias("tile2"), F.col("no").alias("no2"), F.col("fps").alias("b")).hint("merge")
    pairs = near.join(left, ["tile", "no"]).join(right, ["tile2", "no2"]).select("a", "b")

    def compare(batches):
        for batch in batches:
            us, vs = [], []
            for k in range(batch.num_rows):
                u, v = forest(batch["a"][k].values.to_numpy(), batch["b"][k].values.to_numpy(), radius)
                us.append(u)
                vs.append(v)
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                yield pa.RecordBatch.from_pydict({"u": pa.array(u[u != v], pa.int64()),
                                                  "v": pa.array(v[u != v], pa.int64())})

    return map_arrow(pairs, compare, "u long, v long")


def near_dedup(docs: DataFrame, *, shingle: int = 3, radius: int = 2, seed: int = 42,
               id_col: str = "doc_id", text_col: str = "text", file_no: FileNumbers | None = None) -> DataFrame:
    """One row per input row: ``_rid``, id, fingerprint, component_id, stays.

    Documents are linked if their fingerprints differ in ``radius`` bits or less;
    ``component_id`` is the smallest id that can be reached (null only if all ids
    in the group are null). One row of each group stays: the smallest id, of rows
    that repeat it the first in the table. Null and empty texts and texts of white
    space have fingerprint zero, linked like any other. Other columns are
    ignored. No rows give no rows. ``_rid`` holds for one scan, or with ``file_no`` from
    ``common.file_seed`` for all.
    """
    rows = written(fingerprints(docs, shingle=shingle, seed=seed, id_col=id_col, text_col=text_col,
                                file_no=file_no), "simhash")
    distinct = written(rows.groupBy("fp").agg(F.min(row_key("id")).alias("first")), "simhash_distinct")
    group = components(links(distinct, radius), "simhash_components")
    distinct = distinct.join(group.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    first = distinct.groupBy("root").agg(F.min("first").alias("first"))
    of = written(distinct.select("fp", "root").join(first, "root").select("fp", "first"), "simhash_groups")
    return rows.join(of, "fp").select(
        "_rid", F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"), (F.col("first.rid") == F.col("_rid")).alias("stays"))


def drop_near_copies(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = in_files(docs)
    seed = file_seed(docs)
    kept = near_dedup(docs, file_no=seed, **params).where("stays").select("_rid")
    return rows_with(docs, kept, seed).select("row.*")
