"""A table of vectors that every executor has a copy of, looked up by id with no exchange.

Where rows refer to vectors by id, a row needs 8 bytes until its vector is read. The table goes to the executors as
files of the session (``addFile``), which their Python workers map into memory: pages of the file, no copy a worker.
It is bounded (``MAX_BYTES``); ``shipped`` returns None for what is larger or no plain table of vectors, and the caller joins
instead. The driver writes the files partition by partition and holds the ids.
"""

from __future__ import annotations

import sys
import tempfile
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pyarrow only

MAX_BYTES = 1 << 30
BLOCK_ROWS = 4_096


@dataclass
class VectorTable:
    """Names of the session's files, the width and the element type of the vectors."""
    ids: str
    vecs: str
    width: int
    kind: str  # of numpy

    def open(self):
        """On an executor: (sorted ids, which row of the vectors each has, vectors)."""
        ids = np.load(SparkFiles.get(self.ids), mmap_mode="r")
        return ids[0], ids[1], np.memmap(SparkFiles.get(self.vecs), self.kind, "r").reshape(-1, self.width)

    def _type(self) -> T.DataType:
        return T.ArrayType(T.FloatType() if self.kind == "<f4" else T.DoubleType())

    def vectors_of(self, ids: DataFrame, column: str = "vec") -> DataFrame:
        """Rows with the vector in place of the id in ``column``, row-local; null for one that is not there."""
        schema = T.StructType([T.StructField(f.name, self._type()) if f.name == column else f for f in ids.schema.fields])
        return ids.mapInArrow(make_row_resolver(self, column), schema)

    def placed(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows with the vectors' rows in the table in place of the ids in the array ``column``, row-local: -1 for an id that is
        null or that the table has not, null where that holds for all of a row's."""
        schema = T.StructType([T.StructField(f.name, T.ArrayType(T.IntegerType())) if f.name == column else f
                               for f in rows.schema.fields])
        return rows.mapInArrow(make_placer(self, column), schema)

    def resolve(self, rows: DataFrame, column: str, placed: bool = False) -> DataFrame:
        """Rows with the vectors in place of the ids in the array ``column``, row-local: zeros for an id that is null or that the
        table has not, null where that holds for all of a row's (as ``attach_vectors``). ``placed``: the array has rows of the table."""
        schema = T.StructType([T.StructField(f.name, T.ArrayType(self._type())) if f.name == column else f
                               for f in rows.schema.fields])
        return rows.mapInArrow(make_resolver(self, column, placed), schema)


@dataclass
class VectorsById:
    """Vectors of sentences by id: rows ``(article_id, pos, vec)``, ``vec`` an id of ``table``."""
    ids: DataFrame
    table: VectorTable

    def rows(self) -> DataFrame:
        """``(article_id, pos, vec)`` with the vectors."""
        return self.table.vectors_of(self.ids)


def rows_of(ids: np.ndarray, places: np.ndarray, wanted) -> np.ndarray:
    """The row of each wanted id (an Arrow array); -1 for null ids and those not there."""
    has = ~wanted.is_null().to_numpy(zero_copy_only=False)
    keys = wanted.fill_null(0).to_numpy(zero_copy_only=False)
    if not len(ids):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(ids, keys), len(ids) - 1)
    return np.where(has & (ids[at] == keys), places[at], -1)


def _found(column, at: np.ndarray):
    """(elements of each list, whether it has one in the table)."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return n, np.bincount(np.repeat(np.arange(len(n)), n), at >= 0, minlength=len(n)) > 0


def make_row_resolver(table: VectorTable, column: str):
    def run(batches):
        import pyarrow as pa

        ids, places, vecs = table.open()
        for b in batches:
            at = rows_of(ids, places, b.column(column))
            has = at >= 0
            offsets = np.concatenate([[0], np.cumsum(has * table.width)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~has, False)), pa.array(vecs[at[has]].ravel()))
            yield pa.RecordBatch.from_arrays([lists if c == column else b.column(c) for c in b.schema.names],
                                             names=b.schema.names)
    return run


def make_placer(table: VectorTable, column: str):
    def run(batches):
        import pyarrow as pa

        ids, places, _ = table.open()
        for b in batches:
            at = rows_of(ids, places, b.column(column).flatten()).astype(np.int32)
            n, found = _found(b.column(column), at)
            offsets = np.concatenate([[0], np.cumsum(n * found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~found, False)), pa.array(at[np.repeat(found, n)]))
            yield pa.RecordBatch.from_arrays([lists if c == column else b.column(c) for c in b.schema.names],
                                             names=b.schema.names)
    return run


def make_resolver(table: VectorTable, column: str, placed: bool = False):
    def run(batches):
        import pyarrow as pa

        ids, places, vecs = table.open()
        for whole in batches:
            each = whole.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, start = np.cumsum(each), 0
            while start < whole.num_rows:  # 16 MB of vectors at a time, or one row's
                most = (ends[start - 1] if start else 0) + max(1, (16 << 20) // (8 * table.width))
                end = max(start + 1, int(np.searchsorted(ends, most, side="right")))
                b, n = whole.slice(start, end - start), each[start:end]
                start = end
                flat = b.column(column).flatten()
                at = flat.to_numpy(zero_copy_only=False) if placed else rows_of(ids, places, flat)
                found = _found(b.column(column), at)[1]
                if placed:  # a list is there, whatever it has
                    found = ~b.column(column).is_null().to_numpy(zero_copy_only=False)
                given = np.repeat(found, n)
                v = np.where((at >= 0)[given, None], vecs[np.maximum(at[given], 0)], vecs.dtype.type(0))
                own = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * table.width), pa.array(v.ravel()))
                offsets = np.concatenate([[0], np.cumsum(n * found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~found, False)), own)
                yield pa.RecordBatch.from_arrays([lists if c == column else b.column(c) for c in b.schema.names],
                                                 names=b.schema.names)
    return run


def _make_blocks():
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for start in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(start, BLOCK_ROWS)
                v = part.column("vec").flatten()
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.array([part.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()),
                    "vecs": pa.array([v.to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
                    "holes": pa.array([v.null_count], pa.int64())})
    return run


def shipped(vectors: DataFrame, key: str, vec: str, max_bytes: int = MAX_BYTES) -> VectorTable | None:
    """The table ``(key, vec)`` sent to the executors. Rows without a key or a vector are as if they weren't there. None if it
    would be larger than ``max_bytes``, has an id twice, vectors of several widths or null elements."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vec).alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    kind = "<f4" if isinstance(rows.schema["vec"].dataType.elementType, T.FloatType) else "<f8"
    if kind == "<f8":
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    n, least, width = rows.agg(F.count("*"), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if not n or not width or least != width or n * (width * int(kind[2]) + 16) > max_bytes:
        return None
    folder, name = tempfile.mkdtemp(prefix="vectors-", dir=SparkFiles.getRootDirectory()), uuid4().hex[:12]  # goes with the session
    ids = []
    with open(f"{folder}/vecs-{name}.bin", "wb") as out:
        for r in rows.mapInArrow(_make_blocks(), "ids binary, vecs binary, holes bigint").toLocalIterator():
            if r.holes:
                return None
            ids.append(np.frombuffer(bytes(r.ids), "<i8"))
            out.write(r.vecs)
    ids = np.concatenate(ids)
    order = np.argsort(ids, kind="stable")
    if (np.diff(ids[order]) == 0).any():
        return None
    np.save(f"{folder}/ids-{name}.npy", np.stack([ids[order], order]))
    for file in (f"ids-{name}.npy", f"vecs-{name}.bin"):
        spark.sparkContext.addFile(f"{folder}/{file}")
    return VectorTable(f"ids-{name}.npy", f"vecs-{name}.bin", width, kind)
