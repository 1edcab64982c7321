"""Element-wise sums of packed vectors.

Each partition adds up its vectors and sends the sum as binary blocks of at most ``BLOCK``
numbers, one row per key and block. Rows are merged in a tree of two levels: first by
key, block and one of ``LANES`` lanes, then by key and block. A merging task reads rows
sorted by key and holds one block at a time, so neither wide vectors nor many partitions
or keys meet in one task, and no number becomes a row of its own.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pyarrow only

BLOCK = 8_192   # numbers of a block
LANES = 64      # lanes of the first merge
DIRECT = 16 << 20  # bytes of partitions' sums that the driver may add up itself
HELD = 64 << 20  # bytes of sums that a partition holds before it sends them


def block_rows(vectors: dict, fields: dict, dtype: str, block: int = BLOCK):
    """Record batch (key columns, ``block``, ``blob``) of a dict key tuple -> vector.

    ``fields``: name and Arrow type of each key column."""
    import pyarrow as pa

    keys, nos, blobs = [], [], []
    for key, v in vectors.items():
        for no in range(0, -(-len(v) // block) or 1):
            keys.append(key)
            nos.append(no)
            blobs.append(np.ascontiguousarray(v[no * block:(no + 1) * block], dtype).tobytes())
    cols = {name: pa.array([k[i] for k in keys], kind) for i, (name, kind) in enumerate(fields.items())}
    return pa.RecordBatch.from_pydict(cols | {"block": pa.array(nos, pa.int32()), "blob": pa.array(blobs, pa.binary())})


def make_merger(keys: tuple, dtype: str):
    """Rows sorted by ``keys`` -> one row per key with the sum of its blobs."""
    def run(batches):
        import pyarrow as pa

        current, total = None, None

        def row(schema):
            cols = [pa.array([v], schema.field(k).type) for k, v in zip(keys, current)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([total.tobytes()], pa.binary())], names=[*keys, "blob"])

        schema = None
        for batch in batches:
            schema = batch.schema
            for key, blob in zip(zip(*[batch.column(k).to_pylist() for k in keys]), batch.column("blob")):
                v = np.frombuffer(blob.as_buffer(), dtype)
                if key != current:
                    if current is not None:
                        yield row(schema)
                    current, total = key, v.copy()
                elif len(v) <= len(total):
                    total[:len(v)] += v
                else:  # vectors of a key may differ in length
                    v = v.copy()
                    v[:len(total)] += total
                    total = v
        if current is not None:
            yield row(schema)
    return run


def merged_blocks(parts: DataFrame, dtype: str = "<f8", lanes: int = LANES) -> DataFrame:
    """Sum rows (key columns, ``block``, ``blob``) by key and block; any number of partitions."""
    keys = tuple(c for c in parts.columns if c != "blob")

    def level(df, by):
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "blob")
        spread = df.select(*by, "blob").repartition(*by).sortWithinPartitions(*by)
        return spread.mapInArrow(make_merger(tuple(by), dtype), f"{kinds}, blob binary")

    first = parts.withColumn("_lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
    return level(level(first, (*keys, "_lane")).drop("_lane"), keys)


def collected(blocks: DataFrame, dtype: str = "<f8") -> np.ndarray | None:
    """The summed vector of rows (``block``, ``blob``) without keys; None without rows."""
    rows = sorted(blocks.select("block", "blob").collect(), key=lambda r: r.block)
    return np.concatenate([np.frombuffer(bytes(r.blob), dtype) for r in rows]) if rows else None


def summed(parts: DataFrame, partitions: int, size: int, dtype: str = "<f8") -> np.ndarray | None:
    """The sum of one vector of ``size`` numbers a partition: added on the driver if all of them are few bytes,
    else merged in the tree first."""
    if partitions * size * np.dtype(dtype).itemsize > DIRECT:
        return collected(merged_blocks(parts, dtype), dtype)
    total: dict = {}
    for r in parts.select("block", "blob").collect():
        v = np.frombuffer(bytes(r.blob), dtype)
        total[r.block] = total[r.block] + v if r.block in total else v
    return np.concatenate([total[b] for b in sorted(total)]) if total else None
