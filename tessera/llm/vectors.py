"""Integer vectors for the vector operators: floor(scale * component), packed as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow

LIMB = 32  # bits of a lower limb of a sum


def usable(vec: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    wide = vec.cast("array<double>")
    return vec.isNotNull() & F.forall(wide, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))


def integer_rows(df: DataFrame, scale: int, *, id_col: str, vec_col: str, dim: int | None = None,
                 bits: int = 31) -> DataFrame:
    """(id long, x binary): floor(scale * component) of each usable vector, little-endian signed.

    With ``dim`` only vectors of that many components. ``bits`` 31 packs into 4 bytes, more into 8;
    a number that needs more than ``bits`` bits fails the job: sums and products of it
    would leave the types of the results.
    """
    kind = "<i4" if bits <= 31 else "<i8"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(usable(F.col("v")))
    if dim is not None:
        rows = rows.where(F.size("v") == dim)

    def pack(batches):
        for batch in batches:
            v = batch["v"]
            ends = v.offsets.to_numpy().astype(np.int64)
            x = np.floor(v.values.to_numpy(zero_copy_only=False) * float(scale))
            if len(x) and np.abs(x).max() >= 2.0 ** bits:
                raise OverflowError(f"a component times {scale} needs more than {bits} bits")
            data = x.astype(kind).tobytes()
            size = np.dtype(kind).itemsize
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "x": pa.array(
                [data[a * size:b * size] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())})

    return map_arrow(rows.select("id", F.col("v").cast("array<double>").alias("v")), pack, "id long, x binary")


def matrix(col, kind: str = "<i4", width: int | None = None) -> np.ndarray:
    """Packed vectors as rows of longs; shorter ones are followed by zeros up to ``width`` or the longest."""
    parts = [np.frombuffer(b.as_buffer(), kind) for b in col]
    sizes = {len(p) for p in parts}
    width = max(sizes, default=0) if width is None else width
    if sizes == {width}:
        return np.concatenate(parts).astype(np.int64).reshape(len(parts), width)
    out = np.zeros((len(parts), width), np.int64)
    for row, p in zip(out, parts):
        row[:len(p)] = p
    return out


def slices(batches, rows: int):
    """Batches of at most ``rows`` rows, none empty."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def limbs(v: np.ndarray, n: int = 2) -> np.ndarray:
    """Integers (longs, or Python's of any size) as ``n`` limbs of ``LIMB`` bits, the last with what is left.

    Limbs of many rows add up in longs without a carry: 2 ** 31 rows fit."""
    out = []
    for _ in range(n - 1):
        out.append((v & ((1 << LIMB) - 1)).astype(np.int64))
        v = v >> LIMB
    return np.concatenate([*out, v.astype(np.int64)])


def from_limbs(v: np.ndarray, n: int = 2) -> list[int]:
    """The integers, as Python's, of summed limbs."""
    cut = v.reshape(n, -1).tolist()
    return [sum(x << (LIMB * k) for k, x in enumerate(col)) for col in zip(*cut)]
