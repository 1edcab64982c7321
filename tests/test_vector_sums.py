"""Packed vector sums: blocks, keys, lanes and the bytes that they shuffle."""
import numpy as np
import pyarrow as pa

from tessera.operators import vector_sums as S


def parts_of(spark, n, width, keys=3, partitions=9, block=S.BLOCK):
    """Each partition's sums of the vectors i * [1..width], by key i % keys."""
    def run(batches):
        held = {}
        for b in batches:
            for i in b.column("id").to_pylist():
                key = (None if i % keys == 2 else f"k{i % keys}",)
                held[key] = held.get(key, 0) + i * np.arange(1, width + 1, dtype=np.int64)
        if held:
            yield S.block_rows(held, {"key": pa.string()}, "<i8", block)
    return spark.range(0, n, 1, partitions).mapInArrow(run, "key string, block int, blob binary")


def test_sums_by_key_and_block(spark):
    n, width, block = 500, 70, 16
    got = {}
    for r in S.merged_blocks(parts_of(spark, n, width, block=block), "<i8", lanes=3).collect():
        got.setdefault(r.key, {})[r.block] = np.frombuffer(bytes(r.blob), "<i8")
    assert set(got) == {"k0", "k1", None}
    for k, key in enumerate(("k0", "k1", None)):
        total = sum(i for i in range(n) if i % 3 == k)
        v = np.concatenate([got[key][b] for b in sorted(got[key])])
        assert np.array_equal(v, total * np.arange(1, width + 1))


def test_one_row_per_partition_key_and_block(spark):
    parts = parts_of(spark, 5000, 100, keys=3, partitions=7)
    assert parts.count() == 7 * 3  # not a row per number
    assert parts.selectExpr("max(octet_length(blob))").first()[0] == 100 * 8


def test_no_rows(spark):
    empty = spark.createDataFrame([], "block int, blob binary")
    assert S.collected(S.merged_blocks(empty)) is None


def test_few_bytes_are_added_directly(spark, monkeypatch):
    def run(batches):
        n = sum(b.num_rows for b in batches)
        yield S.block_rows({(): n * np.arange(20.0)}, {}, "<f8", 8)
    parts = spark.range(0, 90, 1, 6).mapInArrow(run, "block int, blob binary")
    direct = S.summed(parts, 6, 20)
    monkeypatch.setattr(S, "DIRECT", 0)
    assert np.array_equal(direct, 90 * np.arange(20.0)) and np.array_equal(S.summed(parts, 6, 20), direct)
