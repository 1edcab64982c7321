"""Executor-side lexicon counting over Arrow batches (mid-size lexicons).

Tokens arrive as Arrow list arrays (computed by the JVM tokeniser). Every
token of a batch is looked up at once in a pandas hash index; counts are
summed per list with ``np.add.reduceat`` over the list offsets. The index is
built once per Python worker process from a broadcast variable.
"""

from __future__ import annotations

import sys
import types

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STASH = "_tessera_lexicon_index_cache"  # survives across tasks in a reused worker


def _index(bc, key: str):
    import pandas as pd

    cache = sys.modules.get(_STASH)
    if cache is None:
        cache = types.ModuleType(_STASH)
        cache.indexes = {}
        sys.modules[_STASH] = cache
    if key not in cache.indexes:
        terms, codes = bc.value  # terms: list[str]; codes: int8 bit flags per term
        cache.indexes[key] = (pd.Index(terms), np.asarray(codes, dtype=np.int8))
    return cache.indexes[key]


def _per_list_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` inside each list given Arrow offsets (empty lists -> 0)."""
    n = len(offsets) - 1
    out = np.zeros(n, dtype=np.int64)
    lengths = np.diff(offsets)
    nz = lengths > 0
    if flags.size and nz.any():
        out[nz] = np.add.reduceat(flags, offsets[:-1][nz])
    return out


def _offsets(arr) -> np.ndarray:
    off = arr.offsets.to_numpy()
    return off - off[0] if off.size else off


def make_counter(bc, key: str, tokens_col: str, nested: bool, names=("_p", "_n", "_b")):
    """Rows with a token column -> same rows + three counts (positive,
    negative, bias). ``nested``: the column is ``list<list<string>>`` (an
    article's sentences) and the counts are ``list<int>`` per article."""

    def run(batches):
        import pyarrow as pa

        index, codes = _index(bc, key)
        for b in batches:
            toks = b.column(tokens_col)
            if isinstance(toks, pa.ChunkedArray):
                toks = toks.combine_chunks()
            outer = _offsets(toks) if nested else None
            inner = toks.flatten() if nested else toks
            values = inner.flatten().to_numpy(zero_copy_only=False)
            offsets = _offsets(inner)
            pos = index.get_indexer(values) if values.size else np.zeros(0, dtype=np.int64)
            hit = pos >= 0
            flag = np.where(hit, codes[np.where(hit, pos, 0)], 0)
            cols = []
            for bit in range(3):
                c = pa.array(_per_list_sums(((flag >> bit) & 1).astype(np.int64), offsets).astype(np.int32))
                if nested:
                    c = pa.ListArray.from_arrays(pa.array(outer.astype(np.int32)), c)
                cols.append(c)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns)] + cols,
                                             names=list(b.schema.names) + list(names))

    return run
