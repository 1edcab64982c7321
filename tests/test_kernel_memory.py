"""H1, H2: a kernel makes padded blocks of a batch, no copy of the whole batch."""
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import crf_kernels as K


@pytest.mark.parametrize("kind", ["nll", "gradient"])
def test_no_copy_of_the_batch(monkeypatch, kind):
    monkeypatch.setattr(K, "CHUNK_CELLS", 1 << 14)
    n, rows, d = 100, 3000, 9
    x = np.random.default_rng(1).normal(size=rows * n * d)
    at = np.arange(rows + 1, dtype=np.int32) * n
    y = pa.ListArray.from_arrays(pa.array(at), pa.array(np.zeros(rows * n, dtype=np.int8)))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([f"a{i}" for i in range(rows)]), pa.array(np.full(rows, n, np.int32)),
         pa.ListArray.from_arrays(pa.array(at * d), pa.array(x)), y, y], names=["article_id", "n", "x", "y", "yi"])
    W, A = np.full((d, 2), 0.1), np.zeros((2, 2))
    step = K.make_sequence_scorer(W, A, "nll") if kind == "nll" else K.make_gradient_step(W, A, (0, 1))
    tracemalloc.start()
    list(step(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes / 2, (peak, x.nbytes)
