"""H1 for many models at once: segments of long sequences side by side, equal to the padded kernel step by step."""
import time

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import crf_fused
from tessera.operators.crf_kernels import nll_and_residuals, nll_and_residuals_flat


@pytest.mark.parametrize("size", [1.0, 8.0, 30.0])  # 30: beyond SCALED_MAX_ABS_TRANSITION, in log space
@pytest.mark.parametrize("K", [2, 3])
def test_flat_equals_padded(size, K):
    rng = np.random.default_rng(3)
    lengths = np.array([3, 0, 200, 64, 1, 65, 700, 128, 5])
    n, N = 3, int(lengths.sum())
    E, y = rng.normal(size=(N, n, K)) * 3, rng.integers(0, K, N)
    A = rng.normal(size=(n, K, K)) * size
    loss, R, gA = nll_and_residuals_flat(E, lengths, y, list(A))
    ends = np.cumsum(lengths)
    for m in range(n):
        want, g = 0.0, np.zeros((K, K))
        for a, b in zip(ends - lengths, ends):
            if a == b:
                continue
            nll, r, ga = nll_and_residuals(E[None, a:b, m], np.ones((1, b - a), bool), y[None, a:b], A[m])
            want, g = want + nll.sum(), g + ga
            assert np.allclose(R[a:b, m], r[0], atol=1e-9)
        assert np.isclose(loss[m], want, rtol=1e-10) and np.allclose(gA[m], g, atol=1e-8)


def _seconds(lengths) -> float:
    rng, N, d = np.random.default_rng(1), int(sum(lengths)), 3
    ends = np.concatenate([[0], np.cumsum(lengths)])
    lists = lambda v, k: pa.ListArray.from_arrays(pa.array((ends * k).astype(np.int32)), pa.array(v))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(lengths, np.int32)), lists(rng.normal(size=N * d), d), lists(np.arange(N, dtype=np.int32) % 2, 1),
         pa.array(np.ones(len(lengths), np.int64))], names=["n", "x", "y", "member"])
    models = [(i, 0, rng.normal(size=(d, 2)), rng.normal(size=(2, 2)), (0, 1)) for i in range(3)]
    step, best = crf_fused.make_fused_step(models, d), np.inf
    for _ in range(3):
        began = time.perf_counter()
        list(step([batch]))
        best = min(best, time.perf_counter() - began)
    return best


def test_a_long_article_is_not_a_loop_over_its_sentences():
    assert _seconds([20_000]) < 8 * _seconds([20] * 1_000)  # a step a sentence took some 50 times as long
