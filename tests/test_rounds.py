"""Round-wise training: the best round is kept, steps equal a plain loop, edges."""
import hashlib

import numpy as np
import pytest

from tessera.operators import metrics as M
from tessera.operators.rounds import (RoundModel, hashed_rows, predict_rows, rate, sparse_rows, train_rounds)


def frame(spark, n=160, seed=1, d=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, (n, d)) / 2.0
    y = (x @ np.array([1.0, -1.0, 0.5]) + rng.normal(0, 0.8, n) > 0.6).astype(float)
    rows = [(f"a{i}", list(map(float, x[i])), float(y[i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "article_id string, features array<double>, label double")


def plain(rows, val, epochs, batches, peak, warmup, decay):
    """The same steps on one machine: (weights, F1) after each epoch."""
    w, out = np.zeros(len(rows[0][1]) + 1), []
    x = np.array([r[1] + [1.0] for r in rows])
    y = np.array([r[2] for r in rows])
    for e in range(epochs):
        of = np.array([int(hashlib.md5(f"round|{e}|{r[0]}".encode()).hexdigest()[:8], 16) % batches for r in rows])
        for b in range(batches):
            if (of == b).any():
                p = 1 / (1 + np.exp(-(x[of == b] @ w)))
                g = x[of == b].T @ (p - y[of == b]) / (of == b).sum()
                w = w - rate(e * batches + b, epochs * batches, peak, warmup) * (g + decay * np.append(w[:-1], 0))
        pred = np.array([np.array(r[1] + [1.0]) @ w > 0 for r in val])
        gold = np.array([r[2] == 1 for r in val])
        tp = (pred & gold).sum()
        out.append((w, 2 * tp / max(1, 2 * tp + (pred & ~gold).sum() + (~pred & gold).sum())))
    return out


@pytest.mark.parametrize("peak", [0.5, 20.0])
def test_steps_and_kept_round(spark, tmp_dir, peak):
    rows, df = frame(spark)
    val_rows, val = frame(spark, 60, 2)
    args = dict(epochs=5, batches=3, peak=peak, warmup=0.2, decay=0.01)
    model = train_rounds(sparse_rows(df, "features"), sparse_rows(val, "features"), 4, partitions=3, **args)
    want = plain(rows, val_rows, **args)
    best = max(range(5), key=lambda e: (want[e][1], -e))
    assert [r[0] for r in model.rounds if r[4]] == [best]
    assert np.allclose([r[1] for r in model.rounds], [f for _, f in want])
    assert np.allclose(model.weights, want[best][0], atol=1e-10)
    if peak == 20.0:  # steps too long: the last round isn't the best, and isn't kept
        assert best < 4 and not np.allclose(model.weights, want[-1][0])
    model.save(spark, f"{tmp_dir}/m")
    back = RoundModel.load(spark, f"{tmp_dir}/m")
    assert np.array_equal(back.weights, model.weights) and back.rounds == model.rounds
    m = M.global_binary_metrics(predict_rows(sparse_rows(val, "features"), back.weights)).first()
    assert m.f1 == back.f1 == max(r[1] for r in model.rounds)


def test_rate_rises_and_falls():
    got = [rate(t, 20, 1.0, 0.2) for t in range(20)]
    assert got[:4] == [0.25, 0.5, 0.75, 1.0] and got[4] == 1.0 and all(a > b for a, b in zip(got[4:], got[5:])) and got[-1] > 0


def test_texts_of_any_kind(spark):
    rows = [("a", "good good day", 1.0), ("b", "bad day", 0.0), ("c", "", 0.0), ("d", None, 0.0), ("e", "good", 1.0)]
    t = hashed_rows(spark.createDataFrame(rows, "article_id string, text string, label double"), size=1 << 10)
    got = {r.article_id: r for r in t.collect()}
    assert len(got) == 5 and list(got["c"].idx) == [] and list(got["d"].idx) == [] and abs(sum(got["a"].val) - 1) < 1e-12
    model = train_rounds(t, t, (1 << 10) + 1, epochs=6, batches=2, peak=5.0, decay=0.0)
    assert model.f1 == 1.0
    with pytest.raises(ValueError):
        train_rounds(t.limit(0), t, 5)
