"""H1-H4 checks: brute force, finite differences, MLlib equivalence, invariance."""
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import crf
from tessera.operators.crf_kernels import nll_and_grad, nll_and_grad_log, pad, viterbi


def _brute(X, W, A):
    n, K = X.shape[0], W.shape[1]
    E = X @ W
    scores = {}
    for path in itertools.product(range(K), repeat=n):
        s = sum(E[t, path[t]] for t in range(n)) + sum(A[path[t - 1], path[t]] for t in range(1, n))
        scores[path] = s
    logZ = np.log(sum(np.exp(v) for v in scores.values()))
    best = max(scores.items(), key=lambda kv: (kv[1], [-x for x in kv[0]]))
    return logZ, scores, best[0]


def test_kernels_against_brute_force():
    rng = np.random.default_rng(0)
    d, K = 3, 2
    for trial in range(20):
        lengths = rng.integers(1, 7, size=4)
        W, A = rng.normal(size=(d, K)), rng.normal(size=(K, K))
        xs = [rng.normal(size=(n, d)) for n in lengths]
        ys = [rng.integers(0, K, size=n) for n in lengths]
        flat = np.concatenate([x.ravel() for x in xs])
        yflat = np.concatenate(ys)
        off = np.concatenate([[0], np.cumsum(lengths[:-1] * d)])
        yoff = np.concatenate([[0], np.cumsum(lengths[:-1])])
        idx = np.arange(len(lengths))
        X, M = pad(flat, off, lengths, idx, d)
        Y, _ = pad(yflat, yoff, lengths, idx, 1)
        nll, _, _ = nll_and_grad(X, M, Y[..., 0].astype(int), W, A, want_grad=False)
        paths = viterbi(X, M, W, A)
        for b in range(len(lengths)):
            logZ, scores, best = _brute(xs[b], W, A)
            assert abs(nll[b] - (logZ - scores[tuple(ys[b])])) < 1e-9
            assert tuple(paths[b, :lengths[b]]) == best


def test_gradient_finite_differences():
    rng = np.random.default_rng(1)
    d, K = 4, 2
    lengths = np.array([3, 5, 1, 6])
    flat = rng.normal(size=int(lengths.sum()) * d)
    yflat = rng.integers(0, K, size=int(lengths.sum()))
    off = np.concatenate([[0], np.cumsum(lengths[:-1] * d)])
    yoff = np.concatenate([[0], np.cumsum(lengths[:-1])])
    idx = np.arange(4)
    X, M = pad(flat, off, lengths, idx, d)
    Y = pad(yflat, yoff, lengths, idx, 1)[0][..., 0].astype(int)

    def f(w):
        W, A = w[:d * K].reshape(d, K), w[d * K:].reshape(K, K)
        nll, gW, gA = nll_and_grad(X, M, Y, W, A)
        return nll.sum(), np.concatenate([gW.ravel(), gA.ravel()])

    w = rng.normal(size=d * K + K * K)
    _, g = f(w)
    eps = 1e-6
    num = np.array([(f(w + eps * e)[0] - f(w - eps * e)[0]) / (2 * eps) for e in np.eye(len(w))])
    assert np.max(np.abs(num - g)) < 1e-6


@pytest.fixture(scope="module")
def synth(spark):
    from tessera.operators.features import FeatureContext, with_feature_arrays
    from tessera.sources.lexicons import lines_from_list, parse_bias_lexicon, parse_subjectivity_lexicon
    from tessera.sources.synthetic import synthetic_articles
    ctx = FeatureContext(parse_bias_lexicon(lines_from_list(spark, ["draconian", "reckless"])),
                         parse_subjectivity_lexicon(lines_from_list(spark, [])))
    arts = with_feature_arrays(synthetic_articles(spark), ctx).cache()
    return arts, ctx


def test_fit_decode_and_invariance(spark, synth):
    from tessera.operators.features import FEATURE_NAMES
    arts, _ = synth
    seqs = crf.sequences(arts.filter("split = 'train'"), FEATURE_NAMES)
    m1 = crf.fit(seqs, FEATURE_NAMES, partitions=1)
    m4 = crf.fit(seqs, FEATURE_NAMES, partitions=4)
    assert np.allclose(m1.W, m4.W, atol=1e-4) and np.allclose(m1.A, m4.A, atol=1e-4)
    test = arts.filter("split = 'test'")
    a = {r.article_id: list(r.p) for r in test.select("article_id", crf.decode(F.col("feats"), m1).alias("p")).collect()}
    b = {r.article_id: list(r.path) for r in crf.decode_in_arrow(crf.sequences(test, FEATURE_NAMES), m1).collect()}
    assert a == b
    gold = {r.article_id: list(r.sentence_labels) for r in test.collect()}
    acc = np.mean([x == y for k in gold for x, y in zip(gold[k], a[k])])
    assert acc > 0.95  # templates are separable by the lexicon words


def test_no_transitions_equals_logistic_regression(spark, synth):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from tessera.operators.features import FEATURE_NAMES
    arts, _ = synth
    names = ("lead", "bias_lex", "len")
    train = arts.filter("split = 'train'")
    seqs = crf.sequences(train, names)
    c2 = 0.5
    m = crf.fit(seqs, names, transitions="none", c2=c2, max_iter=200)
    w_crf = m.W[:, 1] - m.W[:, 0]
    rows = train.select(F.explode(F.arrays_zip("feats", "sentence_labels")).alias("z")).select(
        array_to_vector(F.array(*[F.col("z.feats")[n] for n in names])).alias("features"),
        F.col("z.sentence_labels").cast("double").alias("label"))
    n = rows.count()
    lr = LogisticRegression(fitIntercept=False, standardization=False, regParam=c2 / n,
                            maxIter=500, tol=1e-12).fit(rows)
    assert np.allclose(w_crf, lr.coefficients.toArray(), atol=2e-3, rtol=2e-3)


def test_model_save_load_and_masks(spark, synth, tmp_dir):
    from tessera.operators.features import FEATURE_NAMES
    arts, _ = synth
    seqs = crf.sequences(arts.filter("split = 'train'"), FEATURE_NAMES)
    m = crf.fit(seqs, FEATURE_NAMES, transitions="observed", max_iter=10)
    m.save(spark, f"{tmp_dir}/crf")
    back = crf.CRFModel.load(spark, f"{tmp_dir}/crf")
    assert np.allclose(back.W, m.W) and np.allclose(back.A * back.trans_mask, m.A * m.trans_mask)
    observed = {(r.prev_label, r.label) for r in crf.transition_counts(seqs).collect()}
    assert {(i, j) for i in (0, 1) for j in (0, 1) if m.trans_mask[i, j]} == observed
    none = crf.fit(seqs, FEATURE_NAMES, transitions="none", max_iter=5)
    assert not none.trans_mask.any() and np.all(none.A * none.trans_mask == 0)


def test_scaled_kernel_matches_log_space():
    rng = np.random.default_rng(7)
    d, K = 5, 2
    for scale in (0.1, 1.0, 8.0):
        lengths = rng.integers(0, 40, size=30)
        lengths[0] = 0
        flat = rng.normal(size=int(lengths.sum()) * d) * scale
        yflat = rng.integers(0, K, size=int(lengths.sum()))
        off = np.concatenate([[0], np.cumsum(lengths[:-1] * d)])
        yoff = np.concatenate([[0], np.cumsum(lengths[:-1])])
        idx = np.arange(len(lengths))
        X, M = pad(flat, off, lengths, idx, d)
        Y = pad(yflat, yoff, lengths, idx, 1)[0][..., 0].astype(int)
        W, A = rng.normal(size=(d, K)) * scale, rng.normal(size=(K, K)) * scale
        a = nll_and_grad(X, M, Y, W, A)
        b = nll_and_grad_log(X, M, Y, W, A)
        assert a[0][0] == 0.0
        for u, v in zip(a, b):
            assert np.allclose(u, v, rtol=1e-9, atol=1e-8)


def test_three_labels_fit_and_decode(spark, synth):
    """A label 2 is its own class for the sequence model (not positive for metrics)."""
    from tessera.operators.features import FEATURE_NAMES
    from tessera.plans import experiments as X
    arts, ctx = synth
    three = arts.withColumn("sentence_labels", F.transform(
        F.arrays_zip("sentence_labels", "feats"),
        lambda z: F.when(z["feats"]["lead"] == 1.0, F.lit(2)).otherwise(z["sentence_labels"])))
    run = X.train(spark, three, ctx, X.CRFConfig(use_vectors=False, max_iter=30))
    assert run.model.labels == (0, 1, 2)
    pred = X.predict(run, three.filter("split = 'test'"), ctx).collect()
    firsts = [r.pred[0] for r in pred if r.pred]
    assert np.mean([f == 2 for f in firsts]) > 0.9


def test_segmented_forward_backward_equals_whole():
    from tessera.operators.crf_kernels import scan_messages, segment_share, segment_transfer
    rng = np.random.default_rng(11)
    d, K = 4, 3
    for n, S in ((1, 1), (7, 3), (20, 4), (33, 33), (50, 7)):
        X = rng.normal(size=(n, d))
        y = rng.integers(0, K, size=n)
        W, A = rng.normal(size=(d, K)), rng.normal(size=(K, K))
        M = np.ones((1, n), dtype=bool)
        ref_nll, ref_gW, ref_gA = nll_and_grad_log(X[None], M, y[None], W, A)
        cuts = list(range(0, n, S))
        Ls = [segment_transfer(X[s:s + S], W, A, s == 0) for s in cuts]
        alpha_in, beta_out, logZ = scan_messages(Ls)
        loss, gW, gA = 0.0, np.zeros((d, K)), np.zeros((K, K))
        for g, s in enumerate(cuts):
            l, a, b = segment_share(X[s:s + S], y[s:s + S], y[s - 1] if s else None,
                                    alpha_in[g], beta_out[g], logZ, W, A, s == 0)
            loss, gW, gA = loss + l, gW + a, gA + b
        assert abs(loss - ref_nll[0]) < 1e-9 and np.allclose(gW, ref_gW) and np.allclose(gA, ref_gA)


def test_segment_parallel_fit_equals_whole_sequence_fit(spark, synth):
    """Long sequences trained segment-parallel give the same model."""
    from tessera.operators.features import FEATURE_NAMES
    arts, _ = synth
    seqs = crf.sequences(arts.filter("split = 'train'"), FEATURE_NAMES)
    whole = crf.fit(seqs, FEATURE_NAMES, max_iter=15)
    split = crf.fit(seqs, FEATURE_NAMES, max_iter=15, hot_len=6, segment_len=3)
    assert np.allclose(whole.W, split.W, atol=1e-6) and np.allclose(whole.A, split.A, atol=1e-6)


def test_segmented_viterbi_equals_whole():
    from tessera.operators.crf_kernels import scan_viterbi, segment_decode, segment_max_transfer
    rng = np.random.default_rng(5)
    d, K = 4, 3
    for n, S in ((1, 1), (9, 2), (30, 7), (40, 40), (57, 5)):
        X = rng.normal(size=(n, d))
        W, A = rng.normal(size=(d, K)), rng.normal(size=(K, K))
        ref = viterbi(X[None], np.ones((1, n), dtype=bool), W, A)[0]
        cuts = list(range(0, n, S))
        enters, ends = scan_viterbi([segment_max_transfer(X[s:s + S], W, A, s == 0) for s in cuts])
        path = np.concatenate([segment_decode(X[s:s + S], W, A, enters[g], ends[g])
                               for g, s in enumerate(cuts)])
        assert path.tolist() == ref.tolist()


def test_segmented_decode_equals_arrow_decode(spark, synth):
    from tessera.operators.features import FEATURE_NAMES
    arts, _ = synth
    seqs = crf.sequences(arts.filter("split = 'train'"), FEATURE_NAMES)
    m = crf.fit(seqs, FEATURE_NAMES, max_iter=10)
    test = crf.sequences(arts.filter("split = 'test'"), FEATURE_NAMES)
    a = {r.article_id: list(r.path) for r in crf.decode_in_arrow(test, m).collect()}
    b = {r.article_id: list(r.path) for r in crf.decode_segmented(test, m, segment_len=2).collect()}
    assert a == b and len(a) == 60


def test_grouped_gradient_sum_equals_collected(spark, synth):
    from tessera.operators.crf_kernels import make_gradient_step
    from tessera.operators.features import FEATURE_NAMES
    arts, _ = synth
    data = crf.prepare_training_data(crf.sequences(arts.filter("split = 'train'"), FEATURE_NAMES), 5)
    rng = np.random.default_rng(2)
    W, A = rng.normal(size=(9, 2)) * 0.1, rng.normal(size=(2, 2))
    parts = data.mapInArrow(make_gradient_step(W, A, (0, 1)), crf.STEP_SCHEMA)
    a = crf.CRFObjective._sum_rows(parts, 5, 22)
    b = crf.CRFObjective._sum_rows(parts, 10_000, 22)
    assert abs(a[0] - b[0]) < 1e-9 and np.allclose(a[1], b[1]) and a[2] == b[2] == 90


def test_preconditioning_reaches_lower_objective(spark, synth):
    from tessera.operators.features import FEATURE_NAMES
    arts, _ = synth
    seqs = crf.sequences(arts.filter("split = 'train'"), FEATURE_NAMES)
    plain = crf.fit(seqs, FEATURE_NAMES, max_iter=20, precondition=False)
    scaled = crf.fit(seqs, FEATURE_NAMES, max_iter=20)
    assert scaled.info["objective"] <= plain.info["objective"] + 1e-9
