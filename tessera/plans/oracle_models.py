"""Oracle SQL for the model-job queries (fixed-weight CRF pieces, reports)."""

from __future__ import annotations

from ..operators.features import FEATURE_NAMES
from .catalog_models import (FIXED_STATE, FIXED_TRANS, ROUND_FEATURES, ROUNDS, SPARSE_MAX_ATTRIBUTES,
                             SPARSE_MIN_COUNT)
from .oracle import ARTS, FEATS, ORACLE, SENTS, _tok, _with

A = FIXED_TRANS


def _d(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def _emission(k: int) -> str:
    s = "CAST(0.0 AS DOUBLE)"
    for n in FEATURE_NAMES:
        s = f"({s} + {_d(FIXED_STATE.get(n, (0.0, 0.0))[k])} * {n})"
    return s


EM = f"""
em AS (SELECT article_id, pos, label, split, {_emission(0)} AS e0, {_emission(1)} AS e1 FROM feats)"""

ORACLE["label_transitions"] = _with(ARTS, """
cnt AS (SELECT prev_label, label, count(*) AS n
        FROM (SELECT unnest(sentence_labels[1:len(sentence_labels) - 1]) AS prev_label,
                     unnest(sentence_labels[2:len(sentence_labels)]) AS label
              FROM arts WHERE split = 'train' AND len(sentence_labels) > 1)
        GROUP BY prev_label, label)""") + """
SELECT CAST(p.a AS INTEGER) AS prev_label, CAST(q.b AS INTEGER) AS label, CAST(coalesce(n, 0) AS BIGINT) AS n,
       true AS weight_all, coalesce(n, 0) > 0 AS weight_observed, false AS weight_none
FROM (VALUES (0), (1)) p(a) CROSS JOIN (VALUES (0), (1)) q(b)
LEFT JOIN cnt ON cnt.prev_label = p.a AND cnt.label = q.b"""

ORACLE["crf_emissions"] = _with(ARTS, SENTS, FEATS, EM) + """
SELECT article_id, pos, e0, e1 FROM em"""

_VIT = f"""
vit(article_id, pos, s0, s1, p0, p1) AS (
  SELECT article_id, pos, e0, e1, [0], [1] FROM em WHERE pos = 0
  UNION ALL
  SELECT v.article_id, e.pos,
    greatest(v.s0 + {_d(A[0][0])}, v.s1 + {_d(A[1][0])}) + e.e0,
    greatest(v.s0 + {_d(A[0][1])}, v.s1 + {_d(A[1][1])}) + e.e1,
    list_append(CASE WHEN v.s0 + {_d(A[0][0])} >= v.s1 + {_d(A[1][0])} THEN v.p0 ELSE v.p1 END, 0),
    list_append(CASE WHEN v.s0 + {_d(A[0][1])} >= v.s1 + {_d(A[1][1])} THEN v.p0 ELSE v.p1 END, 1)
  FROM vit v JOIN em e ON e.article_id = v.article_id AND e.pos = v.pos + 1
)"""

_DECODE = "WITH RECURSIVE " + ",".join([ARTS, SENTS, FEATS, EM, _VIT]) + """
SELECT a.article_id, coalesce(array_to_string(d.path, ','), '') AS path,
       CASE WHEN list_contains(d.path, 1) THEN 1 ELSE 0 END AS y_pred
FROM arts a LEFT JOIN (
  SELECT v.article_id, CASE WHEN v.s0 >= v.s1 THEN v.p0 ELSE v.p1 END AS path
  FROM vit v JOIN (SELECT article_id, max(pos) AS last FROM em GROUP BY article_id) l
    ON v.article_id = l.article_id AND v.pos = l.last) d
  ON a.article_id = d.article_id"""

ORACLE["crf_decode"] = _DECODE
ORACLE["crf_decode_arrow"] = _DECODE
ORACLE["crf_predict"] = _DECODE

def _lse(x: str, y: str) -> str:
    return f"(greatest({x}, {y}) + ln(exp(({x}) - greatest({x}, {y})) + exp(({y}) - greatest({x}, {y}))))"


_FWD = f"""
fwd(article_id, pos, a0, a1, sc, prev) AS (
  SELECT article_id, pos, e0, e1, CASE WHEN label = 1 THEN e1 ELSE e0 END, label FROM em WHERE pos = 0
  UNION ALL
  SELECT f.article_id, e.pos,
    {_lse(f'f.a0 + {_d(A[0][0])}', f'f.a1 + {_d(A[1][0])}')} + e.e0,
    {_lse(f'f.a0 + {_d(A[0][1])}', f'f.a1 + {_d(A[1][1])}')} + e.e1,
    f.sc + CASE WHEN e.label = 1 THEN e.e1 ELSE e.e0 END
         + CASE WHEN f.prev = 0 AND e.label = 0 THEN {_d(A[0][0])}
                WHEN f.prev = 0 AND e.label = 1 THEN {_d(A[0][1])}
                WHEN f.prev = 1 AND e.label = 0 THEN {_d(A[1][0])}
                ELSE {_d(A[1][1])} END,
    e.label
  FROM fwd f JOIN em e ON e.article_id = f.article_id AND e.pos = f.pos + 1
)"""

ORACLE["crf_loglik"] = "WITH RECURSIVE " + ",".join([ARTS, SENTS, FEATS, EM, _FWD]) + f"""
SELECT f.article_id, round({_lse('f.a0', 'f.a1')} - f.sc, 6) AS nll
FROM fwd f JOIN (SELECT article_id, max(pos) AS last FROM em GROUP BY article_id) l
  ON f.article_id = l.article_id AND f.pos = l.last"""

_STATE_ROWS = " UNION ALL ".join(
    f"SELECT '{n}|{k}' AS param, round(sum({n} * (0.5 - CASE WHEN label = {k} THEN 1 ELSE 0 END)), 6) AS value "
    f"FROM feats WHERE split = 'train'"
    for n in FEATURE_NAMES for k in (0, 1))
_TRANS_ROWS = " UNION ALL ".join(
    f"SELECT 'trans|{i}|{j}' AS param, "
    f"round(0.25 * count(*) - count(*) FILTER (WHERE prev_label = {i} AND label = {j}), 6) AS value FROM pairs"
    for i in (0, 1) for j in (0, 1))

ORACLE["crf_grad0"] = _with(ARTS, SENTS, FEATS, """
pairs AS (SELECT unnest(sentence_labels[1:len(sentence_labels) - 1]) AS prev_label,
                 unnest(sentence_labels[2:len(sentence_labels)]) AS label
          FROM arts WHERE split = 'train' AND len(sentence_labels) > 1)""") + f"""
SELECT 'loss' AS param, round(ln(2) * sum(n), 6) AS value
FROM (SELECT count(*) AS n FROM feats WHERE split = 'train' GROUP BY article_id)
UNION ALL {_STATE_ROWS}
UNION ALL {_TRANS_ROWS}"""

# token attributes of every sentence and of the one before
ATTRS = f"""
toks AS (SELECT article_id, pos, label, {_tok('sentence')} AS own FROM sents),
named AS (
  SELECT label, 'w=' || unnest(own) AS name FROM toks
  UNION ALL
  SELECT label, 'p=' || unnest(before)
  FROM (SELECT label, lag(own) OVER (PARTITION BY article_id ORDER BY pos) AS before FROM toks)),
dict AS (SELECT name, count(*) AS n FROM named GROUP BY name
         HAVING count(*) >= {SPARSE_MIN_COUNT}
            AND count(*) * {SPARSE_MAX_ATTRIBUTES} >= (SELECT count(*) FROM named))"""

ORACLE["crf_attributes"] = _with(ARTS, SENTS, ATTRS) + """
SELECT name, n FROM dict"""

ORACLE["crf_sparse_grad0"] = _with(ARTS, SENTS, ATTRS, """
pairs AS (SELECT unnest(sentence_labels[1:len(sentence_labels) - 1]) AS prev_label,
                 unnest(sentence_labels[2:len(sentence_labels)]) AS label
          FROM arts WHERE len(sentence_labels) > 1)""") + f"""
SELECT 'loss' AS param, round(ln(2) * count(*), 6) AS value FROM sents
UNION ALL SELECT name || '|' || k, round(sum(0.5::DOUBLE - CASE WHEN label = k THEN 1 ELSE 0 END), 6)
FROM named JOIN dict USING (name) CROSS JOIN (VALUES (0), (1)) l(k) GROUP BY name, k
UNION ALL {_TRANS_ROWS}"""

# every sentence of every article, with its vector if the table has one
LOOKUP = """
lookup AS (
  SELECT s.article_id, s.split, s.pos, e.embedding, max(len(e.embedding)) OVER (PARTITION BY s.article_id) AS width
  FROM (SELECT article_id, split, pos, CAST(substr(article_id, 5) AS BIGINT) AS doc_id FROM sents) s
  LEFT JOIN embeddings e ON e.vec_id = (s.doc_id * 31 + s.pos) % (SELECT max(vec_id) + 1 FROM embeddings))"""


def _found(value: str) -> str:
    return f"CASE WHEN width IS NULL THEN NULL WHEN embedding IS NULL THEN 0.0 ELSE CAST({value} AS DOUBLE) END"


ORACLE["embed_lookup"] = _with(ARTS, SENTS, LOOKUP) + f"""
SELECT article_id, pos, CASE WHEN width IS NULL THEN 0 ELSE 1 END AS has_vec, {_found('embedding[1]')} AS v_first,
       {_found('list_max(embedding)')} AS v_max, {_found('list_min(embedding)')} AS v_min
FROM lookup"""

ORACLE["stored_lookup"] = _with(ARTS, SENTS) + """
SELECT s.article_id, s.split, s.pos, 1 AS has_vec, CAST(e.embedding[1] AS DOUBLE) AS v_first,
       CAST(list_max(e.embedding) AS DOUBLE) AS v_max, CAST(list_min(e.embedding) AS DOUBLE) AS v_min
FROM (SELECT article_id, split, pos, CAST(substr(article_id, 5) AS BIGINT) AS doc_id FROM sents
      WHERE split = 'test') s
JOIN embeddings e ON e.vec_id = (s.doc_id * 31 + s.pos) % (SELECT max(vec_id) + 1 FROM embeddings)"""

# a vector for every sentence
VECS = """
vecs AS (
  SELECT s.article_id, s.split, s.pos, list_transform(e.embedding, lambda x: x::DOUBLE) AS v
  FROM (SELECT article_id, split, pos, CAST(substr(article_id, 5) AS BIGINT) AS doc_id FROM sents) s
  JOIN embeddings e ON e.vec_id = (s.doc_id * 31 + s.pos) % (SELECT max(vec_id) + 1 FROM embeddings)),
dims AS (SELECT i, v[i + 1] AS x, v[i + 2] AS y FROM (
           SELECT v, unnest(range(len(v))) AS i FROM vecs WHERE split = 'train')),
means AS (SELECT i, avg(x) AS m FROM dims GROUP BY i)"""

# missing vectors of articles that have others are zero
ZERO_VECS = VECS.replace(VECS[:VECS.index("dims AS")], """
vecs AS (
  SELECT article_id, split, pos, CASE WHEN embedding IS NULL THEN list_transform(range(width), lambda x: 0.0::DOUBLE)
                                      ELSE list_transform(embedding, lambda x: x::DOUBLE) END AS v
  FROM lookup WHERE width IS NOT NULL),
""")

ORACLE["pca_fit"] = _with(ARTS, SENTS, LOOKUP, ZERO_VECS) + """
SELECT 'rows' AS kind, CAST(0 AS INTEGER) AS i, CAST(count(*) AS DOUBLE) AS value FROM vecs WHERE split = 'train'
UNION ALL SELECT 'mean', CAST(i AS INTEGER), round(m, 6) + 0.0 FROM means
UNION ALL SELECT 'variance', CAST(i AS INTEGER), round(var_samp(x), 6) + 0.0 FROM dims GROUP BY i
UNION ALL SELECT 'covariance_next', CAST(i AS INTEGER), round(covar_samp(x, y), 6) + 0.0 FROM dims
          WHERE y IS NOT NULL GROUP BY i
UNION ALL SELECT unnest(['length', 'residual']), CAST(i AS INTEGER), unnest([1.0::DOUBLE, 0.0::DOUBLE])
          FROM means WHERE i < 50"""

ORACLE["pca_fit_wide"] = _with(ARTS, SENTS, VECS) + """
SELECT 'rows' AS kind, CAST(0 AS INTEGER) AS i, CAST(count(*) AS DOUBLE) AS value FROM vecs WHERE split = 'train'
UNION ALL SELECT 'total_variance', 0, round(sum(v), 6) FROM (SELECT var_samp(x) AS v FROM dims GROUP BY i)
UNION ALL SELECT 'mean', CAST(i AS INTEGER), round(m, 6) + 0.0 FROM means
UNION ALL SELECT unnest(['length', 'residual']), CAST(i AS INTEGER), unnest([1.0::DOUBLE, 0.0::DOUBLE])
          FROM means WHERE i < 50"""

ORACLE["pca_project"] = _with(ARTS, SENTS, VECS) + """
SELECT article_id, pos, round(sqrt(sum((x - m) * (x - m))), 5) AS from_mean
FROM (SELECT article_id, pos, unnest(range(len(v))) AS i, unnest(v) AS x FROM vecs) JOIN means USING (i)
GROUP BY article_id, pos"""

_BUCKETS = "list_transform(toks, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 64)"
ORACLE["sentence_vectors"] = _with(ARTS, SENTS) + f"""
SELECT article_id, pos,
       array_to_string(list_transform(list_sort(list_distinct(b)),
                       lambda d: d || ':' || len(list_filter(b, lambda x: x = d))), ' ') AS mean_vec,
       CASE WHEN len(b) > 0 THEN b[1] || ':1' ELSE '' END AS cls_vec
FROM (SELECT article_id, pos, {_BUCKETS} AS b FROM (SELECT *, {_tok('sentence')} AS toks FROM sents))"""

ORACLE["pool_mean"] = """
SELECT label, CAST(dim AS INTEGER) AS dim, round(sum(CAST(v AS DOUBLE)) / greatest(count(*), 1), 6) AS value
FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS v FROM embeddings)
GROUP BY label, dim"""

ORACLE["pool_first"] = """
SELECT label, CAST(dim AS INTEGER) AS dim, CAST(v AS DOUBLE) AS value
FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS v
      FROM (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label))"""

ORACLE["argmax_label"] = """
SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax,
       CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS first_positive
FROM embeddings"""

# ----------------------------------------------------------------- rule family
from ..operators.baseline import RULE_CANDIDATES  # noqa: E402
from .oracle import ART_PRED, _metrics_sql  # noqa: E402

_CAND_VALUES = ", ".join(f"({i}, '{name}', '{f}', {t})" for i, (name, f, t) in enumerate(RULE_CANDIDATES))
CROW = f"""
amax AS (
  SELECT a.article_id, a.domain, a.split, coalesce(m.y_true, 0) AS y_true,
         coalesce(m.mx_bias_lex, -1.0) AS mx_bias_lex, coalesce(m.mx_sent_neg, -1.0) AS mx_sent_neg,
         coalesce(m.mx_sent_pos, -1.0) AS mx_sent_pos
  FROM arts a LEFT JOIN (
    SELECT article_id, max(bias_lex) AS mx_bias_lex, max(sent_neg) AS mx_sent_neg,
           max(sent_pos) AS mx_sent_pos, max(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS y_true
    FROM feats GROUP BY article_id) m USING (article_id)
),
cand(cand_idx, candidate, feature, thr) AS (VALUES {_CAND_VALUES}),
crow AS (
  SELECT a.article_id, a.domain, a.split, a.y_true, CAST(c.cand_idx AS INTEGER) AS cand_idx, c.candidate,
    CASE WHEN (CASE c.feature WHEN 'bias_lex' THEN a.mx_bias_lex WHEN 'sent_neg' THEN a.mx_sent_neg
                              ELSE a.mx_sent_pos END) > c.thr THEN 1 ELSE 0 END AS y_pred
  FROM amax a CROSS JOIN cand c
)"""

ORACLE["best_candidate"] = _with(ARTS, SENTS, FEATS, CROW, "cm AS (" + _metrics_sql(
    "(SELECT * FROM crow WHERE split = 'val')", ["cand_idx", "candidate"]) + ")") + """
SELECT cm.*, coalesce(b.is_best, false) AS is_best
FROM cm LEFT JOIN (SELECT cand_idx, true AS is_best FROM cm ORDER BY f1 DESC, cand_idx ASC LIMIT 1) b
  USING (cand_idx)"""

ORACLE["cross_domain"] = _with(ARTS, SENTS, FEATS, CROW, "cm AS (" + _metrics_sql(
    "crow", ["domain", "cand_idx", "candidate"]) + ")") + """
SELECT b.domain AS train_domain, t.domain AS test_domain, t.candidate, t.accuracy, t.precision, t.recall,
       t.f1, b.domain || '->' || t.domain AS notes
FROM (SELECT domain, cand_idx FROM (
        SELECT domain, cand_idx, row_number() OVER (PARTITION BY domain ORDER BY f1 DESC, cand_idx ASC) AS rk
        FROM cm) WHERE rk = 1) b
JOIN cm t ON t.cand_idx = b.cand_idx AND t.domain <> b.domain"""


def _rule_metrics(rule: str, model: str) -> str:
    src = f"(SELECT split, y_true, y_pred_{rule} AS y_pred FROM art_pred WHERE split IN ('val', 'test'))"
    thr = "CAST(NULL AS DOUBLE)" if rule == "a" else "0.0::DOUBLE"
    return f"""
SELECT '{model}' AS model, 'all' AS domain, split, accuracy, precision, recall, f1,
       CASE WHEN split = 'val' THEN 'validation' ELSE 'test' END AS notes, {thr} AS threshold,
       CASE WHEN split = 'val' THEN '{model.lower()}' ELSE '{model.lower()}_eval' END AS source
FROM ({_metrics_sql(src, ['split'])})"""


MAIN = ("main AS (" + _rule_metrics("a", "RULE_BIAS") + " UNION ALL " + _rule_metrics("b", "RULE_NEG") + ")")
ORACLE["results_main"] = _with(ARTS, SENTS, FEATS, ART_PRED, MAIN) + "SELECT * FROM main"

ORACLE["chart_main"] = _with(ARTS, SENTS, FEATS, ART_PRED, MAIN) + """
SELECT model, source, 'f1' AS metric, f1 AS value FROM main
UNION ALL SELECT model, source, 'precision', precision FROM main
UNION ALL SELECT model, source, 'recall', recall FROM main"""


def _subtype_sql(pred: str, model: str) -> str:
    return f"""
SELECT '{model}' AS model, subtype, precision, recall,
       CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
       support
FROM (
  SELECT subtype, support,
    CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
    CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall
  FROM (
    SELECT subtype,
      count(*) FILTER (WHERE pred = 1 AND label = 1) AS tp,
      count(*) FILTER (WHERE pred = 1 AND label = 0) AS fp,
      count(*) FILTER (WHERE pred = 0 AND label = 1) AS fn,
      count(*) AS support
    FROM (SELECT subtype, label, CASE WHEN {pred} > 0 THEN 1 ELSE 0 END AS pred FROM feats WHERE split = 'test')
    GROUP BY subtype))"""


ORACLE["results_subtype"] = _with(ARTS, SENTS, FEATS) + _subtype_sql("bias_lex", "RULE_BIAS_EVAL") + \
    " UNION ALL " + _subtype_sql("sent_neg", "RULE_NEG_EVAL")

_PCTS = "(VALUES (25.0::DOUBLE), (50.0::DOUBLE), (100.0::DOUBLE)) p(train_pct)"
ORACLE["chart_curve"] = _with(ARTS, SENTS, FEATS, CROW, f"""
tr AS (SELECT c.*, p.train_pct FROM crow c CROSS JOIN {_PCTS}
       WHERE c.split = 'train'
         AND (('0x' || substr(md5('curve|' || c.article_id), 1, 8))::BIGINT % 100) < p.train_pct)""",
    "tm AS (" + _metrics_sql("tr", ["train_pct", "cand_idx", "candidate"]) + ")",
    "te AS (" + _metrics_sql("(SELECT * FROM crow WHERE split = 'test')", ["cand_idx", "candidate"]) + ")") + """
SELECT 'RULE_SELECTED' AS model, CAST(row_number() OVER (ORDER BY b.train_pct) - 1 AS INTEGER) AS point,
       b.train_pct, te.f1
FROM (SELECT train_pct, cand_idx FROM (
        SELECT train_pct, cand_idx,
               row_number() OVER (PARTITION BY train_pct ORDER BY f1 DESC, cand_idx ASC) AS rk FROM tm)
      WHERE rk = 1) b
JOIN te ON te.cand_idx = b.cand_idx"""

ORACLE["metrics_toxic"] = _with(
    ARTS, SENTS, FEATS, ART_PRED,
    "lj AS (SELECT p.domain, l.toxic, p.y_pred_a FROM art_pred p "
    "JOIN labels l ON p.article_id = 'doc_' || CAST(l.doc_id AS VARCHAR))"
) + _metrics_sql("lj", ["domain"], yt="toxic", yp="y_pred_a")


# ----------------------------------------------------------------- rounds
def _rounds_sql() -> str:
    """Every mini-batch step of the fixed-step training written out, then the scores after each epoch."""
    from ..operators.rounds import rate
    epochs, batches, peak, warmup, decay = (ROUNDS[k] for k in ("epochs", "batches", "peak", "warmup", "decay"))
    names = [f"x{i}" for i in range(len(ROUND_FEATURES))]
    margin = " + ".join([f"r.{n} * w.{n}" for n in names] + ["w.b"])
    parts = ["r AS MATERIALIZED (SELECT article_id, split, y_true, "
             + ", ".join(f"greatest(mx_{f}, 0.0::DOUBLE) AS {n}" for f, n in zip(ROUND_FEATURES, names)) + " FROM amax)",
             "w0 AS MATERIALIZED (SELECT " + ", ".join(f"0.0::DOUBLE AS {n}" for n in names) + ", 0.0::DOUBLE AS b)"]
    for t in range(epochs * batches):
        lr, epoch = rate(t, epochs * batches, peak, warmup), t // batches
        grads = ", ".join([f"avg((p - y_true) * {n}) AS g{n}" for n in names] + ["avg(p - y_true) AS gb"])
        moved = ", ".join([f"w.{n} - {_d(lr)} * coalesce(g{n} + {_d(decay)} * w.{n}, 0) AS {n}" for n in names]
                          + [f"w.b - {_d(lr)} * coalesce(gb, 0) AS b"])
        parts.append(f"""w{t + 1} AS MATERIALIZED (SELECT {moved} FROM w{t} w, (SELECT {grads} FROM (
            SELECT r.*, 1.0 / (1.0 + exp(-({margin}))) AS p FROM r, w{t} w WHERE r.split = 'train' AND
            ('0x' || substr(md5('round|{epoch}|' || r.article_id), 1, 8))::BIGINT % {batches} = {t % batches})))""")
    ends = [(e, f"w{(e + 1) * batches}") for e in range(epochs)]
    scored = " UNION ALL ".join(
        f"SELECT {e} AS epoch, r.y_true, CASE WHEN {margin} > 0 THEN 1 ELSE 0 END AS y_pred FROM r, {w} w "
        "WHERE r.split = 'val'" for e, w in ends)
    every = " UNION ALL ".join(f"SELECT {e} AS epoch, * FROM {w}" for e, w in ends)
    parts += [f"em AS MATERIALIZED ({_metrics_sql(f'({scored})', ['epoch'])})", f"ew AS ({every})",
              "best AS (SELECT epoch FROM em ORDER BY f1 DESC, epoch LIMIT 1)"]
    kept = ", ".join(f"round(k.{n}, 6) AS w_{f}" for n, f in zip([*names, "b"], [*ROUND_FEATURES, "intercept"]))
    return _with(ARTS, SENTS, FEATS, CROW, *parts) + f"""
SELECT CAST(em.epoch AS INTEGER) AS epoch, em.f1 AS val_f1, em.accuracy AS val_accuracy, em.n,
       em.epoch = best.epoch AS is_best, {kept}
FROM em, best JOIN ew k ON k.epoch = best.epoch"""


ORACLE["round_training"] = _rounds_sql()

ORACLE["results_csv"] = ORACLE["results_main"]
ORACLE["results_subtype_csv"] = ORACLE["results_subtype"]
ORACLE["articles_jsonl"] = _with(ARTS) + """
SELECT article_id, CASE WHEN b = 0 OR domain IS NULL THEN 'MBIB' ELSE domain END AS domain, split,
       CAST(len(sentences) AS INTEGER) AS n_sentences,
       array_to_string(list_transform(sentence_labels, lambda x: CAST(x AS VARCHAR)), ',') AS labels,
       array_to_string(subtypes, ',') AS subtypes
FROM (SELECT *, ('0x' || substr(md5('json|' || article_id), 1, 8))::BIGINT % 8 AS b FROM arts)"""
