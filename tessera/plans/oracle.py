"""DuckDB SQL for every SQL-expressible catalogue query.

The tables ``documents``, ``embeddings``, ... are views over the same
Parquet files. The SQL re-derives everything from the raw tables; it shares
only fixed values (word lists, patterns) with the Spark side.
"""

from __future__ import annotations

from ..functions.stats import chi2_1_sf_sql
from ..functions.text import MODAL_PATTERN, SENTENCE_SPLIT, TOKEN_PATTERN
from ..sources.articles import GOLD_EMOTIVE, GOLD_LOADED, GOLD_TERMS

ORACLE: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _inlist(words) -> str:
    return "(" + ", ".join(_q(w) for w in sorted(set(words))) + ")"


def _count_in(toks: str, words) -> str:
    words = sorted(set(words))
    if not words:
        return "0"
    return f"len(list_filter({toks}, lambda t: t IN {_inlist(words)}))"


def _tok(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {_q(TOKEN_PATTERN)})"


# stand-in lexicons after parsing (see sources.lexicons)
BIAS = ("trash", "scum", "idiot", "clown", "#x", "so-called", "freedom fighter")
POSITIVE = ("with", "for", "that")
NEGATIVE = ("was", "worthless", "pathetic")
SUBJ_ROWS = (("with", "positive"), ("for", "positive"), ("that", "positive"),
             ("was", "negative"), ("worthless", "negative"), ("pathetic", "negative"),
             ("on", "neutral"), ("the", "both"))

ARTS = f"""
arts AS (
  SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS article_id, lang AS domain,
         CASE WHEN b < 3 THEN 'train' WHEN b = 3 THEN 'val' ELSE 'test' END AS split,
         sentences,
         list_transform(sentences, lambda s:
             CASE WHEN len(list_filter({_tok('s')}, lambda t: t IN {_inlist(GOLD_TERMS)})) > 0
                  THEN 1 ELSE 0 END) AS sentence_labels,
         list_transform(sentences, lambda s:
             CASE WHEN len(list_filter({_tok('s')}, lambda t: t IN {_inlist(GOLD_LOADED)})) > 0 THEN 'loaded'
                  WHEN len(list_filter({_tok('s')}, lambda t: t IN {_inlist(GOLD_EMOTIVE)})) > 0 THEN 'emotive'
                  ELSE 'none' END) AS subtypes
  FROM (
    SELECT doc_id, lang,
           (('0x' || substr(md5('42|' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 6) AS b,
           coalesce(list_filter(string_split_regex(text, {_q(SENTENCE_SPLIT)}), lambda x: trim(x) <> ''),
                    CAST([] AS VARCHAR[])) AS sentences
    FROM documents)
)"""

SENTS = """
sents AS (
  SELECT article_id, domain, split, CAST(pos AS INTEGER) AS pos, sentence,
         CAST(sentence_labels[pos + 1] AS INTEGER) AS label, subtypes[pos + 1] AS subtype
  FROM (SELECT article_id, domain, split, sentence_labels, subtypes,
               unnest(range(len(sentences))) AS pos, unnest(sentences) AS sentence
        FROM arts)
)"""

FEATS = f"""
feats AS (
  SELECT *,
    CAST(pos AS DOUBLE) AS position,
    CAST(CASE WHEN pos = 0 THEN 1 ELSE 0 END AS DOUBLE) AS lead,
    CAST({_count_in('toks', POSITIVE)} AS DOUBLE) AS sent_pos,
    CAST({_count_in('toks', NEGATIVE)} AS DOUBLE) AS sent_neg,
    CAST({_count_in('toks', POSITIVE)} + {_count_in('toks', NEGATIVE)} AS DOUBLE) AS sent_subj,
    CAST({_count_in('toks', BIAS)} AS DOUBLE) AS bias_lex,
    CAST(contains(sentence, '"') OR contains(sentence, '''') AS DOUBLE) AS has_quotes,
    CAST(regexp_matches(lower(sentence), {_q(MODAL_PATTERN)}) AS DOUBLE) AS has_modal,
    CAST(len(toks) AS DOUBLE) AS len
  FROM (SELECT *, {_tok('sentence')} AS toks FROM sents)
)"""

# article-level rule predictions: A = any sentence with bias_lex > 0, B = sent_neg > 0
ART_PRED = """
art_pred AS (
  SELECT a.article_id, a.domain, a.split,
         coalesce(s.y_true, 0) AS y_true, coalesce(s.y_pred_a, 0) AS y_pred_a,
         coalesce(s.y_pred_b, 0) AS y_pred_b
  FROM arts a LEFT JOIN (
    SELECT article_id,
           max(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS y_true,
           max(CASE WHEN bias_lex > 0 THEN 1 ELSE 0 END) AS y_pred_a,
           max(CASE WHEN sent_neg > 0 THEN 1 ELSE 0 END) AS y_pred_b
    FROM feats GROUP BY article_id) s USING (article_id)
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def _metrics_sql(source: str, keys: list[str], yt: str = "y_true", yp: str = "y_pred") -> str:
    k = ", ".join(keys)
    kk = (k + ", ") if keys else ""
    group = f"GROUP BY {k}" if keys else ""
    return f"""
SELECT {kk}n, tp, fp, fn, tn,
  CASE WHEN n > 0 THEN CAST(n_correct AS DOUBLE) / CAST(n AS DOUBLE) END AS accuracy,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE)
       ELSE 0.0 END AS f1
FROM (
  SELECT {kk}
    count(*) FILTER (WHERE {yt} = 1 AND {yp} = 1) AS tp,
    count(*) FILTER (WHERE {yt} <> 1 AND {yp} = 1) AS fp,
    count(*) FILTER (WHERE {yt} = 1 AND {yp} <> 1) AS fn,
    count(*) FILTER (WHERE {yt} <> 1 AND {yp} <> 1) AS tn,
    count(*) FILTER (WHERE {yt} = {yp}) AS n_correct,
    count(*) AS n
  FROM {source} {group})"""


ORACLE["articles"] = _with(ARTS) + """
SELECT article_id, domain, split, CAST(len(sentences) AS INTEGER) AS n_sentences,
       array_to_string(list_transform(sentence_labels, lambda x: CAST(x AS VARCHAR)), ',') AS labels,
       array_to_string(subtypes, ',') AS subtypes
FROM arts"""

ORACLE["sentences"] = _with(ARTS, SENTS) + """
SELECT article_id, domain, split, pos, sentence, label, subtype FROM sents"""

ORACLE["article_text"] = _with(ARTS) + f"""
SELECT article_id, CAST(length(txt) AS INTEGER) AS n_chars, CAST(len(toks) AS INTEGER) AS n_tokens,
       CAST(len(toks[1:512]) AS INTEGER) AS n_kept, md5(array_to_string(toks[1:512], ' ')) AS kept_md5
FROM (SELECT article_id, txt, {_tok('txt')} AS toks
      FROM (SELECT article_id, array_to_string(sentences, ' ') AS txt FROM arts))"""

ORACLE["article_labels"] = _with(ARTS) + """
SELECT article_id, domain, split,
       CASE WHEN len(list_filter(sentence_labels, lambda x: x = 1)) > 0 THEN 1 ELSE 0 END AS label
FROM arts"""

ORACLE["union_domains"] = _with(ARTS) + """
SELECT domain, split, count(*) AS n_articles, CAST(sum(len(sentences)) AS BIGINT) AS n_sentences
FROM arts GROUP BY domain, split"""

ORACLE["lexicon_bias"] = _with(ARTS, SENTS) + f"""
SELECT l.term, CAST(coalesce(h.n_hits, 0) AS BIGINT) AS n_hits
FROM (SELECT unnest({'[' + ', '.join(_q(t) for t in BIAS) + ']'}) AS term) l
LEFT JOIN (SELECT term, count(*) AS n_hits
           FROM (SELECT unnest({_tok('sentence')}) AS term FROM sents)
           WHERE term IN {_inlist(BIAS)} GROUP BY term) h USING (term)"""

ORACLE["lexicon_subjectivity"] = _with(ARTS, SENTS) + f"""
SELECT l.word, l.polarity, CAST(coalesce(h.n_hits, 0) AS BIGINT) AS n_hits
FROM (VALUES {', '.join(f'({_q(w)}, {_q(p)})' for w, p in SUBJ_ROWS)}) l(word, polarity)
LEFT JOIN (SELECT word, count(*) AS n_hits
           FROM (SELECT unnest({_tok('sentence')}) AS word FROM sents)
           WHERE word IN {_inlist(w for w, _ in SUBJ_ROWS)} GROUP BY word) h USING (word)"""

ORACLE["features"] = _with(ARTS, SENTS, FEATS) + """
SELECT article_id, pos, position, lead, sent_pos, sent_neg, sent_subj, bias_lex,
       has_quotes, has_modal, len FROM feats"""

ORACLE["feat_position"] = _with(ARTS, SENTS, FEATS) + """
SELECT article_id, pos, position, lead FROM feats"""

ORACLE["feat_tokens"] = _with(ARTS, SENTS) + f"""
SELECT article_id, pos, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, ' ') AS tokens
FROM (SELECT article_id, pos, {_tok('sentence')} AS toks FROM sents)"""

ORACLE["feat_polarity"] = _with(ARTS, SENTS, FEATS) + """
SELECT article_id, pos, sent_pos, sent_neg, sent_subj FROM feats"""

ORACLE["feat_lexicon_counts"] = _with(ARTS, SENTS, FEATS) + """
SELECT article_id, pos, sent_pos, sent_neg, sent_subj, bias_lex FROM feats"""

ORACLE["feat_bias"] = _with(ARTS, SENTS, FEATS) + """
SELECT article_id, pos, bias_lex FROM feats"""

ORACLE["feat_cues"] = _with(ARTS, SENTS, FEATS) + """
SELECT article_id, pos, has_quotes, has_modal FROM feats"""

ORACLE["confusion"] = _with(ARTS, SENTS, FEATS, ART_PRED) + """
SELECT count(*) FILTER (WHERE y_true = 1 AND y_pred_a = 1) AS tp,
       count(*) FILTER (WHERE y_true <> 1 AND y_pred_a = 1) AS fp,
       count(*) FILTER (WHERE y_true = 1 AND y_pred_a <> 1) AS fn,
       count(*) FILTER (WHERE y_true <> 1 AND y_pred_a <> 1) AS tn,
       count(*) AS n
FROM art_pred"""

ORACLE["metrics_sentence"] = _with(
    ARTS, SENTS, FEATS,
    "sent_pred AS (SELECT split, label AS y_true, CASE WHEN bias_lex > 0 THEN 1 ELSE 0 END AS y_pred FROM feats)"
) + _metrics_sql("sent_pred", ["split"])

ORACLE["metrics_article"] = _with(ARTS, SENTS, FEATS, ART_PRED) + _metrics_sql(
    "art_pred", ["split"], yp="y_pred_a")

ORACLE["metrics_by_domain"] = _with(ARTS, SENTS, FEATS, ART_PRED) + _metrics_sql(
    "art_pred", ["domain", "split"], yp="y_pred_a")

ORACLE["subtype_breakdown"] = _with(ARTS, SENTS, FEATS) + """
SELECT subtype, precision, recall,
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
    FROM (SELECT subtype, label, CASE WHEN bias_lex > 0 THEN 1 ELSE 0 END AS pred
          FROM feats WHERE split = 'test')
    GROUP BY subtype))"""

ORACLE["predictions"] = _with(ARTS, SENTS, FEATS, ART_PRED) + """
SELECT article_id, y_true, y_pred_a AS y_pred FROM art_pred WHERE split = 'test'"""

_STAT = "(CASE WHEN n01 + n10 > 0 THEN pow(abs(n01 - n10) - 1, 2) / (n01 + n10) ELSE 0.0 END)"
ORACLE["mcnemar"] = _with(ARTS, SENTS, FEATS, ART_PRED) + f"""
SELECT n_pairs, n01, n10, round(statistic, 6) AS statistic,
       round(CASE WHEN n01 + n10 > 0 THEN {chi2_1_sf_sql('statistic')} ELSE 1.0 END, 6) AS p_value
FROM (
  SELECT n_pairs, n01, n10, {_STAT} AS statistic
  FROM (
    SELECT count(*) AS n_pairs,
      count(*) FILTER (WHERE y_true <> y_pred_a AND y_true = y_pred_b) AS n01,
      count(*) FILTER (WHERE y_true = y_pred_a AND y_true <> y_pred_b) AS n10
    FROM art_pred WHERE split = 'test'))"""


def oracle_sql() -> dict[str, str]:
    from . import oracle_models  # noqa: F401  (registers model queries)
    return dict(ORACLE)
