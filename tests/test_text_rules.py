"""Tokenisation, lexicon counts, cue flags, positions."""
from pyspark.sql import functions as F

from tessera.operators.features import FeatureContext, sentence_features
from tessera.sources.lexicons import lines_from_list, parse_bias_lexicon, parse_subjectivity_lexicon


def _feats(spark, sentences, bias=(), subj=(), strategy="auto"):
    ctx = FeatureContext(parse_bias_lexicon(lines_from_list(spark, list(bias))),
                         parse_subjectivity_lexicon(lines_from_list(spark, list(subj))))
    rows = [("a", i, s) for i, s in enumerate(sentences)]
    df = spark.createDataFrame(rows, "article_id string, pos int, sentence string")
    return {r.pos: r for r in sentence_features(df, ctx, True, strategy).collect()}


def test_tokens_and_quotes(spark):
    from tessera.functions.text import tokens
    df = spark.createDataFrame([('The policy\'s so-called "plan" 2x ü',)], "s string")
    toks = df.select(tokens("s").alias("t")).first().t
    assert toks == ["the", "policy's", "so", "called", "plan", "x"]
    f = _feats(spark, ['The policy\'s so-called "plan"', "it's", "no quote here"])
    assert f[0].has_quotes == 1.0 and f[1].has_quotes == 1.0 and f[2].has_quotes == 0.0
    assert f[0].len == 5.0


def test_modal_whole_word(spark):
    f = _feats(spark, ["mighty oak", "it might.", "émight", "Reportedly so", "x_could", "could"])
    assert [f[i].has_modal for i in range(6)] == [0.0, 1.0, 0.0, 1.0, 0.0, 1.0]


def test_polarity_and_bias_counts(spark):
    subj = ["word1=good priorpolarity=positive", "word1=bad priorpolarity=negative",
            "word1=meh priorpolarity=neutral", "word1=odd priorpolarity=both"]
    bias = ["reckless", "so-called", "freedom fighter"]
    for strategy in ("inline", "arrow", "broadcast", "salted"):
        f = _feats(spark, ["good good bad meh odd", "so-called freedom fighter reckless reckless reckless", ""],
                   bias, subj, strategy)
        assert (f[0].sent_pos, f[0].sent_neg, f[0].sent_subj) == (2.0, 1.0, 3.0)
        assert f[1].bias_lex == 3.0  # multi-word and hyphenated entries never match (R3)
        assert (f[2].len, f[2].sent_pos, f[2].bias_lex) == (0.0, 0.0, 0.0)
        assert f[0].position == 0.0 and f[0].lead == 1.0 and f[2].position == 2.0 and f[2].lead == 0.0


def test_feature_arrays_match_long_rows(spark):
    from tessera.operators.features import FEATURE_NAMES, with_feature_arrays
    from tessera.operators.sentences import explode_sentences
    ctx = FeatureContext(parse_bias_lexicon(lines_from_list(spark, ["bad"])),
                         parse_subjectivity_lexicon(lines_from_list(spark, ["word1=good priorpolarity=positive"])))
    arts = spark.createDataFrame(
        [("a", "D", "train", ["good bad", "It might be bad."], [0, 1], None),
         ("b", "D", "test", [], [], None)],
        "article_id string, domain string, split string, sentences array<string>, "
        "sentence_labels array<int>, subtypes array<string>")
    arr = with_feature_arrays(arts, ctx).select("article_id", F.posexplode("feats").alias("pos", "f"))
    a = {(r.article_id, r.pos): tuple(r.f) for r in arr.collect()}
    long = sentence_features(explode_sentences(arts, keep=()), ctx, True, "inline")
    b = {(r.article_id, r.pos): tuple(r[n] for n in FEATURE_NAMES) for r in long.collect()}
    assert a == b and len(a) == 2


def test_features_invariant_to_partitioning(spark):
    from tessera.plans.common import feature_context
    from tessera.operators.sentences import explode_sentences
    from tessera.sources.articles import testdata_articles
    arts = testdata_articles(spark, "/root/testdata/sf0.001")
    ctx = feature_context(spark)
    ref = None
    for p in (1, 4, 13):
        f = sentence_features(explode_sentences(arts.repartition(p), keep=()), ctx, True, "inline")
        rows = sorted(tuple(r) for r in f.drop("sentence", "label", "subtype").collect())
        ref = ref or rows
        assert rows == ref


def test_feature_arrays_join_strategies_match_inline(spark):
    from tessera.operators.features import with_feature_arrays
    from tessera.plans.common import feature_context
    from tessera.sources.articles import testdata_articles
    arts = testdata_articles(spark, "/root/testdata/sf0.001")
    ctx = feature_context(spark)

    def rows(strategy):
        f = with_feature_arrays(arts, ctx, True, strategy)
        return sorted((r.article_id, [tuple(x) for x in r.feats]) for r in f.select("article_id", "feats").collect())

    ref = rows("inline")
    assert rows("arrow") == ref and rows("broadcast") == ref and rows("salted") == ref
