"""A lexicon join shuffles a sentence with its token count, not with its tokens a second time."""
import pytest

from tessera.operators import features as FT
from tessera.sources.lexicons import testdata_bias_lexicon as bias_lexicon
from tessera.sources.lexicons import testdata_subjectivity_lexicon as subjectivity_lexicon


@pytest.mark.parametrize("strategy", ["broadcast", "salted"])
def test_tokens_are_not_shuffled_with_the_sentence(spark, strategy):
    ctx = FT.FeatureContext(bias_lexicon(spark), subjectivity_lexicon(spark))
    sents = spark.createDataFrame([("a", 0, "Scum and scum, with"), ("a", 1, ""), ("b", 0, "fine")],
                                  "article_id string, pos int, sentence string")
    joined = FT._joined_counts(sents, ctx, strategy)
    assert not [f.name for f in joined.schema.fields if f.dataType.simpleString().startswith("array")]
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(FT.sentence_features(sents, ctx, True, strategy)) == key(FT.sentence_features(sents, ctx, True, "inline"))
