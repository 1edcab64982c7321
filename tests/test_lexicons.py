"""Lexicon parsing."""
import pytest

from tessera.sources.lexicons import (lines_from_list, load_bias_lexicon, load_subjectivity_lexicon,
                                      parse_bias_lexicon, parse_subjectivity_lexicon)


def test_bias_lexicon_rules(spark, tmp_dir):
    lines = ["# comment", "Reckless", "  reckless ", "", "   ", " #x", "so-called"]
    terms = {r.term for r in parse_bias_lexicon(lines_from_list(spark, lines)).collect()}
    assert terms == {"reckless", "#x", "so-called"}
    p = f"{tmp_dir}/bias.txt"
    with open(p, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    assert {r.term for r in load_bias_lexicon(spark, p).collect()} == terms
    assert load_bias_lexicon(spark, f"{tmp_dir}/missing.txt").count() == 0


def test_subjectivity_rules(spark, tmp_dir):
    lines = ["# type=strongsubj word1=heroic priorpolarity=positive",
             "type=weaksubj len=1 word1=Good pos1=adj priorpolarity=positive",
             "type=weaksubj len=1 word1=good pos1=adj priorpolarity=negative",
             "len=1 word1=plain",
             "len=1 priorpolarity=negative",
             "word1=Case priorpolarity=Positive",
             ""]
    lex = {r.word: r.polarity for r in parse_subjectivity_lexicon(lines_from_list(spark, lines)).collect()}
    assert lex == {"good": "negative", "plain": "neutral", "case": "Positive"}
    p = f"{tmp_dir}/subj.tff"
    with open(p, "w", encoding="utf-8") as f:
        f.write("\n".join(lines))
    assert {r.word: r.polarity for r in load_subjectivity_lexicon(spark, p).collect()} == lex
    assert load_subjectivity_lexicon(spark, f"{tmp_dir}/none.tff").count() == 0


def test_subjectivity_all_comments_is_empty(spark):
    lines = ["# type=strongsubj len=1 word1=heroic pos1=adj stemmed1=n priorpolarity=positive"]
    assert parse_subjectivity_lexicon(lines_from_list(spark, lines)).count() == 0


def test_subjectivity_two_equals_fails(spark):
    with pytest.raises(Exception):
        parse_subjectivity_lexicon(lines_from_list(spark, ["word1=a=b priorpolarity=positive"])).collect()


def test_crlf_lexicon_file(spark, tmp_dir):
    p = f"{tmp_dir}/crlf.tff"
    with open(p, "w", encoding="utf-8", newline="") as f:
        f.write("word1=a priorpolarity=positive\r\nword1=a priorpolarity=negative\r\n")
    assert {r.word: r.polarity for r in load_subjectivity_lexicon(spark, p).collect()} == {"a": "negative"}
