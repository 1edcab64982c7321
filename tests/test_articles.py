"""Article reading and sentence rows."""
import json

import pytest

from tessera.functions.labels import any_positive
from tessera.operators.sentences import explode_sentences
from tessera.sources.articles import read_articles_jsonl


def _write(tmp_dir, lines):
    p = f"{tmp_dir}/a.jsonl"
    with open(p, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return p


def test_jsonl_defaults_and_casts(spark, tmp_dir):
    recs = [json.dumps({"article_id": "a", "sentences": ["x", "y", "z"], "sentence_labels": ["1", True, 1.7, 0]}),
            "   ",
            "",
            json.dumps({"article_id": "b", "domain": "W", "split": "test", "sentences": ["q"],
                        "sentence_labels": [2], "subtypes": ["loaded"]}),
            json.dumps({"article_id": "c", "sentences": [], "sentence_labels": []})]
    df = read_articles_jsonl(spark, _write(tmp_dir, recs))
    rows = {r.article_id: r for r in df.withColumn("label", any_positive("sentence_labels")).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert (rows["a"].domain, rows["a"].split) == ("MBIB", "train")
    assert rows["a"].sentence_labels == [1, 1, 1, 0]
    assert rows["b"].label == 0  # label 2 is not positive
    assert rows["c"].label == 0  # no sentences
    sents = explode_sentences(df).collect()
    assert sorted((r.article_id, r.pos, r.label) for r in sents) == [
        ("a", 0, 1), ("a", 1, 1), ("a", 2, 1), ("b", 0, 2)]  # extra label ignored


def test_missing_required_field_fails(spark, tmp_dir):
    p = _write(tmp_dir, [json.dumps({"sentences": ["x"], "sentence_labels": [0]})])
    with pytest.raises(Exception):
        read_articles_jsonl(spark, p).collect()


def test_too_few_labels_fails(spark, tmp_dir):
    p = _write(tmp_dir, [json.dumps({"article_id": "a", "sentences": ["x", "y"], "sentence_labels": [0]})])
    with pytest.raises(Exception):
        explode_sentences(read_articles_jsonl(spark, p)).collect()


def test_synthetic_corpus_invariants(spark):
    from tessera.sources.synthetic import synthetic_articles
    a = synthetic_articles(spark).collect()
    assert len(a) == 180 and len({r.article_id for r in a}) == 180
    by_split = {}
    for r in a:
        assert 5 <= len(r.sentences) <= 8 and sum(r.sentence_labels) <= 2
        assert len(r.sentences) == len(r.sentence_labels) == len(r.subtypes)
        for s, y, st in zip(r.sentences, r.sentence_labels, r.subtypes):
            assert (st in ("loaded", "emotive")) == (y == 1) and (("draconian" in s) == (y == 1))
        by_split[r.split] = by_split.get(r.split, 0) + 1
    assert by_split == {"train": 90, "val": 30, "test": 60}
    again = synthetic_articles(spark).repartition(7).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, again))


def test_null_domain_gets_default(spark, tmp_dir):
    p = _write(tmp_dir, [json.dumps({"article_id": "a", "domain": None, "split": None,
                                     "sentences": ["x"], "sentence_labels": [0]})])
    r = read_articles_jsonl(spark, p).first()
    assert (r.domain, r.split) == ("MBIB", "train")  # X13
