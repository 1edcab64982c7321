"""The pipeline against the operators applied by brute force, stage by stage, and the registered queries."""
import os
import re
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from tessera.llm.common import written  # noqa: E402
from tessera.llm.quality_qda import quality_scores  # noqa: E402
from tessera.llm.simhash import fingerprint  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="testdata not present")


def test_stages(spark):
    import duckdb

    from tessera.llm.queries import MIX_SQL
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], SF), name))
    for t in tables[:5]:
        assert t.columns == columns
    rows = [[tuple(r) for r in t.collect()] for t in tables]

    good = {r.doc_id for r in quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            .where("predicted = 1").collect()}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if r[0] in good)

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in sorted(rows[1]):
        first.setdefault(norm(r[1]), r)
    assert sorted(rows[2]) == sorted(first.values())

    left, top = sorted(rows[2]), {}
    fps = [fingerprint((r[1] or "").encode(), 3, 42) for r in left]
    for i in range(len(left)):
        top[i] = i
    for i in range(len(left)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = top[i], top[j]
                for k in top:
                    if top[k] == max(a, b):
                        top[k] = min(a, b)
    assert sorted(rows[3]) == [r for i, r in enumerate(left) if top[i] == i]

    con = duckdb.connect()
    con.execute("CREATE TABLE docs (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO docs VALUES (?, ?, ?, ?, ?)", rows[3])
    want = {i: n for i, n in con.execute(
        "WITH " + MIX_SQL.replace("{docs}", "docs") + " SELECT doc_id, copies FROM mix").fetchall() if n}
    assert Counter(r[0] for r in rows[4]) == want

    pieces = tables[5].collect()
    assert Counter((r.doc_id) for r in pieces if r.start == 0) == want
    fill = Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_registered(spark):
    import __spark_entry__ as E
    names = [q for q in E.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
    assert "pipeline" in E.queries()
