"""The registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm.centroids import cluster
from tessera.llm.common import file_seed, table
from tessera.session import shared_path
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.html_text import extract_text
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mix
from tessera.llm.packing import pack
from tessera.llm.quality_qda import quality_scores
from tessera.llm.quality_rules import BASE, quality_rules
from tessera.llm.simhash import near_dedup
from tessera.llm.suffix_dedup import suffix_dedup
from tessera.llm.token_files import read_token_files, write_token_files
from tessera.llm.top_k import top_k
from tessera.llm.whitening import whiten


def op1_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents")).drop("_rid")


def tokenizer_path(name="byte_bpe_50k.json"):
    import public_tokenizers
    return public_tokenizers.path(name)


def op2_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, max_tokens=2048)


def op7_token_files(spark, sf_dir):
    path = shared_path(spark, "token_files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return read_token_files(spark, path)


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).drop("_rid")


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op5_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("_rid")


def op8_simhash(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents"), shingle=3, radius=2).select(
        "doc_id", "fingerprint", "component_id")


def op9_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", *BASE, "base_failed", "kept")


def op10_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mix(docs, file_no=file_seed(docs)).select(
        "doc_id", "size", "source_size", "target", "taken")


def op11_centroids(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed=3)[0]


def op12_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")


def op13_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"), components=16, scale=64).withColumn(
        "deviation", F.col("deviation").cast("long"))


OP1_SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS win
      FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM l)),
later AS (SELECT doc_id, pos FROM w
          QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (SELECT unnest([0, 1, 2]) AS k)),
isl AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gone),
n AS (SELECT doc_id, count(*) AS n_removed, count(DISTINCT g) AS n_spans FROM isl GROUP BY 1),
e AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM l),
t AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.pos) AS text
      FROM e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos WHERE g.pos IS NULL GROUP BY 1)
SELECT l.doc_id, len(ls)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(t.text, '') AS text
FROM l LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
           FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

MIX_SQL = r"""
d AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             length(coalesce(text, '')) AS nc FROM {docs}),
k AS (SELECT *, greatest((6.0::DOUBLE / (6.0::DOUBLE + abs(nc::DOUBLE / greatest(size, 1)::DOUBLE - 6.0::DOUBLE)))
                         * (size::DOUBLE / (size::DOUBLE + 20.0::DOUBLE)), 0.01::DOUBLE) AS weight,
      ((('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE)
      / 4503599627370496.0::DOUBLE AS u FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
s1 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][
                 ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w,
              source_size::DOUBLE * 3.0::DOUBLE AS most, sum(source_size) OVER ()::DOUBLE AS total FROM s0),
s2 AS (SELECT *, total - coalesce(sum(most) OVER o, 0) AS left_size,
              sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS left_w FROM s1
       WINDOW o AS (ORDER BY most / w, source IS NULL, source
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, max(CASE WHEN left_size / left_w * w <= most THEN left_size / left_w END) OVER () AS level
       FROM s2),
s4 AS (SELECT source, source_size, coalesce(least(most, level * w), most) AS target FROM s3),
m0 AS (SELECT k.*, s4.source_size, s4.target,
              CASE WHEN s4.source_size > 0 THEN floor(s4.target / s4.source_size) ELSE 0 END AS epochs,
              -ln(u) / weight AS key
       FROM k JOIN s4 ON k.source IS NOT DISTINCT FROM s4.source),
m1 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM m0),
mix AS (SELECT *, least(epochs::BIGINT + CASE WHEN ahead + size / 2.0 <= target - epochs * source_size
                                              THEN 1 ELSE 0 END, 3) AS copies FROM m1)
"""

OP10_SQL = ("WITH " + MIX_SQL.replace("{docs}", "documents") + """
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM mix
""")


USABLE_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"


def centroids_sql(k=8, rounds=10, dim=64, scale=1024, seed=3):
    """Ten rounds written out, each one with its table of centroids."""
    def dist(a, b):
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"

    def nearest(c):
        return f"""SELECT r, arg_min(no, (d, no)) AS no, min(d) AS d FROM (
            SELECT r, no, {dist('v.x', 'c.x')} AS d FROM v, {c} c) GROUP BY r"""

    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, sha256('{seed}:' || vec_id) AS h,
            list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS x
        FROM embeddings WHERE {USABLE_SQL} AND len(embedding) = {dim})""",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS no, x FROM v ORDER BY h, x LIMIT {k})"]
    for i in range(rounds):
        parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.no, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
            SELECT no, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM (
                SELECT no, j, sum(x)::BIGINT AS s, count(*) AS n FROM (
                    SELECT a.no, unnest(v.x) AS x, unnest(range(len(v.x))) AS j
                    FROM ({nearest(f'c{i}')}) a JOIN v USING (r)) GROUP BY no, j) GROUP BY no) m USING (no))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, no::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY no))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM ({nearest(f'c{rounds}')}) a JOIN v USING (r) JOIN c{rounds} c USING (no)"""


TOP_K_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id,
                  list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
           FROM embeddings WHERE {USABLE_SQL}),
s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, v.r AS r2,
             list_sum(list_transform(list_zip(q.x, v.x), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v ON q.r <> v.r WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER o)::INTEGER AS rank, vec_id, score FROM s
WINDOW o AS (PARTITION BY r ORDER BY score DESC, vec_id, r2) QUALIFY row_number() OVER o <= 5
"""


def queries():
    return {f.__name__: f for f in (
        op1_line_dedup, op2_packing, op3_exact_dedup, op4_suffix_dedup, op5_html_text, op6_quality_classifier, op7_token_files, op8_simhash,
        op9_quality_rules, op10_mixing, op11_centroids, op12_top_k, op13_whitening)}


def oracle_sql():
    return {"op1_line_dedup": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op10_mixing": OP10_SQL,
            "op11_centroids": centroids_sql(), "op12_top_k": TOP_K_SQL}
