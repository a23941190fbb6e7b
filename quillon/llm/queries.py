"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import (
    ann_tree,
    exact_dedup,
    jaccard_join,
    line_dedup,
    mixing,
    ppm,
    secrets,
    sentencepiece_bpe,
    token_counts,
    toxicity,
)
from quillon.llm.common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read(spark, sf_dir, "documents"), runs=True)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents")).drop("class_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.nearest(read(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.lm_scores(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_mixing": op4_mixing,
    "op5_secrets": op5_secrets,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_nearest": op7_nearest,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_lm_scores": op10_lm_scores,
}

def _found(kind: str, pattern: str, least: str) -> str:
    """DuckDB SQL: rows of (doc_id, kind, start, stop, value) for one pattern."""
    return f"""
        SELECT doc_id, '{kind}' AS kind, source,
               unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
                   "start" := list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT
                              + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT,
                   hit := m[i]))) AS s
        FROM (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), {pattern}) AS m,
                     string_split_regex(coalesce(text, ''), {pattern}) AS p FROM documents)
        WHERE len(m) > 0 {least}"""


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_ASSIGNED = f"regexp_extract(s.hit, {_sql(secrets.ASSIGN)}, 2)"
_SECRETS_SQL = f"""
    WITH a AS ({_found("assign", _sql(secrets.ASSIGN), "")}),
    base AS (
        SELECT doc_id, 0 AS k, kind, source, s.start AS b, s.start + length(s.hit) AS e, {_ASSIGNED} AS value
        FROM a WHERE length({_ASSIGNED}) >= 12
        UNION ALL SELECT doc_id, 1, kind, source, s.start, s.start + length(s.hit), s.hit
        FROM ({_found("access", _sql("AKIA[A-Z0-9]+"), "")}) WHERE length(s.hit) >= 18
        UNION ALL SELECT doc_id, 2, kind, source, s.start, s.start + length(s.hit), s.hit
        FROM ({_found("hex", _sql("[0-9a-f]+"), "")}) WHERE length(s.hit) >= 16
    ), bare AS (
        SELECT doc_id, 3 AS k, 'owned' AS kind, source, s.start AS b, s.start + length(s.hit) AS e, s.hit AS value
        FROM ({_found("owned", _sql(secrets.BARE), "")})
    ), mixed AS (
        SELECT * FROM base UNION ALL
        SELECT * FROM bare x WHERE regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
            AND regexp_matches(value, '[0-9]') AND len(list_distinct(string_split(value, ''))) >= 12
            AND NOT EXISTS (SELECT 1 FROM base y WHERE y.doc_id = x.doc_id AND y.b < x.e AND x.b < y.e)
    ), owners AS (
        SELECT value, count(DISTINCT coalesce('o' || source, 'n')) AS owners, count(DISTINCT coalesce('r' || doc_id, 'n')) AS repos
        FROM mixed GROUP BY value
    ), told AS (
        SELECT *, owners < {secrets.WIDE} AND repos < {secrets.WIDE_REPOS} AS live FROM mixed JOIN owners USING (value)
    ), per AS (
        SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
               count(*) FILTER (k = 2) AS n_hex,
               string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) FILTER (k < 3) AS base,
               string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) FILTER (k < 3 OR live) AS spans,
               count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live AND k < 3) AS n_copied,
               max(repos) AS repos, max(owners) AS owners
        FROM told GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
           coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
           coalesce(repos, 0) AS repos, coalesce(owners, 0) AS owners
    FROM documents LEFT JOIN per USING (doc_id)
"""

ORACLE_SQL = {
    "op3_jaccard_join": r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), s AS (
        SELECT doc_id, unnest(list_distinct(CASE
            WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g
        FROM d
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
        FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
    ), l AS (
        SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
    ), r AS (
        SELECT doc_id AS node, doc_id AS comp FROM documents
        UNION SELECT b, comp FROM r JOIN l ON a = node
    )
    SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(comp) AS component_id
    FROM documents LEFT JOIN n USING (doc_id) JOIN r ON node = doc_id GROUP BY doc_id
    """,
    "op5_secrets": _SECRETS_SQL,
    "op6_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), g AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM d
        )
        SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
}
