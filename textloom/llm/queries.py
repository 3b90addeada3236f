"""The package's registered queries, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, importance, infinigram, langid, lines, mixing, near, quality, secrets, toxicity
from .common import WORDS_SQL, table


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.jaccard_join(table(spark, sf_dir, "documents"))


def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infinigram.scores(table(spark, sf_dir, "documents"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.run_report(table(spark, sf_dir, "documents"))


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def _importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_jaccard_join": _near,
    "op2_source_mixing": _mixing,
    "op3_quality_rules": _quality,
    "op4_lm_scoring": _scoring,
    "op5_line_dedup": _lines,
    "op6_toxicity": _toxicity,
    "op7_language_id": _langid,
    "op8_quality_classifier": _importance,
    "op9_decontamination": _decontaminate,
    "op10_secret_scan": _secrets,
}

NEAR_ORACLE = f"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, text) AS d, doc_id, {WORDS_SQL} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
g AS MATERIALIZED (SELECT DISTINCT d, array_to_string(w[k:k + {near.N} - 1], ' ') AS g FROM (SELECT d, w, unnest(range(1, greatest(1, len(w) - {near.N} + 1) + 1)) AS k FROM docs WHERE len(w) > 0)),
sets AS MATERIALIZED (SELECT d, list_sort(list(g)) AS s, count(*) AS n FROM g GROUP BY d),
nodes AS MATERIALIZED (SELECT min(d) AS node, list(d) AS ds, count(*) AS copies, any_value(n) AS n FROM sets GROUP BY s),
tokens AS MATERIALIZED (SELECT node, g.g FROM nodes JOIN g ON g.d = node),
shared AS (SELECT x.node AS a, y.node AS b, count(*) AS m FROM tokens x JOIN tokens y ON x.g = y.g AND x.node < y.node GROUP BY ALL),
pairs AS MATERIALIZED (SELECT a, b FROM shared JOIN nodes x ON a = x.node JOIN nodes y ON b = y.node WHERE m / CAST(x.n + y.n - m AS DOUBLE) >= {near.THRESHOLD}::DOUBLE - 1e-12),
edges AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
member AS (SELECT node, copies, unnest(ds) AS d FROM nodes),
classes AS (SELECT r.a AS node, min(docs.doc_id) AS class_id, count(*) AS members FROM reach r JOIN member m ON m.node = r.b JOIN docs USING (d) GROUP BY r.a),
links AS (SELECT a AS node, count(*) AS n FROM edges GROUP BY a)
SELECT doc_id, class_id, copies - 1 AS n_copies, coalesce(links.n, 0) AS n_links
FROM member JOIN docs USING (d) JOIN classes USING (node) LEFT JOIN links USING (node) WHERE members > 1"""

ORACLES = {
    "op1_ngram_jaccard_join": NEAR_ORACLE,
    "op3_quality_rules": quality.ORACLE,
    "op9_decontamination": decontaminate.ORACLE,
    "op10_secret_scan": secrets.ORACLE,
}
