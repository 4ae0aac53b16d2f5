"""The named queries of the training-text operators, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import abuse, leakage, neardup, packing, quality, scan, sentences, splitting, topn
from corpusloom.session import read

Query = Callable[[SparkSession, str], DataFrame]


def _audited(spark: SparkSession, d: str, task: str) -> DataFrame:
    return read(spark, d, "audit_sample", "id", "task").where(F.col("task") == task).select("id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.found(read(spark, d, "passages", "id", "text", "source_title"), _audited(spark, d, "sentences"))


def p1_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(read(spark, d, "passages", "id", "text", "source_title"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scan.found(read(spark, d, "passages", "id", "text", "source_title"), _audited(spark, d, "scan_noise"))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan.repaired(read(spark, d, "passages", "id", "text", "source_title"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found(read(spark, d, "passages", "id", "text", "source_title"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_all(read(spark, d, "passages", "id", "text", "source_title"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs(read(spark, d, "passages", "id", "text"))


P4_SQL = """
WITH p AS (SELECT id, min(text) AS t FROM passages WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id),
w AS (SELECT id, regexp_extract_all(lower(t), '[\\pL\\pN]+') AS w FROM p),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 20),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id)
SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k >= 0.5 * (x.n + y.n - k)
"""


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups at the stricter similarity of 0.8, one row per passage id."""
    return neardup.groups(read(spark, d, "passages", "id", "text"), threshold=0.8)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.found(read(spark, d, "passages", "id", "text"))


def p5_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(read(spark, d, "passages", "id", "text", "word_count"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    best = topn.top_by_theme(read(spark, d, "passages", "id", "source_id", "themes"), read(spark, d, "swi_scores", "passage_id", "overall_score", "created_at"), read(spark, d, "themes", "theme_id"))
    return best.select("source_id", "theme", "id")


P6_SQL = """
WITH latest AS (
  SELECT passage_id AS id, created_at, max(overall_score) AS score,
         row_number() OVER (PARTITION BY passage_id ORDER BY created_at DESC NULLS LAST) AS r
  FROM swi_scores WHERE overall_score IS NOT NULL AND passage_id IS NOT NULL GROUP BY passage_id, created_at),
carried AS (SELECT DISTINCT id, source_id, unnest(themes) AS theme FROM passages),
ranked AS (
  SELECT source_id, theme, c.id, row_number() OVER (PARTITION BY source_id, theme ORDER BY score DESC, c.id) AS r
  FROM carried c JOIN latest l ON l.id = c.id AND l.r = 1
  WHERE source_id IS NOT NULL AND theme IN (SELECT theme_id FROM themes))
SELECT source_id, theme, id FROM ranked WHERE r <= 3
"""


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(read(spark, d, "documents", "doc_id", "text"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_pack(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read(spark, d, "documents", "doc_id", "text"), read(spark, d, "golden_set", "id", "text"))


def _weights(spark: SparkSession, d: str) -> dict:
    return abuse.fitted(read(spark, d, "documents", "doc_id", "text"), read(spark, d, "labels", "doc_id", "rater", "toxic"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.found(read(spark, d, "documents", "doc_id", "text"), weights=_weights(spark, d))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(read(spark, d, "documents", "doc_id", "text"), weights=_weights(spark, d))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(read(spark, d, "documents", "doc_id", "source", "text"), weights=_weights(spark, d))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_sentences": p1_sentences,
        "p2_found": p2_found,
        "p2_repaired": p2_repaired,
        "p3_found": p3_found,
        "p3_pieces": p3_pieces,
        "p4_found": p4_found,
        "p4_groups": p4_groups,
        "p5_found": p5_found,
        "p5_statistics": p5_statistics,
        "p6_found": p6_found,
        "p7_pack": p7_pack,
        "p7_fill": p7_fill,
        "p8_found": p8_found,
        "p8_leaks": p8_leaks,
        "p9_found": p9_found,
        "p9_scores": p9_scores,
        "p9_rates": p9_rates,
    }


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL, "p6_found": P6_SQL}
