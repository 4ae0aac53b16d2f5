"""Search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import search
from corpusloom.plans.book import query
from corpusloom.session import read


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "passages", "id", "author", "source_type", "source_title", "text")


@query("""
SELECT id, source_title FROM (SELECT id, source_title, row_number() OVER (PARTITION BY id ORDER BY source_title NULLS FIRST) AS r FROM passages
  WHERE source_type = 'sermon' AND contains(lower(text), 'patience') AND contains(lower(text), 'weaver')) WHERE r = 1 ORDER BY id LIMIT 50""")
def keyword_and_search(spark: SparkSession, d: str) -> DataFrame:
    """Filters reach the scan; only ids and titles of the rows that pass are gathered by id."""
    hits = search.matching(_passages(spark, d), "Patience weaver", source_type="sermon", author="").select("id", "source_title")
    return hits.groupBy("id").agg(F.min(F.struct("source_title")).alias("m")).select("id", "m.source_title").orderBy("id").limit(50)


@query("""
SELECT id, max(score) AS score FROM (SELECT id, CAST(100 * (length(lower(coalesce(source_title, ''))) - length(replace(lower(coalesce(source_title, '')), 'patience', ''))) / 8
  + (length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), 'patience', ''))) / 8 AS INT) AS score FROM passages)
WHERE score > 0 GROUP BY id ORDER BY score DESC, id LIMIT 20""")
def scored_search(spark: SparkSession, d: str) -> DataFrame:
    """Rows are scored where they are read; what is gathered by id is a number."""
    hits = search.with_score(_passages(spark, d), "Patience").where("score > 0").select("id", "score")
    return hits.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "id").limit(20)


@query("""
SELECT DISTINCT id FROM passages WHERE list_contains(themes, (SELECT min(theme_id) FROM themes))""")
def theme_filter(spark: SparkSession, d: str) -> DataFrame:
    first = read(spark, d, "themes", "theme_id").agg(F.min("theme_id").alias("t")).first()["t"]
    return read(spark, d, "passages", "id", "themes").where(search.has_theme(F.col("themes"), first)).select("id").distinct()


@query("SELECT DISTINCT id FROM passages WHERE coalesce(len(themes), 0) = 0")
def untagged(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "passages", "id", "themes").where(search.is_untagged(F.col("themes"))).select("id").distinct()


@query("""
SELECT doc_id, CASE WHEN k > 40 THEN '...' ELSE '' END || substr(text, greatest(k - 40, 0) + 1, least(k + 6 + 40, length(text)) - greatest(k - 40, 0)) || CASE WHEN k + 46 < length(text) THEN '...' ELSE '' END AS context FROM (
  SELECT doc_id, text, strpos(lower(text), 'weaver') - 1 AS k FROM documents WHERE text IS NOT NULL) WHERE k >= 0""")
def context_snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents", "doc_id", "text").where("text is not null")
    return docs.select("doc_id", T.context(F.col("text"), "weaver", 40).alias("context")).where("context is not null")


@query("""
SELECT doc_id, CASE WHEN length(f) <= 80 THEN f ELSE regexp_replace(substr(f, 1, 80), ' [^ ]*$', '') || '…' END AS snippet FROM (
  SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS f FROM documents WHERE text IS NOT NULL)""")
def text_snippets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.snippet(F.col("text"), 80).alias("snippet"))


@query("""
SELECT doc_id, CASE WHEN length(text) <= 100 THEN text WHEN strpos(c, ' ') > 0 AND 100 - strpos(reverse(c), ' ') > 80 THEN substr(c, 1, 100 - strpos(reverse(c), ' ')) || '...' ELSE c || '...' END AS short FROM (
  SELECT doc_id, text, substr(text, 1, 100) AS c FROM documents WHERE text IS NOT NULL)""")
def truncated(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.truncate(F.col("text"), 100).alias("short"))


@query("""
SELECT doc_id, replace(regexp_replace(regexp_replace(e, '(?i)(patience)', '<mark>\\1</mark>', 'g'), '(?i)(weaver)', '<mark>\\1</mark>', 'g'), chr(10), '<br>' || chr(10)) AS html FROM (
  SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS e FROM documents WHERE text IS NOT NULL)""")
def highlighted(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents", "doc_id", "text").where("text is not null")
    return docs.select("doc_id", T.line_breaks(T.highlight(F.col("text"), ["patience", "weaver", "a"])).alias("html"))


@query("""
SELECT id FROM (SELECT DISTINCT id FROM passages) ORDER BY sha256('7' || id), id LIMIT 10""")
def random_passages(spark: SparkSession, d: str) -> DataFrame:
    """Ten passages in the order of a hash: the sample is the feature."""
    return search.random_rows(read(spark, d, "passages", "id").distinct(), 10, "7").select("id")


@query("""
SELECT DISTINCT passage_id, reference FROM scripture_refs WHERE (lower(book) = 'matthew' OR (NOT EXISTS (SELECT 1 FROM scripture_refs WHERE lower(book) = 'matthew') AND starts_with(lower(book), 'matthew')))
  AND 10 BETWEEN verse_start AND coalesce(verse_end, verse_start) AND chapter = 5""")
def citation_lookup(spark: SparkSession, d: str) -> DataFrame:
    return search.citations(read(spark, d, "scripture_refs", "passage_id", "reference", "book", "chapter", "verse_start", "verse_end"), "Matthew 5:10").select("passage_id", "reference").distinct()
