"""Works: rollups, gates and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import registry
from corpusloom.plans.book import query
from corpusloom.session import read


@query("""
WITH b AS (SELECT id AS work_id, unnest(range(len(passage_ids))) AS pos, unnest(passage_ids) AS passage_id FROM works),
p AS (SELECT id, max({w: word_count, t: themes}) AS p FROM passages GROUP BY id),
m AS (SELECT work_id, pos, passage_id, p.p.w AS w, p.p.t AS t FROM b JOIN p ON p.id = b.passage_id)
SELECT work_id, string_agg(passage_id, ',' ORDER BY pos) AS ids, CAST(coalesce(sum(w), 0) AS BIGINT) AS words,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(flatten(list(coalesce(t, []))), lambda x: x IS NOT NULL))), ','), '') AS themes FROM m GROUP BY work_id""")
def work_rollup(spark: SparkSession, d: str) -> DataFrame:
    return registry.rollup(read(spark, d, "works", "id", "passage_ids"), read(spark, d, "passages", "id", "word_count", "themes"))


@query("""
WITH b AS (SELECT id AS work_id, unnest(passage_ids) AS passage_id FROM works), p AS (SELECT DISTINCT id FROM passages WHERE id IS NOT NULL)
SELECT 'repeated-work' AS check, id FROM works GROUP BY id HAVING count(*) > 1 UNION ALL
SELECT 'shared-passage', passage_id FROM b GROUP BY passage_id HAVING count(DISTINCT work_id) > 1 UNION ALL
SELECT 'loose-passage', id FROM p WHERE id NOT IN (SELECT passage_id FROM b WHERE passage_id IS NOT NULL) UNION ALL
SELECT 'empty-work', id FROM works WHERE id NOT IN (SELECT work_id FROM b JOIN p ON p.id = b.passage_id)""")
def registry_gate(spark: SparkSession, d: str) -> DataFrame:
    return registry.registry_gate(read(spark, d, "works", "id", "passage_ids"), read(spark, d, "passages", "id"))


@query("""
WITH p AS (SELECT id, author, source_url, text, coalesce(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v\\x{a0}]+', ' ', 'g')), '') = '' AS blank,
  CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> '')) END AS words FROM passages)
SELECT 'repeated-id' AS check, id, count(*) AS n FROM p GROUP BY id HAVING count(*) > 1 UNION ALL
SELECT DISTINCT 'blank-text', id, 1 FROM p WHERE blank UNION ALL SELECT DISTINCT 'short-text', id, 1 FROM p WHERE NOT blank AND words < 20 UNION ALL
SELECT DISTINCT 'missing-author', id, 1 FROM p WHERE author IS NULL UNION ALL SELECT DISTINCT 'missing-source_url', id, 1 FROM p WHERE source_url IS NULL""")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return registry.validation(read(spark, d, "passages", "id", "text", "author", "source_url"), ["author", "source_url"])


@query("""
WITH q AS (SELECT id AS quote_id, CASE WHEN bucket = 'off-topic' THEN 'absent' ELSE 'present' END AS expect, substr(text, 1, 30) AS anchor FROM golden_set),
h AS (SELECT quote_id, count(DISTINCT p.id) AS found FROM q JOIN passages p ON contains(lower(p.text), lower(q.anchor)) GROUP BY quote_id)
SELECT q.quote_id, expect, coalesce(found, 0) AS found, CASE WHEN (expect = 'absent' AND coalesce(found, 0) = 0) OR (expect <> 'absent' AND coalesce(found, 0) > 0) THEN 'PASS' ELSE 'FAIL' END AS status FROM q LEFT JOIN h ON q.quote_id = h.quote_id""")
def sentinel_suite(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "golden_set", "id", "bucket", "text").select(F.col("id").alias("quote_id"), F.when(F.col("bucket") == "off-topic", "absent").otherwise("present").alias("expect"), F.substring("text", 1, 30).alias("anchor"))
    return registry.sentinels(read(spark, d, "passages", "id", "text"), q)


@query("""
SELECT id, source_id, CASE WHEN starts_with(source_id, 'jx-journal') THEN 'journal' WHEN contains(source_id, '-hymn-') THEN 'hymns' WHEN contains(source_id, '-letter-') THEN 'letters' ELSE 'prose' END AS kind FROM works""")
def work_kinds(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("source_id")
    rules = [(s.startswith("jx-journal"), "journal"), (s.contains("-hymn-"), "hymns"), (s.contains("-letter-"), "letters"), (F.lit(True), "prose")]
    return registry.classified(read(spark, d, "works", "id", "source_id"), rules, "kind").select("id", "source_id", "kind")


@query("""
SELECT id, r AS closed_reason, r IS NULL AS open FROM (SELECT id, CASE WHEN coalesce(word_count, 0) < 100 THEN 'too short' WHEN license_text IS NULL THEN 'no license' WHEN regexp_matches(coalesce(editorial_note, ''), 'doubt') THEN 'doubtful' END AS r FROM works)""")
def closing_reasons(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "works", "id", "word_count", "license_text", "editorial_note")
    reasons = [(F.coalesce("word_count", F.lit(0)) < 100, "too short"), (F.col("license_text").isNull(), "no license"), (F.coalesce("editorial_note", F.lit("")).rlike("doubt"), "doubtful")]
    return registry.quality_flag(w, reasons).select("id", "closed_reason", "open")


@query("""
SELECT corpus, 0 AS part, string_agg('<url><loc>https://example.org/' || replace(id, '&', '&amp;') || '</loc></url>', chr(10) ORDER BY id) AS xml FROM works WHERE open GROUP BY corpus""")
def sitemap(spark: SparkSession, d: str) -> DataFrame:
    return registry.sitemap(read(spark, d, "works", "id", "corpus", "open"), "https://example.org")


@query("""
WITH b AS (SELECT id AS work_id, unnest(range(len(passage_ids))) AS pos, unnest(passage_ids) AS passage_id FROM works WHERE open)
SELECT work_id, string_agg(text, chr(10) || chr(10) ORDER BY pos, text) AS text FROM b JOIN (SELECT id, max(text) AS text FROM passages GROUP BY id) p ON p.id = b.passage_id WHERE text IS NOT NULL GROUP BY work_id""")
def registry_text_export(spark: SparkSession, d: str) -> DataFrame:
    return registry.text_export(read(spark, d, "works", "id", "passage_ids", "open"), read(spark, d, "passages", "id", "text"))


@query("""
SELECT count(CASE WHEN open THEN 1 END) AS open_works, count(CASE WHEN NOT coalesce(open, false) THEN 1 END) AS closed_works,
  (SELECT count(DISTINCT id) FROM passages) AS passages, (SELECT CAST(coalesce(sum(word_count), 0) AS BIGINT) FROM passages) AS words FROM works""")
def export_manifest(spark: SparkSession, d: str) -> DataFrame:
    return registry.manifest(read(spark, d, "works", "open"), read(spark, d, "passages", "id", "word_count"))


@query("""
SELECT corpus, '| id | title |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || id || ' | ' || coalesce(title, '') || ' |', chr(10) ORDER BY id) AS report FROM works GROUP BY corpus""")
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.sources import io

    return io.markdown_rows(read(spark, d, "works", "corpus", "id", "title"), ["id", "title"], [F.col("id")], "corpus")


@query("""
SELECT id, numbering.bicentennial AS bicentennial, numbering.sugden AS sugden, source_edition.year AS edition_year, len(coalesce(title_alt, [])) AS alt_titles FROM works""")
def work_records(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "works", "id", "numbering", "source_edition", "title_alt")
    return w.select("id", F.col("numbering.bicentennial").alias("bicentennial"), F.col("numbering.sugden").alias("sugden"), F.col("source_edition.year").alias("edition_year"), F.coalesce(F.when(F.col("title_alt").isNull(), 0).otherwise(F.size("title_alt")), F.lit(0)).alias("alt_titles"))


@query("""
WITH e AS (SELECT book, chapter, string_agg(e, '; ' ORDER BY e) AS entries FROM (SELECT book, chapter, passage_id || ':' || coalesce(CAST(verse_start AS VARCHAR), '') || CASE WHEN verse_end > verse_start THEN '-' || verse_end ELSE '' END AS e
  FROM scripture_refs WHERE book IS NOT NULL AND chapter IS NOT NULL AND passage_id IS NOT NULL) GROUP BY book, chapter)
SELECT book, 0 AS part, '{' || string_agg('"' || chapter || '":"' || entries || '"', ',' ORDER BY CAST(chapter AS VARCHAR)) || '}' AS document FROM e GROUP BY book""")
def nested_citation_index(spark: SparkSession, d: str) -> DataFrame:
    """The citation index as one JSON document per book."""
    from corpusloom.operators import citations

    return citations.nested_index(read(spark, d, "scripture_refs"))
