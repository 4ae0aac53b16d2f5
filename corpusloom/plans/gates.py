"""Gates over the tables and over results made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import gates, journal, segment
from corpusloom.plans.book import query
from corpusloom.plans.journal import _PARAGRAPHS, _paragraphs
from corpusloom.session import read


@query(f"""SELECT doc_id, 2 AS expected, (len(l) + 1) // 2 AS found FROM (SELECT doc_id, l FROM {_PARAGRAPHS}) WHERE len(l) > 0 AND (len(l) + 1) // 2 <> 2""")
def block_count_gate(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose chapters make another number of blocks than two (openings kept apart by their number)."""
    piece = lambda p, i: F.concat(F.when(i % 2 == 0, "Chapter I\n").otherwise("Chapter II\n"), i.cast("string"), F.lit(" "), p)
    books = _paragraphs(spark, d).select("doc_id", F.concat(F.array_join(F.transform("l", piece), "\n"), F.lit("\n")).alias("text"))
    blocks = segment.reset_blocks(books, r"[ \t]*Chapter\s+([IVXLCDM]+)[ \t]*\n", ["First", "Second"], "doc_id")
    return gates.block_counts(blocks, 2).withColumnRenamed("id", "doc_id")


_DIMS, _COUNTERS = ["grace", "holiness"], ["pride"]


@query("""
WITH n AS (SELECT id, CAST(substr(id, 4, 3) AS INT) AS n FROM golden_set)
SELECT id, 'missing label' AS problem FROM n WHERE n % 5 = 1 UNION ALL SELECT id, 'keys of dimensions' FROM n WHERE n % 5 = 2 UNION ALL SELECT id, 'overall_score out of range' FROM n WHERE n % 5 = 3
UNION ALL SELECT id, 'unknown stance' FROM n WHERE n % 5 = 4 UNION ALL SELECT id, 'dimension score out of range' FROM n WHERE n % 7 = 0""")
def judged_results(spark: SparkSession, d: str) -> DataFrame:
    """Problems of judge results that are sound but for the defects put in by number."""
    n = read(spark, d, "golden_set", "id").withColumn("n", F.substring("id", 4, 3).cast("int"))
    score = lambda s: F.struct(s.alias("score"))
    second = F.when(F.col("n") % 5 == 2, "elsewhere").otherwise("holiness")
    payload = F.struct(
        F.when(F.col("n") % 5 == 3, 101).otherwise(F.col("n") % 100).alias("overall_score"), F.when(F.col("n") % 5 != 1, "fair").alias("label"), F.lit("as it is").alias("summary"),
        F.create_map(F.lit("grace"), score(F.when(F.col("n") % 7 == 0, -1).otherwise(5)), second, score(F.lit(100))).alias("dimensions"),
        F.create_map(F.lit("pride"), F.struct(F.when(F.col("n") % 5 == 4, "perhaps").otherwise("absent").alias("stance"))).alias("counter_indicators"),
    )
    return gates.judge_problems(n.select("id", F.to_json(payload).alias("payload")), _DIMS, _COUNTERS)


@query("""
WITH o AS (SELECT doc_id, text AS a, CASE WHEN doc_id % 6 = 0 THEN substr(text, 1, length(text) // 2) WHEN doc_id % 7 = 0 THEN 'Preface. ' || text WHEN doc_id % 11 = 0 THEN replace(text, '?', '.') ELSE text END AS b FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, a, b, len(list_filter(string_split_regex(a, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS wa, len(list_filter(string_split_regex(b, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS wb FROM o),
f AS (SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(a, '?') AND NOT contains(b, '?') THEN 'questions' END, CASE WHEN abs(wb - wa) > 0.08 * wa THEN 'words' END,
  CASE WHEN substr(trim(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g')), 1, 60) <> substr(trim(regexp_replace(lower(b), '[^a-z0-9]+', ' ', 'g')), 1, 60) THEN 'opening' END], lambda x: x IS NOT NULL), ',') AS reasons FROM n)
SELECT doc_id, reasons, (SELECT count(*) > 15 FROM f WHERE reasons <> '') AS halted FROM f WHERE reasons <> ''""")
def reextraction_gate(spark: SparkSession, d: str) -> DataFrame:
    """Documents extracted again, some cut, some with a preface, some with their questions lost."""
    old = read(spark, d, "documents", "doc_id", "text").where("text is not null")
    k, t = F.col("doc_id"), F.col("text")
    new = F.when(k % 6 == 0, F.expr("substr(text, 1, length(text) div 2)")).when(k % 7 == 0, F.concat(F.lit("Preface. "), t)).when(k % 11 == 0, F.replace(t, F.lit("?"), F.lit("."))).otherwise(t)
    return gates.reextraction(old, old.select("doc_id", new.alias("text")), "doc_id")


@query()
def sentinel_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Where the passages that tell of a reference stand, and how near their wording is to what it should be."""
    g = read(spark, d, "golden_set", "id", "bucket", "text").where("text is not null")
    s = g.select("id", F.when(F.col("bucket") == "off-topic", "absent").otherwise("present").alias("expect"), F.substring("text", 1, 30).alias("anchor"), F.substring("text", 1, 240).alias("canonical"), F.lit("jx-").alias("source_id"))
    return gates.sentinel_verdicts(read(spark, d, "passages", "id", "source_id", "text"), s)


@query("""
WITH c AS (SELECT id, unnest([0, 1, 2]) AS ordinal, unnest([substr(text, 1, 40), substr(text, 1, 22), substr(text, 50, 18)]) AS anchor FROM golden_set WHERE text IS NOT NULL),
h AS (SELECT c.id, ordinal, anchor, count(DISTINCT p.id) AS found FROM c JOIN passages p ON trim(anchor) <> '' AND contains(lower(p.text), lower(anchor)) GROUP BY c.id, ordinal, anchor),
f AS (SELECT id, min({o: ordinal, a: anchor, f: found}) AS m FROM h GROUP BY id)
SELECT g.id, m.o AS ordinal, m.a AS anchor, coalesce(m.f, 0) AS found FROM (SELECT DISTINCT id FROM c) g LEFT JOIN f ON f.id = g.id""")
def first_anchors(spark: SparkSession, d: str) -> DataFrame:
    """For each reference the first of three anchors that the passages hold."""
    g = read(spark, d, "golden_set", "id", "text").where("text is not null")
    tries = F.array(*(F.struct(F.lit(k).alias("ordinal"), F.substring("text", a, n).alias("anchor")) for k, (a, n) in enumerate(((1, 40), (1, 22), (50, 18)))))
    anchors = g.select("id", F.explode(tries).alias("t")).select("id", "t.*")
    return gates.first_present(read(spark, d, "passages", "id", "text"), anchors)


@query("SELECT g.id, g.bucket, length(g.text) AS n FROM golden_set g")
def required_rows(spark: SparkSession, d: str) -> DataFrame:
    """A join that fails where a row has no partner; every one has."""
    g = read(spark, d, "golden_set", "id", "bucket", "text")
    return gates.required(g.select("id", "bucket"), g.select("id", F.length("text").alias("n")), "id")


@query("""
WITH s AS (SELECT source_id, CASE WHEN bool_or(source_url IS NOT NULL AND source_url <> '') THEN 'green' WHEN min(source_type) IN ('letter', 'journal') THEN 'yellow' ELSE 'red' END AS verdict, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS words FROM passages WHERE source_id IS NOT NULL GROUP BY source_id)
SELECT source_id, verdict, words, CASE verdict WHEN 'red' THEN 0 WHEN 'yellow' THEN 1 ELSE 2 END AS rank, row_number() OVER (PARTITION BY verdict ORDER BY words DESC, source_id) AS place FROM s""")
def ranked_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources by verdict, the worst first, then by falling number of words."""
    p = read(spark, d, "passages", "source_id", "source_url", "source_type", "word_count").where("source_id is not null")
    s = p.groupBy("source_id").agg(F.bool_or(F.coalesce(F.col("source_url") != "", F.lit(False))).alias("url"), F.min("source_type").alias("kind"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))
    verdict = T.first_match([(F.col("url"), "green"), (F.col("kind").isin("letter", "journal"), "yellow")], "red")
    return gates.ranked(s.select("source_id", verdict.alias("verdict"), "words"), "verdict", ["red", "yellow", "green"], "words", "source_id")
