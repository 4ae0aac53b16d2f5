"""Joins, set operations and updates by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import joins, ordered
from corpusloom.plans.book import query
from corpusloom.session import read


@query("""
SELECT DISTINCT s.passage_id, s.overall_score, p.source_id FROM swi_scores s JOIN (SELECT DISTINCT id, source_id FROM passages) p ON p.id = s.passage_id""")
def score_join(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "swi_scores", "passage_id", "overall_score")
    p = read(spark, d, "passages", "id", "source_id").distinct()
    return s.join(p, s["passage_id"] == p["id"]).select("passage_id", "overall_score", "source_id").distinct()


@query("""
SELECT DISTINCT r.passage_id, r.reference, substr(p.text, 1, 60) AS snippet FROM scripture_refs r LEFT JOIN (SELECT id, max(text) AS text FROM passages GROUP BY id) p ON p.id = r.passage_id""")
def index_snippets(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "scripture_refs", "passage_id", "reference").distinct()
    p = read(spark, d, "passages", "id", "text").groupBy("id").agg(F.max("text").alias("text"))
    return r.join(p, r["passage_id"] == p["id"], "left").select("passage_id", "reference", F.substring("text", 1, 60).alias("snippet"))


@query("""
SELECT work_id, CAST(pos AS INT) AS pos, passage_id, length(text) AS chars FROM (
  SELECT id AS work_id, unnest(range(len(passage_ids))) AS pos, unnest(passage_ids) AS passage_id FROM works) b
JOIN (SELECT id, max(text) AS text FROM passages GROUP BY id) p ON p.id = b.passage_id WHERE text IS NOT NULL""")
def work_passages(spark: SparkSession, d: str) -> DataFrame:
    m = joins.ordered_members(read(spark, d, "works", "id", "passage_ids"), read(spark, d, "passages", "id", "text"))
    return m.select("work_id", "pos", "passage_id", F.length("text").alias("chars"))


@query("""
SELECT DISTINCT id, theme_id, theme_name FROM (SELECT id, unnest(themes) AS t FROM passages) JOIN themes ON t = theme_id""")
def passage_themes(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "passages", "id", "themes").select("id", F.explode("themes").alias("t"))
    t = read(spark, d, "themes", "theme_id", "theme_name")
    return p.join(t, p["t"] == t["theme_id"]).select("id", "theme_id", "theme_name").distinct()


@query("""
SELECT w.id, b.source_id, b.n AS passages, r.refs FROM works w
LEFT JOIN (SELECT source_id, count(*) AS n FROM passages GROUP BY source_id) b ON b.source_id = w.source_id
LEFT JOIN (SELECT p.source_id, count(*) AS refs FROM scripture_refs s JOIN (SELECT DISTINCT id, source_id FROM passages) p ON p.id = s.passage_id GROUP BY p.source_id) r ON r.source_id = w.source_id""")
def work_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Works with two left lookups by source."""
    w = read(spark, d, "works", "id", "source_id")
    p = read(spark, d, "passages", "id", "source_id")
    n = p.groupBy("source_id").agg(F.count("*").alias("passages")).withColumn("b_source", F.col("source_id"))
    refs = read(spark, d, "scripture_refs", "passage_id").join(p.distinct(), F.col("passage_id") == F.col("id")).groupBy("source_id").agg(F.count("*").alias("refs"))
    out = w.join(n, "source_id", "left").join(refs, "source_id", "left")
    return out.select("id", F.col("b_source").alias("source_id"), "passages", "refs")


@query("""
SELECT legacy_id, min(target) AS target FROM (
  SELECT CASE WHEN regexp_matches(coalesce(closed_reason, ''), '^duplicate-of:\\S+') THEN regexp_extract(closed_reason, '^duplicate-of:(\\S+)', 1) ELSE id END AS target, unnest(legacy_ids) AS legacy_id FROM works)
WHERE legacy_id IS NOT NULL GROUP BY legacy_id""")
def legacy_redirects(spark: SparkSession, d: str) -> DataFrame:
    return joins.redirects(read(spark, d, "works", "id", "legacy_ids", "closed_reason"))


@query("""
SELECT passage_id, min(work_id || '#p' || (pos + 1)) AS url FROM (
  SELECT id AS work_id, unnest(range(len(passage_ids))) AS pos, unnest(passage_ids) AS passage_id FROM works) WHERE passage_id IS NOT NULL GROUP BY passage_id""")
def passage_anchors(spark: SparkSession, d: str) -> DataFrame:
    b = joins.bridge(read(spark, d, "works", "id", "passage_ids")).where("passage_id is not null")
    return b.groupBy("passage_id").agg(F.min(F.concat("work_id", F.lit("#p"), (F.col("pos") + 1).cast("string"))).alias("url"))


@query("""
SELECT DISTINCT id FROM passages WHERE id NOT IN (SELECT passage_id FROM swi_scores WHERE passage_id IS NOT NULL AND overall_score IS NOT NULL)""")
def unscored_passages(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "swi_scores", "passage_id", "overall_score").where("overall_score is not null").select(F.col("passage_id").alias("id"))
    return joins.anti(read(spark, d, "passages", "id").distinct(), s, "id")


@query("SELECT DISTINCT passage_id FROM swi_scores WHERE passage_id IS NOT NULL AND passage_id NOT IN (SELECT id FROM passages WHERE id IS NOT NULL)")
def orphan_scores(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "passages", "id").select(F.col("id").alias("passage_id"))
    return joins.anti(read(spark, d, "swi_scores", "passage_id").where("passage_id is not null").distinct(), p, "passage_id")


@query("""
SELECT passage_id, overall_score, engine FROM (
  SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY created_at DESC NULLS LAST, overall_score DESC NULLS LAST, engine DESC NULLS LAST) AS r FROM swi_scores WHERE passage_id IS NOT NULL) WHERE r = 1""")
def latest_scores(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "swi_scores", "passage_id", "overall_score", "engine", "created_at").where("passage_id is not null")
    return joins.latest_per_key(s, ["passage_id"], [F.col("created_at").desc_nulls_last(), F.col("overall_score").desc_nulls_last(), F.col("engine").desc_nulls_last()]).drop("created_at")


@query("""
WITH fresh AS (SELECT passage_id, max(overall_score) AS overall_score FROM swi_scores WHERE engine = (SELECT max(engine) FROM swi_scores) AND passage_id IS NOT NULL GROUP BY passage_id),
base AS (SELECT passage_id, min(overall_score) AS overall_score FROM swi_scores WHERE passage_id IS NOT NULL GROUP BY passage_id)
SELECT * FROM base WHERE passage_id NOT IN (SELECT passage_id FROM fresh) UNION ALL SELECT * FROM fresh""")
def upserted_scores(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "swi_scores", "passage_id", "overall_score", "engine")
    newest = s.agg(F.max("engine")).scalar()
    fresh = s.where((F.col("engine") == newest) & F.col("passage_id").isNotNull()).groupBy("passage_id").agg(F.max("overall_score").alias("overall_score"))
    base = s.where("passage_id is not null").groupBy("passage_id").agg(F.min("overall_score").alias("overall_score"))
    return joins.upsert(base, fresh, "passage_id")


@query("""
WITH p AS (SELECT passage_id, max({c: created_at, t: CAST(overall_score AS VARCHAR)}).t AS patch FROM swi_scores WHERE overall_score IS NOT NULL AND created_at IS NOT NULL GROUP BY passage_id)
SELECT g.id, coalesce(p.patch, g.label) AS label FROM (SELECT id, min(source_type) AS label FROM passages GROUP BY id) g LEFT JOIN p ON p.passage_id = g.id""")
def patched(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a column replaced where a patch has their key; the latest patch counts."""
    base = read(spark, d, "passages", "id", "source_type").groupBy("id").agg(F.min("source_type").alias("label"))
    patches = read(spark, d, "swi_scores", "passage_id", "overall_score", "created_at").where("overall_score is not null and created_at is not null")
    return joins.patch(base, patches.select(F.col("passage_id").alias("id"), F.col("overall_score").cast("string").alias("label"), "created_at"), "id", "label", "created_at")


@query("""
SELECT passage_id FROM (SELECT DISTINCT passage_id FROM scripture_refs WHERE passage_id IS NOT NULL) EXCEPT SELECT id FROM passages""")
def unmatched_refs(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "scripture_refs", "passage_id").where("passage_id is not null")
    return r.subtract(read(spark, d, "passages", "id"))


@query("SELECT passage_id FROM scripture_refs WHERE passage_id IS NOT NULL INTERSECT SELECT passage_id FROM swi_scores")
def scored_refs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "scripture_refs", "passage_id").where("passage_id is not null").intersect(read(spark, d, "swi_scores", "passage_id"))


@query("""
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'matched' WHEN b.id IS NULL THEN 'left only' ELSE 'right only' END AS status
FROM (SELECT DISTINCT id FROM passages WHERE id IS NOT NULL) a FULL OUTER JOIN (SELECT DISTINCT passage_id AS id FROM swi_scores WHERE passage_id IS NOT NULL) b ON a.id = b.id""")
def full_outer_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return joins.reconcile(read(spark, d, "passages", "id"), read(spark, d, "swi_scores", "passage_id").withColumnRenamed("passage_id", "id"), "id")


@query("""
SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AS labelled FROM documents""")
def labelled_flag(spark: SparkSession, d: str) -> DataFrame:
    return joins.semi_flag(read(spark, d, "documents", "doc_id"), read(spark, d, "labels", "doc_id"), "doc_id", "labelled")


@query("""
SELECT g.id AS item, d.doc_id FROM documents d JOIN (SELECT id, substr(text, 1, 40) AS anchor FROM golden_set) g ON contains(lower(d.text), lower(g.anchor)) WHERE trim(g.anchor) <> '' AND d.text IS NOT NULL""")
def anchor_contains(spark: SparkSession, d: str) -> DataFrame:
    anchors = read(spark, d, "golden_set", "id", "text").select(F.col("id").alias("item"), F.substring("text", 1, 40).alias("anchor"))
    docs = read(spark, d, "documents", "doc_id", "text").where("text is not null")
    return joins.containing(docs, anchors, "text", "anchor", "doc_id").select("item", "doc_id")


@query("""
WITH t AS (SELECT DISTINCT lower(word) AS term FROM dictionary WHERE length(word) >= 3),
k AS (SELECT theme_id AS dimension, row_number() OVER (ORDER BY theme_id) AS ordinal, unnest(string_split(keywords, ',')) AS keyword FROM themes),
h AS (SELECT term, min({o: ordinal, d: dimension}) AS m FROM t JOIN (SELECT dimension, ordinal, lower(trim(keyword)) AS keyword FROM k) k ON contains(term, keyword) OR contains(keyword, term) WHERE length(keyword) >= 3 GROUP BY term)
SELECT term, m.d AS dimension FROM h""")
def keyword_dimensions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    from corpusloom.sources import io

    themes = read(spark, d, "themes", "theme_id", "keywords").withColumn("ordinal", F.row_number().over(Window.orderBy("theme_id")))  # a dimension of some dozens of rows
    keywords = themes.select(F.col("theme_id").alias("dimension"), "ordinal", F.explode(io.keyword_list(F.lower("keywords"))).alias("keyword"))
    terms = read(spark, d, "dictionary", "word").select(F.lower("word").alias("term")).where("term is not null").distinct()
    return joins.keyword_dimension(terms, keywords)


@query("""
SELECT a.source_id, a.n AS position, a.id, b.id AS work_id FROM (SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY id) AS n FROM (SELECT DISTINCT source_id, id FROM passages)) a
JOIN (SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY id) AS n FROM works) b ON a.source_id = b.source_id AND a.n = b.n""")
def zip_positions(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "passages", "source_id", "id").where("source_id is not null").distinct()
    w = read(spark, d, "works", "source_id", "id").where("source_id is not null").withColumnRenamed("id", "work_id")
    # ids are cut by their beginnings, so that no source is one task
    z = joins.zip_by_position(p, w, [F.col("id")], [F.col("work_id")], "source_id", F.expr("substr(id, 1, 15)"), F.expr("substr(work_id, 1, 15)"))
    return z.select("source_id", "position", "id", "work_id")


@query("""
WITH k AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id, ts)
SELECT e.event_id, k.value AS as_of_value FROM events e ASOF LEFT JOIN k ON e.user_id = k.user_id AND e.ts >= k.ts""")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the value of its user's last event of the first type at or before it."""
    e = read(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    first = e.agg(F.min("event_type")).scalar()
    checkpoints = e.where(F.col("event_type") == first).groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return ordered.as_of(e.select("event_id", "user_id", "ts"), checkpoints, ["user_id"], "ts", "value", F.date_trunc("month", F.col("ts"))).select("event_id", "as_of_value")


@query("""
WITH b AS (SELECT doc_id, length(text) AS len, unnest([0, length(text) // 3, 2 * (length(text) // 3)]) AS off FROM documents WHERE length(text) >= 9),
n AS (SELECT doc_id, off, coalesce(lead(off) OVER (PARTITION BY doc_id ORDER BY off), len) AS nxt FROM b)
SELECT n.doc_id, CAST(off AS INT) AS offset, substr(text, off + 1, nxt - off) AS slice FROM n JOIN documents USING (doc_id)""")
def boundary_slices(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents", "doc_id", "text").where("length(text) >= 9")
    third = F.expr("cast(length(text) div 3 as int)")
    bounds = docs.select("doc_id", F.explode(F.array(F.lit(0), third, 2 * third)).alias("offset"))
    return ordered.slices(docs, bounds, "doc_id", "text", "offset").select("doc_id", "offset", "slice")


@query("""
WITH u AS (SELECT id, 0 AS rank, source_id FROM works UNION ALL SELECT id, 1, upper(source_id) FROM works WHERE open)
SELECT id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank DESC, source_id NULLS LAST) AS r FROM u) WHERE r = 1""")
def union_later_wins(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "works", "id", "source_id", "open")
    return joins.union_later_wins([w.select("id", "source_id"), w.where("open").select("id", F.upper("source_id").alias("source_id"))], "id")


@query("""
SELECT DISTINCT p.id, t AS theme FROM (SELECT id, source_id, word_count, unnest(themes) AS t FROM passages) p WHERE t IS NOT NULL AND word_count >= 200
  AND source_id IN (SELECT source_id FROM works WHERE open)""")
def eligible_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "passages", "id", "source_id", "word_count", "themes").where("word_count >= 200")
    open_ = read(spark, d, "works", "source_id", "open").where("open").select("source_id")
    return p.join(open_, "source_id", "left_semi").select("id", F.explode("themes").alias("theme")).where("theme is not null").distinct()


@query("""
SELECT DISTINCT id, created_at FROM passages WHERE NOT (source_type = 'journal' AND (created_at IS NULL OR substr(created_at, 1, 10) NOT BETWEEN '2020-01-01' AND '2024-12-31'))""")
def date_window(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "passages", "id", "source_type", "created_at")
    inside = F.coalesce(F.substring("created_at", 1, 10).between("2020-01-01", "2024-12-31"), F.lit(False))
    return p.where(~((F.col("source_type") == "journal") & ~inside)).select("id", "created_at").distinct()


@query("SELECT id FROM works WHERE starts_with(source_id, 'jx-journal')")
def scope_prefix(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "works", "id", "source_id").where(F.col("source_id").startswith("jx-journal")).select("id")
