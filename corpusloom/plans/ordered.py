"""Ordered analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import dates
from corpusloom.operators import ordered, registry
from corpusloom.plans.book import query
from corpusloom.session import read


@query("""
SELECT corpus, id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM (
  SELECT corpus, id, list_aggregate(list_transform(regexp_extract_all(id, '\\d+|\\D+'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(p, 12, '0') ELSE p END), 'string_agg', '') AS k FROM works)
WINDOW w AS (PARTITION BY corpus ORDER BY k, id)""")
def work_prev_next(spark: SparkSession, d: str) -> DataFrame:
    return registry.neighbours_in_corpus(read(spark, d, "works", "corpus", "id"))


@query("""
WITH s AS (SELECT passage_id AS id, max(overall_score) AS score FROM swi_scores WHERE overall_score IS NOT NULL GROUP BY passage_id),
c AS (SELECT DISTINCT id, t AS theme FROM (SELECT id, unnest(themes) AS t FROM passages) WHERE t IS NOT NULL)
SELECT theme, id, score, r AS rank FROM (SELECT theme, c.id, score, row_number() OVER (PARTITION BY theme ORDER BY score DESC, c.id) AS r FROM c JOIN s ON s.id = c.id) WHERE r <= 60""")
def top_per_theme(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "swi_scores", "passage_id", "overall_score").where("overall_score is not null").groupBy(F.col("passage_id").alias("id")).agg(F.max("overall_score").alias("score"))
    c = read(spark, d, "passages", "id", "themes").select("id", F.explode("themes").alias("theme")).where("theme is not null").distinct()
    return ordered.first_n(c.join(s, "id"), ["theme"], [F.col("score").desc(), F.col("id")], 60).select("theme", "id", "score", "rank")


@query("""
SELECT source_id, chunk_index, wc FROM (SELECT source_id, chunk_index, wc, coalesce(max(wc) OVER (PARTITION BY source_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM (SELECT source_id, chunk_index, max(word_count) AS wc FROM passages WHERE source_id IS NOT NULL AND chunk_index IS NOT NULL GROUP BY source_id, chunk_index)) WHERE wc > b""")
def monotonic_filter(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "passages", "source_id", "chunk_index", "word_count").dropna(subset=["source_id", "chunk_index"])
    one = p.groupBy("source_id", "chunk_index").agg(F.max("word_count").alias("wc"))
    return ordered.strictly_increasing(one, ["source_id"], [F.col("chunk_index")], "wc", F.floor(F.col("chunk_index") / 1000)).select("source_id", "chunk_index", "wc")


@query("""
SELECT event_id, user_id, sum(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM events""")
def reset_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    first = e.agg(F.min("event_type")).scalar()
    marked = e.withColumn("_reset", F.col("event_type") == first)
    return ordered.reset_sessions(marked, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("_reset")).select("event_id", "user_id", "session")


@query("""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 1""")
def first_of_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text no earlier one has; the partition key is a digest, not the text."""
    docs = read(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return ordered.first_of_repeats(docs, ["h"], [F.col("doc_id")]).select("doc_id")


@query("""
WITH e AS (SELECT event_id, user_id, ts, CAST(ts AS DATE) AS day FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS seq, lead(day) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_day FROM e)
SELECT event_id, seq, CASE WHEN seq = 1 THEN '' WHEN seq <= 26 THEN chr(CAST(96 + seq AS INT)) WHEN seq <= 702 THEN chr(CAST(96 + (seq - 1) // 26 AS INT)) || chr(CAST(97 + (seq - 1) % 26 AS INT))
  ELSE chr(CAST(96 + ((seq - 1) // 26 - 1) // 26 AS INT)) || chr(CAST(97 + ((seq - 1) // 26 - 1) % 26 AS INT)) || chr(CAST(97 + (seq - 1) % 26 AS INT)) END AS suffix, next_day FROM n""")
def same_day_suffix(spark: SparkSession, d: str) -> DataFrame:
    """Every event with its number of the day as letters; the SQL knows up to three of them."""
    e = read(spark, d, "events", "event_id", "user_id", "ts").withColumn("day", F.to_date("ts"))
    e = ordered.suffixed(e, ["user_id", "day"], [F.col("ts"), F.col("event_id")])
    from pyspark.sql.window import Window

    return e.withColumn("next_day", F.lead("day").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).select("event_id", "seq", "suffix", "next_day")


def _pass_sql(k: int) -> str:
    """One pass over v{k}: values far from the median of their neighbours become null."""
    frame = lambda a, b: f"list(value) FILTER (value IS NOT NULL) OVER (PARTITION BY user_id, value IS NULL ORDER BY ts, event_id ROWS BETWEEN {a} AND {b})"
    return f"""v{k + 1} AS (SELECT event_id, user_id, ts, CASE WHEN len(near) >= 3 AND abs(value - list_aggregate(near, 'median')) > 50 THEN NULL ELSE value END AS value FROM (
  SELECT *, list_concat(coalesce({frame('15 PRECEDING', '1 PRECEDING')}, []), coalesce({frame('1 FOLLOWING', '15 FOLLOWING')}, [])) AS near FROM v{k}))"""


@query(f"WITH v0 AS (SELECT event_id, user_id, ts, value FROM events), {', '.join(map(_pass_sql, range(4)))} SELECT event_id, value FROM v4")
def rolling_median_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Values far from the median of their neighbours demoted, in four passes."""
    e = read(spark, d, "events", "event_id", "user_id", "ts", "value")
    return ordered.demote_outliers(e, ["user_id"], [F.col("ts"), F.col("event_id")], "value", 50).select("event_id", "value")


@query("""
SELECT id, theme FROM (SELECT id, theme, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM (
  SELECT id, theme, min(pos) AS pos FROM (SELECT id, unnest(range(len(themes))) AS pos, lower(unnest(themes)) AS theme FROM (SELECT id, max(themes) AS themes FROM passages GROUP BY id)) WHERE theme IS NOT NULL GROUP BY id, theme)) WHERE n <= 20""")
def distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of each row, the first of equal ones (case ignored), at most twenty."""
    p = read(spark, d, "passages", "id", "themes").groupBy("id").agg(F.max("themes").alias("themes"))
    e = p.select("id", F.posexplode("themes").alias("pos", "t")).withColumn("theme", F.lower("t")).where("theme is not null")
    one = ordered.first_of_repeats(e, ["id", "theme"], [F.col("pos")])
    return ordered.first_n(one, ["id"], [F.col("pos")], 20).select("id", "theme")


@query("""
WITH h AS (SELECT DISTINCT source_id, chunk_index FROM passages WHERE source_id IS NOT NULL AND chunk_index IS NOT NULL),
w AS (SELECT source_id, unnest(range(0, max(chunk_index) + 1)) AS chunk_index FROM h GROUP BY source_id)
SELECT source_id, CAST(chunk_index AS INT) AS missing FROM w WHERE (source_id, chunk_index) NOT IN (SELECT source_id, chunk_index FROM h)""")
def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    return ordered.gaps(read(spark, d, "passages", "source_id", "chunk_index"), "source_id", "chunk_index")


@query("""
SELECT source_id, chunk_index, count(*) AS n FROM (SELECT DISTINCT source_id, chunk_index, id FROM passages) GROUP BY source_id, chunk_index HAVING count(*) > 1""")
def repeated_numbers(spark: SparkSession, d: str) -> DataFrame:
    return ordered.repeated(read(spark, d, "passages", "source_id", "chunk_index", "id").distinct(), ["source_id", "chunk_index"])


@query("""
WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) - 250 AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d FROM orders),
j AS (SELECT *, (14 - m) // 12 AS a FROM o), k AS (SELECT *, y + 4800 - a AS yy, m + 12 * a - 3 AS mm FROM j),
n AS (SELECT o_orderkey, y, m, d, CASE WHEN y * 10000 + m * 100 + d >= 17520914 THEN d + (153 * mm + 2) // 5 + 365 * yy + yy // 4 - yy // 100 + yy // 400 - 32045
   ELSE d + (153 * mm + 2) // 5 + 365 * yy + yy // 4 - 32083 END AS jdn FROM k)
SELECT o_orderkey, jdn, CAST(jdn % 7 AS INT) AS weekday FROM n""")
def weekday_julian(spark: SparkSession, d: str) -> DataFrame:
    """Day numbers and weekdays of dates moved back 250 years, across the change of calendar."""
    o = read(spark, d, "orders", "o_orderkey", "o_orderdate")
    y, m, day = F.year("o_orderdate") - 250, F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    return o.select("o_orderkey", dates.day_number(y, m, day).alias("jdn"), dates.weekday(y, m, day).alias("weekday"))


@query("""
SELECT id, CAST(date_add(DATE '2026-01-01', CAST(row_number() OVER (ORDER BY sha256('9' || id), id) AS INT)) AS DATE) AS day FROM (
  SELECT id FROM works WHERE open ORDER BY sha256('9' || id), id LIMIT 30)""")
def daily_schedule(spark: SparkSession, d: str) -> DataFrame:
    """One open work a day from the day after a given start; thirty days are the feature."""
    from pyspark.sql.window import Window

    order = F.sha2(F.concat(F.lit("9"), F.col("id")), 256)
    w = read(spark, d, "works", "id", "open").where("open").select("id", order.alias("h")).orderBy("h", "id").limit(30)
    return w.select("id", F.date_add(F.lit("2026-01-01").cast("date"), F.row_number().over(Window.orderBy("h", "id"))).alias("day"))


@query("""
WITH h AS (SELECT id, author, source_id, sha256('99' || id) AS h FROM works),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY h, id) AS r FROM h) WHERE r = 1),
minor AS (SELECT id, author, source_id FROM one WHERE author = (SELECT min(author) FROM works) ORDER BY h, id LIMIT 5),
rest AS (SELECT id, author, source_id FROM one WHERE NOT author = (SELECT min(author) FROM works) ORDER BY h, id LIMIT 25)
SELECT * FROM minor UNION ALL SELECT * FROM rest""")
def quota_selection(spark: SparkSession, d: str) -> DataFrame:
    """Thirty works of distinct sources with a quota for one author; the number is the feature."""
    w = read(spark, d, "works", "id", "author", "source_id")
    w = w.withColumn("_first", w.agg(F.min("author")).scalar())
    return ordered.quota(w, "source_id", F.col("author") == F.col("_first"), 30, 5, "99").select("id", "author", "source_id")


@query("""
SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) > 200 AS over_cap FROM events GROUP BY 1""")
def daily_counter_cap(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.streaming import feeds

    return feeds.capped(read(spark, d, "events", "ts").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")), 200)


@query("""
SELECT CAST(year AS INT) AS year, count(*) AS entries, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS words, string_agg(id, ',' ORDER BY id) FILTER (word_count >= 200) AS long_ids
FROM (SELECT id, min(year) AS year, max(word_count) AS word_count FROM passages WHERE source_type = 'journal' GROUP BY id)  GROUP BY year""")
def year_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "passages", "id", "year", "word_count", "source_type").where("source_type = 'journal'").groupBy("id").agg(F.min("year").alias("year"), F.max("word_count").alias("word_count"))
    long_ids = F.sort_array(F.collect_list(F.when(F.col("word_count") >= 200, F.col("id"))))
    out = p.groupBy("year").agg(F.count("*").alias("entries"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), long_ids.alias("l"))
    return out.select("year", "entries", "words", F.when(F.size("l") > 0, F.concat_ws(",", "l")).alias("long_ids"))
