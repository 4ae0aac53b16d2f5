"""Quotable sentences of the passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import ordered, quotes
from corpusloom.plans.book import query
from corpusloom.session import read

EDITORIAL = [r"\bnotice\s+this\b", r"\bdiscuss\b", r"\bcompare\b", r"\bin\s+those\s+days\b", r"\bnote:\s"]
LIKED = ["mercy", "patience", "hope", "charity", "joy", "holiness", "soul", "heart"]
HARSH = ["idleness", "wrath", "pride", "affliction"]
ARGUED = ["vanity", "scoffers", "covetousness"]

_RS = quotes
_CHECKS = [
    ("contains(s, '^')", "caret"),
    ("len(w) > 3 AND len(list_filter(w, lambda x: length(x) = 1 AND x NOT IN ('A', 'I', 'a'))) > 0.2 * len(w)", "single letters"),
    ("regexp_matches(s, '(?i)[bcdfghjklmnpqrstvwxyz]{5,}')", "consonants"),
    (r"regexp_matches(s, '[\x{370}-\x{3FF}\x{400}-\x{4FF}\x{590}-\x{5FF}]')", "script"),
    (r"regexp_matches(s, '[a-z]\d{2,}|\d[A-Z][a-z]')", "digits in words"),
    (r"regexp_matches(s, '\s-\w|\w-\s')", "loose hyphen"),
    ("regexp_matches(s, '[a-z]{2}[A-Z]')", "joined words"),
    ("len(list_filter(w, lambda x: regexp_matches(regexp_replace(x, '[^a-zA-Z]', '', 'g'), '^[a-z]{15,}$'))) > 0", "long word"),
    (r"regexp_matches(s, '[\"''][^a-zA-Z\s]')".replace(r"\"", '"'), "stray quote"),
    (r"regexp_matches(s, '\b\w{2,}\s+(?:" + "|".join(_RS.TORN) + r")\b')", "torn word"),
    ("regexp_matches(s, '(?i)" + "|".join(_RS.STUCK) + "')", "stuck words"),
    (r"regexp_matches(s, '\bHYMN\s+\d+\b|\bl\.\s*m\.\s*$|\bPage\s+[IVXLC]+\b')", "page matter"),
    ("(" + " + ".join(f"CAST(contains(lower(s), '{x}') AS INT)" for x in _RS.FOREIGN) + ") >= 2", "foreign words"),
    ("len(regexp_extract_all(s, '[!?]')) > 3", "marks"),
    (r"regexp_matches(s, '\w[)\]]\s*\w\s+\w{1,3}\s+\w')", "bracket in word"),
    (r"len(regexp_extract_all(s, '\b[A-Z][a-z]?\s+[a-z]\b')) >= 2", "redacted name"),
]
_UNFIT = [
    (r"regexp_matches(s, '(?i)^\s*[*+]?\s*\d?\s*[A-Z][a-z]+\.?\s+[ivxlc]+')", "footnote"),
    ("regexp_matches(s, '(?i)" + "|".join(EDITORIAL) + "')", "editorial"),
    *_CHECKS,
    ("length(s) < 60 OR length(s) > 240", "length"),
    ("len(regexp_extract_all(s, '[A-Za-z]')) > 0 AND len(regexp_extract_all(s, '[A-Z]')) > 0.35 * len(regexp_extract_all(s, '[A-Za-z]'))", "capitals"),
    (r"regexp_matches(s, '^\d+\s+[A-Z][a-z]+.*\.')", "header"),
    (r"regexp_matches(s, '(?i)^(?:Your\s+(?:affectionate|obedient|humble)|I\s+am,?\s+(?:dear|with|your))|Your\s+(?:affectionate|obliged|obedient)\s+') OR regexp_matches(s, 'MY DEAR\b')", "salutation"),
    ("regexp_matches(s, '^[a-z]')", "starts lower"),
    (r"regexp_matches(s, '^[A-Z][a-z]+''?s?\s+[A-Z][a-z]+,\s+(?:In|At|Near)\s|^To\s+(?:Miss|Mrs|Mr|Dr)\s')", "address"),
    (r"len(list_filter(range(1, len(v)), lambda i: v[i] = v[i + 1] AND length(v[i]) >= 4)) > 0", "repeated word"),
    (r"regexp_matches(s, '^Alter''?d\s+from\b|From the (?:German|French|Latin)\b|Section\s+[IVX]+\.?\s*$|^Adapted\b')", "attribution"),
]
_ONE = "(SELECT id, min(text) AS text FROM passages WHERE source_type IN ('sermon', 'treatise') GROUP BY id)"
_DENSITY = r"(CASE WHEN length(regexp_replace({t}, '\s', '', 'g')) = 0 THEN 1.0 ELSE length(regexp_replace({t}, '[\pL\pN\s.,;:!?''" + '"' + r"()\-]', '', 'g')) / length(regexp_replace({t}, '\s', '', 'g')) END)"
_SENTENCES = rf"""(SELECT id, pos, s, list_filter(string_split_regex(s, '\s+'), lambda x: x <> '') AS w, regexp_extract_all(s, '\w+|[^\w\s]+') AS v FROM (
  SELECT id, pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\s*(?:\d+\.?\s+|Sect\.\s*[IVXLC]+\.?\s*)', ''), '\s+\d+\.\s*$', ''), '\s*\(\d+\)\s*', ' ', 'g'), '\s+\d+\s+[A-Z][a-z]*\s*!?\s*$', ''), '^\s+|\s+$', '', 'g') AS s FROM (
  SELECT id, unnest(range(len(l))) AS pos, unnest(l) AS x FROM (SELECT id, string_split(regexp_replace(text, '([.!?])\s+([A-Z"''])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM {_ONE} WHERE text IS NOT NULL AND {_DENSITY.format(t="text")} <= 0.05))) WHERE s <> '')"""
_REASON = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in _UNFIT) + " END"
_HAS = lambda words: " + ".join(rf"CAST(regexp_matches(s, '(?i)\b{w}\b') AS INT)" for w in words)
_SCORE = rf"""(CASE WHEN length(s) >= 120 THEN 30 WHEN length(s) >= 80 THEN 20 ELSE 10 END - round({_DENSITY.format(t="s")} * 100, 6)
  + CASE WHEN regexp_matches(s, '[.!"]$') THEN 10 WHEN NOT regexp_matches(s, '[.!?"'']$') THEN -15 ELSE 0 END - 5 * len(regexp_extract_all(s, '\d+')) - CASE WHEN regexp_matches(s, '\(\w+\s+\d+\)') THEN 10 ELSE 0 END
  + 3 * ({_HAS(LIKED)}) - 5 * ({_HAS(HARSH)}) - 3 * ({_HAS(ARGUED)}) - CASE WHEN regexp_matches(s, '\bDEAR\s+[A-Z]') THEN 40 ELSE 0 END - CASE WHEN regexp_matches(s, '\bMY\s+DEAR\b') THEN 40 ELSE 0 END
  - CASE WHEN regexp_matches(s, '^(?:And|But|Or|For|Nor|Yet|So)\b') THEN 5 ELSE 0 END - CASE WHEN regexp_matches(s, '\b(?:in|at|to|of|the|a|an|with|from|Dr|Mr|Mrs|Vol|St)\.*\s*$') THEN 50 ELSE 0 END)"""
_BEST = f"""(SELECT id, s AS sentence, score FROM (SELECT id, s, {_SCORE} AS score, row_number() OVER (PARTITION BY id ORDER BY {_SCORE} DESC, pos) AS r FROM {_SENTENCES} WHERE ({_REASON}) IS NULL) WHERE r = 1)"""


def _one(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "passages", "id", "source_type", "text").where("source_type in ('sermon', 'treatise')").groupBy("id").agg(F.min("text").alias("text")).where("text is not null")


@query(f"SELECT coalesce({_REASON}, 'fit') AS reason, count(*) AS n FROM {_SENTENCES} GROUP BY 1")
def unfit_sentences(spark: SparkSession, d: str) -> DataFrame:
    """How many sentences each reason leaves out."""
    from corpusloom.functions import text as T

    sound = _one(spark, d).where(T.artifact_density(F.col("text")) <= 0.05)
    each = sound.select(F.explode(F.split("text", r"(?<=[.!?])\s+(?=[A-Z\"'])")).alias("s")).select(quotes.trimmed(F.col("s")).alias("s")).where("s <> ''")
    return each.groupBy(F.coalesce(quotes.unfit(F.col("s"), EDITORIAL), F.lit("fit")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT id, sentence, round(score, 3) AS score FROM {_BEST}")
def best_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Each passage's best sentence by the rubric."""
    found = quotes.candidates(_one(spark, d), EDITORIAL, (LIKED, HARSH, ARGUED))
    return quotes.best(found).select("id", "sentence", F.round("score", 3).alias("score"))


_POSTS = rf"""(SELECT b.id, sentence || chr(10) || chr(10) || '— ' || array_to_string(list_transform(string_split(author, '-'), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS post, author, source_id FROM {_BEST} b
  JOIN (SELECT id, min(author) AS author, min(source_id) AS source_id FROM passages GROUP BY id) p ON p.id = b.id WHERE author IS NOT NULL AND source_id IS NOT NULL)"""
_CHOSEN = f"""(WITH c AS (SELECT *, sha256('99' || id) AS h FROM {_POSTS} WHERE length(post) <= 280), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY h, id) AS r FROM c) WHERE r = 1),
 m AS (SELECT id, author, source_id, post FROM one WHERE author = 'clement-wexcombe' ORDER BY h, id LIMIT 5), o AS (SELECT id, author, source_id, post FROM one WHERE author <> 'clement-wexcombe' ORDER BY h, id LIMIT 25) SELECT * FROM m UNION ALL SELECT * FROM o)"""


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    found = quotes.best(quotes.candidates(_one(spark, d), EDITORIAL, (LIKED, HARSH, ARGUED)))
    meta = read(spark, d, "passages", "id", "author", "source_id").groupBy("id").agg(F.min("author").alias("author"), F.min("source_id").alias("source_id"))
    posts = quotes.posts(found.join(meta, "id").where("author is not null and source_id is not null"))
    return ordered.quota(posts, "source_id", F.col("author") == "clement-wexcombe", 30, 5, "99").select("id", "author", "source_id", "post")


@query(f"SELECT id, author, source_id, post, CAST(DATE '2026-01-01' + CAST(row_number() OVER (ORDER BY sha256('day' || id), id) AS INT) AS DATE) AS day FROM {_CHOSEN}")
def post_calendar(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline: sentences, filters, the best of each passage, thirty of different sources with a quota, one a day."""
    return quotes.scheduled(_chosen(spark, d), "2026-01-01", [F.sha2(F.concat(F.lit("day"), "id"), 256), F.col("id")])


@query(f"SELECT author, count(*) AS posts, min(length(post)) AS shortest, max(length(post)) AS longest FROM {_CHOSEN} GROUP BY author")
def post_counts(spark: SparkSession, d: str) -> DataFrame:
    return quotes.by_author(_chosen(spark, d))


@query(f"""
WITH c AS (SELECT * FROM {_CHOSEN} UNION ALL SELECT id || '-again', author, source_id, repeat(post, 2) FROM {_CHOSEN} WHERE author = 'clement-wexcombe')
SELECT 'count' AS check, count(*) || ' instead of 30' AS detail FROM c HAVING count(*) <> 30 UNION ALL SELECT 'source', source_id FROM c GROUP BY source_id HAVING count(*) > 1 UNION ALL SELECT 'length', post FROM c WHERE length(post) > 280""")
def post_gate(spark: SparkSession, d: str) -> DataFrame:
    """What the gate finds if the minority's posts are there twice, the second time doubled."""
    c = _chosen(spark, d)
    again = c.where("author = 'clement-wexcombe'").select(F.concat("id", F.lit("-again")).alias("id"), "author", "source_id", F.repeat("post", F.lit(2)).alias("post"))
    return quotes.post_gate(c.unionByName(again), 30)
