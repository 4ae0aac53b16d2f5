"""Statistics over passages, works and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import search, stats
from corpusloom.plans.book import query
from corpusloom.session import read


@query("""
SELECT count(*) AS passages, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS words,
       count(DISTINCT coalesce(author, '')) AS authors, count(DISTINCT coalesce(source_type, '')) AS types,
       (SELECT count(DISTINCT t) FROM (SELECT unnest(themes) AS t FROM passages)) AS themes
FROM passages""")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.corpus_totals(read(spark, d, "passages", "word_count", "author", "source_type", "themes"))


@query("""
SELECT CASE WHEN grouping(author) = 0 THEN 'author' WHEN grouping(source_id) = 0 THEN 'source_id'
            WHEN grouping(source_type) = 0 THEN 'source_type' ELSE 'all' END AS key,
       CASE WHEN grouping(author) = 0 THEN coalesce(author, '') WHEN grouping(source_id) = 0 THEN coalesce(source_id, '')
            WHEN grouping(source_type) = 0 THEN coalesce(source_type, '') ELSE '' END AS value,
       count(*) AS passages, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS words,
       min(coalesce(year, 0)) AS first_year, max(coalesce(year, 0)) AS last_year
FROM passages GROUP BY GROUPING SETS ((author), (source_id), (source_type), ())""")
def stats_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return stats.grouped_counts(read(spark, d, "passages", "author", "source_id", "source_type", "word_count", "year"), ["author", "source_id", "source_type"])


@query("""
SELECT count(*) AS passages, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS words,
       CAST(floor(avg(word_count)) AS BIGINT) AS mean_words,
       count(CASE WHEN coalesce(len(themes), 0) > 0 THEN 1 END) AS themed,
       round(100.0 * count(CASE WHEN coalesce(len(themes), 0) > 0 THEN 1 END) / count(*), 2) AS themed_percent
FROM passages""")
def coverage_stats(spark: SparkSession, d: str) -> DataFrame:
    themed = F.count(F.when(~search.is_untagged(F.col("themes")), 1))
    p = read(spark, d, "passages", "word_count", "themes")
    return p.agg(F.count("*").alias("passages"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), F.floor(F.avg("word_count")).alias("mean_words"), themed.alias("themed"), F.round(F.lit(100.0) * themed / F.count("*"), 2).alias("themed_percent"))


@query("""
SELECT source_title, count(*) AS n, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS words FROM passages WHERE source_title IS NOT NULL
GROUP BY source_title ORDER BY n DESC, source_title LIMIT 10""")
def largest_sources(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "passages", "source_title", "word_count").where("source_title is not null")
    return p.groupBy("source_title").agg(F.count("*").alias("n"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words")).orderBy(F.col("n").desc(), "source_title").limit(10)


@query("""
WITH c AS (SELECT t AS theme, count(*) AS n FROM (SELECT unnest(themes) AS t FROM passages) WHERE t IS NOT NULL GROUP BY t)
SELECT theme, n, repeat('#', CAST(floor(n * 40 / (SELECT max(n) FROM c)) AS INT)) AS bar FROM c""")
def theme_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.theme_histogram(read(spark, d, "passages", "themes"))


@query("""
WITH c AS (SELECT t AS theme, count(*) AS n FROM (SELECT unnest(themes) AS t FROM passages) GROUP BY t)
SELECT theme_id, theme_name, coalesce(n, 0) AS n FROM themes LEFT JOIN c ON theme_id = theme""")
def theme_dimension(spark: SparkSession, d: str) -> DataFrame:
    return stats.theme_dimension(read(spark, d, "themes", "theme_id", "theme_name"), read(spark, d, "passages", "themes"))


_ROLLUP = """
SELECT source_id, f.source_title AS source_title, f.author AS author, f.source_type AS source_type, f.year AS year, passages FROM (
  SELECT source_id, arg_min({source_title: source_title, author: author, source_type: source_type, year: year},
         (id, coalesce(chunk_index, -1), coalesce(created_at, ''))) AS f, count(*) AS passages
  FROM passages GROUP BY source_id)"""


@query(_ROLLUP)
def source_rollup(spark: SparkSession, d: str) -> DataFrame:
    return stats.source_rollup(read(spark, d, "passages", "source_id", "id", "chunk_index", "created_at", "source_title", "author", "source_type", "year"))


@query(f"""
SELECT author, source_type, row_number() OVER (PARTITION BY author, source_type ORDER BY coalesce(year, 9999), source_id) AS place, source_id FROM ({_ROLLUP})""")
def author_type_sources(spark: SparkSession, d: str) -> DataFrame:
    return stats.author_type_sources(source_rollup(spark, d))


@query("""
SELECT source_type, n, weight, round(weight / (SELECT sum(word_count) FROM passages), 6) AS share FROM (
  SELECT source_type, count(*) AS n, CAST(sum(word_count) AS BIGINT) AS weight FROM passages GROUP BY source_type)""")
def type_shares(spark: SparkSession, d: str) -> DataFrame:
    return stats.share_of(read(spark, d, "passages", "source_type", "word_count"), "source_type", "word_count")


@query("""
SELECT source_id, count(*) AS passages, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS words, bool_or(source_url IS NOT NULL AND source_url <> '') AS has_url,
       min(author) AS author FROM passages GROUP BY source_id""")
def provenance_sources(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "passages", "source_id", "word_count", "source_url", "author")
    return p.groupBy("source_id").agg(F.count("*").alias("passages"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), F.bool_or(F.coalesce(F.col("source_url") != "", F.lit(False))).alias("has_url"), F.min("author").alias("author"))


#: Collections of sources: pattern of the id, collection, verdict. The first that matches counts; sources without one are red.
_COLLECTIONS = [
    ("^jx-journal$", "diary", "GREEN"), ("^jx-journal-17[0-4]", "early-journals", "GREEN"), ("^jx-journal", "journals", "YELLOW"), ("^jx-letter-.*-to-(mr|mrs|miss)-", "letters-to-persons", "YELLOW"),
    ("^jx-letter", "letters", "GREEN"), ("^jx-sermon", "sermons", "GREEN"), ("^jx-notes", "notes", "YELLOW"), ("^jx-treatise", "treatises", "YELLOW"), ("^jx-minutes", "minutes", "GREEN"),
    ("^cx-hymn", "hymns", "GREEN"), ("^cx-", "clement", "YELLOW"), ("^vx-(sermon|letter)", "others", "RED"), ("^vx-", "various", "YELLOW"),
]
_VERDICTS = f"""
SELECT source_id, collection, CASE WHEN verdict = 'YELLOW' AND has_url THEN 'GREEN' ELSE verdict END AS verdict, passages, words FROM (
  SELECT source_id, {"CASE " + " ".join(f"WHEN regexp_matches(source_id, '{p}') THEN '{c}'" for p, c, _ in _COLLECTIONS)} ELSE 'uncategorized' END AS collection, {"CASE " + " ".join(f"WHEN regexp_matches(source_id, '{p}') THEN '{v}'" for p, _, v in _COLLECTIONS)} ELSE 'RED' END AS verdict,
    count(*) AS passages, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS words, bool_or(coalesce(source_url, '') <> '') AS has_url FROM passages WHERE source_id IS NOT NULL GROUP BY source_id)"""


@query(_VERDICTS)
def provenance_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Each source's collection by thirteen ordered rules, and its verdict, which an address lifts from yellow to green."""
    s = provenance_sources(spark, d).where("source_id is not null")
    rules = [(F.col("source_id").rlike(p), c, v) for p, c, v in _COLLECTIONS]
    verdict = T.first_match([(r, v) for r, _, v in rules], "RED")
    lifted = F.when((F.col("v") == "YELLOW") & F.col("has_url"), "GREEN").otherwise(F.col("v"))
    return s.withColumn("v", verdict).select("source_id", T.first_match([(r, c) for r, c, _ in rules], "uncategorized").alias("collection"), lifted.alias("verdict"), "passages", "words")


@query(f"SELECT verdict, count(*) AS sources, CAST(sum(words) AS BIGINT) AS words FROM ({_VERDICTS}) GROUP BY verdict")
def provenance_summary(spark: SparkSession, d: str) -> DataFrame:
    return provenance_verdicts(spark, d).groupBy("verdict").agg(F.count("*").alias("sources"), F.sum("words").alias("words"))


@query("""
SELECT CAST(least(floor(overall_score / 10), 9) AS INT) AS bin, count(*) AS n FROM swi_scores WHERE overall_score IS NOT NULL GROUP BY 1""")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.fixed_bins(read(spark, d, "swi_scores", "overall_score"), "overall_score", 10, 9)


@query("""
SELECT label, count(*) AS n, CAST(floor(avg(overall_score)) AS BIGINT) AS mean, min(overall_score) AS least, max(overall_score) AS greatest
FROM swi_scores WHERE overall_score IS NOT NULL GROUP BY label""")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.score_summary(read(spark, d, "swi_scores", "label", "overall_score"), "label", "overall_score")


@query("""
WITH s AS (SELECT passage_id, max(overall_score) AS score FROM swi_scores WHERE overall_score IS NOT NULL AND passage_id IS NOT NULL GROUP BY passage_id)
SELECT * FROM (SELECT passage_id, score, row_number() OVER (ORDER BY score DESC, passage_id) AS place, 'top' AS "end" FROM s) WHERE place <= 15
UNION ALL SELECT * FROM (SELECT passage_id, score, row_number() OVER (ORDER BY score, passage_id) AS place, 'bottom' FROM s) WHERE place <= 10""")
def score_extremes(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen best and the ten worst passages: the numbers are the feature."""
    s = read(spark, d, "swi_scores", "passage_id", "overall_score").dropna().groupBy("passage_id").agg(F.max("overall_score").alias("score"))
    return stats.extremes(s, "score", "passage_id")


@query("""
SELECT round(median(overall_score), 3) AS median, round(avg(overall_score), 3) AS mean, min(overall_score) AS least, max(overall_score) AS greatest
FROM (SELECT overall_score FROM (SELECT DISTINCT passage_id, overall_score, sha256(passage_id) AS h FROM swi_scores WHERE overall_score IS NOT NULL) ORDER BY h, passage_id, overall_score LIMIT 50)""")
def score_sample(spark: SparkSession, d: str) -> DataFrame:
    """Median, mean and range of a fixed sample of 50 scores (the sample is the feature)."""
    s = read(spark, d, "swi_scores", "passage_id", "overall_score").where("overall_score is not null").distinct()
    s = s.orderBy(F.sha2("passage_id", 256), "passage_id", "overall_score").limit(50)
    return s.agg(F.round(F.median("overall_score"), 3).alias("median"), F.round(F.avg("overall_score"), 3).alias("mean"), F.min("overall_score").alias("least"), F.max("overall_score").alias("greatest"))


_TARGETS = [("sermons", ["sermon"], 141), ("letters", ["letter"], 2000), ("journals", ["journal"], 28), ("hymns", ["hymn", "hymn-stanza"], 5500)]


@query(" UNION ALL ".join(
    f"SELECT '{n}' AS kind, count(DISTINCT source_id) AS have, {t} AS target, round(count(DISTINCT source_id) / {t}, 4) AS share FROM passages WHERE source_type IN ({', '.join(repr(x) for x in types)})" for n, types, t in _TARGETS
))
def ingest_progress(spark: SparkSession, d: str) -> DataFrame:
    return stats.progress(read(spark, d, "passages", "source_type", "source_id"), _TARGETS)


@query("""
SELECT 'all' AS by, 'passages' AS value, count(*) AS n FROM passages UNION ALL SELECT 'all', 'sources', count(DISTINCT coalesce(source_id, '')) FROM passages
UNION ALL SELECT 'source_type', coalesce(source_type, 'unknown'), count(*) FROM passages GROUP BY 2 UNION ALL SELECT 'author', coalesce(author, 'unknown'), count(*) FROM passages GROUP BY 2
UNION ALL SELECT 'all', 'embedded', count(DISTINCT id) FROM passages WHERE id IN (SELECT passage_id FROM swi_scores)""")
def ingest_status(spark: SparkSession, d: str) -> DataFrame:
    """Passages by type and author; scored passages stand in for embedded ones, as the vectors' ids are others."""
    scored = read(spark, d, "swi_scores", "passage_id").select(F.col("passage_id").alias("id"))
    return stats.status(read(spark, d, "passages", "id", "source_id", "source_type", "author"), scored)


@query("""
SELECT author, count(DISTINCT corpus) AS corpora, count(*) AS works, count(CASE WHEN open THEN 1 END) AS open_works FROM works GROUP BY author""")
def author_index(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "works", "author", "corpus", "open")
    return w.groupBy("author").agg(F.countDistinct("corpus").alias("corpora"), F.count("*").alias("works"), F.count(F.when(F.col("open"), 1)).alias("open_works"))


# Regular inflections, stated again for the comparison: base forms of w, null where an ending doesn't apply.
def _single(b: str) -> str:
    return f"CASE WHEN length({b}) > 1 AND right({b}, 1) = substr({b}, length({b}) - 1, 1) AND right({b}, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left({b}, length({b}) - 1) END"


def _y(b: str) -> str:
    return f"CASE WHEN length({b}) > 1 AND right({b}, 1) = 'i' THEN left({b}, length({b}) - 1) || 'y' END"


def bases_sql(w: str) -> str:
    """SQL list of what ``w`` may be a regular inflection of."""
    out = [f"CASE WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y' END", f"CASE WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND length({w}) > 2 THEN left({w}, length({w}) - 1) END"]
    out += [f"CASE WHEN {w} LIKE '%es' AND length({w}) > 3 THEN left({w}, length({w}) - {k}) END" for k in (1, 2)]
    for ending, least, doubled, y in (("ed", 3, True, True), ("ing", 4, True, False), ("est", 5, True, True), ("er", 4, True, True)):
        b = f"left({w}, length({w}) - {len(ending)})"
        forms = [b, f"{b} || 'e'"] + [_single(b)] * doubled + [_y(b)] * y
        out += [f"CASE WHEN {w} LIKE '%{ending}' AND length({w}) > {least} THEN {f} END" for f in forms]
    out.append(f"CASE WHEN length({w}) > 4 AND {w} LIKE '%ily' THEN left({w}, length({w}) - 3) || 'y' WHEN length({w}) > 4 AND {w} LIKE '%ly' THEN left({w}, length({w}) - 2) END")
    return f"list_filter([{', '.join(out)}], lambda b: b IS NOT NULL AND b <> {w})"


_HEADER = "REV.*[0-9]|[0-9].*JOURNAL"


@query(f"""
WITH tok AS (SELECT source_id, t, count(*) AS n FROM (SELECT source_id, unnest(regexp_extract_all(text, '[A-Za-z'']+')) AS t FROM passages) GROUP BY source_id, t),
low AS (SELECT source_id, t, n, regexp_replace(lower(t), '^''+|''+$', '', 'g') AS w FROM tok),
known AS (SELECT lower(word) AS w FROM dictionary WHERE word IS NOT NULL UNION SELECT lower(t) FROM tok WHERE regexp_matches(t, '^[A-Z][a-z]+$') GROUP BY t HAVING sum(n) >= 5),
words AS (SELECT DISTINCT w FROM low WHERE w <> ''),
forms AS (SELECT w, unnest(list_concat([w], CASE WHEN regexp_matches(w, '^[^'']+''[^'']+$') THEN list_transform(['', 'a', 'e', 'i', 'o', 'u'], lambda v: replace(w, '''', v)) ELSE [] END)) AS f FROM words),
meant AS (SELECT w, unnest(list_concat([f], {bases_sql('f')})) AS b FROM forms),
sound AS (SELECT DISTINCT w FROM meant WHERE b IN (SELECT w FROM known) UNION SELECT w FROM words WHERE length(w) <= 1),
bad AS (SELECT source_id, t, sum(n) AS n, row_number() OVER (PARTITION BY source_id ORDER BY sum(n) DESC, t) AS r FROM low WHERE w <> '' AND w NOT IN (SELECT w FROM sound) GROUP BY source_id, t),
b AS (SELECT source_id, CAST(sum(n) AS BIGINT) AS non_words, string_agg(t || ':' || CAST(n AS BIGINT), '; ' ORDER BY r) FILTER (r <= 20) AS top_offenders FROM bad GROUP BY source_id),
s AS (SELECT source_id, count(*) AS passages, count(CASE WHEN regexp_matches(text, '{_HEADER}') THEN 1 END) AS header_passages FROM passages GROUP BY source_id),
t AS (SELECT source_id, CAST(sum(n) AS BIGINT) AS words FROM tok GROUP BY source_id)
SELECT s.source_id, passages, coalesce(words, 0) AS words, coalesce(non_words, 0) AS non_words, round(CASE WHEN words > 0 THEN coalesce(non_words, 0) / words ELSE 0 END, 3) AS rate, header_passages, coalesce(top_offenders, '') AS top_offenders
FROM s LEFT JOIN t ON t.source_id = s.source_id LEFT JOIN b ON b.source_id = s.source_id""")
def noise_report(spark: SparkSession, d: str) -> DataFrame:
    """Words that nothing explains, by source; the rate to three places, as the two engines round halves apart."""
    return stats.token_noise(read(spark, d, "passages", "source_id", "text"), read(spark, d, "dictionary"), _HEADER).withColumn("rate", F.round(F.col("non_words") / F.greatest(F.col("words"), F.lit(1)), 3))


@query("""
SELECT t AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(t, '^[A-Z][a-z]+$') GROUP BY t HAVING count(*) >= 5""")
def proper_nouns(spark: SparkSession, d: str) -> DataFrame:
    return stats.proper_nouns(read(spark, d, "documents", "text").where("text is not null"))


@query("""
WITH tok AS (SELECT id, text, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM passages),
bad AS (SELECT * FROM tok WHERE length(w) > 3 AND w NOT IN (SELECT lower(word) FROM dictionary WHERE word IS NOT NULL))
SELECT w, n, s.id AS sample_id, substr(s.text, greatest(strpos(lower(s.text), w) - 30, 1), 60) AS sample FROM (
  SELECT w, count(*) AS n, min({id: id, text: text}) AS s FROM bad GROUP BY w)""")
def unknown_contexts(spark: SparkSession, d: str) -> DataFrame:
    return stats.unknown_contexts(read(spark, d, "passages", "id", "text"), read(spark, d, "dictionary"))


_NGRAMS = """
WITH t AS (SELECT regexp_extract_all(lower(text), '[a-z'']+') AS tok FROM {table} WHERE text IS NOT NULL{where}),
r AS (SELECT 1 AS n, unnest(tok) AS term FROM t
      UNION ALL SELECT 2, unnest(list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1])) FROM t WHERE len(tok) >= 2
      UNION ALL SELECT 3, unnest(list_transform(range(1, len(tok) - 1), lambda i: tok[i] || ' ' || tok[i + 1] || ' ' || tok[i + 2])) FROM t WHERE len(tok) >= 3)
SELECT n, term, count(*) AS count FROM r GROUP BY n, term"""


@query(_NGRAMS.format(table="documents", where=""))
def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.ngram_counts(read(spark, d, "documents", "text"))


@query("""
WITH tok AS (SELECT source_type = 'sermon' AS own, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS term FROM passages),
a AS (SELECT term, count(*) AS count FROM tok WHERE own GROUP BY term), b AS (SELECT term, count(*) AS ref FROM tok WHERE NOT own GROUP BY term),
s AS (SELECT a.term, count, coalesce(ref, 0) AS ref,
        round(log2((count / (SELECT sum(count) FROM a)) / ((coalesce(ref, 0) + 0.5) / (SELECT sum(ref) FROM b))), 4) AS ratio
      FROM a LEFT JOIN b ON a.term = b.term WHERE count >= 5)
SELECT * FROM s WHERE ratio > 0 ORDER BY ratio DESC, term LIMIT 200""")
def distinctive_terms(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "passages", "source_type", "text")
    own = stats.ngram_counts(p.where("source_type = 'sermon'"), (1,)).select("term", "count")
    other = stats.ngram_counts(p.where("source_type <> 'sermon'"), (1,)).select("term", "count")
    return stats.distinctive_terms(own, other)


@query("""
SELECT lang, count(*) AS n, count(CASE WHEN t <> text THEN 1 END) AS changed, round(avg(before), 6) AS before, round(avg(after), 6) AS after FROM (
  SELECT lang, text, t, CASE WHEN length(regexp_replace(text, '[ \\n\\t]', '', 'g')) = 0 THEN 1 ELSE length(regexp_replace(text, '[\\pL\\pN \\n\\t.,;:!?''"()\\-]', '', 'g')) / length(regexp_replace(text, '[ \\n\\t]', '', 'g')) END AS before,
    CASE WHEN length(regexp_replace(t, '[ \\n\\t]', '', 'g')) = 0 THEN 1 ELSE length(regexp_replace(t, '[\\pL\\pN \\n\\t.,;:!?''"()\\-]', '', 'g')) / length(regexp_replace(t, '[ \\n\\t]', '', 'g')) END AS after
  FROM (SELECT lang, text, trim(regexp_replace(regexp_replace(text, '[|~^*_=<>{}#\\[\\]]+', ' ', 'g'), ' {2,}', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)) GROUP BY lang""")
def cleaning_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many texts an ordered rule table changes, and their mean artifact density before and after."""
    from corpusloom.functions import text as T

    docs = read(spark, d, "documents", "lang", "text").where("text is not null")
    docs = docs.withColumn("t", F.trim(T.rule_fold(F.col("text"), [(r"[|~^*_=<>{}#\[\]]+", " "), (r" {2,}", " ")])))
    density = lambda c: T.artifact_density(F.col(c))
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(F.col("t") != F.col("text"), 1)).alias("changed"), F.round(F.avg(density("text")), 6).alias("before"), F.round(F.avg(density("t")), 6).alias("after"))


@query("""
SELECT book, count(*) AS refs, count(DISTINCT chapter) AS chapters, (SELECT count(*) FROM scripture_refs WHERE book IS NOT NULL) AS total FROM scripture_refs WHERE book IS NOT NULL GROUP BY book""")
def citation_books(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators import citations

    return citations.books(read(spark, d, "scripture_refs", "book", "chapter")).select("book", "refs", "chapters", "total")


@query("""
SELECT book, chapter, verse_start, count(*) AS n FROM scripture_refs WHERE book IS NOT NULL AND chapter IS NOT NULL AND verse_start IS NOT NULL
GROUP BY ALL ORDER BY n DESC, book, chapter, verse_start LIMIT 10""")
def citation_top_verses(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators import citations

    return citations.top(read(spark, d, "scripture_refs", "book", "chapter", "verse_start"), ["book", "chapter", "verse_start"])


@query("""
SELECT passage_id, count(*) AS n FROM scripture_refs WHERE passage_id IS NOT NULL GROUP BY passage_id ORDER BY n DESC, passage_id LIMIT 10""")
def citation_top_passages(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators import citations

    return citations.top(read(spark, d, "scripture_refs", "passage_id"), ["passage_id"])


@query("""
SELECT book, chapter, 0 AS part, string_agg(e, '; ' ORDER BY e) AS entries FROM (
  SELECT book, chapter, passage_id || ':' || coalesce(CAST(verse_start AS VARCHAR), '') || CASE WHEN verse_end > verse_start THEN '-' || verse_end ELSE '' END AS e
  FROM scripture_refs WHERE book IS NOT NULL AND chapter IS NOT NULL AND passage_id IS NOT NULL) GROUP BY book, chapter""")
def citation_index(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators import citations

    return citations.index(read(spark, d, "scripture_refs"))
