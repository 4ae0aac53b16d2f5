"""Diaries, hymn books and commentaries. The test tables hold none, so each query sets the documents' paragraphs as one and takes it apart again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import journal, segment
from corpusloom.plans.book import query
from corpusloom.session import read

_PARAGRAPHS = """(SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '[0-9]', '', 'g'), '\\n[ \\t\\n\\r\\f\\v]*\\n'), lambda x: regexp_replace(x, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')), lambda x: x <> '') AS l
  FROM documents WHERE text IS NOT NULL)"""


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, l): the paragraphs of each document, without digits."""
    docs = read(spark, d, "documents", "doc_id", "text").where("text is not null")
    return docs.select("doc_id", T.paragraphs(F.regexp_replace("text", "[0-9]", "")).alias("l")).where(F.size("l") > 0)


def _day(i: Column) -> Column:
    """Paragraph i's day: three days after the one before, from a day that the document gives."""
    return F.date_add(F.lit("1760-01-01").cast("date"), (F.col("doc_id") % 3000).cast("int") + 3 * i)


def _diaries(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): each paragraph after a head; the first in full ("Tue. January 1, 1760.- "), the others by weekday and day."""
    entry = lambda p, i: F.concat(F.date_format(_day(i), "E"), F.lit(". "), F.when(i == 0, F.date_format(_day(i), "MMMM d, yyyy")).otherwise(F.date_format(_day(i), "d")), F.lit(".- "), p)
    return _paragraphs(spark, d).select("doc_id", F.array_join(F.transform("l", entry), "\n\n").alias("text"))


_ENTRIES = f"""(SELECT doc_id, i, DATE '1760-01-01' + CAST(doc_id % 3000 + 3 * i AS INT) AS day, p FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS p FROM {_PARAGRAPHS}))"""
_HEADED = f"""(SELECT *, strftime(day, '%a') || '. ' || CASE WHEN i = 0 THEN strftime(day, '%B %-d, %Y') ELSE strftime(day, '%-d') END || '.- ' || p AS body FROM {_ENTRIES})"""


@query(f"SELECT doc_id, i AS n, strftime(day, '%Y-%m-%d') AS date, 'ok' AS status FROM {_ENTRIES}")
def diary_dates(spark: SparkSession, d: str) -> DataFrame:
    """The date of every entry, from heads that mostly give weekday and day only."""
    from pyspark.sql.window import Window

    s = journal.scan(_diaries(spark, d), "doc_id")
    return s.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("offset")) - 1).alias("n"), "date", "status")


@query(f"""
WITH e AS (SELECT doc_id, i, strftime(day, '%Y-%m-%d') AS date, body, lead(strftime(day, '%Y-%m-%d')) OVER (PARTITION BY doc_id ORDER BY i) AS next_date FROM {_HEADED}),
k AS (SELECT *, CAST(date[1:4] AS INT) AS year, regexp_replace(body, '[ \\t\\n\\r\\f\\v]+$', '') AS text FROM e WHERE doc_id % 3 <> 0 OR date BETWEEN '1762-01-01' AND '1765-12-31'),
n AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY date, doc_id, i) - 1 AS chunk_index, row_number() OVER (PARTITION BY date ORDER BY doc_id, i) AS nth, lag(doc_id) OVER (PARTITION BY date ORDER BY doc_id, i) AS before,
  len(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?')) AS words FROM k)
SELECT year, chunk_index, date || CASE WHEN nth = 1 THEN '' WHEN nth <= 26 THEN chr(CAST(96 + nth AS INT)) ELSE chr(CAST(96 + (nth - 1) // 26 AS INT)) || chr(CAST(97 + (nth - 1) % 26 AS INT)) END AS anchor,
  words, CASE WHEN words > 120 THEN 'range' ELSE 'day' END AS date_precision, CASE WHEN words > 120 THEN next_date END AS content_extends_to, doc_id AS source_id, coalesce(before <> doc_id, false) AS collides, md5(text) AS digest FROM n""")
def journal_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of all diaries as one journal, numbered by year; a third of the diaries only fill a gap of four years."""
    texts = _diaries(spark, d).withColumnRenamed("doc_id", "source_id")
    keep = texts.select("source_id", F.when(F.col("source_id") % 3 == 0, "KEEP-UNIQUE").otherwise("KEEP").alias("verdict"), F.lit("1762-01-01").alias("covers_from"), F.lit("1765-12-31").alias("covers_to"))
    out = journal.entries(texts, journal.scan(texts, "source_id"), keep, large=120)
    return out.select("year", "chunk_index", "anchor", "words", "date_precision", "content_extends_to", "source_id", "collides", F.md5("text").alias("digest"))


_BOOK = f"""(SELECT doc_id, i + 1 AS position, i * 2 % 7 + 1 AS printed, p FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS p FROM {_PARAGRAPHS}))"""


def _hymn_book(spark: SparkSession, d: str) -> DataFrame:
    piece = lambda p, i: F.concat(F.lit("HYMN  "), (i * 2 % 7 + 1).cast("string"), F.lit(".\n"), p)
    text = F.concat(F.lit("TITLE\n"), F.array_join(F.transform("l", piece), "\n"), F.lit("\nINDEX  TO  THE  HYMNS.\nHYMN 9. see above"))
    book = _paragraphs(spark, d).select("doc_id", text.alias("text"))
    return segment.numbered_book(book, r"[ \t]*HYMN[ \t]+(\d+)\.", "INDEX  TO  THE  HYMNS.", "doc_id").withColumnRenamed("id", "doc_id")


@query(f"""
SELECT doc_id, position, printed, md5(t) AS digest, len(regexp_extract_all(t, '[A-Za-z]+(?:''[A-Za-z]+)?')) AS words FROM (SELECT *, regexp_replace(regexp_replace('HYMN  ' || printed || '.' || chr(10) || p, '[ \\t]{{2,}}', ' ', 'g'), '(?m)[ \\t]+$', '', 'g') AS t FROM {_BOOK})""")
def hymn_book(spark: SparkSession, d: str) -> DataFrame:
    """The numbered pieces before the index, numbered anew by their order."""
    return _hymn_book(spark, d).select("doc_id", "position", "printed", F.md5("text").alias("digest"), "words")


@query(f"""
WITH h AS (SELECT doc_id, printed, count(*) AS n FROM {_BOOK} GROUP BY doc_id, printed), w AS (SELECT doc_id, unnest(range(1, max(printed) + 1)) AS number FROM h GROUP BY doc_id)
SELECT doc_id, 'duplicate' AS kind, printed AS number FROM h WHERE n > 1 UNION ALL SELECT doc_id, 'gap', number FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = w.doc_id AND h.printed = w.number)""")
def hymn_findings(spark: SparkSession, d: str) -> DataFrame:
    return segment.number_findings(_hymn_book(spark, d), "doc_id")


@query(f"""
WITH c AS (SELECT doc_id, i, i // 2 AS b, i % 2 + 1 AS chapter, regexp_replace('Chapter ' || CASE WHEN i % 2 = 0 THEN 'I' ELSE 'II' END || chr(10) || p, '[ \\t\\n\\r\\f\\v]+$', '') AS body, p FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS p FROM {_PARAGRAPHS})),
o AS (SELECT doc_id, b, row_number() OVER (PARTITION BY doc_id, trim(regexp_replace(substr('Chapter I' || chr(10) || p || chr(10), 1, 100), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) ORDER BY b) AS seen FROM c WHERE chapter = 1),
k AS (SELECT doc_id, b, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS block, count(*) OVER (PARTITION BY doc_id) AS n FROM o WHERE seen = 1)
SELECT c.doc_id, k.block, CASE WHEN k.n = 2 THEN ['First', 'Second'][k.block] END AS name, c.chapter, md5(c.body) AS digest FROM c JOIN k ON k.doc_id = c.doc_id AND k.b = c.b""")
def commentary_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Chapters in blocks that begin anew at chapter I, repeated blocks dropped, two blocks named by position."""
    piece = lambda p, i: F.concat(F.when(i % 2 == 0, "Chapter I\n").otherwise("Chapter II\n"), p)
    books = _paragraphs(spark, d).select("doc_id", F.concat(F.array_join(F.transform("l", piece), "\n"), F.lit("\n")).alias("text"))
    out = segment.reset_blocks(books, r"[ \t]*Chapter\s+([IVXLCDM]+)[ \t]*\n", ["First", "Second"], "doc_id")
    return out.select(F.col("id").alias("doc_id"), "block", "name", "chapter", F.md5("body").alias("digest"))


@query(f"""
WITH t AS (SELECT doc_id, l[1] AS a, coalesce(l[2], '') AS b FROM {_PARAGRAPHS} WHERE len(l) > 0),
x AS (SELECT doc_id, length('x' || chr(10) || 'PREFACE') AS pb, length('x' || chr(10) || 'PREFACE' || chr(10) || a || chr(10) || 'BODY') AS bb, length('x' || chr(10) || 'PREFACE' || chr(10) || a || chr(10) || 'BODY' || chr(10) || b) AS total FROM t)
SELECT doc_id, 0 AS n, 'Preface' AS name, pb AS "begin", bb AS "end" FROM x UNION ALL SELECT doc_id, 1, 'Body', bb, total FROM x UNION ALL SELECT doc_id, 2, 'Notes', NULL, NULL FROM x""")
def named_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections under headings searched in order, the last of which no document has."""
    p = _paragraphs(spark, d).select("doc_id", F.concat(F.lit("x\nPREFACE\n"), F.get("l", F.lit(0)), F.lit("\nBODY\n"), F.coalesce(F.get("l", F.lit(1)), F.lit(""))).alias("text"))
    out = segment.ordered_sections(p, [(r"^[ \t]*PREFACE[ \t]*$", "Preface"), (r"^[ \t]*BODY[ \t]*$", "Body"), (r"^[ \t]*NOTES OF THE EDITOR[ \t]*$", "Notes")], "doc_id")
    return out.withColumnRenamed("id", "doc_id")


@query("""
WITH h AS (SELECT id, min(text) AS text FROM passages WHERE text IS NOT NULL GROUP BY id),
m AS (SELECT id, unnest(range(len(v))) AS pos, CAST(unnest(v) AS INT) AS verse FROM (SELECT id, regexp_extract_all(text, '(?:^|\\n)[ \\t]*(\\d{1,3})\\.[ \\t]', 1) AS v FROM h))
SELECT id, pos, verse FROM (SELECT *, coalesce(max(verse) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM m) WHERE verse > b""")
def verse_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Numbers at line heads that only rise within a passage."""
    p = read(spark, d, "passages", "id", "text").where("text is not null").groupBy("id").agg(F.min("text").alias("text"))
    return segment.verse_marks(p, r"(?:^|\n)[ \t]*(\d{1,3})\.[ \t]")
