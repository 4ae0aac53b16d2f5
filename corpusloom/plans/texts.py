"""Text functions and segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import citations, segment
from corpusloom.plans.book import query
from corpusloom.plans.stats import bases_sql
from corpusloom.session import read


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", "text")


@query("""
SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> '')) AS INT) AS words FROM documents WHERE text IS NOT NULL""")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("""
SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z'']+')) AS INT) AS lower_tokens, CAST(len(regexp_extract_all(text, '[A-Za-z'']+')) AS INT) AS cased_tokens,
       CAST(len(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?')) AS INT) AS words FROM documents WHERE text IS NOT NULL""")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _texts(spark, d).select("doc_id", F.size(T.ascii_tokens(t)).alias("lower_tokens"), F.size(T.cased_tokens(t)).alias("cased_tokens"), F.size(T.cased_tokens(t, "[A-Za-z]+(?:'[A-Za-z]+)?")).alias("words"))


@query("""
SELECT doc_id, round(CASE WHEN v = 0 THEN 1.0 ELSE length(regexp_replace(text, '[\\pL\\pN \\t\\n\\r\\f\\v.,;:!?''"()\\-]', '', 'g')) / v END, 6) AS density
FROM (SELECT doc_id, text, length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g')) AS v FROM documents WHERE text IS NOT NULL)""")
def artifact_density(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.round(T.artifact_density(F.col("text")), 6).alias("density"))


@query("""
SELECT doc_id, CAST((length(l) - length(replace(l, 'the ', ''))) / 4 AS INT) AS hits FROM (SELECT doc_id, lower(text) AS l FROM documents WHERE text IS NOT NULL)""")
def phrase_counts(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", T.overlapping_count(F.lower("text"), "the ").alias("hits"))


@query("""
SELECT doc_id, CAST(unnest(list_filter(range(0, length(l) - 5), lambda i: substr(l, i + 1, 6) = 'weaver')) AS INT) AS at FROM (SELECT doc_id, lower(text) AS l FROM documents WHERE text IS NOT NULL AND contains(lower(text), 'weaver'))""")
def phrase_offsets(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d).withColumn("l", F.lower("text")).where(F.col("l").contains("weaver"))
    return docs.select("doc_id", F.explode(T.phrase_offsets(F.col("l"), "weaver")).alias("at"))


@query("""
SELECT doc_id, CAST(i - 1 AS INT) AS n, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS i FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL))""")
def sentence_split_naive(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.posexplode(T.sentences_naive(F.col("text"))).alias("n", "sentence"))


@query("""
SELECT doc_id, CAST(i - 1 AS INT) AS n, p AS paragraph FROM (SELECT doc_id, unnest(l) AS p, unnest(range(1, len(l) + 1)) AS i FROM (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n[ \\t\\n\\r\\f\\v]*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL))""")
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("n", "paragraph"))


@query("""
WITH h AS (SELECT id, min(text) AS text FROM passages WHERE source_type = 'hymn' AND text IS NOT NULL GROUP BY id),
s AS (SELECT id, list_filter(list_transform(string_split_regex(text, '\\n[ \\t\\n\\r\\f\\v]*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM h)
SELECT id || '-full' AS id, CAST(NULL AS INT) AS stanza_number, text FROM h UNION ALL
SELECT id || '-stanza-' || lpad(CAST(i AS VARCHAR), 2, '0'), CAST(i AS INT), regexp_replace(x, '^\\d+\\.?[ \\t\\n\\r\\f\\v]+', '') FROM (SELECT id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM s)""")
def hymn_chunks(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "passages", "id", "source_type", "text").where("source_type = 'hymn' and text is not null").groupBy("id").agg(F.min("text").alias("text"))
    return segment.hymn_rows(h)


def _words_sql(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '[ \\t\\n\\r\\f\\v\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{1c}}-\\x{{1f}}]+'), lambda w: w <> ''))"


_CLOSED = "CASE WHEN len(s.held) > 0 THEN list_append(s.chunks, array_to_string(s.held, chr(10) || chr(10))) ELSE s.chunks END"
_CUT = f"""list_reduce(string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda t, y: CASE WHEN len(t.run) > 0 AND t.c + {_words_sql('y')} > 400
  THEN {{chunks: list_append(t.chunks, array_to_string(t.run, ' ')), run: [t.run[-1], y], c: {_words_sql('t.run[-1]')} + {_words_sql('y')}}} ELSE {{chunks: t.chunks, run: list_append(t.run, y), c: t.c + {_words_sql('y')}}} END,
  {{chunks: {_CLOSED}, run: CAST([] AS VARCHAR[]), c: CAST(0 AS BIGINT)}})"""
_STEP = f"""CASE WHEN {_words_sql('x')} > 400 THEN {{chunks: ({_CUT}).chunks, held: [array_to_string(({_CUT}).run, ' ')], n: ({_CUT}).c}}
  WHEN s.n + {_words_sql('x')} > 400 THEN {{chunks: {_CLOSED}, held: [x], n: CAST({_words_sql('x')} AS BIGINT)}} ELSE {{chunks: s.chunks, held: list_append(s.held, x), n: s.n + {_words_sql('x')}}} END"""
_CHUNKS = f"""(SELECT id, CASE WHEN len(s.held) > 0 THEN list_append(s.chunks, array_to_string(s.held, chr(10) || chr(10))) ELSE s.chunks END AS c FROM (
  SELECT id, list_reduce(list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^[\\s\\x{{a0}}\\x{{3000}}\\x{{2028}}]+|[\\s\\x{{a0}}\\x{{3000}}\\x{{2028}}]+$', '', 'g')), lambda p: p <> ''), lambda s, x: {_STEP},
    {{chunks: CAST([] AS VARCHAR[]), held: CAST([] AS VARCHAR[]), n: CAST(0 AS BIGINT)}}) AS s FROM (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL)))"""


@query(f"SELECT id, CAST(k AS INT) AS chunk_index, text, CAST({_words_sql('text')} AS INT) AS word_count FROM (SELECT id, unnest(range(len(c))) AS k, unnest(c) AS text FROM {_CHUNKS})")
def greedy_chunks(spark: SparkSession, d: str) -> DataFrame:
    return segment.greedy_chunks(read(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


# The books in order, for the comparison; an abbreviation is the first book's that it begins, but for those listed.
_CANON = """Genesis Exodus Leviticus Numbers Deuteronomy Joshua Judges Ruth 1_Samuel 2_Samuel 1_Kings 2_Kings 1_Chronicles 2_Chronicles Ezra Nehemiah Esther Job Psalms Proverbs Ecclesiastes
    Song_of_Solomon Isaiah Jeremiah Lamentations Ezekiel Daniel Hosea Joel Amos Obadiah Jonah Micah Nahum Habakkuk Zephaniah Haggai Zechariah Malachi Matthew Mark Luke John Acts Romans 1_Corinthians
    2_Corinthians Galatians Ephesians Philippians Colossians 1_Thessalonians 2_Thessalonians 1_Timothy 2_Timothy Titus Philemon Hebrews James 1_Peter 2_Peter 1_John 2_John 3_John Jude Revelation""".split()
_SHORT = "Gen Exod Ex Lev Num Deut Josh Judg Neh Esth Psalm Psa Ps Pss Prov Eccles Eccl Song Isa Jer Lam Ezek Dan Hos Obad Jon Mic Nah Hab Zeph Hag Zech Mal Matt Mt Mk Lk Jn Rom Gal Eph Phil Col Tit Philem Heb Jas Rev"
_NUMBERED = "Samuel Kings Chronicles Corinthians Thessalonians Timothy Peter John Sam Kgs Chron Chr Cor Thess Thes Tim Pet Jn"
_BOOKS_SQL = "(SELECT unnest([" + ", ".join(f"'{b.replace('_', ' ')}'" for b in _CANON) + f"]) AS name, unnest(range({len(_CANON)})) AS k)"
_EXCEPT = "MAP {'mt': 'matthew', 'mk': 'mark', 'lk': 'luke', 'jn': 'john', 'jas': 'james', 'pss': 'psalms', '1kgs': '1kings', '2kgs': '2kings', '1jn': '1john', '2jn': '2john', '3jn': '3john', 'songs': 'songofsolomon', 'songofsongs': 'songofsolomon'}"


def _book_sql(written: str) -> str:
    key = f"regexp_replace(lower({written}), '[\\s.\\-_]', '', 'g')"
    return f"(SELECT arg_min(name, k) FROM {_BOOKS_SQL} WHERE starts_with(replace(lower(name), ' ', ''), coalesce({_EXCEPT}[{key}], {key})))"


_NAMES_SQL = "|".join(sorted([rf"[123]\s*{n}" for n in _NUMBERED.split()] + [b for b in _CANON if "_" not in b] + [r"Song\s+of\s+Solomon"] + _SHORT.split(), key=lambda x: (-len(x), x)))
_CITED = rf"\b({_NAMES_SQL})\.?\s*(\d{{1,3}}):(\d{{1,3}})(?:\s?[-–]\s?(\d{{1,3}})|\s?,\s?(\d{{1,3}}))?"


@query(rf"""
WITH p AS (SELECT id, min(text) AS text FROM passages GROUP BY id), m AS (SELECT id, unnest(range(len(l))) AS pos, unnest(l) AS matched FROM (SELECT id, regexp_extract_all(text, '(?i){_CITED}') AS l FROM p WHERE text IS NOT NULL)),
g AS (SELECT *, regexp_extract(matched, '(?i){_CITED}', ['book', 'c', 'v', 'e', 'f']) AS g FROM m), b AS (SELECT written, {_book_sql('written')} AS book FROM (SELECT DISTINCT g.book AS written FROM g)),
c AS (SELECT id, pos, matched, b.book, CAST(g.c AS INT) AS chapter, CAST(g.v AS INT) AS verse_start, CAST(coalesce(nullif(g.e, ''), nullif(g.f, ''), g.v) AS INT) AS verse_end FROM g JOIN b ON b.written = g.g.book)
SELECT id, pos, matched, book || ' ' || chapter || ':' || verse_start || CASE WHEN verse_end <> verse_start THEN '-' || verse_end ELSE '' END AS reference, book, chapter, verse_start, verse_end FROM c""")
def extracted_citations(spark: SparkSession, d: str) -> DataFrame:
    # repeated rows give the same citations: what is made distinct is small, not the texts
    return citations.extract(read(spark, d, "passages", "id", "text")).distinct()


@query(f"""
WITH b AS (SELECT book, {_book_sql('book')} AS name FROM (SELECT DISTINCT book FROM scripture_refs WHERE book IS NOT NULL))
SELECT passage_id, reference, b.name, r.book FROM (SELECT DISTINCT passage_id, reference, book FROM scripture_refs WHERE book IS NOT NULL) r JOIN b ON b.book = r.book""")
def book_names(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "scripture_refs", "passage_id", "reference", "book").where("book is not null").distinct()
    return r.withColumn("name", citations.book_name(F.col("book")))


@query("""
SELECT doc_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 1, 50000) AS plain
FROM (SELECT doc_id, '<html><head><style>p {color: red}</style></head><body><p>' || replace(text, chr(10), '<br>') || '</p><SCRIPT>x</SCRIPT></body></html>' AS h FROM documents WHERE text IS NOT NULL)""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of each text, and back to text."""
    page = F.concat(F.lit("<html><head><style>p {color: red}</style></head><body><p>"), F.replace(F.col("text"), F.lit("\n"), F.lit("<br>")), F.lit("</p><SCRIPT>x</SCRIPT></body></html>"))
    return _texts(spark, d).select("doc_id", T.strip_html(page).alias("plain"))


@query("""
SELECT doc_id, regexp_replace(regexp_replace(text, '[ \\t]{2,}', ' ', 'g'), '(?m)[ \\t]+$', '', 'g') AS clean FROM documents WHERE text IS NOT NULL""")
def light_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", T.light_clean(F.col("text")).alias("clean"))


_WS = "[ \\t\\n\\r\\f\\x0b]"


@query("""
WITH p AS (SELECT id, translate(min(text), '‘’‚“”„–—', '''''''\"\"\"--') AS t FROM passages WHERE text IS NOT NULL GROUP BY id),
l AS (SELECT id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT (regexp_matches(trim(x, ' '), '^[\\[\\(\\-\\s]*\\d{1,4}[\\]\\)\\-\\s]*$') OR (length(trim(x, ' ')) < 60 AND upper(trim(x, ' ')) = trim(x, ' ') AND lower(trim(x, ' ')) <> trim(x, ' ')))), chr(10)) AS t FROM p)
SELECT id, md5(trim(regexp_replace(regexp_replace(regexp_replace(t, '(\\w)-\\n(\\w)', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS clean FROM l""")
def page_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Ingest cleaning but for the compatibility forms, which SQL doesn't know (tested by themselves)."""
    p = read(spark, d, "passages", "id", "text").where("text is not null").groupBy("id").agg(F.min("text").alias("text"))
    return p.select("id", F.md5(T.clean_page_text(F.col("text"), normalise=False)).alias("clean"))


_FIXES = {"tbe": "the", "aud": "and", "witb": "with", "tliat": "that", "fome": "some", "fuch": "such", "firft": "first", "moft": "most"}


@query(f"""
WITH p AS (SELECT id, translate(replace(min(text), 'ſ', 's'), '‘’‚“”„–—', '''''''\"\"\"--') AS t FROM passages WHERE text IS NOT NULL GROUP BY id),
l AS (SELECT id, array_to_string(list_transform(list_filter(string_split(t, chr(10)), lambda x: NOT (regexp_matches(trim(x, ' '), '^[^A-Za-z]*$') OR regexp_matches(trim(x, ' '), '^(?:[A-Z]\\s*\\d+|\\[\\d+\\]|\\d{{1,3}})$')
  OR (length(trim(x, ' ')) < 5 AND NOT regexp_matches(trim(x, ' '), '[aeiouAEIOU]')) OR regexp_matches(trim(x, ' '), '^(Source|Title|Date):'))), lambda x: trim(x, ' ')), ' ') AS t FROM p),
s AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[|*#@&$%{{}}\\[\\]<>^~\\\\]', '', 'g'), '\\s*--\\s*', ' ', 'g'), '\\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\\.\\s*\\d+\\.?', '', 'g'), '\\((?:[Pp]age|p\\.)\\s*\\d+\\.?\\)', '', 'g') AS t FROM l)
SELECT id, md5(trim(regexp_replace(array_to_string(list_transform(regexp_extract_all(t, '[A-Za-z'']+|[^A-Za-z'']+'), lambda w: CASE w {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _FIXES.items())} ELSE w END), ''), '\\s+', ' ', 'g'), ' ')) AS clean FROM s""")
def scan_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Second-stage cleaning but for the compatibility forms."""
    p = read(spark, d, "passages", "id", "text").where("text is not null").groupBy("id").agg(F.min("text").alias("text"))
    return p.select("id", F.md5(T.clean_scan_text(F.col("text"), _FIXES, "^(Source|Title|Date):", normalise=False)).alias("clean"))


@query("""
WITH d AS (SELECT doc_id, '16 REV. J. WEXCOMBE''S JOURNAL' || chr(10) || 'To the Rev. Mr. WEXCOMBE' || chr(10) || text AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT (regexp_matches(x, '(?i)REV\\.?.{0,25}WEXC') AND regexp_matches(x, '\\d|J[O0]URNA[L1]'))), chr(10)) AS t FROM d)
SELECT doc_id, md5(regexp_replace(array_to_string(list_transform(regexp_extract_all(t, '[A-Za-z'']+|[^A-Za-z'']+'), lambda w: CASE w WHEN 'tlie' THEN 'the' WHEN 'Sunpay' THEN 'Sunday' WHEN 'rot' THEN 'not' ELSE w END), ''), '\\[was\\b', 'I was', 'g')) AS clean FROM l""")
def garbles_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Running headers put on each text and taken off again, a salutation kept, words and a misread letter repaired."""
    t = F.concat(F.lit("16 REV. J. WEXCOMBE'S JOURNAL\nTo the Rev. Mr. WEXCOMBE\n"), F.col("text"))
    fixed = T.clean_garbles(t, r"REV\.?.{0,25}WEXC", [r"\d", "J[O0]URNA[L1]"], {"tlie": "the", "Sunpay": "Sunday", "rot": "not"}, [(r"\[was\b", "I was")])
    return _texts(spark, d).select("doc_id", F.md5(fixed).alias("clean"))


@query("""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\\d{1,3}[ \\t]*$', '', 'g'), '\\n{4,}', repeat(chr(10), 3), 'g'), '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g')) AS clean FROM documents WHERE text IS NOT NULL""")
def boilerplate_stripped(spark: SparkSession, d: str) -> DataFrame:
    """A producer's header, footer and label put around each text and taken off again."""
    t = F.concat(F.lit("12 This document was made by the press\nof the town.\n\n[Title]\nModernized text\n"), F.col("text"), F.lit("\n3 This document was made by the press"))
    blocks = [r"^[\d ]*This document was made by the press\n.*?\n\[Title\]\n", r"^Modernized text[ \t]*\n", r"\n^[\d ]*This document was made by the press[^\n]*$"]
    return _texts(spark, d).select("doc_id", F.md5(T.clean_boilerplate(t, blocks)).alias("clean"))


#: An editor's marks: cross references, citations, orphans of either. (name, pattern, replacement), applied in order, twice.
_EDITORIAL = [
    ("journal_header", r"([.!?])\s+Journal,?\s*\d{4}\s*[-–]?\s*", r"$1 "),
    ("see_above", r"\s*See above,?\s*pp?\.\s*\d+(?:[-–,]\s*\d+)*\.?", ""),
    ("see_below", r"\s*See below,?\s*pp?\.\s*\d+(?:[-–,]\s*\d+)*\.?", ""),
    ("compare", r"\s*\b(?:Cf|Compare)\.?\s+[A-Z][a-z]+\.?\s+[ivxlc]+\.\s*\d+,?", ""),
    ("serm", r"\s*\(Serm\.\s+[ivxlc]+\.\s+sect\.\s+\d+\)", ""),
    ("vol", r"\s*\b[Vv]ol\.\s*[ivxlc]+\.?,?\s*pp?\.\s*\d+\.?", ""),
    ("note", r"([.!?])\s+Note\s*[-—:]\s[^.]{0,150}\.", r"$1"),
    ("i_hyphen", r"\bI[-–]([a-z]+ed|went|rode|saw|had|was|did|came|met)\b", r"I $1"),
    ("sentence_dash", r"([.!?])\s*[-–]\s*(I|We|He|She|They)\b", r"$1 $2"),
    ("spaces", r"[ \t]{2,}", " "),
    ("orphan_mark", r"([,;:])\s*([,;:])", r"$2"),
    ("orphan_close", r"(\)\.)\s*;+\s+", r"$1 "),
]


def _fold_sql(text: str, passes: int = 2) -> str:
    for _ in range(passes):
        for _name, p, r in _EDITORIAL:
            text = f"regexp_replace({text}, '{p}', '{r.replace('$', chr(92))}', 'g')"
    return text


@query(f"SELECT doc_id, md5({_fold_sql('text')}) AS clean FROM documents WHERE text IS NOT NULL")
def editorial_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Twelve ordered rules in two passes, as one expression."""
    return _texts(spark, d).select("doc_id", F.md5(T.rule_fold(F.col("text"), [(p, r) for _, p, r in _EDITORIAL], 2)).alias("clean"))


@query("""
SELECT doc_id, CAST(a AS BIGINT) AS quotes, CAST(b AS BIGINT) AS dashes, CAST(c AS BIGINT) AS blanks FROM (SELECT doc_id, len(regexp_extract_all(text, '[“”]')) AS a, len(regexp_extract_all(text, '[–—]')) AS b,
  len(regexp_extract_all(text, ' {2,}')) AS c FROM documents WHERE text IS NOT NULL)""")
def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits per rule of an ordered rule table, counted before each rule's own step."""
    hits = T.rule_hits(F.col("text"), [("[“”]", '"'), ("[–—]", "-"), (" {2,}", " ")])
    return _texts(spark, d).select("doc_id", hits.alias("h")).select("doc_id", F.col("h")[0].cast("long").alias("quotes"), F.col("h")[1].cast("long").alias("dashes"), F.col("h")[2].cast("long").alias("blanks"))


@query("""
SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug, sha256('v1:' || coalesce(title, '')) AS key FROM works""")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "works", "id", "title")
    return w.select("id", T.slug(F.col("title")).alias("slug"), F.sha2(F.concat(F.lit("v1:"), F.coalesce("title", F.lit(""))), 256).alias("key"))


@query("""
SELECT source_id, CASE regexp_extract(source_id, '^([a-z]+)-', 1) WHEN 'jx' THEN 'josiah-wexcombe' WHEN 'cx' THEN 'clement-wexcombe' ELSE 'unknown' END AS author,
       CASE WHEN regexp_extract(source_id, '^[a-z]+-(sermon|letter|journal|hymn|notes|minutes|treatise)', 1) = '' THEN 'other' ELSE regexp_extract(source_id, '^[a-z]+-(sermon|letter|journal|hymn|notes|minutes|treatise)', 1) END AS source_type,
       CAST(nullif(regexp_extract(source_id, '-(1[678]\\d\\d)(?:-|$)', 1), '') AS INT) AS year FROM (SELECT DISTINCT source_id FROM passages WHERE source_id IS NOT NULL)""")
def name_metadata(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.sources import io

    s = read(spark, d, "passages", "source_id").where("source_id is not null").distinct()
    out = s.select(*io.name_metadata(F.col("source_id"), {"jx": "josiah-wexcombe", "cx": "clement-wexcombe"}))
    return out.select("source_id", "author", "source_type", "year")


@query("""
SELECT theme_id, trim(k) AS keyword FROM (SELECT theme_id, unnest(string_split(keywords, ',')) AS k FROM themes) WHERE trim(k) <> ''""")
def theme_keywords(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.sources import io

    return read(spark, d, "themes", "theme_id", "keywords").select("theme_id", F.explode(io.keyword_list(F.col("keywords"))).alias("keyword"))


@query("SELECT DISTINCT lower(word) AS word FROM dictionary WHERE word IS NOT NULL AND word <> '' UNION SELECT 'itinerant'")
def dictionary_words(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.sources import io

    return io.dictionary(read(spark, d, "dictionary", "word"), ["Itinerant"])


@query("""
SELECT numeral, CAST(list_position(['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii','xiii','xiv','xv','xvi','xvii','xviii','xix','xx','xxi','xxii'], numeral) AS INT) AS value, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(text, 'vol\\. ([ivx]+)\\.', 1)) AS numeral FROM documents WHERE text IS NOT NULL) GROUP BY numeral""")
def roman_numerals(spark: SparkSession, d: str) -> DataFrame:
    n = _texts(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"vol\. ([ivx]+)\."), F.lit(1))).alias("numeral")).groupBy("numeral").agg(F.count("*").alias("n"))
    return n.select("numeral", T.roman_value(F.col("numeral")).alias("value"), "n")


@query("""
SELECT doc_id, CAST(i - 1 AS INT) AS pos, h AS head, CAST(list_position(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'], substr(h, 1, 3)) - 1 AS INT) AS weekday, CAST(regexp_extract(h, '(\\d+)$', 1) AS INT) AS day
FROM (SELECT doc_id, unnest(l) AS h, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\\b(?:Mon|Tues|Tue|Wed|Thurs|Thur|Fri|Sat|Sun)\\.?[ \\t\\n]+\\d{1,2}\\b') AS l FROM documents WHERE text IS NOT NULL))""")
def date_heads(spark: SparkSession, d: str) -> DataFrame:
    return segment.date_heads(_texts(spark, d), "doc_id").withColumnRenamed("id", "doc_id")


@query("""
SELECT doc_id, CAST(i - 1 AS INT) AS pos, CAST(regexp_extract(x, '^\\s*(\\d{1,6})\\.\\s', 1) AS INT) AS number FROM (
  SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(x, '^\\s*(\\d{1,6})\\.\\s')""")
def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    return segment.numbered_lines(_texts(spark, d), "doc_id").select(F.col("id").alias("doc_id"), "pos", "number")


@query("""
WITH w AS (SELECT w AS garble, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM passages) WHERE contains(w, 'f') GROUP BY w),
k AS (SELECT DISTINCT lower(word) AS fix FROM dictionary WHERE word IS NOT NULL),
u AS (SELECT * FROM w WHERE garble NOT IN (SELECT fix FROM k)),
c AS (SELECT DISTINCT garble, n, fix FROM (SELECT garble, n, unnest(list_transform(list_filter(range(1, length(garble) + 1), lambda i: substr(garble, i, 1) = 'f'), lambda i: substr(garble, 1, i - 1) || 's' || substr(garble, i + 1))) AS fix FROM u UNION ALL SELECT garble, n, replace(garble, 'f', 's') FROM u))
SELECT garble, min(c.fix) AS fix, any_value(n) AS n, count(*) > 1 AS ambiguous FROM c JOIN k ON c.fix = k.fix GROUP BY garble""")
def letter_substitutions(spark: SparkSession, d: str) -> DataFrame:
    """Unknown words that s for f turns into dictionary words."""
    from corpusloom.operators import repair

    return repair.substitutions(repair.tokens(read(spark, d, "passages", "text")), read(spark, d, "dictionary", "word"))


@query(f"""
WITH known AS (SELECT DISTINCT lower(word) AS stem FROM dictionary WHERE word IS NOT NULL), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM passages WHERE text IS NOT NULL),
u AS (SELECT word, unnest({bases_sql('word')}) AS stem FROM w WHERE word NOT IN (SELECT stem FROM known))
SELECT word, min(stem) AS stem FROM u WHERE stem IN (SELECT stem FROM known) GROUP BY word""")
def regular_inflections(spark: SparkSession, d: str) -> DataFrame:
    """Corpus words that are regular inflections of dictionary words."""
    from corpusloom.operators import repair

    return repair.regular_inflections(repair.tokens(read(spark, d, "passages", "text")), read(spark, d, "dictionary", "word"))


@query()
def quote_wording(spark: SparkSession, d: str) -> DataFrame:
    """How closely each document that holds the beginning of a golden item follows the item's first sentence."""
    from corpusloom.operators import joins, repair

    items = read(spark, d, "golden_set", "id", "text").select(F.col("id").alias("item"), F.substring("text", 1, 24).alias("anchor"), F.element_at(T.sentences_naive(F.col("text")), 1).alias("quote"))
    found = joins.containing(read(spark, d, "documents", "doc_id", "text").where("text is not null"), items, "text", "anchor", "doc_id")
    return repair.wording(found).select("item", "doc_id", F.round("similarity", 4).alias("similarity"))


@query("""
SELECT doc_id, regexp_replace(text, '(\\pL)[-¬\\x{ad}]\\n[ \\t\\n\\r\\f\\v]*(\\p{Ll})', '\\1\\2', 'g') AS joined FROM documents WHERE text IS NOT NULL""")
def rejoined_lines(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators import repair

    return _texts(spark, d).select("doc_id", repair.rejoined(F.col("text")).alias("joined"))


_STANZAS = "list_filter(list_transform(string_split_regex(t, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g')), lambda x: x <> '')"


@query(f"""
WITH t AS (SELECT doc_id, translate(text, '‘’‚“”„–—', '''''''\"\"\"--') AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT (regexp_matches(trim(x, ' '), '^[\\[\\(\\-\\s]*\\d{{1,4}}[\\]\\)\\-\\s]*$') OR (length(trim(x, ' ')) < 60 AND upper(trim(x, ' ')) = trim(x, ' ') AND lower(trim(x, ' ')) <> trim(x, ' ')))), chr(10)) AS t FROM t),
c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '(\\w)-\\n(\\w)', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ') AS t FROM l),
v AS (SELECT doc_id, unnest(range(len(s))) AS k, regexp_replace(unnest(s), '^\\d+\\.?\\s+', '') AS text FROM (SELECT doc_id, {_STANZAS} AS s FROM c WHERE t <> ''))
SELECT doc_id || '-stanza-' || lpad(CAST(k + 1 AS VARCHAR), 2, '0') AS id, k + 1 AS stanza_number, md5(text) AS digest FROM v""")
def ingested_verse(spark: SparkSession, d: str) -> DataFrame:
    """Documents through the ingest plan as a collection of verse, every one of them short enough to go stanza by stanza."""
    from corpusloom.operators import ingest
    from corpusloom.plans.scoring import RULES

    out = ingest.passages(_sources(spark, d), RULES, verse_below=10**9, normalise=False)
    return out.select("id", "stanza_number", F.md5("text").alias("digest"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents", "doc_id", "author", "source", "title", "year", "text")
    return docs.select(F.col("doc_id").cast("string").alias("source_id"), "author", F.when(F.col("source").startswith("school"), "hymn").otherwise("prose").alias("source_type"), "title", "year", "text")


@query()
def ingested_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents through the ingest plan: cleaned, chunked, tagged."""
    from corpusloom.operators import ingest
    from corpusloom.plans.scoring import RULES

    return ingest.passages(_sources(spark, d), RULES)


@query("SELECT coalesce(source_id, '') AS source_id, count(*) AS passages_added, CAST(sum(word_count) AS BIGINT) AS words, 'ok' AS status FROM passages WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM works WHERE open AND source_id IS NOT NULL) GROUP BY 1")
def ingest_log(spark: SparkSession, d: str) -> DataFrame:
    """The log rows of the sources that aren't open works yet."""
    from corpusloom.operators import ingest

    rows = read(spark, d, "passages", "source_id", "word_count").where("source_id is not null")
    return ingest.log(ingest.new_only(rows, read(spark, d, "works", "source_id", "open").where("open and source_id is not null")))


@query("SELECT id, count(*) AS in_base, count(*) AS in_more FROM works GROUP BY id UNION ALL SELECT id || '-new', 0, count(*) FROM works GROUP BY id HAVING count(*) > 1")
def union_check(spark: SparkSession, d: str) -> DataFrame:
    """Ids that a union of works with themselves and with renamed ones would hold more than once."""
    from corpusloom.operators import joins

    w = read(spark, d, "works", "id")
    return joins.union_unique(w, w.unionByName(w.select(F.concat("id", F.lit("-new")).alias("id"))), "id")[1]


@query("""
SELECT id, CASE numbering.bicentennial WHEN 1 THEN 'first' WHEN 7 THEN 'seventh' ELSE 'js-' || lpad(CAST(numbering.bicentennial AS VARCHAR), 3, '0') END AS number_id,
  CASE author WHEN 'various' THEN 'Sundry Hands' ELSE array_to_string(list_transform(string_split_regex(author, '[-_]+'), lambda x: upper(x[1]) || lower(x[2:])), ' ') END AS shown FROM works""")
def formatted_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids made of numbers, but for two with names of their own, and authors as they are shown."""
    w = read(spark, d, "works", "id", "numbering", "author")
    return w.select("id", T.formatted_id("js-", F.col("numbering.bicentennial"), 3, {1: "first", 7: "seventh"}).alias("number_id"), T.display_name(F.col("author"), {"various": "Sundry Hands"}).alias("shown"))
