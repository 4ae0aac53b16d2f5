"""Sources and sinks: what is written to the shared folder is read again and compared with where it came from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.functions import text as T
from corpusloom.operators import citations, joins, registry
from corpusloom.plans.book import query
from corpusloom.session import read
from corpusloom.sources import io


def _folder(spark: SparkSession, name: str) -> str:
    path = f"{session.shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    session._note(spark, path)
    return path


_REFS = "(SELECT DISTINCT book, chapter, passage_id, coalesce(CAST(verse_start AS VARCHAR), '') AS verses FROM scripture_refs WHERE book IS NOT NULL AND chapter IS NOT NULL AND passage_id IS NOT NULL)"


def _refs(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "scripture_refs", "book", "chapter", "passage_id", "verse_start").where("book is not null and chapter is not null and passage_id is not null")
    return r.select("book", "chapter", "passage_id", F.coalesce(F.col("verse_start").cast("string"), F.lit("")).alias("verses")).distinct()


@query(f"SELECT book, chapter, row_number() OVER (PARTITION BY book, chapter ORDER BY passage_id, verses) - 1 AS pos, passage_id, verses FROM {_REFS}")
def nested_map_scan(spark: SparkSession, d: str) -> DataFrame:
    """The index written as JSON documents book -> chapter -> entries, and read back into rows."""
    rows = citations.merged(_refs(spark, d).limit(0).withColumn("pos", F.lit(0)), _refs(spark, d))
    chapters = citations.nested_document(rows, most=10**9).select("book", F.struct(F.col("chapter").cast("string"), "entries").alias("c"))
    path = _folder(spark, "nested")
    chapters.groupBy("book").agg(F.to_json(F.map_from_arrays(F.array("book"), F.array(F.map_from_entries(F.collect_list("c"))))).alias("value")).select("value").write.text(path)
    # each line is a document
    lines = spark.read.text(path).select(F.explode(F.from_json("value", io.NESTED)).alias("book", "chapters")).select("book", F.explode("chapters").alias("chapter", "entries"))
    out = lines.select("book", F.col("chapter").cast("int").alias("chapter"), F.posexplode("entries").alias("pos", "e"))
    return out.select("book", "chapter", "pos", "e.passage_id", "e.verses")


@query(f"""
WITH o AS (SELECT book, chapter, 0 AS n, row_number() OVER (PARTITION BY book, chapter ORDER BY passage_id, verses) AS o, passage_id, verses FROM {_REFS} WHERE chapter % 2 = 0),
a AS (SELECT * FROM o UNION ALL SELECT book, chapter, 1, 0, passage_id || '-note', verses FROM {_REFS} WHERE chapter % 3 = 0)
SELECT book, chapter, row_number() OVER (PARTITION BY book, chapter ORDER BY n, o, passage_id, verses) - 1 AS pos, passage_id, verses FROM a""")
def merged_index(spark: SparkSession, d: str) -> DataFrame:
    """New entries put after the old ones of their chapter, new chapters begun."""
    r = _refs(spark, d)
    old = citations.merged(r.limit(0).withColumn("pos", F.lit(0)), r.where("chapter % 2 = 0"))
    return citations.merged(old, r.where("chapter % 3 = 0").withColumn("passage_id", F.concat("passage_id", F.lit("-note"))))


@query("SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY c NULLS LAST, id) - 1 AS pos, id FROM (SELECT source_id, id, min(chunk_index) AS c FROM passages WHERE source_id IS NOT NULL GROUP BY source_id, id)")
def source_order(spark: SparkSession, d: str) -> DataFrame:
    return joins.by_source(read(spark, d, "passages", "source_id", "id", "chunk_index"))


@query("SELECT passage_id, min({o: overall_score, w: word_count}).o AS overall_score, min({o: overall_score, w: word_count}).w AS word_count FROM swi_scores WHERE label IN (SELECT min(label) FROM swi_scores) AND passage_id IS NOT NULL GROUP BY passage_id")
def typed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A lookup out of strings, some of them empty, kept by label."""
    s = read(spark, d, "swi_scores", "passage_id", "overall_score", "word_count", "label")
    first = s.agg(F.min("label").alias("m")).first()["m"]
    strings = s.select("passage_id", "label", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("overall_score", "word_count")))
    return io.typed_lookup(strings, "passage_id", {"overall_score": "int", "word_count": "int"}, {"label": [first]})


@query("SELECT theme_name AS \"group\", trim(k) AS phrase FROM (SELECT theme_name, unnest(string_split(keywords, ',')) AS k FROM themes) WHERE trim(k) <> ''")
def lexicon_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The themes' keywords written as a lexicon document, and read back; a lexicon that isn't there is empty."""
    t = read(spark, d, "themes", "theme_name", "keywords").select("theme_name", io.keyword_list(F.col("keywords")).alias("k"))
    path = _folder(spark, "lexicon")
    doc = t.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("theme_name", "k"))).alias("curated_phrases"), F.array().cast("array<struct<term:string,count:bigint,distinctiveness:double>>").alias("top_distinctive"))).alias("value"))
    doc.write.text(path)
    return io.read_lexicon(spark, path)[0].unionByName(io.read_lexicon(spark, path + "-none")[0])


@query("""
SELECT id, CASE WHEN regexp_matches(stem, '^sermon-\\d+-') THEN 'Sermon ' || CAST(regexp_extract(stem, '^sermon-(\\d+)-', 1) AS INT) || ': ' ELSE '' END || array_to_string(list_transform(string_split(replace(regexp_replace(stem, '^sermon-\\d+-', ''), '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title,
  CASE WHEN regexp_extract(stem, '(sermon|hymn|journal|letter|notes|minutes)', 1) = '' THEN 'treatise' ELSE regexp_extract(stem, '(sermon|hymn|journal|letter|notes|minutes)', 1) END AS kind
FROM (SELECT id, regexp_replace(source_id, '^[a-z]+-', '') AS stem FROM (SELECT DISTINCT id, source_id FROM works))""")
def stem_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles and kinds from file names."""
    stem = F.regexp_replace("source_id", "^[a-z]+-", "")
    return read(spark, d, "works", "id", "source_id").distinct().select("id", io.stem_title(stem).alias("title"), io.stem_type(stem).alias("kind"))


@query("""
SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(string_split_regex(text, '\\n[ \\t\\n\\r\\f\\v]*\\n'), lambda x: true), lambda p: trim(regexp_replace(p, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10)) AS body FROM documents WHERE text IS NOT NULL""")
def page_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of each text, with other paragraphs between, and the text of the right ones taken out of them."""
    docs = read(spark, d, "documents", "doc_id", "text").where("text is not null")
    p = lambda x: F.concat(F.lit('<p id="x" class="first bodytext">'), F.replace(T.escape_html(x), F.lit("\n"), F.lit("<br/>")), F.lit('</p>\n<P class="note">not <b>this</b></P>'))
    page = F.concat(F.lit("<html><body><p>nor this</p>"), F.array_join(F.transform(F.split("text", r"\n\s*\n"), p), "\n"), F.lit("</body></html>"))
    return docs.select("doc_id", F.array_join(io.body_paragraphs(page), "\n\n").alias("body"))


@query("""SELECT doc_id, array_to_string(list_slice(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''), 1, 80), ' ') AS beginning FROM documents WHERE text IS NOT NULL""")
def first_words(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", io.first_words(F.col("text"), 80).alias("beginning"))


@query("""
WITH r AS (SELECT legacy_id, min(t) AS target FROM (SELECT unnest(legacy_ids) AS legacy_id, CASE WHEN starts_with(closed_reason, 'duplicate-of:') THEN regexp_extract(closed_reason, '^duplicate-of:(\\S+)', 1) ELSE id END AS t FROM works) WHERE legacy_id IS NOT NULL GROUP BY legacy_id)
SELECT legacy_id, target FROM r UNION ALL SELECT id, CASE WHEN starts_with(id, 'jx-journal') THEN 'journal' ELSE 'letters' END FROM (SELECT DISTINCT id FROM passages) WHERE (starts_with(id, 'jx-journal') OR starts_with(id, 'jx-letter')) AND id NOT IN (SELECT legacy_id FROM r)""")
def filled_redirects(spark: SparkSession, d: str) -> DataFrame:
    """Old ids with their works, and passage ids without one by the first rule for their prefix."""
    known = joins.redirects(read(spark, d, "works", "id", "legacy_ids", "closed_reason"))
    return joins.redirects_filled(known, read(spark, d, "passages", "id"), [("jx-journal", "journal"), ("jx-letter", "letters")])


@query("""
SELECT row_number() OVER (ORDER BY corpus NULLS FIRST, part) - 1 AS n, '<sitemap><loc>https://example.org/sitemap-' || replace(coalesce(corpus, 'other'), '/', '-') || CASE WHEN part > 0 THEN '-' || part ELSE '' END || '.xml</loc></sitemap>' AS line
FROM (SELECT DISTINCT corpus, (row_number() OVER (PARTITION BY corpus ORDER BY id) - 1) // 20 AS part FROM works WHERE open)""")
def sitemap_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of the site maps, cut into parts of twenty."""
    return registry.sitemap_index(registry.sitemap(read(spark, d, "works", "id", "corpus", "open"), "https://example.org", 20), "https://example.org")


@query("""
WITH b AS (SELECT id AS work_id, unnest(range(len(passage_ids))) AS pos, unnest(passage_ids) AS passage_id FROM works WHERE open)
SELECT replace(work_id, '/', '_') || '.txt' AS name, md5(string_agg(text, chr(10) || chr(10) ORDER BY pos, text)) AS digest FROM b JOIN (SELECT id, max(text) AS text FROM passages GROUP BY id) p ON p.id = b.passage_id WHERE text IS NOT NULL GROUP BY work_id""")
def tar_export(spark: SparkSession, d: str) -> DataFrame:
    """The texts of open works as files of four archives, written, read and unpacked."""
    texts = registry.text_export(read(spark, d, "works", "id", "passage_ids", "open"), read(spark, d, "passages", "id", "text"))
    path = _folder(spark, "archives")
    io.tar_shards(texts.withColumn("name", F.replace("work_id", F.lit("/"), F.lit("_"))), "name", "text", 4).write.parquet(path)
    return io.tar_members(spark.read.parquet(path)).select("name", F.md5("text").alias("digest"))


@query("""
SELECT '# Export' || chr(10) || chr(10) || count(CASE WHEN open THEN 1 END) || ' open works, ' || (SELECT count(DISTINCT id) FROM passages) || ' passages, ' || (SELECT CAST(coalesce(sum(word_count), 0) AS BIGINT) FROM passages) || ' words.' || chr(10) || chr(10) || '- works: one JSON object a work' || chr(10) || '- passages: one JSON object a passage' || chr(10) AS value FROM works""")
def export_readme(spark: SparkSession, d: str) -> DataFrame:
    m = registry.manifest(read(spark, d, "works", "open"), read(spark, d, "passages", "id", "word_count"))
    return io.export_readme(m, [("works", "one JSON object a work"), ("passages", "one JSON object a passage")])


@query("SELECT vec_id, len(embedding) AS size, (SELECT count(*) FROM embeddings) AS count, (SELECT max(len(embedding)) FROM embeddings) AS dimensions, 'given' AS model FROM embeddings")
def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with what is known of their run, written and read."""
    path = _folder(spark, "vectors")
    io.write_vectors(read(spark, d, "embeddings"), path, "vec_id", "embedding", model="given")
    about = spark.read.schema("count long, dimensions int, model string").json(f"{path}/metadata")
    v = spark.read.parquet(f"{path}/vectors").select("vec_id", F.size("embedding").alias("size"))
    return v.withColumns({c: about.agg(F.max(c)).scalar() for c in ("count", "dimensions", "model")})


@query("SELECT DISTINCT id, upper(title) AS title FROM works")
def published_version(spark: SparkSession, d: str) -> DataFrame:
    """A table rewritten: the second version is read, the first is still there."""
    base = _folder(spark, "published")
    w = read(spark, d, "works", "id", "title").distinct()
    first = io.publish(w, base)
    io.publish(spark.read.parquet(f"{base}/{first}").withColumn("title", F.upper("title")), base)
    return io.read_published(spark, base)


@query("SELECT DISTINCT id, source_id FROM passages WHERE id = (SELECT max(id) FROM passages)")
def indexed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A lookup of one id in a table sorted by it."""
    path = _folder(spark, "indexed")
    p = read(spark, d, "passages", "id", "source_id")
    io.write_indexed(p, "id", path)
    last = p.agg(F.max("id").alias("m")).first()["m"]
    return spark.read.parquet(path).where(F.col("id") == last).distinct()


@query("""
SELECT '{"overall_score":' || overall_score || ',"passage_id":"' || passage_id || '"}' AS value FROM (SELECT DISTINCT passage_id, overall_score FROM swi_scores WHERE overall_score IS NOT NULL AND passage_id IS NOT NULL)
UNION ALL SELECT '{"total_files":' || count(DISTINCT passage_id) || ',"last_updated":"2026-01-01"}' FROM swi_scores WHERE overall_score IS NOT NULL AND passage_id IS NOT NULL""")
def score_store(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "swi_scores", "passage_id", "overall_score").dropna().distinct()
    return io.score_store(s, "passage_id", F.lit("2026-01-01"))


@query("""
SELECT passage_id, overall_score, CASE WHEN created_at + INTERVAL 30 DAY > (SELECT max(created_at) FROM swi_scores) THEN 'fresh' ELSE 'stale' END AS state
FROM (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY created_at DESC, overall_score DESC NULLS LAST) AS r FROM swi_scores WHERE passage_id IS NOT NULL AND created_at IS NOT NULL) WHERE r = 1""")
def cache_states(spark: SparkSession, d: str) -> DataFrame:
    """The last score of each passage, fresh for thirty days before the newest of all."""
    s = read(spark, d, "swi_scores", "passage_id", "overall_score", "created_at")
    return joins.cache_state(s, s.agg(F.max("created_at")).scalar(), "30 days", "passage_id", "created_at", "overall_score")
