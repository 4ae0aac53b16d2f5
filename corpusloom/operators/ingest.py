"""Raw texts to tagged passages in one plan: clean, chunk (prose or verse), tag, append what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import joins, segment, tagging


def passages(texts: DataFrame, rules: list[tuple[str, list[str]]], most: int = 400, verse_below: int | None = None, normalise: bool = True) -> DataFrame:
    """Passage rows of (source_id, author, source_type, title, year, text): cleaned, chunked and tagged.

    Sources of type hymn go stanza by stanza, others in chunks of at most ``most`` words. With
    ``verse_below``, as for a collection of verse, every text of fewer words goes stanza by
    stanza and longer ones in chunks, whatever their type.
    """
    clean = texts.withColumn("text", T.clean_page_text(F.col("text"), normalise)).where("text is not null and text <> ''")
    is_verse = F.col("source_type") == "hymn" if verse_below is None else T.word_count(F.col("text")) < verse_below
    prose = segment.greedy_chunks(clean.where(~is_verse), "source_id", "text", most).select(
        F.format_string("%s-%03d", "id", "chunk_index").alias("id"), F.col("id").alias("source_id"), "chunk_index", "text", F.lit(None).cast("int").alias("stanza_number")
    )
    verse = clean.where(is_verse).select(F.col("source_id"), F.posexplode(T.stanzas(F.col("text"))).alias("chunk_index", "text"))
    verse = verse.select(F.format_string("%s-stanza-%02d", "source_id", F.col("chunk_index") + 1).alias("id"), "source_id", "chunk_index", "text", (F.col("chunk_index") + 1).alias("stanza_number"))
    rows = prose.unionByName(verse).join(texts.select("source_id", "author", "source_type", F.col("title").alias("source_title"), "year"), "source_id")
    rows = rows.withColumns({"word_count": T.word_count(F.col("text")), "themes": F.array().cast("array<string>")})
    return tagging.tag_untagged(rows, rules)


def new_only(rows: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Rows of sources that are not there yet; all of them if forced."""
    return rows if force else joins.anti(rows, existing, "source_id")


def log(rows: DataFrame) -> DataFrame:
    """(source_id, passages_added, words, status) per source, for the ingest log."""
    return rows.groupBy("source_id").agg(F.count("*").alias("passages_added"), F.sum("word_count").alias("words"), F.lit("ok").alias("status"))
