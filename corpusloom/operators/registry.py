"""Works: classification, rollups, gates, and what is written out from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T
from corpusloom.operators import joins


def classified(sources: DataFrame, rules: list[tuple[Column, str]], column: str = "corpus") -> DataFrame:
    """Each source with the value of the first rule that holds; a source no rule covers is an error when it is read."""
    value = T.first_match(rules)
    return sources.withColumn(column, F.when(value.isNull(), F.raise_error(F.lit("no rule covers a source"))).otherwise(value))


def quality_flag(sources: DataFrame, reasons: list[tuple[Column, str]]) -> DataFrame:
    """open and closed_reason: the first reason that holds closes a source."""
    reason = T.first_match(reasons)
    return sources.withColumn("closed_reason", reason).withColumn("open", F.col("closed_reason").isNull())


def rollup(works: DataFrame, passages: DataFrame) -> DataFrame:
    """Per work: its existing passages in order, their words, its themes sorted and distinct."""
    one = passages.groupBy("id").agg(F.max(F.struct("word_count", "themes")).alias("p")).select("id", "p.word_count", "p.themes")
    members = joins.bridge(works).join(one, F.col("passage_id") == F.col("id"))
    out = members.groupBy("work_id").agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("pos", "passage_id"))), lambda s: s["passage_id"])).alias("ids"),
        F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"),
        F.concat_ws(",", F.sort_array(F.array_compact(F.array_distinct(F.flatten(F.collect_list(F.coalesce("themes", F.array().cast("array<string>")))))))).alias("themes"),
    )
    return out


def registry_gate(works: DataFrame, passages: DataFrame) -> DataFrame:
    """(check, id): repeated work ids, passages in several works or in none, works without an existing passage."""
    bridge = joins.bridge(works)
    ids = passages.select(F.col("id").alias("passage_id")).where("id is not null").distinct()
    row = lambda df, name, col: df.select(F.lit(name).alias("check"), F.col(col).alias("id"))
    repeated = row(works.groupBy("id").count().where("count > 1"), "repeated-work", "id")
    shared = row(bridge.groupBy("passage_id").agg(F.countDistinct("work_id").alias("n")).where("n > 1"), "shared-passage", "passage_id")
    loose = row(ids.join(bridge.select("passage_id").distinct(), "passage_id", "left_anti"), "loose-passage", "passage_id")
    full = bridge.join(ids, "passage_id", "left_semi").select(F.col("work_id").alias("id")).distinct()
    empty = row(works.join(full, "id", "left_anti"), "empty-work", "id")
    return repeated.unionByName(shared).unionByName(loose).unionByName(empty)


def validation(passages: DataFrame, required: list[str], least_words: int = 20) -> DataFrame:
    """(check, id, n): repeated ids, blank texts, short texts, missing fields."""
    words = T.word_count(F.col("text"))
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"[\s\x{a0}]+", " ")), F.lit("")) == ""
    row = lambda df, name: df.select(F.lit(name).alias("check"), "id", F.lit(1).cast("long").alias("n"))
    out = passages.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated-id").alias("check"), "id", "n")
    out = out.unionByName(row(passages.where(blank).select("id").distinct(), "blank-text"))
    out = out.unionByName(row(passages.where(~blank & (words < least_words)).select("id").distinct(), "short-text"))
    for c in required:
        out = out.unionByName(row(passages.where(F.col(c).isNull()).select("id").distinct(), f"missing-{c}"))
    return out


def sentinels(passages: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote_id, expect, found, status): whether each anchor is present where it should be, and absent where it shouldn't."""
    hits = joins.containing(passages.select("id", "text").where("text is not null"), quotes, "text", "anchor").groupBy("quote_id").agg(F.countDistinct("id").alias("found"))
    found = F.coalesce("found", F.lit(0))
    ok = F.when(F.col("expect") == "absent", found == 0).otherwise(found > 0)
    return quotes.select("quote_id", "expect").join(hits, "quote_id", "left").select("quote_id", "expect", found.alias("found"), F.when(ok, "PASS").otherwise("FAIL").alias("status"))


def neighbours_in_corpus(works: DataFrame) -> DataFrame:
    """Each work with the ones before and after it in its corpus, in natural order."""
    w = Window.partitionBy("corpus").orderBy(T.natural_key(F.col("id")), "id")
    return works.select("corpus", "id", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"))


def sitemap(works: DataFrame, base: str, most: int = 50_000) -> DataFrame:
    """(corpus, part, xml): the addresses of open works in order, at most ``most`` in a part."""
    line = F.concat(F.lit(f"<url><loc>{base}/"), T.escape_html(F.col("id")), F.lit("</loc></url>"))
    rows = works.where("open").select("corpus", "id", line.alias("line"), F.floor((F.row_number().over(Window.partitionBy("corpus").orderBy("id")) - 1) / most).cast("int").alias("part"))
    ordered = F.sort_array(F.collect_list(F.struct("id", "line")))
    return rows.groupBy("corpus", "part").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("xml"))


def sitemap_index(maps: DataFrame, base: str) -> DataFrame:
    """(n, line): the lines of the index of all site maps, in order of corpus and part; works without a corpus come first."""
    name = F.concat(F.coalesce(F.replace("corpus", F.lit("/"), F.lit("-")), F.lit("other")), F.when(F.col("part") > 0, F.concat(F.lit("-"), F.col("part").cast("string"))).otherwise(""))
    line = F.concat(F.lit(f"<sitemap><loc>{base}/sitemap-"), T.escape_html(name), F.lit(".xml</loc></sitemap>"))
    # one row per site map: a thousandth of a percent of the works
    return maps.select("corpus", "part", line.alias("line")).select((F.row_number().over(Window.orderBy(F.col("corpus").asc_nulls_first(), "part")) - 1).alias("n"), "line")


def text_export(works: DataFrame, passages: DataFrame) -> DataFrame:
    """(work_id, text) of open works: their passages' texts in order, blank lines between."""
    members = joins.ordered_members(works.where("open"), passages)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "text")))
    return members.groupBy("work_id").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n\n").alias("text"))


def manifest(works: DataFrame, passages: DataFrame) -> DataFrame:
    """One row: open works, closed works, passages and words."""
    counts = works.agg(F.count(F.when(F.col("open"), 1)).alias("open_works"), F.count(F.when(~F.coalesce("open", F.lit(False)), 1)).alias("closed_works"))
    return counts.withColumns({"passages": passages.agg(F.countDistinct("id")).scalar(), "words": passages.agg(F.coalesce(F.sum("word_count"), F.lit(0))).scalar()})
