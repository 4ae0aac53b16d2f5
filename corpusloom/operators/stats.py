"""Grouped statistics over a passage table and its companions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T
from corpusloom.operators import repair


def corpus_totals(passages: DataFrame) -> DataFrame:
    """One row: passages, words, distinct authors and types (missing ones are one value), distinct themes."""
    themes = passages.select(F.explode("themes").alias("t")).agg(F.countDistinct("t")).scalar()
    totals = passages.agg(
        F.count("*").alias("passages"),
        F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"),
        F.countDistinct(F.coalesce("author", F.lit(""))).alias("authors"),
        F.countDistinct(F.coalesce("source_type", F.lit(""))).alias("types"),
    )
    return totals.withColumn("themes", themes)


def grouped_counts(passages: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by each key and overall in one pass: (key, value, passages, words, first and last year)."""
    names = F.coalesce(*(F.when(F.grouping(k) == 0, F.lit(k)) for k in keys), F.lit("all"))
    values = F.coalesce(*(F.when(F.grouping(k) == 0, F.coalesce(F.col(k), F.lit(""))) for k in keys), F.lit(""))
    out = passages.groupingSets([*([k] for k in keys), []], *keys).agg(
        names.alias("key"), values.alias("value"), F.count("*").alias("passages"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"),
        F.min(F.coalesce("year", F.lit(0))).alias("first_year"), F.max(F.coalesce("year", F.lit(0))).alias("last_year"),
    )
    return out.select("key", "value", "passages", "words", "first_year", "last_year")


def theme_counts(passages: DataFrame) -> DataFrame:
    """(theme, n) of the non-null themes passages carry, once per passage row."""
    return passages.select(F.explode("themes").alias("theme")).where("theme is not null").groupBy("theme").agg(F.count("*").alias("n"))


def theme_histogram(passages: DataFrame, width: int = 40) -> DataFrame:
    """Theme counts with a bar whose longest has ``width`` blocks."""
    top = F.max("n").over(Window.partitionBy())  # one row per theme, a bounded dimension
    return theme_counts(passages).withColumn("bar", F.repeat(F.lit("#"), F.floor(F.col("n") * width / top).cast("int")))


def theme_dimension(themes: DataFrame, passages: DataFrame) -> DataFrame:
    """Every theme with its number of passages, 0 if none."""
    return themes.join(theme_counts(passages), themes["theme_id"] == F.col("theme"), "left").select("theme_id", "theme_name", F.coalesce("n", F.lit(0)).alias("n"))


def source_rollup(passages: DataFrame) -> DataFrame:
    """Per source: title, author, type and year of its first row (by id, then chunk), and its number of rows."""
    first = F.min(F.struct("id", F.coalesce("chunk_index", F.lit(-1)).alias("c"), F.coalesce("created_at", F.lit("")).alias("a"), "source_title", "author", "source_type", "year"))
    out = passages.groupBy("source_id").agg(first.alias("f"), F.count("*").alias("passages"))
    return out.select("source_id", *(F.col(f"f.{c}").alias(c) for c in ("source_title", "author", "source_type", "year")), "passages")


def author_type_sources(rollup: DataFrame) -> DataFrame:
    """(author, source_type, place, source_id): the sources of each author and type in order of year (missing last) and id."""
    w = Window.partitionBy("author", "source_type").orderBy(F.coalesce("year", F.lit(9999)), "source_id")
    return rollup.select("author", "source_type", F.row_number().over(w).alias("place"), "source_id")


def extremes(df: DataFrame, value: str, tie: str, top: int = 15, bottom: int = 10) -> DataFrame:
    """The ``top`` greatest and ``bottom`` least rows with their place from either end; equal values by the tie. Two ordered limits, no sort of all."""
    known = df.where(F.col(value).isNotNull())
    high = known.orderBy(F.col(value).desc(), tie).limit(top).withColumn("place", F.row_number().over(Window.orderBy(F.col(value).desc(), tie)))
    low = known.orderBy(F.col(value), tie).limit(bottom).withColumn("place", F.row_number().over(Window.orderBy(F.col(value), tie)))
    return high.withColumn("end", F.lit("top")).unionByName(low.withColumn("end", F.lit("bottom")))


def share_of(df: DataFrame, key: str, weight: str) -> DataFrame:
    """Per key: rows, weight, and the share of all weight."""
    out = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))
    total = df.agg(F.sum(weight)).scalar()
    return out.select(key, "n", "weight", F.round(F.try_divide(F.col("weight"), total), 6).alias("share"))


def fixed_bins(df: DataFrame, value: str, width: int, last: int) -> DataFrame:
    """Histogram over bins of equal width; values beyond go into the last bin."""
    return df.where(F.col(value).isNotNull()).groupBy(F.least(F.floor(F.col(value) / width), F.lit(last)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def score_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: count, mean rounded down, least and greatest value."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.floor(F.avg(value)).cast("long").alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def token_noise(passages: DataFrame, dictionary: DataFrame, header: str | None = None, top: int = 20, least_known: int = 5) -> DataFrame:
    """Per source: passages, words, words that nothing explains, their rate, passages with a running header, the ``top`` offenders.

    Tokens are [A-Za-z']+; known are dictionary words and capitalised tokens seen
    ``least_known`` times; regular inflections and elisions of known words and single
    letters are no noise either. Texts are taken apart once, and counted per source before
    anything is shuffled; the dictionary meets distinct words only. Offenders are as written.
    """
    rows = passages.select("source_id", "text")
    tokens = rows.select("source_id", F.explode(T.cased_tokens(F.col("text"))).alias("t")).groupBy("source_id", "t").agg(F.count("*").alias("n"))
    proper = tokens.where(F.col("t").rlike("^[A-Z][a-z]+$")).groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") >= least_known)
    known = dictionary.select(F.lower("word").alias("w")).where("w is not null").union(proper.select(F.lower("t").alias("w"))).distinct()
    low = tokens.withColumn("w", F.lower(F.regexp_replace("t", "^'+|'+$", "")))
    sound = repair.explained(low.where("w <> ''").select("w"), known)
    bad = low.where("w <> ''").join(sound, "w", "left_anti").groupBy("source_id", "t").agg(F.sum("n").alias("n"))
    totals = tokens.groupBy("source_id").agg(F.sum("n").alias("words"))
    rank = Window.partitionBy("source_id").orderBy(F.col("n").desc(), "t")
    worst = bad.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= top).groupBy("source_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "t", "n"))), lambda s: F.concat(s["t"], F.lit(":"), s["n"].cast("string"))), "; ").alias("top_offenders"))
    sums = bad.groupBy("source_id").agg(F.sum("n").alias("non_words"))
    headed = F.count_if(F.col("text").rlike(header)) if header else F.lit(0).cast("long")
    sources = rows.groupBy("source_id").agg(F.count("*").alias("passages"), headed.alias("header_passages"))
    out = sources.join(totals, "source_id", "left").join(sums, "source_id", "left").join(worst, "source_id", "left")
    words, non_words = F.coalesce("words", F.lit(0)), F.coalesce("non_words", F.lit(0))
    return out.select("source_id", "passages", words.alias("words"), non_words.alias("non_words"), F.when(words > 0, F.bround(non_words / words, 4)).otherwise(0.0).alias("rate"), "header_passages", F.coalesce("top_offenders", F.lit("")).alias("top_offenders"))


def proper_nouns(passages: DataFrame, least: int = 5) -> DataFrame:
    """Capitalised tokens seen at least ``least`` times."""
    tokens = passages.select(F.explode(T.cased_tokens(F.col("text"), "[A-Za-z]+")).alias("token")).where(F.col("token").rlike("^[A-Z][a-z]+$"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def unknown_contexts(passages: DataFrame, dictionary: DataFrame, around: int = 30) -> DataFrame:
    """Lower-case tokens not in the dictionary: in how many texts, and the text around one (of the smallest id).

    Only words and ids are shuffled; the texts are met once more by the ids of the samples.
    """
    tokens = passages.select("id", F.explode(F.array_distinct(T.ascii_tokens(F.col("text"), "[a-z]+"))).alias("w")).where("length(w) > 3")
    counted = tokens.groupBy("w").agg(F.count("*").alias("n"), F.min("id").alias("sample_id"))
    bad = counted.join(dictionary.select(F.lower("word").alias("w")).distinct(), "w", "left_anti")
    found = bad.join(passages.select(F.col("id").alias("sample_id"), "text"), "sample_id").withColumn("at", F.position(F.col("w"), F.lower("text"))).where("at > 0")
    cut = F.substring(F.col("text"), F.greatest(F.col("at") - around, F.lit(1)), F.lit(2 * around))
    return found.groupBy("w", "n", "sample_id").agg(F.min(cut).alias("sample"))


def ngram_counts(passages: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), least: int = 1) -> DataFrame:
    """(n, term, count) of runs of lower-case tokens within a text, seen at least ``least`` times.

    Only the run itself is counted and shuffled; how long it is, is read off its blanks.
    """
    tokens = passages.where("text is not null").select(T.ascii_tokens(F.col("text")).alias("tok"))
    runs = F.concat(*(T.ngrams(F.col("tok"), n) for n in sizes))
    counted = tokens.select(F.explode(runs).alias("term")).groupBy("term").agg(F.count("*").alias("count")).where(F.col("count") >= least)
    return counted.select((F.regexp_count("term", F.lit(" ")) + 1).alias("n"), "term", "count")


def distinctive_terms(own: DataFrame, reference: DataFrame, least: int = 5, top: int = 200) -> DataFrame:
    """Terms by log2 of their share in ``own`` over their share in ``reference`` (each term, count), half a count added to the reference."""
    joined = own.join(reference.select("term", F.col("count").alias("ref")), "term", "left")
    joined = joined.withColumns({"own_total": own.agg(F.sum("count")).scalar(), "ref_total": reference.agg(F.sum("count")).scalar()})
    ratio = F.log2((F.col("count") / F.col("own_total")) / ((F.coalesce("ref", F.lit(0)) + 0.5) / F.coalesce("ref_total", F.lit(1))))
    scored = joined.where(F.col("count") >= least).select("term", "count", F.coalesce("ref", F.lit(0)).alias("ref"), F.round(ratio, 4).alias("ratio")).where("ratio > 0")
    return scored.orderBy(F.col("ratio").desc(), "term").limit(top)


def progress(passages: DataFrame, targets: list[tuple[str, list[str], int]]) -> DataFrame:
    """(kind, have, target, share): distinct sources of each kind (a name, its source types, how many are wanted)."""
    counts = passages.agg(*(F.countDistinct(F.when(F.col("source_type").isin(*types), F.col("source_id"))).alias(name) for name, types, _ in targets))
    rows = F.array(*(F.struct(F.lit(n).alias("kind"), F.col(n).alias("have"), F.lit(t).alias("target"), F.round(F.col(n) / t, 4).alias("share")) for n, _, t in targets))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def status(passages: DataFrame, embedded: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """(by, value, n): passages in all, by type and by author, distinct sources, and passages that have a vector."""
    def counted(name: str) -> DataFrame:
        return passages.groupBy(F.coalesce(name, F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("by"), "value", "n")

    one = passages.agg(F.count("*").alias("passages"), F.countDistinct(F.coalesce("source_id", F.lit(""))).alias("sources"))
    all_rows = one.select(F.explode(F.array(F.struct(F.lit("passages").alias("value"), F.col("passages").alias("n")), F.struct(F.lit("sources").alias("value"), F.col("sources").alias("n")))).alias("r")).select(F.lit("all").alias("by"), "r.*")
    out = all_rows.unionByName(counted("source_type")).unionByName(counted("author"))
    if embedded is not None:
        have = passages.select(id_col).distinct().join(embedded.select(id_col).distinct(), id_col, "left_semi").agg(F.count("*").alias("n"))
        out = out.unionByName(have.select(F.lit("all").alias("by"), F.lit("embedded").alias("value"), "n"))
    return out


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))
