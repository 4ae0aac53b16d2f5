"""Search: predicates, ranked results and snippets. Every ranking has a total order (ties by id)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def equal_filters(df: DataFrame, **values: str | None) -> DataFrame:
    """Rows whose columns equal the given values; an empty value filters nothing."""
    for column, value in values.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def has_all_terms(text: Column, query: str) -> Column:
    """Every white-space term of the query is in the text, whatever the case; true for an empty query."""
    out = F.lit(True)
    for term in query.lower().split():
        out = out & F.lower(text).contains(term)
    return out


def has_theme(themes: Column, theme: str) -> Column:
    return F.coalesce(F.array_contains(themes, theme), F.lit(False))


def is_untagged(themes: Column) -> Column:
    """Null or empty."""
    return F.coalesce(F.size(themes), F.lit(0)) <= 0


def matching(df: DataFrame, query: str, **values: str | None) -> DataFrame:
    """Rows that hold all terms and equal the given values."""
    return equal_filters(df, **values).where(has_all_terms(F.col("text"), query))


def keyword(df: DataFrame, query: str, limit: int = 50, **values: str | None) -> DataFrame:
    """The first rows (by id) that hold all terms."""
    return matching(df, query, **values).orderBy("id").limit(limit)


def with_score(df: DataFrame, query: str, **values: str | None) -> DataFrame:
    """Adds ``score``: 100 times the hits in the title plus the hits in the text."""
    q = query.lower()
    score = 100 * T.count_literal(F.lower(F.coalesce("source_title", F.lit(""))), q) + T.count_literal(F.lower(F.coalesce("text", F.lit(""))), q)
    return equal_filters(df, **values).withColumn("score", score)


def scored(df: DataFrame, query: str, limit: int, **values: str | None) -> DataFrame:
    """Rows by their score; rows without hits are left out."""
    return with_score(df, query, **values).where("score > 0").orderBy(F.col("score").desc(), "id").limit(limit)


def random_rows(df: DataFrame, n: int, seed: str = "") -> DataFrame:
    """``n`` rows in the order of a hash of the id: the same ones on every run."""
    return df.orderBy(F.sha2(F.concat(F.lit(seed), F.col("id")), 256), "id").limit(n)


CITATION = re.compile(r"\s*((?:\d\s*)?[A-Za-z]+\.?)\s*(\d+)?(?::(\d+))?\s*$")


def parse_citation(query: str) -> tuple[str, int | None, int | None] | None:
    """(book, chapter, verse) of a query such as "1 Cor 13:4"; None if it is none."""
    m = CITATION.match(query)
    if not m:
        return None
    return re.sub(r"\s+", " ", m[1].strip(". ").lower()), m[2] and int(m[2]), m[3] and int(m[3])


def citations(refs: DataFrame, query: str) -> DataFrame:
    """References to the book (exact name, else the first whose name begins so), chapter and verse; a verse within a range counts."""
    parsed = parse_citation(query)
    if not parsed:
        return refs.limit(0)
    book, chapter, verse = parsed
    # the exact name where there is one, else names that begin so: told apart by one aggregate, in the plan
    named = refs.agg(F.coalesce(F.bool_or(F.lower("book") == book), F.lit(False))).scalar()
    out = refs.withColumn("_named", named).where(F.when(F.col("_named"), F.lower("book") == book).otherwise(F.lower("book").startswith(book))).drop("_named")
    if chapter is not None:
        out = out.where(F.col("chapter") == chapter)
    if verse is not None:
        out = out.where(F.lit(verse).between(F.col("verse_start"), F.coalesce("verse_end", "verse_start")))
    return out.distinct()
