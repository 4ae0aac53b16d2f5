"""Quotable sentences: split, trimmed of markers, filtered by ordered reasons, scored by an additive rubric, the best of each passage.

Every filter is a Column; the first that holds names why a sentence is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T
from corpusloom.operators import ordered

# Endings that stand alone only where a word was torn, words run together, words of another language.
TORN = ("ing", "tion", "ness", "ment", "ful", "less", "ous", "ive", "able", "ible", "ally", "erly", "ance", "ence", "gation", "dence")
STUCK = ("dayand", "nightand", "allthe", "forthe", "inthe", "ofthe", "tothe", "fromthe", "withthe", "andthe")
FOREIGN = ("quo", "mare", "tellus", "ardeat", "mundi", "moles", "operosa", "laboret", "caeli", "correptaque", "regia")


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether the text matches any of the patterns, whatever the case: one alternation, one pass."""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


# The patterns, limits and weights below; which sentences are left out and how they rank depends on each.


def scan_problems(s: Column) -> list[tuple[Column, str]]:
    """(condition, name) of what shows a sentence to be misread, in order."""
    tokens = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    single = F.size(F.filter(tokens, lambda w: (F.length(w) == 1) & ~w.isin("A", "I", "a")))
    foreign = sum((F.when(F.contains(F.lower(s), F.lit(w)), 1).otherwise(0) for w in FOREIGN), F.lit(0))
    return [
        (s.contains("^"), "caret"),
        ((F.size(tokens) > 3) & (single > 0.2 * F.size(tokens)), "single letters"),
        (s.rlike("(?i)[bcdfghjklmnpqrstvwxyz]{5,}"), "consonants"),
        (s.rlike(r"[\x{370}-\x{3FF}\x{400}-\x{4FF}\x{590}-\x{5FF}]"), "script"),
        (s.rlike(r"[a-z]\d{2,}|\d[A-Z][a-z]"), "digits in words"),
        (s.rlike(r"\s-\w|\w-\s"), "loose hyphen"),
        (s.rlike("[a-z]{2}[A-Z]"), "joined words"),
        (F.exists(tokens, lambda w: F.regexp_replace(w, "[^a-zA-Z]", "").rlike("^[a-z]{15,}$")), "long word"),
        (s.rlike(r"[\"'][^a-zA-Z\s]"), "stray quote"),
        (s.rlike(r"\b\w{2,}\s+(?:" + "|".join(TORN) + r")\b"), "torn word"),
        (s.rlike("(?i)" + "|".join(STUCK)), "stuck words"),
        (s.rlike(r"\bHYMN\s+\d+\b|\bl\.\s*m\.\s*$|\bPage\s+[IVXLC]+\b"), "page matter"),
        (foreign >= 2, "foreign words"),
        (F.regexp_count(s, F.lit("[!?]")) > 3, "marks"),
        (s.rlike(r"\w[)\]]\s*\w\s+\w{1,3}\s+\w"), "bracket in word"),
        (F.regexp_count(s, F.lit(r"\b[A-Z][a-z]?\s+[a-z]\b")) >= 2, "redacted name"),
    ]


def unfit(s: Column, editorial: list[str], shortest: int = 60, longest: int = 240) -> Column:
    """Why a sentence can't be quoted: the first reason that holds, null for none."""
    letters, capitals = F.regexp_count(s, F.lit("[A-Za-z]")), F.regexp_count(s, F.lit("[A-Z]"))
    rules = [
        (s.rlike(r"(?i)^\s*[*+]?\s*\d?\s*[A-Z][a-z]+\.?\s+[ivxlc]+"), "footnote"),
        *([(any_of(s, editorial), "editorial")] if editorial else []),
        *scan_problems(s),
        ((F.length(s) < shortest) | (F.length(s) > longest), "length"),
        ((letters > 0) & (capitals > 0.35 * letters), "capitals"),
        (s.rlike(r"^\d+\s+[A-Z][a-z]+.*\."), "header"),
        (s.rlike(r"(?i)^(?:Your\s+(?:affectionate|obedient|humble)|I\s+am,?\s+(?:dear|with|your))|Your\s+(?:affectionate|obliged|obedient)\s+") | s.rlike(r"MY DEAR\b"), "salutation"),
        (s.rlike("^[a-z]"), "starts lower"),
        (s.rlike(r"^[A-Z][a-z]+'?s?\s+[A-Z][a-z]+,\s+(?:In|At|Near)\s|^To\s+(?:Miss|Mrs|Mr|Dr)\s"), "address"),
        (s.rlike(r"\b(\w{4,})\s+\1\b"), "repeated word"),
        (s.rlike(r"^Alter'?d\s+from\b|From the (?:German|French|Latin)\b|Section\s+[IVX]+\.?\s*$|^Adapted\b"), "attribution"),
    ]
    return T.first_match(rules)


def trimmed(s: Column) -> Column:
    """Section numbers, bracketed marks and loose page numbers taken off a sentence."""
    for pattern, instead in ((r"^\s*(?:\d+\.?\s+|Sect\.\s*[IVXLC]+\.?\s*)", ""), (r"\s+\d+\.\s*$", ""), (r"\s*\(\d+\)\s*", " "), (r"\s+\d+\s+[A-Z][a-z]*\s*!?\s*$", "")):
        s = F.regexp_replace(s, pattern, instead)
    return T.strip(s)


def rubric(s: Column, liked: list[str], harsh: list[str], argued: list[str]) -> Column:
    """The additive score: length, artifacts, ending, numbers, words liked and not, openings and ends that show a cut."""
    has = lambda words: sum((F.when(s.rlike(rf"(?i)\b{w}\b"), 1).otherwise(0) for w in words), F.lit(0))
    when = lambda condition, value: F.when(condition, value).otherwise(0)
    ended = s.rlike(r"[.!\"]$")
    return (
        F.when(F.length(s) >= 120, 30).when(F.length(s) >= 80, 20).otherwise(10)
        - F.round(T.artifact_density(s) * 100, 6)
        + F.when(ended, 10).when(~s.rlike(r"[.!?\"']$"), -15).otherwise(0)
        - 5 * F.regexp_count(s, F.lit(r"\d+"))
        - when(s.rlike(r"\(\w+\s+\d+\)"), 10)
        + 3 * has(liked) - 5 * has(harsh) - 3 * has(argued)
        - when(s.rlike(r"\bDEAR\s+[A-Z]"), 40) - when(s.rlike(r"\bMY\s+DEAR\b"), 40)
        - when(s.rlike(r"^(?:And|But|Or|For|Nor|Yet|So)\b"), 5)
        - when(s.rlike(r"\b(?:in|at|to|of|the|a|an|with|from|Dr|Mr|Mrs|Vol|St)\.*\s*$"), 50)
    )


def candidates(passages: DataFrame, editorial: list[str], words: tuple[list[str], list[str], list[str]], id_col: str = "id", text_col: str = "text", most_artifacts: float = 0.05) -> DataFrame:
    """(id, pos, sentence, score) of the sentences that may be quoted; passages with too many artifacts have none."""
    sound = passages.where(T.artifact_density(F.col(text_col)) <= most_artifacts)
    each = sound.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"(?<=[.!?])\s+(?=[A-Z\"'])")).alias("pos", "s")).select("id", "pos", trimmed(F.col("s")).alias("sentence")).where("sentence <> ''")
    kept = each.where(unfit(F.col("sentence"), editorial).isNull())
    return kept.withColumn("score", rubric(F.col("sentence"), *words).cast("double"))


def best(found: DataFrame) -> DataFrame:
    """The best sentence of each passage; the first of equal ones."""
    return ordered.first_n(found, ["id"], [F.col("score").desc(), F.col("pos")], 1).drop("rank", "pos")


def posts(chosen: DataFrame, author: str = "author", most: int = 280) -> DataFrame:
    """Adds ``post``: the sentence and who said it; longer ones are left out."""
    return chosen.withColumn("post", F.concat("sentence", F.lit("\n\n— "), F.initcap(F.replace(author, F.lit("-"), F.lit(" "))))).where(F.length("post") <= most)


def post_gate(selected: DataFrame, n: int, source: str = "source_id", post: str = "post", most: int = 280) -> DataFrame:
    """(check, detail) of violated conditions: the number of posts, sources used twice, posts that are too long."""
    count = selected.agg(F.count("*").alias("k")).where(F.col("k") != n).select(F.lit("count").alias("check"), F.format_string("%d instead of %d", "k", F.lit(n)).alias("detail"))
    twice = selected.groupBy(source).agg(F.count("*").alias("k")).where("k > 1").select(F.lit("source").alias("check"), F.col(source).alias("detail"))
    long = selected.where(F.length(post) > most).select(F.lit("length").alias("check"), F.col(post).alias("detail"))
    return count.unionByName(twice).unionByName(long)


def by_author(selected: DataFrame, author: str = "author", post: str = "post") -> DataFrame:
    """Posts per author with their shortest and longest length, and the totals of all in ``all``."""
    return selected.groupBy(author).agg(F.count("*").alias("posts"), F.min(F.length(post)).alias("shortest"), F.max(F.length(post)).alias("longest"))


def scheduled(selected: DataFrame, start: str, order: list[Column]) -> DataFrame:
    """One post a day from the day after ``start``; the selection is bounded by its number."""
    return selected.withColumn("day", F.date_add(F.lit(start).cast("date"), F.row_number().over(Window.orderBy(*order))))
