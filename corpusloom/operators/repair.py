"""Word repair over a vocabulary: substitution candidates, regular inflections, wording similarity.

All of it works on distinct words, never on running text, so its cost follows the
vocabulary and not the corpus.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.functions import text as T

#: Endings, what stands in their place in the base form, the least length of the word, whether a doubled consonant is undone and an i before them is a y.
ENDINGS = (
    ("ies", "y", 5, False, False), ("es", "", 4, False, False), ("es", "e", 4, False, False), ("s", "", 3, False, False),
    ("ed", "", 4, True, True), ("ed", "e", 4, False, False), ("ing", "", 5, True, False), ("ing", "e", 5, False, False),
    ("est", "", 6, True, True), ("est", "e", 6, False, False), ("er", "", 5, True, True), ("er", "e", 5, False, False),
    ("ily", "y", 5, False, False), ("ly", "", 5, False, False),
)


def stems(word: Column) -> Column:
    """What the word may be a regular inflection of: each ending taken off or replaced, doubled consonants single, i before the ending back to y."""
    out = []
    for ending, instead, least, single, i_to_y in ENDINGS:
        base = F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(instead))
        fits = word.endswith(ending) & (F.length(word) >= least)
        if ending == "s":
            fits = fits & ~word.endswith("ss")
        if ending == "ly":
            fits = fits & ~word.endswith("ily")
        out.append(F.when(fits, base))
        if single:
            out.append(F.when(fits & base.rlike(r"([^aeiou])\1$"), F.substring(base, F.lit(1), F.length(base) - 1)))
        if i_to_y:
            out.append(F.when(fits & base.rlike(r".i$"), F.concat(F.substring(base, F.lit(1), F.length(base) - 1), F.lit("y"))))
    return F.array_except(F.array_compact(F.array(*out)), F.array(word))


def regular_inflections(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, stem) of words not in the dictionary whose stem is: an equi-join on the stems."""
    known = dictionary.select(F.lower("word").alias("stem")).where("stem is not null").distinct()
    w = words.select(F.lower("word").alias("word")).where("word is not null").distinct()
    unknown = w.join(known.withColumnRenamed("stem", "word"), "word", "left_anti")
    return unknown.select("word", F.explode(stems(F.col("word"))).alias("stem")).join(known, "stem").groupBy("word").agg(F.min("stem").alias("stem"))


def elided(word: Column) -> Column:
    """What a word with one inner apostrophe may stand for: the apostrophe dropped or a vowel in its place (heav'n, promis'd); empty for others."""
    inner = word.rlike("^[^']+'[^']+$")
    forms = F.array(*(F.replace(word, F.lit("'"), F.lit(v)) for v in ("", "a", "e", "i", "o", "u")))
    return F.when(inner, forms).otherwise(F.array().cast("array<string>"))


def explained(words: DataFrame, known: DataFrame, column: str = "w") -> DataFrame:
    """The distinct words that are known, regular inflections of known words, elisions of either, or single letters: equi-joins on what they may stand for."""
    w = words.select(column).distinct()
    full = F.concat(F.array(F.col(column)), elided(F.col(column)))
    bases = F.array_distinct(F.concat(full, F.flatten(F.transform(full, stems))))
    meant = w.select(column, F.explode(bases).alias("_base"))
    by_base = meant.join(known.select(F.col("w").alias("_base")).distinct(), "_base", "left_semi").select(column)
    return by_base.unionByName(w.where(F.length(column) <= 1)).distinct()


def substitutions(words: DataFrame, dictionary: DataFrame, seen: str = "f", meant: str = "s") -> DataFrame:
    """(garble, fix, n, ambiguous): unknown words (word, n) that one or two substitutions turn into dictionary words.

    The candidates are each single place and all places at once; ``ambiguous`` if several
    are words, of which the first in order is given.
    """
    known = dictionary.select(F.lower("word").alias("fix")).where("fix is not null").distinct()
    w = words.select(F.lower("word").alias("garble"), "n").where(F.col("garble").contains(seen)).groupBy("garble").agg(F.sum("n").alias("n"))
    unknown = w.join(known.withColumnRenamed("fix", "garble"), "garble", "left_anti")
    places = F.filter(F.sequence(F.lit(1), F.length("garble")), lambda i: F.substring(F.col("garble"), i, F.lit(len(seen))) == seen)
    each = F.transform(places, lambda i: F.overlay(F.col("garble"), F.lit(meant), i, F.lit(len(seen))))
    every = F.array(F.replace("garble", F.lit(seen), F.lit(meant)))
    tried = unknown.select("garble", "n", F.explode(F.array_distinct(F.concat(each, every))).alias("fix"))
    return tried.join(known, "fix").groupBy("garble").agg(F.min("fix").alias("fix"), F.first("n").alias("n"), (F.count("*") > 1).alias("ambiguous"))


_NOT_WORDS = re.compile(r"[^a-z0-9]+")


def nearest_wording(text: str, quote: str) -> float:
    """The similarity (share of matching characters) of the quote with the nearest stretch of the text; 1 if the text holds it.

    Only letters and digits count, whatever the case. The nearest stretch is that of the
    quote's number of words whose words match it best in order, the first of equal ones: every
    word may begin it, and how many words it shares in any order bounds how well it can
    match, so that most are passed over. It is compared by characters.
    """
    a, b = _NOT_WORDS.sub(" ", quote.lower()).strip(), _NOT_WORDS.sub(" ", text.lower()).strip()
    if not a or not b:
        return 0.0
    if a in b:
        return 1.0
    wanted, words = a.split(), b.split()
    n, left, shared, bounds = len(wanted), Counter(wanted), 0, []
    for k, w in enumerate(words):
        shared += left[w] > 0
        left[w] -= 1
        if k >= n:
            left[words[k - n]] += 1
            shared -= left[words[k - n]] > 0
        if k >= n - 1:
            bounds.append((-shared, k - n + 1))
    best, at = 0.0, 0
    matcher = difflib.SequenceMatcher(None, autojunk=False)
    matcher.set_seq2(wanted)
    for shared, k in sorted(bounds):
        window = words[k : k + n]
        if -2.0 * shared / (n + len(window)) <= best:
            break
        matcher.set_seq1(window)
        if matcher.ratio() > best:
            best, at = matcher.ratio(), k
    return difflib.SequenceMatcher(None, " ".join(words[at : at + n]), a, autojunk=False).ratio()


def wording(pairs: DataFrame) -> DataFrame:
    """Candidate pairs (text, quote, ...) with ``similarity``; only for candidates found by a join."""
    session.ship(pairs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series, quotes: pd.Series) -> pd.Series:
        return pd.Series([nearest_wording(t or "", q or "") for t, q in zip(texts, quotes)])

    return pairs.withColumn("similarity", score("text", "quote"))


def letters_with_offsets(text: str) -> tuple[str, list[int]]:
    """The letters of a text in lower case, and where each stands in it."""
    at = [k for k, c in enumerate(text) if c.isalpha()]
    return "".join(text[k].lower() for k in at), at


def locate_loosely(text: str, wanted: str) -> int:
    """Where ``wanted`` begins in the text if only letters count; -1 if nowhere."""
    letters, at = letters_with_offsets(text)
    k = letters.find(letters_with_offsets(wanted)[0])
    return at[k] if k >= 0 and at else -1


def located(df: DataFrame, text: str, wanted: str, name: str = "offset") -> DataFrame:
    """Adds the offset at which ``wanted`` begins by its letters alone."""
    session.ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[name] = pd.array([locate_loosely(t or "", w) if w else -1 for t, w in zip(pdf[text], pdf[wanted])], "Int32")
            yield pdf

    return df.mapInPandas(run, df.withColumn(name, F.lit(0)).schema)


def rejoined(text: Column) -> Column:
    """Words cut over line ends joined, in the JVM: a letter, a mark, a line end, a small letter."""
    return F.regexp_replace(text, r"(\p{L})[-¬\x{ad}]\n\s*(\p{Ll})", "$1$2")


def tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of the lower-case tokens of all texts."""
    return df.where(F.col(text).isNotNull()).select(F.explode(T.ascii_tokens(F.col(text), "[a-z]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
