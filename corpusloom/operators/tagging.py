"""Rule-driven labels and scores. Rules are data: lists of (label, patterns) in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def any_pattern(text: Column, patterns: list[str]) -> Column:
    """Whether the lower-cased text matches any pattern: one alternation, one pass."""
    return F.lower(text).rlike("|".join(f"(?:{p})" for p in patterns))


def pattern_hits(text: Column, patterns: list[str]) -> Column:
    """Sum of the matches of each pattern in the lower-cased text."""
    out = F.lit(0)
    for p in patterns:
        out = out + F.regexp_count(F.lower(text), F.lit(p))
    return out


def top_labels(text: Column, rules: list[tuple[str, list[str]]], n: int = 3) -> Column:
    """The n labels with most matches, ties in the order of the rules; labels without matches are left out."""
    if not rules:
        return F.array().cast("array<string>")
    scored = F.array(*(F.struct((-pattern_hits(text, p)).alias("hits"), F.lit(k).alias("k"), F.lit(label).alias("label")) for k, (label, p) in enumerate(rules)))
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda s: s["hits"] < 0)), 1, n), lambda s: s["label"])


def tag_untagged(df: DataFrame, rules: list[tuple[str, list[str]]], n: int = 3) -> DataFrame:
    """Themes of untagged rows from the rules; other rows keep theirs."""
    untagged = F.coalesce(F.size("themes"), F.lit(0)) <= 0
    return df.withColumn("themes", F.when(untagged, top_labels(F.col("text"), rules, n)).otherwise(F.col("themes")))


def flags(text: Column, keywords: list[tuple[str, str]]) -> Column:
    """The names of the keyword patterns that the lower-cased text matches, in their order."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(name)) for name, p in keywords)))


def suggested(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The labels whose rule the text meets, in the order of the rules."""
    return F.array_compact(F.array(*(F.when(any_pattern(text, p), F.lit(label)) for label, p in rules)))


def better_theme(text: Column, suggestions: list[tuple[str, list[str]]], keywords: list[tuple[str, str]], by_keyword: list[tuple[str, str]], default: str) -> Column:
    """The first suggestion, else the theme of the first keyword found, else the default."""
    found = flags(text, keywords)
    choices = [(F.array_contains(found, k), theme) for k, theme in by_keyword]
    return F.coalesce(F.get(suggested(text, suggestions), F.lit(0)), T.first_match(choices, default) if choices else F.lit(default))


def review(df: DataFrame, rules: dict[str, list[str]], fallback: str, suggestions: list[tuple[str, list[str]]] | None = None, keywords: list[tuple[str, str]] | None = None, by_keyword: list[tuple[str, str]] | None = None, titles: list[tuple[str, str, bool]] | None = None, title: str = "source_title") -> DataFrame:
    """Themes whose rule the text doesn't meet removed (themes without a rule stay); a better one if none is left.

    Adds ``issues`` and, beside ``themes``, ``reviewed``. A title rule (word, theme, whether the
    text must meet the theme's rule) reports a theme that the title asks for and the row
    lacks; it changes nothing by itself. Rows without issues keep their themes, null ones too.
    """
    text = F.col("text")
    meets = {t: F.coalesce(any_pattern(text, p), F.lit(False)) for t, p in rules.items()}
    failing = F.array_compact(F.array(*(F.when(~meets[t] & F.coalesce(F.array_contains("themes", t), F.lit(False)), F.lit(t)) for t in sorted(rules))))
    asked = [
        F.when(F.lower(title).contains(word) & ~F.coalesce(F.array_contains("themes", t), F.lit(False)) & (meets[t] if needed else F.lit(True)), F.lit(t)) for word, t, needed in (titles or [])
    ]
    untitled = F.array_compact(F.array(*asked)) if asked else F.array().cast("array<string>")
    out = df.withColumns({"_failing": failing, "_untitled": untitled})
    issues = F.concat(F.transform("_failing", lambda t: F.concat(F.lit("over-tagged: "), t)), F.transform("_untitled", lambda t: F.concat(F.lit("title: "), t)))
    kept = F.filter("themes", lambda t: ~F.coalesce(F.array_contains(F.col("_failing"), t), F.lit(False)))
    better = better_theme(text, suggestions or [], keywords or [], by_keyword or [], fallback)
    out = out.withColumn("issues", issues).withColumn("reviewed", F.when((F.size(kept) == 0) & (F.size("issues") > 0), F.array(better)).otherwise(kept))
    return out.drop("_failing", "_untitled")


def review_deltas(reviewed: DataFrame) -> DataFrame:
    """(theme, removed, added) over all rows."""
    gone = reviewed.select(F.explode(F.array_except("themes", "reviewed")).alias("theme"), F.lit(1).alias("removed"), F.lit(0).alias("added"))
    come = reviewed.select(F.explode(F.array_except("reviewed", "themes")).alias("theme"), F.lit(0).alias("removed"), F.lit(1).alias("added"))
    return gone.unionByName(come).where("theme is not null").groupBy("theme").agg(F.sum("removed").alias("removed"), F.sum("added").alias("added"))


def ladder(x: Column, steps: list[tuple[float, str]], default: str) -> Column:
    """The label of the highest step (threshold, label) that x reaches."""
    return T.first_match([(x >= t, label) for t, label in sorted(steps, reverse=True)], default)
