"""Affinity scores: rule sets counted over a text, densities and counts saturated, blended, reduced by counter-markers.

Rule sets are data. Phrases are counted wherever they begin (overlapping ones included),
patterns without overlap, both in the lower-cased text. All expressions stay in the JVM; the phrases
of a set are met in one pass of one alternation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import citations, joins


@dataclass(frozen=True)
class RuleSet:
    """A dimension: phrases and patterns, what a phrase counts, the density and count at which it is saturated."""

    name: str
    phrases: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    phrase_weight: int = 3
    max_density: float = 15.0
    max_count: float = 30.0


@dataclass(frozen=True)
class Counter(RuleSet):
    """Markers that speak against; each refutation takes three of their hits away."""

    # fixed values: least hits and penalty of each step
    refutations: tuple[str, ...] = ()
    ladder: tuple[tuple[int, int], ...] = ((1, 5), (3, 10), (6, 15), (11, 20), (21, 25))


@dataclass(frozen=True)
class Scale:
    """What a score is made of: theology-like dimensions (best plus breadth), scripture, language, the counter set."""

    dimensions: tuple[RuleSet, ...]
    allusions: tuple[str, ...]
    curated: tuple[str, ...]
    terms: tuple[str, ...]
    counter: Counter
    labels: tuple[tuple[int, str], ...]
    rhetoric: tuple[str, ...] = ()
    names: tuple[str, ...] = field(default=("scripture", "vocabulary"))

    def scored(self) -> list[str]:
        return [d.name for d in self.dimensions] + list(self.names)


def phrase_hits(low: Column, phrases: tuple[str, ...]) -> Column:
    """Places where a phrase begins, summed over the phrases. Phrases of which one begins another are counted in separate passes."""
    passes: list[list[str]] = []
    for p in sorted(set(phrases), key=lambda x: (len(x), x)):
        group = next((g for g in passes if not any(p.startswith(q) for q in g)), None)
        if group is None:
            passes.append([p])
        else:
            group.append(p)
    out = F.lit(0)
    for group in passes:
        out = out + F.regexp_count(low, F.lit("(?=" + "|".join(map(T.literal, group)) + ")"))
    return out


def pattern_hits(low: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + F.regexp_count(low, F.lit(p))
    return out


def per_hundred(raw: Column, words: Column) -> Column:
    """Hits per 100 words; a shorter text counts as one of 100."""
    return raw / F.greatest(words / 100.0, F.lit(1.0))


def clamped(raw: Column, words: Column, max_density: float, max_count: float = 30.0) -> Column:
    """0 to 100: the better of saturated density and saturated count, cut to a whole number."""
    curve = lambda x, most: 100 * (1 - F.exp(-3 * F.least(x / most, F.lit(1.0))))
    best = F.greatest(curve(per_hundred(raw, words), max_density), curve(raw.cast("double"), max_count))
    return F.when(raw.isNotNull(), F.least(F.round(best, 9).cast("int"), F.lit(100)))  # a whole number must not fall to the one below


def reference_pattern() -> str:
    """A book by any of its names, a number, perhaps verses."""
    names = sorted({a.lstrip("123") for a in citations.aliases()}, key=lambda a: (-len(a), a))
    return r"\b(?:(?:1|2|3)\s+)?(?:" + "|".join(names) + r")\.?\s*\d+(?::\d+(?:\s*[-,]\s*\d+)*)?"


def reference_count(low: Column) -> Column:
    """Matches of :func:`reference_pattern` in a lower-cased text: the words before numbers that name a book, looked up and not tried one by one."""
    names = sorted({a.lstrip("123") for a in citations.aliases()})
    return F.size(F.filter(F.regexp_extract_all(low, F.lit(r"\b([a-z]+)\.?\s*\d"), F.lit(1)), lambda w: w.isin(names)))


def with_scores(df: DataFrame, scale: Scale, text: str = "text") -> DataFrame:
    """Adds the score of every dimension, counter hits, density and penalty, the overall score, its label and the number of words.

    A null text has null scores.
    """
    # each layer is a projection of its own: what is dear is computed once and then referred to
    out = df.withColumns({"words": T.word_count(F.col(text)), "_low": F.lower(F.col(text))})
    words, low = F.col("words"), F.col("_low")
    raw = {}
    for d in scale.dimensions:
        raw[d.name] = (phrase_hits(low, d.phrases) * d.phrase_weight + pattern_hits(low, d.patterns), d.max_density, d.max_count)
    raw[scale.names[0]] = (reference_count(low) * 2 + pattern_hits(low, scale.allusions), 12.0, 30.0)
    terms = F.lit(0)
    for t in scale.terms[:100]:
        terms = terms + T.count_literal(low, t)
    raw[scale.names[1]] = (phrase_hits(low, scale.curated) * 2 + terms, 25.0, 30.0)
    c = scale.counter
    known = F.col(text).isNotNull()
    against = F.greatest(F.lit(0), phrase_hits(low, c.phrases) * 3 + pattern_hits(low, c.patterns) - 3 * pattern_hits(low, c.refutations))
    out = out.withColumns({f"_raw_{name}": r for name, (r, _, _) in raw.items()} | {"_against": against})
    out = out.withColumns({name: clamped(F.col(f"_raw_{name}"), words, density, count) for name, (_, density, count) in raw.items()} | {"counter": F.when(known, F.col("_against"))})
    out = out.drop("_low", "_against", *(f"_raw_{name}" for name in raw))
    out = out.withColumns({"counter_density": F.bround(per_hundred(F.col("counter"), F.greatest(words, F.lit(1))), 2), "penalty": F.when(known, step(F.col("counter"), c.ladder))})
    theology = theology_score([F.col(d.name) for d in scale.dimensions])
    blend = F.round(theology * 0.60 + F.col(scale.names[0]) * 0.20 + F.col(scale.names[1]) * 0.20, 9).cast("int")
    applied = F.when(theology >= 60, F.least(F.col("penalty"), F.lit(5))).when(theology >= 40, F.least(F.col("penalty"), F.lit(10))).otherwise(F.col("penalty"))
    out = out.withColumn("penalty_applied", F.when(known, applied)).withColumn("overall", F.when(known, F.greatest(F.lit(0), F.least(F.lit(100), blend - F.col("penalty_applied")))))
    return out.withColumn("label", F.when(known, T.first_match([(F.col("overall") >= t, x) for t, x in sorted(scale.labels, reverse=True)], scale.labels[0][1])))


def theology_score(scores: list[Column]) -> Column:
    """The best dimension and five for each that reaches 15 (twenty at most), up to 100."""
    breadth = sum((F.when(s >= 15, 1).otherwise(0) for s in scores), F.lit(0))
    return F.least(F.lit(100), F.greatest(*scores) + F.least(breadth * 5, F.lit(20)))


def step(count: Column, ladder: tuple[tuple[int, int], ...]) -> Column:
    """The value of the highest step (least count, value) reached; 0 below the first."""
    out = F.lit(0)
    for least, value in sorted(ladder):
        out = F.when(count >= least, value).otherwise(out)
    return out


def rhetoric_score(text: Column, words: Column, patterns: tuple[str, ...]) -> Column:
    """Devices of speech (patterns whatever the case) and questions, which count twice."""
    questions = F.regexp_count(text, F.lit(r"[A-Z][^.!?]*\?"))
    return clamped(pattern_hits(F.lower(text), patterns) + F.regexp_count(text, F.lit(r"[A-Z][^.!?]*\?\s")) + questions * 2, words, 12.0)


def summary(scale: Scale) -> Column:
    """Score and label, up to three dimensions of 50 or more, up to two below 20, the penalty; over :func:`with_scores`."""
    ranked = F.array_sort(F.array(*(F.struct((-F.col(n)).alias("s"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate(scale.scored()))))
    strong = F.filter(ranked, lambda r: r["s"] <= -50)
    weak = F.filter(ranked, lambda r: r["s"] > -20)
    names = lambda a, n: F.array_join(F.transform(F.slice(a, 1, n), lambda r: r["n"]), ", ")
    parts = [
        F.concat(F.lit("This text scores "), F.col("overall").cast("string"), F.lit("/100 ("), F.col("label"), F.lit(").")),
        F.when(F.size(strong) > 0, F.concat(F.lit("It shows strongest affinity in "), names(strong, 3), F.lit("."))),
        F.when((F.size(strong) > 0) & (F.size(weak) > 0) & (F.size(weak) < len(scale.scored())), F.concat(F.lit("It lacks emphasis on "), names(weak, 2), F.lit("."))),
        F.when(F.col("penalty_applied") > 0, F.concat(F.lit("Score reduced by "), F.col("penalty_applied").cast("string"), F.lit(" points for counter-markers ("), F.col("counter").cast("string"), F.lit(" found)."))),
    ]
    return F.concat_ws(" ", *parts)


def advisory(words: Column, least: int = 200) -> Column:
    """A note on texts too short to be scored well; null for others."""
    return F.when(words < least, F.concat(F.lit("This text is only "), words.cast("string"), F.lit(f" words; at least {least} are advised.")))


def top_markers(scale: Scale, text: Column, most: int = 20) -> Column:
    """What was found, dimension by dimension: phrases, then the first ten matches of patterns; the first of equal ones, ``most`` at most."""
    low = F.lower(text)
    found = []
    for d in scale.dimensions:
        found.append(F.filter(F.array(*(F.lit(p) for p in d.phrases)), lambda p: low.contains(p)))
        matched = F.concat(*(F.regexp_extract_all(low, F.lit(f"({p})"), F.lit(1)) for p in d.patterns)) if d.patterns else F.array().cast("array<string>")
        found.append(F.slice(matched, 1, 10))
    return F.slice(F.array_distinct(F.concat(*found)), 1, most)


def dispatched(texts: DataFrame, cache: DataFrame, scale: Scale, version: str, key: str = "id", text: str = "text") -> DataFrame:
    """(key, overall, engine): the cached score of a text (by a digest of version and text), else the score by rules.

    Of several cached results of a digest the latest by ``created_at`` counts.
    """
    digest = cache_key(F.col(text), version)
    last = joins.latest_per_key(cache, ["cache_key"], [F.col("created_at").desc_nulls_last(), F.col("overall").desc()]).select("cache_key", F.col("overall").alias("_cached"))
    keyed = texts.select(key, text, digest.alias("cache_key")).join(last, "cache_key", "left")
    hit = keyed.where("_cached is not null").select(key, F.col("_cached").cast("int").alias("overall"), F.lit("cache").alias("engine"))
    miss = with_scores(keyed.where("_cached is null").select(key, text), scale, text).select(key, "overall", F.lit("rules").alias("engine"))
    return hit.unionByName(miss)


def cache_key(text: Column, version: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{version}:"), F.coalesce(text, F.lit(""))), 256)


def compared(texts: DataFrame, scale: Scale, group: str, label: str, text: str = "text") -> DataFrame:
    """Each text of a group of two to five with its score, its place (ties by label) and the distance to the best.

    Groups of other sizes, and texts that are blank or longer than 50,000 characters, are no valid request and are left out.
    """
    from pyspark.sql.window import Window

    n = F.count("*").over(Window.partitionBy(group))
    asked = texts.withColumn("_ok", valid_request(F.col(text))).withColumn("_n", n).withColumn("_bad", F.count_if(~F.col("_ok")).over(Window.partitionBy(group)))
    good = with_scores(asked.where("_n between 2 and 5 and _bad = 0").select(group, label, text), scale, text)
    w = Window.partitionBy(group).orderBy(F.col("overall").desc(), label)
    best = F.max("overall").over(Window.partitionBy(group))
    return good.select(group, label, "overall", "label", F.row_number().over(w).alias("place"), (best - F.col("overall")).alias("behind"))


def valid_request(text: Column, most: int = 50_000) -> Column:
    """A text that may be scored: neither null nor blank nor longer than ``most``."""
    return F.coalesce((F.trim(F.regexp_replace(text, r"\s+", " ")) != "") & (F.length(text) <= most), F.lit(False))


def stance(low: Column, counter: tuple[str, ...]) -> Column:
    """How a text stands to a counter-indicator: the number of its marks as text, 9 at most."""
    return F.least(pattern_hits(low, counter), F.lit(9)).cast("string")


def golden_check(scored: DataFrame, expected: str = "expected_counter", stances: str = "stances") -> DataFrame:
    """Adds ``reasons`` and ``passed`` to scored items: overall outside [expected_min, expected_max], stances other than expected.

    Null bounds and a null map ask nothing.
    """
    low, high = F.col("expected_min"), F.col("expected_max")
    outside = F.coalesce((F.col("overall") < low) | (F.col("overall") > high), F.lit(False))
    range_reason = F.when(outside, F.format_string("score %d outside [%d, %d]", "overall", low, high))
    wrong = F.map_filter(F.coalesce(expected, F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.try_element_at(F.col(stances), k).eqNullSafe(v), F.lit(False)))
    stance_reasons = F.transform(F.array_sort(F.map_entries(wrong)), lambda e: F.concat(e["key"], F.lit(": expected "), F.coalesce(e["value"], F.lit("none")), F.lit(", found "), F.coalesce(F.try_element_at(F.col(stances), e["key"]), F.lit("none"))))
    reasons = F.concat(F.array_compact(F.array(range_reason)), stance_reasons)
    return scored.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def fixture_check(scored: DataFrame, fixtures: DataFrame, scale: Scale) -> DataFrame:
    """(id, status, failures): scored texts against fixtures (id, low, high, dims, penalised, label); nulls ask nothing.

    ``dims`` maps a dimension to its bounds (low, high). A fixture without text is a SKIP.
    """
    joined = fixtures.withColumnRenamed("label", "_label").join(scored, "id", "left")
    checks = [
        F.when((F.col("overall") < F.col("low")) | (F.col("overall") > F.col("high")), F.format_string("overall %d not in [%d, %d]", "overall", "low", "high")),
        *(
            F.when((F.col(n) < F.col("dims")[n]["low"]) | (F.col(n) > F.col("dims")[n]["high"]), F.format_string(f"{n} %d not in [%d, %d]", n, F.col("dims")[n]["low"], F.col("dims")[n]["high"]))
            for n in scale.scored()
        ),
        F.when(F.col("penalised") & (F.col("penalty_applied") == 0), "expected a penalty but none applied").when(~F.col("penalised") & (F.col("penalty_applied") > 0), "unexpected penalty applied"),
        F.when(F.col("_label") != F.col("label"), F.concat(F.lit("label "), F.col("label"), F.lit(" is not "), F.col("_label"))),
    ]
    failures = F.array_compact(F.array(*checks))
    return joined.select("id", F.when(F.col("overall").isNull(), "SKIP").when(F.size(failures) == 0, "PASS").otherwise("FAIL").alias("status"), F.array_join(failures, "; ").alias("failures"))


def located(quotes: DataFrame, texts: DataFrame, key: str, quote: str = "quote", text: str = "text") -> DataFrame:
    """Quotes with the offset at which they begin in their text, whatever the case; quotes that aren't there are dropped."""
    at = F.position(F.lower(F.col(quote)), F.lower(F.col(text)))
    found = quotes.where(F.trim(quote) != "").join(texts.select(key, text), key).withColumn("offset", at - 1).where("offset >= 0")
    return found.drop(text)
