"""Column expressions over text. All stay in the JVM except :func:`nfkc`, which only sees non-ASCII values.

Unless said otherwise a null text gives null. Offsets count code points from 0.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(text: str) -> str:
    """A regular expression that matches exactly ``text`` (in Java's dialect)."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def words(text: Column) -> Column:
    """The non-empty tokens between white space of any kind."""
    return F.filter(F.split(text, r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of white-space tokens; 0 for a null text."""
    return F.when(text.isNull(), 0).otherwise(F.size(words(text)))


def ascii_tokens(text: Column, pattern: str = "[a-z']+") -> Column:
    """Tokens of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))


def cased_tokens(text: Column, pattern: str = "[A-Za-z']+") -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def overlapping_count(text: Column, phrase: str) -> Column:
    """Occurrences of the phrase, overlapping ones included."""
    return F.regexp_count(text, F.lit(f"(?={literal(phrase)})"))


def count_literal(text: Column, phrase: str) -> Column:
    """Occurrences of the phrase that do not overlap."""
    return F.regexp_count(text, F.lit(literal(phrase)))


def phrase_offsets(text: Column, phrase: str) -> Column:
    """Offsets of all occurrences, overlapping ones included; computed only where there is one."""
    n = len(phrase)
    hit = F.filter(F.sequence(F.lit(0), F.length(text) - n), lambda i: F.substring(text, i + 1, F.lit(n)) == phrase)
    return F.when(text.contains(phrase), hit).otherwise(F.array().cast("array<int>"))


def artifact_density(text: Column) -> Column:
    """Share of visible characters that are neither letters, digits nor ordinary punctuation; 1 for an empty text."""
    visible = F.length(F.regexp_replace(text, r"\s", ""))
    odd = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s.,;:!?'\"()\-]", ""))
    return F.when(visible == 0, 1.0).otherwise(odd / visible)


def truncate(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, at the last space if that keeps more than four fifths, with an ellipsis."""
    cut = F.substring(text, 1, limit)
    space = F.length(cut) - F.locate(" ", F.reverse(cut))
    at_space = (F.locate(" ", cut) > 0) & (space > limit * 0.8)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.when(at_space, F.substring(cut, F.lit(1), space)).otherwise(cut), F.lit("...")))


def snippet(text: Column, limit: int) -> Column:
    """White space collapsed, cut at the last space within ``limit``, with an ellipsis if cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.substring(flat, 1, limit)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit("…")))


def context(text: Column, term: str, around: int) -> Column:
    """``around`` characters on both sides of the first match (case ignored), with ellipses where text is left out; null without a match."""
    at = F.locate(term.lower(), F.lower(text)) - 1
    begin, end = F.greatest(at - around, F.lit(0)), F.least(at + len(term) + around, F.length(text))
    body = F.substring(text, begin + 1, end - begin)
    return F.when(at >= 0, F.concat(F.when(begin > 0, "...").otherwise(""), body, F.when(end < F.length(text), "...").otherwise("")))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def highlight(text: Column, terms: list[str]) -> Column:
    """The text escaped for HTML, with each term of two letters or more in <mark>, whatever its case."""
    out = escape_html(text)
    for term in terms:
        if len(term) >= 2:
            out = F.regexp_replace(out, f"(?iu)({literal(term)})", "<mark>$1</mark>")
    return out


def line_breaks(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("<br>\n"))


def strip_html(html: Column, limit: int = 50_000) -> Column:
    """Text of an HTML page: scripts and styles dropped, tags to spaces, white space collapsed, cut."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, limit)


def strip(text: Column) -> Column:
    """White space of any ASCII kind taken off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences_naive(text: Column) -> Column:
    """Split after a stop and white space; empty pieces dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def sentences_before_capital(text: Column) -> Column:
    """Split after a stop and white space where a capital or quotation mark follows."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z\"'“‘])"), strip), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")


def stanzas(text: Column) -> Column:
    """Blocks between blank lines, leading number and stop taken off."""
    return F.transform(paragraphs(text), lambda s: F.regexp_replace(s, r"^\d+\.?\s+", ""))


def light_clean(text: Column) -> Column:
    """Runs of blanks within lines collapsed, line ends trimmed, lines kept."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"(?m)[ \t]+$", "")


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by blanks; none for shorter arrays."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))


def natural_key(text: Column) -> Column:
    """A key that sorts digit runs by value."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(p)), "")


def roman_value(numeral: Column) -> Column:
    """The value of a roman numeral in either case; 0 for other characters."""
    value = lambda c: F.when(c == "i", 1).when(c == "v", 5).when(c == "x", 10).when(c == "l", 50).when(c == "c", 100).when(c == "d", 500).when(c == "m", 1000).otherwise(0)
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    step = lambda acc, c: F.struct(F.when(value(c) < acc["last"], acc["total"] - value(c)).otherwise(acc["total"] + value(c)).alias("total"), F.greatest(acc["last"], value(c)).alias("last"))
    return F.aggregate(F.reverse(F.filter(F.split(F.lower(numeral), ""), lambda c: c != "")), start, step, lambda acc: acc["total"])


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def is_upper(text: Column) -> Column:
    """Has letters and all of them are capitals."""
    return (text == F.upper(text)) & (text != F.lower(text))


def nfkc(text: Column) -> Column:
    """Compatibility-composed text. ASCII values never leave the JVM."""

    @F.pandas_udf("string")
    def normalise(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.when(text.rlike(r"[^\x00-\x7F]"), normalise(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "‘’‚“”„–—", "'''\"\"\"--")


def first_match(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The value of the first rule whose condition holds."""
    return F.coalesce(*(F.when(condition, F.lit(value)) for condition, value in rules), F.lit(default))


def rule_fold(text: Column, rules: list[tuple[str, str]], passes: int = 1) -> Column:
    """Ordered (pattern, replacement) rules applied in turn."""
    for _ in range(passes):
        for pattern, replacement in rules:
            text = F.regexp_replace(text, pattern, replacement)
    return text


def rule_hits(text: Column, rules: list[tuple[str, str]]) -> Column:
    """How often each rule of :func:`rule_fold` applies, counted before its own step."""
    out = []
    for pattern, replacement in rules:
        out.append(F.regexp_count(text, F.lit(pattern)))
        text = F.regexp_replace(text, pattern, replacement)
    return F.array(*out)


def keep_lines(text: Column, drop) -> Column:
    """The text without the lines for which ``drop`` (a function of the line) holds."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.coalesce(drop(line), F.lit(False))), "\n")


def clean_page_text(text: Column, normalise: bool = True) -> Column:
    """Ingest cleaning: NFKC, straight quotes, page-number and capital header lines dropped, hyphenated ends joined, white space tidied."""
    out = straight_quotes(nfkc(text) if normalise else text)
    out = keep_lines(out, lambda line: F.trim(line).rlike(r"^[\[\(\-\s]*\d{1,4}[\]\)\-\s]*$") | ((F.length(F.trim(line)) < 60) & is_upper(F.trim(line))))
    out = F.regexp_replace(out, r"(\w)-\n(\w)", "$1$2")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def fix_words(text: Column, fixes: dict[str, str]) -> Column:
    """Whole words ([A-Za-z']+) replaced by a table in one pass, whatever its size."""
    if not fixes:
        return text
    table = F.create_map(*(F.lit(x) for pair in sorted(fixes.items()) for x in pair))
    parts = F.regexp_extract_all(text, F.lit("([A-Za-z']+|[^A-Za-z']+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(table, w), w)), "")


def clean_scan_text(text: Column, fixes: dict[str, str], metadata: str | None = None, normalise: bool = True) -> Column:
    """Second-stage cleaning of scanned text, to one line.

    In order: long s and compatibility forms, straight quotes; lines of noise (no letters),
    of metadata (``metadata``), page marks and shreds without vowels dropped, the others
    joined; stray symbols, double dashes, day markers and page references taken out;
    whole-word fixes in one pass; white space collapsed.
    """
    out = F.replace(text, F.lit("ſ"), F.lit("s"))
    out = straight_quotes(nfkc(out) if normalise else out)

    def noise(line: Column) -> Column:
        s = F.trim(line)
        bad = s.rlike(r"^[^A-Za-z]*$") | s.rlike(r"^(?:[A-Z]\s*\d+|\[\d+\]|\d{1,3})$") | ((F.length(s) < 5) & ~s.rlike("[aeiouAEIOU]"))
        return bad | s.rlike(metadata) if metadata else bad

    out = F.array_join(F.transform(F.filter(F.split(out, "\n"), lambda x: ~noise(x)), lambda x: F.trim(x)), " ")
    out = F.regexp_replace(out, r"[|*#@&$%{}\[\]<>^~\\]", "")
    out = F.regexp_replace(out, r"\s*--\s*", " ")
    out = F.regexp_replace(out, r"\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.\s*\d+\.?", "")
    out = F.regexp_replace(out, r"\((?:[Pp]age|p\.)\s*\d+\.?\)", "")
    return F.trim(F.regexp_replace(fix_words(out, fixes), r"\s+", " "))


def clean_garbles(text: Column, header: str, beside: list[str], fixes: dict[str, str], rules: list[tuple[str, str]]) -> Column:
    """Repairs of one scan: running-header lines (``header`` and at least one of ``beside`` in the line) dropped, word fixes, rules in order.

    A quoted salutation looks like a header but has nothing beside it, and stays.
    """
    out = keep_lines(text, lambda line: line.rlike(f"(?i){header}") & line.rlike("|".join(f"(?:{p})" for p in beside)))
    return rule_fold(fix_words(out, fixes), rules)


def clean_boilerplate(text: Column, blocks: list[str]) -> Column:
    """Producer's blocks and lines (patterns over many lines), page-number lines and long runs of blank lines taken out."""
    for p in blocks:
        text = F.regexp_replace(text, f"(?ms){p}", "")
    text = F.regexp_replace(text, r"(?m)^\d{1,3}[ \t]*$", "")
    return strip(F.regexp_replace(text, r"\n{4,}", "\n\n\n"))


def formatted_id(prefix: str, number: Column, width: int, overrides: dict[int, str] | None = None) -> Column:
    """``prefix`` and the number with leading zeros, but for numbers with an id of their own; null for null."""
    own = F.try_element_at(F.create_map(*(F.lit(x) for pair in sorted(overrides.items()) for x in pair)), number) if overrides else F.lit(None).cast("string")
    return F.coalesce(own, F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0")))


def display_name(key: Column, names: dict[str, str]) -> Column:
    """The name to show for a key; for keys without one the key's words with capitals."""
    table = F.create_map(*(F.lit(x) for pair in sorted(names.items()) for x in pair))
    return F.coalesce(F.try_element_at(table, key), F.initcap(F.regexp_replace(key, "[-_]+", " ")))
