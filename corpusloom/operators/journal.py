"""Dated diaries: entry heads, their dates by a constrained walk, entries as passages.

A head states a weekday and a day, sometimes a month and a year. Which date it means
depends on the heads before it, so the walk is one Python pass over a document; all
that follows (slices, order, numbers, suffixes) is relational.
"""

from __future__ import annotations

import re
import statistics
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom import session
from corpusloom.operators import repair, segment

# How entry heads, extract headers and openings are written.
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
MONTH_NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_DAY = r"(?:Sun|Mon|Tues|Tue|Wednes|Wed|Thurs|Thur|Thu|Fri|Satur|Sat)(?:day)?"
_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)"
_YEAR = r"1[67]\d\d"
#: Groups: page tag's year; year, month, day, weekday of the form "1752. March 15, Sun"; weekday, month, day, year of "Sun. March 15, 1752".
HEAD = (
    rf"(?i)(?:\[Journal,\s*({_YEAR})\]\s*)?(?:(?:({_YEAR})\.[ \t]*\n?[ \t]*)?({_MONTH})\b\.?,?\s*(\d{{1,2}}),?\s*({_DAY})\b"
    rf"|\b({_DAY})\b\.?,?\s*(?:({_MONTH})\b\.?,?\s*)?(\d{{1,2}})(?:st|nd|rd|th)?\s*(?:,\s*({_YEAR}))?)\s*(?:\.\s*-{{1,2}}|\.\s|,\s*-{{1,2}}|-)"
)
_HEAD = re.compile(HEAD)
#: The header of an extract: "FROM May 1, 1738, TO June 3, 1739".
_RANGE = re.compile(rf"FROM\s+({_MONTH})\w*\.?\s*\d{{1,2}},?\s*({_YEAR})\s*,?\s*TO\s+{_MONTH}\w*\.?\s*\d{{1,2}},?\s*{_YEAR}", re.I)
_OPENING = re.compile(rf"^({_MONTH})\.?\s+({_YEAR}),", re.I | re.M)
_ANY_YEAR = re.compile(rf"\b({_YEAR})\b")


def _month(name: str) -> int:
    return MONTH_NAMES.index(name[:3].lower()) + 1


def heads(text: str) -> list[dict]:
    """offset, weekday (0 for Monday), day, month, year, snippet of every entry head; a year stated in the head outranks the page tag's."""
    out = []
    for m in _HEAD.finditer(text):
        tag, y1, m1, d1, w1, w2, m2, d2, y2 = m.groups()
        day, weekday, month = int(d1 or d2), (w1 or w2)[:3].lower(), m1 or m2
        year = y1 or y2 or tag
        if 1 <= day <= 31:
            out.append({"offset": m.start(), "weekday": WEEKDAYS.index(weekday), "day": day, "month": month and _month(month), "year": year and int(year), "snippet": text[m.start() : m.start() + 64].replace("\n", " ")})
    return out


def _next_month(y: int, m: int, by: int) -> tuple[int, int]:
    k = y * 12 + m - 1 + by
    return k // 12, k % 12 + 1


def _candidates(h: dict, y: int | None, m: int | None, seed_year: int | None, last_day: int | None) -> list[tuple[int, int]]:
    """(year, month) a head may mean, likeliest first, from what it states and where the walk stands."""
    hy, hm, day = h["year"], h["month"], h["day"]
    if hy and hm:
        return [(hy, hm)]
    if hy:
        # a year by itself confirms little: go on from the running month before searching the year and the one after
        on = [_next_month(y if y is not None else hy, m, k) for k in range(4)] if m is not None else []
        return on + [(hy + k, mm) for k in (0, 1) for mm in range(1, 13)]
    if hm:
        base = y if y is not None else seed_year
        if base is None:
            return []
        return [(base if m is None or hm >= m else base + 1, hm), (base + 1, hm), (base, hm)]
    if y is None or m is None:
        return []
    here, then = (y, m), _next_month(y, m, 1)
    order = [here, then] if last_day is None or day > last_day else [then, here]
    return order + [_next_month(y, m, k) for k in (2, 3)]


def walk(found: list[dict], year: int | None, month: int | None, bounds: tuple[int, int] | None = None, span: tuple[tuple[int, int, int], tuple[int, int, int]] | None = None) -> list[dict]:
    """The heads with date, resolved_y, resolved_m and status: ok, out-of-range (beyond ``span``) or unresolved.

    A candidate must lie within the bounds (years), exist, fall on the stated weekday and,
    unless fully stated, follow the last date by 400 days at most. The state moves only
    with a head that is resolved, so one bad head derails nothing.
    """
    y, m, last, last_day, out = year, month, None, None, []
    for h in found:
        fit = None
        for cy, cm in _candidates(h, y, m, year, last_day):
            if bounds and not bounds[0] <= cy <= bounds[1]:
                continue
            if h["day"] > segment._month_days(cy, cm) or segment._day_number(cy, cm, h["day"]) % 7 != h["weekday"]:
                continue
            if not (h["year"] and h["month"]) and last is not None and not 0 <= segment._day_number(cy, cm, h["day"]) - last <= 400:
                continue
            fit = cy, cm
            break
        if fit is None:
            out.append({**h, "date": None, "resolved_y": None, "resolved_m": None, "status": "unresolved"})
            continue
        y, m = fit
        last, last_day = segment._day_number(y, m, h["day"]), h["day"]
        outside = span is not None and not span[0] <= (y, m, h["day"]) <= span[1]
        out.append({**h, "date": f"{y:04d}-{m:02d}-{h['day']:02d}", "resolved_y": y, "resolved_m": m, "status": "out-of-range" if outside else "ok"})
    return out


def checkpoints(raw: str, cleaned: str, window: int = 12_000) -> list[tuple[int, int, int]]:
    """(offset in the cleaned text, year, month) of each extract whose header stands in the raw text.

    Headers are lost in cleaning: the words after an extract's first head are looked up in
    the cleaned text by their letters alone, each after the one before. Without such
    headers, lines that open with a month and a year serve.
    """
    raw = raw.replace("—", "--").replace("–", "-")
    letters, at = repair.letters_with_offsets(cleaned)
    out: list[tuple[int, int, int]] = []
    begin = 0

    def anchored(end: int, y: int, m: int) -> None:
        nonlocal begin
        head = _HEAD.search(raw, end, end + window)
        wanted = repair.letters_with_offsets(raw[head.end() : head.end() + 40])[0][:26] if head else ""
        k = letters.find(wanted, begin) if wanted else -1
        if k >= 0:
            begin = k
            out.append((at[k], y, m))

    seen = set()
    for h in _RANGE.finditer(raw):
        # a range quoted in running prose is no header, nor is one printed again
        if h[0].lower() not in seen and "\n" in raw[max(0, h.start() - 30) : h.start()]:
            seen.add(h[0].lower())
            anchored(h.end(), int(h[2]), _month(h[1]))
    if not out:
        for h in _OPENING.finditer(raw):
            anchored(h.end(), int(h[2]), _month(h[1]))
    return out


def rescue(rows: list[dict], text: str, back: int = 4000) -> None:
    """Unresolved heads without a year get the last year named in the ``back`` characters before them, and its first month that fits."""
    for r in rows:
        if r["status"] != "unresolved" or r["year"]:
            continue
        years = _ANY_YEAR.findall(text, max(0, r["offset"] - back), r["offset"])
        if not years:
            continue
        y = int(years[-1])
        for m in [r["month"]] if r["month"] else range(1, 13):
            if r["day"] <= segment._month_days(y, m) and segment._day_number(y, m, r["day"]) % 7 == r["weekday"]:
                r.update(date=f"{y:04d}-{m:02d}-{r['day']:02d}", resolved_y=y, resolved_m=m, status="rescued")
                break


def demote(rows: list[dict], around: int = 15, tolerance: int = 3, passes: int = 4) -> None:
    """Dates more than ``tolerance`` years from the median of their dated neighbours become unresolved, until none does."""
    for _ in range(passes):
        dated = [r for r in rows if r["status"] in ("ok", "rescued")]
        bad = []
        for i, r in enumerate(dated):
            near = [x["resolved_y"] for j, x in enumerate(dated[max(0, i - around) : i + around + 1], max(0, i - around)) if j != i]
            if len(near) >= 3 and abs(r["resolved_y"] - statistics.median(near)) > tolerance:
                bad.append(r)
        if not bad:
            return
        for r in bad:
            r.update(status="unresolved", date=None, resolved_y=None, resolved_m=None)


def scan_text(text: str, raw: str | None, span: tuple | None = None) -> list[dict]:
    """All heads of a document with their dates: every extract is walked from its own header, the rest from the first stated year."""
    found = heads(text)
    seeds = checkpoints(raw, text) if raw else []
    if seeds:
        rows = walk([h for h in found if h["offset"] < seeds[0][0]], None, None, None, span)
        for (at, y, m), end in zip(seeds, [*(s[0] for s in seeds[1:]), len(text)]):
            rows += walk([h for h in found if at <= h["offset"] < end], y, m, None, span)
    else:
        first = next((h for h in found if h["year"]), None)
        rows = walk(found, first and first["year"], first and first["month"], None, span)
    rescue(rows, text)
    demote(rows)
    return rows


def scan(files: DataFrame, key: str, text: str = "text", raw: str | None = None, span: tuple | None = None) -> DataFrame:
    """(key, offset, weekday, day, month, year, date, resolved_y, resolved_m, status, snippet) of every head of every document.

    A document is one row and is scanned as a whole; null and blank ones have no heads.
    """
    session.ship(files.sparkSession)
    kind = files.schema[key].dataType.simpleString()
    columns = ["offset", "weekday", "day", "month", "year", "date", "resolved_y", "resolved_m", "status", "snippet"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *(r[c] for c in columns)) for k, t, w in zip(pdf["k"], pdf["t"], pdf["w"]) if t for r in scan_text(t, w, span)]
            out = pd.DataFrame(rows, columns=[key, *columns])
            for c in ("offset", "weekday", "day", "month", "year", "resolved_y", "resolved_m"):
                out[c] = pd.array([None if pd.isna(v) else int(v) for v in out[c]], "Int32")
            yield out

    rows = files.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.col(raw) if raw else F.lit(None).cast("string")).alias("w"))
    return rows.mapInPandas(run, f"{key} {kind}, offset int, weekday int, day int, month int, year int, date string, resolved_y int, resolved_m int, status string, snippet string")


def entries(texts: DataFrame, bounds: DataFrame, keep: DataFrame, clean: Column | None = None, large: int = 500) -> DataFrame:
    """Diary entries as passages: (year, chunk_index, anchor, date, text, words, date_precision, content_extends_to, status, source_id, source_offset, collides).

    ``texts`` (source_id, text), ``bounds`` (source_id, offset, date, status), ``keep``
    (source_id, verdict, covers_from, covers_to). Boundaries count if resolved and of a kept
    source; an entry runs to the source's next boundary. Of sources kept for a gap
    (KEEP-UNIQUE) only dates within it stay. Entries are numbered by year in the order of
    date, source and offset; a date's second entry gets the suffix b and so on; one of more
    than ``large`` words is marked as a range up to the next entry's date. ``collides`` if
    the same date's entry before it is of another source. Blank entries are left out.
    """
    kept = bounds.where(F.col("status").isin("ok", "rescued")).join(keep, "source_id")
    w = Window.partitionBy("source_id").orderBy("offset")
    spans = kept.withColumns({"_end": F.lead("offset").over(w), "_next": F.lead("date").over(w)})
    spans = spans.where((F.col("verdict") != "KEEP-UNIQUE") | F.col("date").between(F.col("covers_from"), F.col("covers_to")))
    cut = spans.join(texts.select("source_id", "text"), "source_id")
    body = F.substring(F.col("text"), F.col("offset") + 1, F.coalesce("_end", F.length("text")) - F.col("offset"))
    strip = F.regexp_replace(body, r"^\s+|\s+$", "")
    own = cut.withColumn("text", strip if clean is None else clean).where("text <> ''")
    own = own.withColumns({"year": F.substring("date", 1, 4).cast("int"), "words": F.regexp_count("text", F.lit(r"[A-Za-z]+(?:'[A-Za-z]+)?"))})
    by_year = Window.partitionBy("year").orderBy("date", "source_id", "offset")
    by_date = Window.partitionBy("year", "date").orderBy("source_id", "offset")
    nth = F.row_number().over(by_date)
    out = own.withColumns({"chunk_index": F.row_number().over(by_year) - 1, "_nth": nth, "_before": F.lag("source_id").over(by_date)})
    over = F.col("words") > large
    return out.select(
        "year", "chunk_index", F.concat("date", F.when(F.col("_nth") > 1, suffix(F.col("_nth"))).otherwise("")).alias("anchor"), "date", "text", "words",
        F.when(over, "range").otherwise("day").alias("date_precision"), F.when(over, F.col("_next")).alias("content_extends_to"), "status", "source_id",
        F.col("offset").alias("source_offset"), F.coalesce(F.col("_before") != F.col("source_id"), F.lit(False)).alias("collides"),
    )


def suffix(n: Column) -> Column:
    """b for 2, c for 3, ..., z for 26, then aa, ab, ..."""
    return F.when(n <= 26, F.char(96 + n)).otherwise(F.concat(F.char(96 + F.floor((n - 1) / 26)), F.char(97 + (n - 1) % 26)))
