"""Documents into rows: chunks, stanzas, headings, numbered blocks, dated entries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom import session
from corpusloom.functions import text as T


def greedy_pack(text: str, most: int = 400) -> list[str]:
    """Paragraphs packed in order into chunks of at most ``most`` words.

    A longer paragraph closes the running chunk and is cut at sentence ends, each of its
    chunks but the first repeating the last sentence of the one before, even where both
    together exceed the limit; what remains of it runs on. A single sentence beyond the
    limit is a chunk by itself.
    """
    chunks: list[str] = []
    held: list[str] = []
    n = 0

    def close() -> None:
        nonlocal n
        if held:
            chunks.append("\n\n".join(held))
        held.clear()
        n = 0

    for paragraph in (p.strip() for p in re.split(r"\n\s*\n", text)):
        size = len(paragraph.split())
        if not size:
            continue
        if size <= most:
            if n + size > most:
                close()
            held.append(paragraph)
            n += size
            continue
        close()
        run: list[str] = []
        count = 0
        for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
            k = len(sentence.split())
            if run and count + k > most:
                chunks.append(" ".join(run))
                run = run[-1:]
                count = len(run[0].split())
            run.append(sentence)
            count += k
        held.append(" ".join(run))
        n = count
    close()
    return chunks


def greedy_chunks(df: DataFrame, id_col: str = "id", text_col: str = "text", most: int = 400) -> DataFrame:
    """(id, chunk_index, text, word_count) by :func:`greedy_pack`; null and blank texts have none."""
    session.ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, c, len(c.split())) for i, t in zip(pdf["id"], pdf["text"]) if t is not None for k, c in enumerate(greedy_pack(t, most))]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "text", "word_count"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, chunk_index int, text string, word_count int")


def hymn_rows(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The whole hymn (stanza_number null) and one row per stanza, numbered from 1."""
    full = df.select(F.concat(F.col(id_col), F.lit("-full")).alias("id"), F.lit(None).cast("int").alias("stanza_number"), F.col(text_col).alias("text"))
    parts = df.select(F.col(id_col).alias("_id"), F.posexplode(T.stanzas(F.col(text_col))).alias("pos", "text"))
    each = parts.select(F.concat("_id", F.lit("-stanza-"), F.lpad((F.col("pos") + 1).cast("string"), 2, "0")).alias("id"), (F.col("pos") + 1).alias("stanza_number"), "text")
    return full.unionByName(each)


def heading_split(df: DataFrame, heading: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, n, heading, body): the text cut before every line that matches ``heading``; n = 0 is what stands before the first."""
    parts = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, rf"(?m)(?=^{heading}$)")).alias("n", "part"))
    head = F.regexp_extract("part", rf"(?m)\A({heading})$", 1)
    body = T.strip(F.when(head != "", F.substring(F.col("part"), F.length(head) + 1, F.length("part"))).otherwise(F.col("part")))
    return parts.select("id", F.when(F.col("n") >= 0, F.col("n")).alias("n"), head.alias("heading"), body.alias("body")).where("heading <> '' or body <> ''")


def numbered_lines(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, pos, number, line) of the lines that begin with a number and a stop."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    return lines.withColumn("number", F.expr(r"try_cast(nullif(regexp_extract(line, '^\\s*(\\d{1,6})\\.\\s', 1), '') as int)")).where("number is not null")


def ordered_anchors(text: str, anchors: list[str]) -> list[int]:
    """The place of each anchor searched from the end of the one before; -1 where it isn't found (the cursor stays)."""
    out, at = [], 0
    for a in anchors:
        k = text.find(a, at)
        out.append(k)
        if k >= 0:
            at = k + len(a)
    return out


def _day_number(y: int, m: int, d: int) -> int:
    a = (14 - m) // 12
    yy, mm = y + 4800 - a, m + 12 * a - 3
    n = d + (153 * mm + 2) // 5 + 365 * yy + yy // 4
    return n - yy // 100 + yy // 400 - 32045 if (y, m, d) >= (1752, 9, 14) else n - 32083


def _month_days(y: int, m: int) -> int:
    if m == 2:
        return 29 if (y % 4 == 0 and (y % 100 or y % 400 == 0 or y <= 1752)) else 28
    return 30 if m in (4, 6, 9, 11) else 31


def rescued_year(text: Column, before: Column, back: int = 4000) -> Column:
    """The last year (1600 to 1899) named in the ``back`` characters before an offset; null if none."""
    begin = F.greatest(before - back, F.lit(0))
    seen = F.regexp_extract_all(F.substring(text, begin + 1, before - begin), F.lit(r"\b(1[678]\d\d)\b"), F.lit(1))
    return F.try_element_at(seen, F.lit(-1)).cast("int")


def date_heads(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, pos, head, weekday, day) of heads such as "Mon. 7" or "Sun 12" in reading order."""
    pattern = r"\b(Mon|Tues|Tue|Wed|Thurs|Thur|Fri|Sat|Sun)\.?\s+(\d{1,2})\b"
    hits = df.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(text_col, F.lit(f"({pattern})"), F.lit(1))).alias("pos", "head"))
    day = F.substring(F.regexp_extract("head", pattern, 1), 1, 3)
    number = F.array_position(F.array(*(F.lit(x) for x in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"))), day) - 1
    return hits.select("id", "pos", "head", number.cast("int").alias("weekday"), F.regexp_extract("head", pattern, 2).cast("int").alias("day"))


def ordered_sections(df: DataFrame, headings: list[tuple[str, str]], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, n, name, begin, end) of sections whose headings (pattern, name) are searched in order, each after the one before.

    Patterns match whole lines. A heading that isn't found has null offsets (the cursor
    stays), so that a gate can refuse the document; a section ends where the next found
    one's heading begins to be searched: at its own heading's end.
    """
    session.ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    compiled = [(re.compile(p, re.M), name) for p, name in headings]

    def sections(text: str) -> list[tuple[int, str, int | None, int | None]]:
        at, begins = 0, []
        for p, name in compiled:
            m = p.search(text, at)
            begins.append((name, m.end() if m else None))
            at = m.end() if m else at
        ends = [b for _, b in begins[1:]] + [len(text)]
        for k in range(len(ends) - 2, -1, -1):
            ends[k] = ends[k + 1] if ends[k] is None else ends[k]
        return [(k, name, b, e if b is not None else None) for k, ((name, b), e) in enumerate(zip(begins, ends))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *s) for i, t in zip(pdf["id"], pdf["text"]) if t is not None for s in sections(t)]
            out = pd.DataFrame(rows, columns=["id", "n", "name", "begin", "end"])
            for c in ("begin", "end"):
                out[c] = pd.array([None if pd.isna(v) else int(v) for v in out[c]], "Int32")
            yield out

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, n int, name string, begin int, end int")


def numbered_heads(df: DataFrame, pattern: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, n, printed, part): a text cut before each line head that matches ``pattern``, whose first group is its number.

    What stands before the first head belongs to none. ``n`` counts from 1 in reading order.
    """
    parts = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, rf"(?md)(?=^{pattern})")).alias("_k", "part"))
    printed = F.regexp_extract("part", rf"\A{pattern}", 1)
    named = parts.withColumn("printed", printed).where("printed <> ''")
    return named.select("id", F.row_number().over(Window.partitionBy("id").orderBy("_k")).alias("n"), "printed", "part")


def numbered_book(df: DataFrame, pattern: str, cutoff: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, position, printed, text, words) of numbered pieces up to the first ``cutoff`` (an index); numbered by reading order.

    A text without the cutoff is taken whole. The printed number is what was read, right or wrong.
    """
    body = df.select(F.col(id_col).alias("id"), F.substring_index(F.col(text_col), cutoff, 1).alias("text"))
    heads = numbered_heads(body, pattern)
    text = T.light_clean(T.strip(F.col("part")))
    return heads.select("id", F.col("n").alias("position"), F.expr("try_cast(printed as int)").alias("printed"), text.alias("text"), F.regexp_count(text, F.lit("[A-Za-z]+(?:'[A-Za-z]+)?")).alias("words"))


def number_findings(book: DataFrame, key: str = "id", number: str = "printed") -> DataFrame:
    """(key, kind, number): numbers read more than once, and numbers from 1 to the greatest that are missing."""
    have = book.where(F.col(number).isNotNull()).groupBy(key, number).agg(F.count("*").alias("n"))
    twice = have.where("n > 1").select(key, F.lit("duplicate").alias("kind"), F.col(number).alias("number"))
    wanted = have.groupBy(key).agg(F.max(number).alias("m")).where("m >= 1").select(key, F.explode(F.sequence(F.lit(1), F.col("m"))).alias(number))
    gaps = wanted.join(have, [key, number], "left_anti").select(key, F.lit("gap").alias("kind"), F.col(number).alias("number"))
    return twice.unionByName(gaps)


def reset_blocks(df: DataFrame, pattern: str, names: list[str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, block, name, chapter, body): chapters (roman numbers) grouped into blocks that begin at chapter 1, named in order.

    A block whose opening (100 characters of its first chapter, white space collapsed)
    an earlier block has is dropped. Names go to the blocks left by position; a document
    with another number of blocks than names has the name null throughout, for a gate to refuse.
    """
    heads = numbered_heads(df, pattern, id_col, text_col).withColumn("chapter", T.roman_value(F.col("printed")))
    by_doc = Window.partitionBy("id").orderBy("n")
    blocks = heads.withColumn("_b", F.sum(F.when((F.col("chapter") == 1) | (F.col("n") == 1), 1).otherwise(0)).over(by_doc))
    first = blocks.withColumn("_r", F.row_number().over(Window.partitionBy("id", "_b").orderBy("n"))).where("_r = 1")
    opener = F.trim(F.regexp_replace(F.substring("part", 1, 100), r"\s+", " "))
    kept = first.select("id", "_b", opener.alias("_o")).withColumn("_seen", F.row_number().over(Window.partitionBy("id", "_o").orderBy("_b"))).where("_seen = 1")
    order = Window.partitionBy("id").orderBy("_b")
    kept = kept.withColumns({"block": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy("id"))})
    table = F.array(*map(F.lit, names))
    kept = kept.select("id", "_b", "block", F.when(F.col("_n") == len(names), F.get(table, F.col("block") - 1)).alias("name"))
    return blocks.join(kept, ["id", "_b"]).select("id", "block", "name", "chapter", T.strip(F.col("part")).alias("body"))


def verse_marks(df: DataFrame, pattern: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, pos, verse) of verse numbers (first group of ``pattern``) in reading order; a number not above all before it is no verse."""
    marks = df.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1))).alias("pos", "verse")).withColumn("verse", F.col("verse").cast("int"))
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return marks.withColumn("_before", F.coalesce(F.max("verse").over(w), F.lit(0))).where("verse > _before").drop("_before")
