"""Citations in running text: extraction, book names, the inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Book names with their usual abbreviations, in canonical order.
BOOKS = (
    ("Genesis", "gen"), ("Exodus", "exod ex"), ("Leviticus", "lev"), ("Numbers", "num"), ("Deuteronomy", "deut"), ("Joshua", "josh"),
    ("Judges", "judg"), ("Ruth", ""), ("1 Samuel", "1sam"), ("2 Samuel", "2sam"), ("1 Kings", "1kgs 1kings"), ("2 Kings", "2kgs 2kings"),
    ("1 Chronicles", "1chron 1chr"), ("2 Chronicles", "2chron 2chr"),
    ("Ezra", ""), ("Nehemiah", "neh"), ("Esther", "esth"), ("Job", ""), ("Psalms", "ps pss psa psalm"), ("Proverbs", "prov"),
    ("Ecclesiastes", "eccl eccles"), ("Song of Solomon", "song songs songofsongs"), ("Isaiah", "isa"), ("Jeremiah", "jer"), ("Lamentations", "lam"), ("Ezekiel", "ezek"),
    ("Daniel", "dan"), ("Hosea", "hos"), ("Joel", ""), ("Amos", ""), ("Obadiah", "obad"), ("Jonah", "jon"), ("Micah", "mic"), ("Nahum", "nah"),
    ("Habakkuk", "hab"), ("Zephaniah", "zeph"), ("Haggai", "hag"), ("Zechariah", "zech"), ("Malachi", "mal"), ("Matthew", "matt mt"),
    ("Mark", "mk"), ("Luke", "lk"), ("John", "jn"), ("Acts", ""), ("Romans", "rom"), ("1 Corinthians", "1cor"), ("2 Corinthians", "2cor"),
    ("Galatians", "gal"), ("Ephesians", "eph"), ("Philippians", "phil"), ("Colossians", "col"), ("1 Thessalonians", "1thess 1thes"),
    ("2 Thessalonians", "2thess 2thes"), ("1 Timothy", "1tim"), ("2 Timothy", "2tim"), ("Titus", "tit"), ("Philemon", "philem"), ("Hebrews", "heb"),
    ("James", "jas"), ("1 Peter", "1pet"), ("2 Peter", "2pet"), ("1 John", "1jn"), ("2 John", "2jn"), ("3 John", "3jn"), ("Jude", ""), ("Revelation", "rev"),
)


def aliases() -> dict[str, tuple[str, int]]:
    """Book and canonical number by alias (lower case, no blanks, stops or hyphens)."""
    out = {}
    for k, (book, short) in enumerate(BOOKS):
        for alias in [book.lower().replace(" ", ""), *short.split()]:
            out[alias] = (book, k)
    return out


def _key(book: Column) -> Column:
    return F.regexp_replace(F.lower(book), r"[\s.\-_]", "")


def book_name(book: Column) -> Column:
    """The full name of a book in any spelling known; null for others."""
    table = F.create_map(*(F.lit(x) for a, (name, _) in sorted(aliases().items()) for x in (a, name)))
    return F.try_element_at(table, _key(book))


def canonical_order(book: Column) -> Column:
    """The book's number, 999 for unknown ones."""
    table = F.create_map(*(F.lit(x) for a, (_, k) in sorted(aliases().items()) for x in (a, k)))
    return F.coalesce(F.try_element_at(table, _key(book)), F.lit(999))


def _pattern() -> str:
    """(book) (chapter):(verse)[-(verse)], the book's alternation from the alias table, longest first."""
    names = sorted({a for a in aliases()}, key=lambda a: (-len(a), a))
    spaced = [(a[0] + r"\s*" + a[1:] if a[0].isdigit() else r"\s+".join(("song", "of", a[6:])) if a.startswith("songof") else a) for a in names]
    tails = sorted({a[1:] for a in names if a[0].isdigit()}, key=lambda a: (-len(a), a))
    last = r"(?:\s?[-–]\s?(\d{1,3})|\s?,\s?(\d{1,3})(?![\d:]|\s?(?:" + "|".join(tails) + r")\b))?"
    return r"(?i)\b(" + "|".join(spaced) + r")\.?\s*(\d{1,3}):(\d{1,3})" + last


def extract(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, pos, matched, reference, book, chapter, verse_start, verse_end), one row per citation in reading order.

    ``matched`` is the citation as written, ``reference`` in full ("Romans 8:28-30"). A comma
    between verses reads as a range. Null texts have no citations.
    """
    whole = F.regexp_extract_all(text_col, F.lit(f"({_pattern()})".replace("(?i)", "", 1).join(["(?i)", ""])), F.lit(1))
    # most texts hold no chapter and verse at all: a cheap look spares them the long alternation
    hits = df.where(F.col(text_col).rlike(r"\d:\d")).select(F.col(id_col).alias("id"), F.posexplode(whole).alias("pos", "matched"))
    part = lambda k: F.regexp_extract("matched", _pattern(), k)
    chapter, first, last, other = (F.expr(f"try_cast(nullif(g{k}, '') as int)") for k in (2, 3, 4, 5))
    out = hits.withColumns({f"g{k}": part(k) for k in (1, 2, 3, 4, 5)})
    out = out.select("id", "pos", "matched", book_name(F.col("g1")).alias("book"), chapter.alias("chapter"), first.alias("verse_start"), F.coalesce(last, other, first).alias("verse_end"))
    verses = F.concat(F.col("verse_start").cast("string"), F.when(F.col("verse_end") != F.col("verse_start"), F.concat(F.lit("-"), F.col("verse_end").cast("string"))).otherwise(""))
    return out.select("id", "pos", "matched", F.concat("book", F.lit(" "), F.col("chapter").cast("string"), F.lit(":"), verses).alias("reference"), "book", "chapter", "verse_start", "verse_end")


def books(refs: DataFrame) -> DataFrame:
    """Per book: references, distinct chapters, canonical number and share of all references."""
    out = refs.where("book is not null").groupBy("book").agg(F.count("*").alias("refs"), F.countDistinct("chapter").alias("chapters"))
    total = refs.where("book is not null").agg(F.count("*")).scalar()
    return out.withColumn("total", total).withColumn("canon", canonical_order(F.col("book")))


def top(refs: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """The n most frequent values, ties in their own order."""
    return refs.where(" and ".join(f"{c} is not null" for c in columns)).groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *columns).limit(n)


def index(refs: DataFrame, most: int = 1000) -> DataFrame:
    """(book, chapter, part, entries): the passages of each chapter in order, as 'id:first-last' strings, at most ``most`` in a part."""
    verses = F.concat(F.coalesce(F.col("verse_start").cast("string"), F.lit("")), F.when(F.col("verse_end") > F.col("verse_start"), F.concat(F.lit("-"), F.col("verse_end").cast("string"))).otherwise(""))
    rows = refs.where("book is not null and chapter is not null and passage_id is not null").select("book", "chapter", F.concat("passage_id", F.lit(":"), verses).alias("entry"))
    part = F.floor((F.row_number().over(Window.partitionBy("book", "chapter").orderBy("entry")) - 1) / most).cast("int")
    return rows.withColumn("part", part).groupBy("book", "chapter", "part").agg(F.concat_ws("; ", F.sort_array(F.collect_list("entry"))).alias("entries"))


def nested_index(refs: DataFrame, most: int = 1000) -> DataFrame:
    """(book, part, document): JSON documents chapter -> entries, the n-th parts of all chapters of a book in one."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col("chapter").cast("string").alias("chapter"), "entries")))
    return index(refs, most).groupBy("book", "part").agg(F.to_json(F.map_from_entries(pairs)).alias("document"))


def merged(index_rows: DataFrame, new: DataFrame) -> DataFrame:
    """Flat index rows (book, chapter, pos, passage_id, verses) with new entries (the same without pos) after the old ones of their chapter."""
    old = index_rows.select("book", "chapter", F.lit(0).alias("_new"), F.col("pos").cast("long").alias("_o"), "passage_id", "verses")
    more = new.select("book", "chapter", F.lit(1).alias("_new"), F.lit(0).cast("long").alias("_o"), "passage_id", "verses")
    w = Window.partitionBy("book", "chapter").orderBy("_new", "_o", "passage_id", "verses")
    return old.unionByName(more).select("book", "chapter", (F.row_number().over(w) - 1).alias("pos"), "passage_id", "verses")


def nested_document(rows: DataFrame, most: int = 1000) -> DataFrame:
    """(book, chapter, part, entries): flat index rows as arrays of entries in order, ready for a JSON sink; at most ``most`` in a part."""
    entry = F.struct(F.col("pos"), F.struct("passage_id", "verses").alias("e"))
    cut = rows.withColumn("part", F.floor(F.col("pos") / most).cast("int"))
    return cut.groupBy("book", "chapter", "part").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]).alias("entries"))
