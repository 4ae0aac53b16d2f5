"""Diaries, numbered books, gates, scores and quotations on small fixtures with results worked out by hand."""

import difflib
import re
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import gates, joins, journal, quotes, repair, scoring, segment, stats, tagging


def dated(*heads):
    """The dates and states of heads (weekday, day, month, year) walked from nothing."""
    found = [{"offset": k, "weekday": w, "day": d, "month": m, "year": y, "snippet": ""} for k, (w, d, m, y) in enumerate(heads)]
    return [(r["date"], r["status"]) for r in journal.walk(found, None, None)]


def test_heads_of_both_forms():
    text = "1752. March 15, Sun.- Rode. And then\nMon. 16.--Slept. [Journal, 1758] Wed. 21.- Wrote. Tuesday, May 24, 1738.- Felt. Sat. 45.- no"
    got = [(h["weekday"], h["day"], h["month"], h["year"]) for h in journal.heads(text)]
    assert got == [(6, 15, 3, 1752), (0, 16, None, None), (2, 21, None, 1758), (1, 24, 5, 1738)]


def test_walk_fits_weekdays_and_goes_on():
    # 24 May 1738 was a Wednesday (old style); the 25th follows, the 1st is in June
    assert dated((2, 24, 5, 1738), (3, 25, None, None), (3, 1, None, None)) == [("1738-05-24", "ok"), ("1738-05-25", "ok"), ("1738-06-01", "ok")]
    # a head that fits nothing leaves the state alone
    assert dated((2, 24, 5, 1738), (6, 31, None, None), (3, 25, None, None))[1:] == [(None, "unresolved"), ("1738-05-25", "ok")]
    # a stated month before the running one means the next year; a year by itself goes on from the running month
    assert dated((2, 24, 5, 1738), (3, 15, 3, None))[1] == ("1739-03-15", "ok")
    assert dated((2, 24, 5, 1738), (4, 9, None, 1738))[1] == ("1738-06-09", "ok")
    # nothing to stand on
    assert dated((2, 24, None, None)) == [(None, "unresolved")]
    found = [{"offset": 0, "weekday": 2, "day": 24, "month": 5, "year": 1738, "snippet": ""}]
    assert journal.walk(found, None, None, bounds=(1739, 1740))[0]["status"] == "unresolved"
    assert journal.walk(found, None, None, span=((1740, 1, 1), (1750, 1, 1)))[0]["status"] == "out-of-range"


@settings(max_examples=30, deadline=None)
@given(st.dates(date(1753, 1, 1), date(1790, 1, 1)), st.lists(st.integers(1, 27), min_size=1, max_size=30))
def test_walk_finds_dates_known_by_weekday_and_day(first, steps):
    days = [first]
    for s in steps:
        days.append(days[-1] + timedelta(s))
    rows = dated((first.weekday(), first.day, first.month, first.year), *((d.weekday(), d.day, None, None) for d in days[1:]))
    assert all(s == "ok" for _, s in rows) and [d for d, _ in rows] == [d.isoformat() for d in days]


def test_rescue_and_demotion():
    text = "In 1742 it was so. Wed. 24.- x"
    rows = journal.scan_text(text, None)
    assert [(r["date"], r["status"]) for r in rows] == [("1742-02-24", "rescued")]
    rows = [{"status": "ok", "resolved_y": y, "resolved_m": 1, "date": "x"} for y in (1740, 1741, 1741, 1799, 1742)]
    journal.demote(rows)
    assert [r["resolved_y"] for r in rows] == [1740, 1741, 1741, None, 1742]


def test_extracts_begin_anew_at_their_headers():
    raw = "Title\nFROM May 1, 1738, TO June 1, 1738\nWed. 24.-- In the evening I went very unwillingly to a society.\nFROM May 1, 1745, TO June 1, 1745\nFri. 24.-- At noon we rode to Leeds in the rain.\n"
    clean = "Wed. 24.- In the evening I went very  unwillingly to a society.\n\nFri. 24.- At noon we rode to Leeds in the rain."
    assert [(y, m) for _, y, m in journal.checkpoints(raw, clean)] == [(1738, 5), (1745, 5)]
    # the anchor is what follows the head, so the first head stands before its checkpoint
    rows = journal.scan_text("Preface.\n" + clean + " Sat. 25.- Rested.", raw)
    assert rows[-1]["date"] == "1745-05-25"


def test_scan_of_nulls_blanks_and_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "Wed. May 24, 1738.- x")], "f string, text string")
    assert [(r.f, r.date) for r in journal.scan(df, "f").collect()] == [("c", "1738-05-24")]
    assert journal.scan(df.limit(0), "f").count() == 0


def test_entries_of_one_day_in_two_sources(spark):
    texts = spark.createDataFrame([("a", "AAA BBB"), ("b", "CCC")], "source_id string, text string")
    bounds = spark.createDataFrame([("a", 0, "1740-01-01", "ok"), ("a", 4, "1740-01-01", "rescued"), ("a", 2, None, "unresolved"), ("b", 0, "1740-01-01", "ok")], "source_id string, offset int, date string, status string")
    keep = spark.createDataFrame([("a", "KEEP", None, None), ("b", "KEEP-UNIQUE", "1740-01-01", "1740-12-31")], "source_id string, verdict string, covers_from string, covers_to string")
    got = [(r.anchor, r.text, r.collides) for r in journal.entries(texts, bounds, keep).orderBy("chunk_index").collect()]
    assert got == [("1740-01-01", "AAA", False), ("1740-01-01b", "BBB", False), ("1740-01-01c", "CCC", True)]


def test_numbered_books_and_sections(spark):
    df = spark.createDataFrame([(1, "x\nHYMN 1.\nA  b\nHYMN 3.\nC\nINDEX\nHYMN 9. no"), (2, None)], "id int, text string")
    book = segment.numbered_book(df, r"[ \t]*HYMN[ \t]+(\d+)\.", "INDEX")
    assert sorted((r.position, r.printed, r.text) for r in book.collect()) == [(1, 1, "HYMN 1.\nA b"), (2, 3, "HYMN 3.\nC")]
    assert [(r.kind, r.number) for r in segment.number_findings(book).collect()] == [("gap", 2)]
    s = segment.ordered_sections(spark.createDataFrame([(1, "ONE\na\nTWO\nb")], "id int, text string"), [("^TWO$", "t"), ("^ONE$", "o")])
    assert [(r.name, r.begin) for r in s.orderBy("n").collect()] == [("t", 9), ("o", None)]


def test_wording_is_that_of_the_nearest_stretch():
    assert repair.nearest_wording("And he said: In the beginning, was THE word!", "in the beginning was the word") == 1.0
    assert repair.nearest_wording("", "x") == 0.0 and repair.nearest_wording("x", "?!") == 0.0
    quote = "one two three four five six seven"
    text = "zero " * 30 + "one two thee four five six seven eight nine"
    flat = re.sub(r"[^a-z0-9]+", " ", text).split()
    brute = difflib.SequenceMatcher(None, " ".join(flat[30:37]), quote, autojunk=False).ratio()
    assert repair.nearest_wording(text, quote) == pytest.approx(brute)


def test_sentinels_pass_drift_and_fail(spark):
    p = spark.createDataFrame([("jx-1", "jx", "The cold mill stood by the quiet river all the year."), ("cx-1", "cx", "The cold mill stood upon a hill of sand."), ("z", "z", None)], "id string, source_id string, text string")
    s = spark.createDataFrame([
        ("a", "present", "cold mill stood", "The cold mill stood by the quiet river", "jx"), ("b", "present", "cold mill stood", "the cold mill stood while seven bakers danced in moonlight", "cx"),
        ("c", "present", "no such words", "no such words", None), ("d", "absent", "cold mill", "x", None), ("e", None, "hill of sand", "hill of sand", "jx"), ("f", "absent", "warm mill", "x", None),
    ], "id string, expect string, anchor string, canonical string, source_id string")
    got = {r.id: (r.verdict, r.passage_id, r.in_scope) for r in gates.sentinel_verdicts(p, s).collect()}
    assert got["a"] == ("PASS", "jx-1", True) and got["b"][0] == "WORDING" and got["c"] == ("FAIL", None, None)
    assert got["d"][0] == "FAIL" and got["e"] == ("PASS", "cx-1", False) and got["f"] == ("PASS", None, None)


def test_required_join_fails_on_a_missing_row(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert gates.required(left.where("k = 1"), right, "k").collect()[0].v == "x"
    with pytest.raises(Exception, match="no row for 2"):
        gates.required(left, right, "k").collect()


def test_judge_schema_names_what_it_asks_for():
    schema = gates.json_schema(["grace"], ["pride"])
    assert schema["required"] == ["counter_indicators", "dimensions", "label", "overall_score", "summary"]
    assert schema["properties"]["dimensions"]["properties"]["grace"]["properties"]["score"]["maximum"] == 100


def scale():
    return scoring.Scale((scoring.RuleSet("a", ("free mercy", "free"), (r"\bgood\b",)), scoring.RuleSet("b")), (), (), (), scoring.Counter("c", ("bad",), (), refutations=(r"\bnot bad\b",)), ((0, "none"), (50, "some")))


def test_scores_saturate_and_counters_take_away(spark):
    import math

    df = spark.createDataFrame([(1, "free mercy is good"), (2, "bad " * 3), (3, "not bad"), (4, None), (5, "")], "id int, text string")
    got = {r.id: r for r in scoring.with_scores(df, scale()).collect()}
    # phrases: "free mercy" and "free" at one place; a short text counts as one of a hundred words
    want = int(max(100 * (1 - math.exp(-3 * 7 / 15)), 100 * (1 - math.exp(-3 * 7 / 30))))
    assert got[1].a == want == 75 and got[1].overall == int(0.6 * 80) and got[1].label == "none" and got[1].counter == 0
    assert (got[2].counter, got[2].penalty) == (9, 15) and got[2].overall == 0
    assert (got[3].counter, got[3].penalty) == (0, 0) and got[4].overall is None and got[5].a == 0
    words = scoring.with_scores(df, scale()).select("id", scoring.summary(scale()).alias("s"))
    assert {r.id: r.s for r in words.collect()}[1] == "This text scores 48/100 (none). It shows strongest affinity in a. It lacks emphasis on b, scripture."


def test_comparison_asks_for_two_to_five_sound_texts(spark):
    rows = [("g", k, "free mercy" if k else "x") for k in range(2)] + [("h", 0, "x")] + [("i", 0, "x"), ("i", 1, " ")] + [("j", k, "x") for k in range(6)]
    got = scoring.compared(spark.createDataFrame(rows, "g string, k int, text string"), scale(), "g", "k").orderBy("place").collect()
    assert [(r.g, r.k, r.place, r.behind > 0) for r in got] == [("g", 1, 1, False), ("g", 0, 2, True)]


def test_cache_answers_before_the_rules(spark):
    texts = spark.createDataFrame([("a", "free"), ("b", "free mercy"), ("c", None)], "id string, text string")
    cache = texts.where("id = 'a'").select(scoring.cache_key(F.col("text"), "v1").alias("cache_key"), F.lit(99).alias("overall"), F.lit(None).cast("timestamp").alias("created_at"))
    got = {r.id: (r.overall, r.engine) for r in scoring.dispatched(texts, cache, scale(), "v1").collect()}
    assert got["a"] == (99, "cache") and got["b"][1] == "rules" and got["c"] == (None, "rules")
    assert all(r.engine == "rules" for r in scoring.dispatched(texts, cache, scale(), "v2").collect())


def test_sentences_that_cannot_be_quoted(spark):
    why = {
        "A caret^ here.": "caret", "I a b c d am.": "single letters", "The word strngths is torn.": "consonants", "He went in28 days.": "digits in words", "The house -was cold.": "loose hyphen",
        "The oldHouse was cold.": "joined words", "It was happi ness to all.": "torn word", "Wait! What? No! Yes?": "marks", "Short but sound.": "length", "the shepherd " + "was so " * 10: "starts lower",
        "The the house house was cold and nobody ever came to see it again.": "repeated word",
    }
    df = spark.createDataFrame([(s,) for s in why], "s string").select("s", quotes.unfit(F.col("s"), []).alias("r"))
    assert {r.s: r.r for r in df.collect()} == why
    sound = "The shepherd went down to the river in the evening, and he found the boat there."
    assert spark.createDataFrame([(sound,)], "s string").select(quotes.unfit(F.col("s"), [r"\bnotice\b"]).alias("r")).first().r is None
    assert spark.createDataFrame([("12. Sect. IV. Be kind (3) to all. 7.",)], "s string").select(quotes.trimmed(F.col("s")).alias("t")).first().t == "Sect. IV. Be kind to all."


def test_elisions_and_inflections_explain_words(spark):
    known = spark.createDataFrame([("heaven",), ("promise",), ("walk",)], "w string")
    words = spark.createDataFrame([("heav'n",), ("promis'd",), ("walking",), ("a",), ("zzz",), ("x'y'z",)], "w string")
    assert {r.w for r in repair.explained(words, known).collect()} == {"heav'n", "promis'd", "walking", "a"}


def test_review_removes_suggests_and_reports(spark):
    df = spark.createDataFrame([(["grace"], "a battle", "On Hope"), (["grace", "war"], "mercy", "x"), ([], "battle", "On Hope"), (None, "x", "On Hope")], "themes array<string>, text string, source_title string")
    got = tagging.review(df, {"grace": ["mercy"]}, "general", [("war", ["battle"])], titles=[("hope", "hope", False)]).collect()
    assert [r.reviewed for r in got] == [["war"], ["grace", "war"], ["war"], None]
    assert [r.issues for r in got] == [["over-tagged: grace", "title: hope"], [], ["title: hope"], ["title: hope"]]


def test_noise_of_no_rows_and_of_explained_words(spark):
    p = spark.createDataFrame([("s", "walking zzq A zzq"), ("s", None), ("t", "123")], "source_id string, text string")
    d = spark.createDataFrame([("walk",), (None,)], "word string")
    got = {r.source_id: (r.passages, r.words, r.non_words, r.top_offenders) for r in stats.token_noise(p, d).collect()}
    assert got == {"s": (2, 4, 2, "zzq:2"), "t": (1, 0, 0, "")}
    assert stats.token_noise(p.limit(0), d).count() == 0


def test_anchors_of_every_length(spark):
    t = spark.createDataFrame([(1, "The Cold Mill stood -- by"), (2, "old"), (None, "old mill"), (3, None)], "id int, text string")
    a = spark.createDataFrame([("one", "ol"), ("two", "OLD m"), ("three", "e cold mi"), ("none", "--"), ("blank", " "), ("no", "mill sat")], "k string, anchor string")
    few, many = (sorted(tuple(r) for r in joins.containing(t, a, "text", "anchor", few=n).select("id", "k").collect()) for n in (10_000, 1))
    assert few == many == [(1, "none"), (1, "one"), (1, "three"), (1, "two"), (2, "one")]


def test_compatibility_forms_of_page_text(spark):
    df = spark.createDataFrame([("ﬁrst “word”\n12\nTHE HEADER\nmat-\nter  end",), (None,)], "t string")
    assert [r.c for r in df.select(T.clean_page_text(F.col("t")).alias("c")).collect()] == ['first "word"\nmatter end', None]
    scan = spark.createDataFrame([("ſome tbe\n---\nkl\nA 2\nMon. 16. Page | one (p. 11)",)], "t string").select(T.clean_scan_text(F.col("t"), {"tbe": "the"}).alias("c")).first().c
    assert scan == "some the Page one"


def test_command_line_and_table_functions(spark, tmp_path):
    from corpusloom import __main__ as cli
    from corpusloom import udtf
    from corpusloom.sources import io

    rows = [("a", "J", "s1", "Hope", "sermon", 1740, 0, "Hope and hope again.", 4, None, ["t"], None, None, None)]
    spark.createDataFrame(rows, io.PASSAGES).write.parquet(str(tmp_path / "passages.parquet"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "jx-sermon-1740-on-joy.txt").write_text("Joy.\n\nMore joy.")
    (tmp_path / "in" / "s1.txt").write_text("there already")
    run = lambda *a: cli.run(spark, cli.parser().parse_args([str(tmp_path), *a]))
    assert [(r.id, r.score) for r in run("search", "hope").collect()] == [("a", 102)]
    assert run("theme", "t").count() == 1 and run("random").count() == 1 and run("stats").count() == 4 and run("status").count() == 4 and run("validate").count() == 1
    assert {r.source_id for r in run("ingest", str(tmp_path / "in")).collect()} == {"jx-sermon-1740-on-joy"}
    assert run("ingest", str(tmp_path / "in"), "--force").select("source_id").distinct().count() == 2
    assert [(r.id, r.text) for r in run("chunk", str(tmp_path / "in")).orderBy("id").collect()] == [("jx-sermon-1740-on-joy", "Joy.\n\nMore joy."), ("s1", "there already")]
    udtf.register(spark)
    assert [tuple(r) for r in spark.sql("select * from chunk_text('a b.', 400)").collect()] == [(0, "a b.", 2)]
    assert [r.date for r in spark.sql("select * from date_walk('Wed. May 24, 1738.- x')").collect()] == ["1738-05-24"]


def test_blocks_of_a_hot_key_change_nothing(spark):
    import random

    from corpusloom.operators import ordered

    rng = random.Random(4)
    rows = [(k % 3 and 1, k, rng.randint(0, 60) if rng.random() < 0.9 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, k int, v int")
    block = F.floor(F.col("k") / 7)
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert same(ordered.strictly_increasing(df, ["g"], [F.col("k")], "v"), ordered.strictly_increasing(df, ["g"], [F.col("k")], "v", block))
    assert same(ordered.numbered(df, ["g"], [F.col("k")], "n"), ordered.numbered(df, ["g"], [F.col("k")], "n", block))
    marks = df.where("k % 11 = 0").select("g", "k", "v")
    assert same(ordered.as_of(df.select("g", "k"), marks, ["g"], "k", "v"), ordered.as_of(df.select("g", "k"), marks, ["g"], "k", "v", block))
    empty = df.limit(0)
    assert ordered.numbered(empty, ["g"], [F.col("k")], "n", block).count() == 0 and ordered.strictly_increasing(empty, ["g"], [F.col("k")], "v", block).count() == 0
