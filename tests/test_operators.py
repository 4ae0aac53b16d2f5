from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.operators import citations, joins, ordered, registry, search, segment, stats, tagging
from corpusloom.sources import io
from corpusloom.streaming import feeds


def test_monotonic_filter(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([4, 4, 5, 14, 1, 2, 15])], "g int, k int, v int")
    got = ordered.strictly_increasing(df, ["g"], [F.col("k")], "v").orderBy("k").collect()
    assert [r.v for r in got] == [4, 5, 14, 15]


def test_sessions_and_suffixes(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([1, 2, 3, 1, 2, 1])], "g int, k int, v int")
    s = ordered.reset_sessions(df, ["g"], [F.col("k")], F.col("v") == 1).orderBy("k").collect()
    assert [r.session for r in s] == [1, 1, 1, 2, 2, 3]
    assert [r.suffix for r in ordered.suffixed(df.where("k < 3"), ["g"], [F.col("k")]).orderBy("k").collect()] == ["", "b", "c"]


def test_as_of_takes_the_last_at_or_before(spark):
    e = spark.createDataFrame([(1, 1), (1, 5), (1, 7), (2, 9)], "u int, t int")
    c = spark.createDataFrame([(1, 5, "a"), (1, 6, "b")], "u int, t int, v string")
    got = {(r.u, r.t): r.as_of_v for r in ordered.as_of(e, c, ["u"], "t", "v").collect()}
    assert got == {(1, 1): None, (1, 5): "a", (1, 7): "b", (2, 9): None}


def test_outliers_are_demoted_until_none_is_left(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([1740, 1740, 1741, 1799, 1741, 1742])], "g int, k int, y int")
    got = ordered.demote_outliers(df, ["g"], [F.col("k")], "y", 3).orderBy("k").collect()
    assert [r.y for r in got] == [1740, 1740, 1741, None, 1741, 1742]


def test_gaps(spark):
    df = spark.createDataFrame([("a", 0), ("a", 3), ("b", 1)], "s string, n int")
    assert sorted(map(tuple, ordered.gaps(df, "s", "n").collect())) == [("a", 1), ("a", 2), ("b", 0)]


def test_quota_takes_the_minority_first(spark):
    df = spark.createDataFrame([(f"i{k}", f"s{k % 6}", k % 6 == 0) for k in range(30)], "id string, s string, m boolean")
    got = ordered.quota(df, "s", F.col("m"), 4, 1, "7").collect()
    assert len({r.s for r in got}) == 4 and sum(r.m for r in got) == 1


def test_patch_and_upsert(spark):
    base = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, t string")
    patches = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("z", "9", 1)], "id string, t string, o int")
    assert sorted(map(tuple, joins.patch(base, patches, "id", "t", "o").collect())) == [("a", "2"), ("b", "y")]
    assert sorted(map(tuple, joins.upsert(base, spark.createDataFrame([("b", "n")], "id string, t string"), "id").collect())) == [("a", "x"), ("b", "n")]


def test_containing_ignores_case_and_blank_anchors(spark):
    t = spark.createDataFrame([(1, "The Cold Mill stood"), (2, "none"), (3, None)], "id int, text string")
    a = spark.createDataFrame([("x", "old mill"), ("y", " "), ("z", "ld mill sto"), ("w", "old mills stood")], "k string, anchor string")
    assert sorted(tuple(r) for r in joins.containing(t, a, "text", "anchor").select("id", "k").collect()) == [(1, "x"), (1, "z")]


def test_citations(spark):
    t = "See 2 Cor 5:17, 1 John 1:9 and Song 2:1. But not corn 5:17; 3 Jn 1:4-6 and Ps 16:18,20."
    got = citations.extract(spark.createDataFrame([(1, t), (2, None)], "id int, text string")).orderBy("pos").collect()
    assert [(r.book, r.chapter, r.verse_start, r.verse_end) for r in got] == [("2 Corinthians", 5, 17, 17), ("1 John", 1, 9, 9), ("Song of Solomon", 2, 1, 1), ("3 John", 1, 4, 6), ("Psalms", 16, 18, 20)]


def test_citation_lookup_uses_verse_ranges(spark):
    r = spark.createDataFrame([("p", "John", 5, 16, 18), ("q", "1 John", 5, 17, None)], "passage_id string, book string, chapter int, verse_start int, verse_end int")
    assert [x.passage_id for x in search.citations(r, "john 5:17").collect()] == ["p"]
    assert search.citations(r, "???").count() == 0


def test_scored_search_orders_ties_by_id(spark):
    df = spark.createDataFrame([("b", "t", "x x"), ("a", "t", "x x"), ("c", "x", "y"), ("d", None, None)], "id string, source_title string, text string")
    assert [(r.id, r.score) for r in search.scored(df, "X", 9).collect()] == [("c", 100), ("a", 2), ("b", 2)]


def test_labels_and_ladder(spark):
    rules = [("one", ["a"]), ("two", ["b"]), ("three", ["zz"])]
    df = spark.createDataFrame([("b a", None), ("b b a", ["kept"])], "text string, themes array<string>")
    assert [r.themes for r in tagging.tag_untagged(df, rules).collect()] == [["one", "two"], ["kept"]]
    steps = [(0, "none"), (10, "slight"), (25, "some")]
    got = spark.range(1).select(*(tagging.ladder(F.lit(x), steps, "none").alias(f"c{x}") for x in (0, 9, 10, 25, 99))).first()
    assert tuple(got) == ("none", "none", "slight", "some", "some")


def test_review_keeps_themes_without_a_rule(spark):
    df = spark.createDataFrame([("mercy", ["grace", "war"]), ("tea", ["grace"])], "text string, themes array<string>")
    got = tagging.review(df, {"grace": ["mercy"], "war": ["battle"]}, "general").collect()
    assert [r.reviewed for r in got] == [["grace"], ["general"]]


def test_registry_gate_finds_each_fault(spark):
    w = spark.createDataFrame([("w1", ["p1"]), ("w1", ["p2"]), ("w2", ["p1"]), ("w3", ["gone"])], "id string, passage_ids array<string>")
    p = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "id string")
    assert sorted(map(tuple, registry.registry_gate(w, p).collect())) == [("empty-work", "w3"), ("loose-passage", "p3"), ("repeated-work", "w1"), ("shared-passage", "p1")]


def test_write_is_refused_while_there_are_violations(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "id string")
    assert io.write_if_sound(df, df, f"file://{tmp_path}/no") == 1 and not (tmp_path / "no").exists()
    assert io.write_if_sound(df, df.limit(0), f"file://{tmp_path}/yes") == 0 and (tmp_path / "yes").exists()


def test_json_lines_skip_blank_and_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "a"}\n\n{"id": "b"}\nnot json\n')
    assert sorted(r.id for r in io.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "id string", strict=False).collect()) == ["a", "b"]
    assert io.read_optional(spark, f"file://{tmp_path}/none*", "id string").count() == 0


def test_vectors_from_npz(spark, tmp_path):
    import numpy as np

    np.savez(tmp_path / "e.npz", ids=np.array(["a", "b"]), embeddings=np.array([[3.0, 4.0], [0.0, 0.0]]))
    got = {r.id: r.embedding for r in io.read_vectors(spark, f"file://{tmp_path}").collect()}
    assert [round(x, 4) for x in got["a"]] == [0.6, 0.8] and got["b"] == [0.0, 0.0]


def test_texts_and_exports_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "jx-sermon-1740-on-hope.txt").write_text("Some text.")
    t = io.read_texts(spark, f"file://{tmp_path}/in")
    got = t.select("text", *io.name_metadata(F.col("name"), {"jx": "J. X."})).first()
    assert (got.text, got.author, got.source_type, got.title, got.year) == ("Some text.", "J. X.", "sermon", "On Hope", 1740)
    w = spark.createDataFrame([("w", True)], "id string, open boolean")
    io.write_export(w, w.select("id"), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/works").count() == 1


def test_headings_and_numbers(spark):
    df = spark.createDataFrame([(1, "front\nCHAPTER I\none\nCHAPTER II\ntwo")], "id int, text string")
    got = segment.heading_split(df, "CHAPTER [IVX]+").orderBy("n").collect()
    assert [(r.heading, r.body) for r in got] == [("", "front"), ("CHAPTER I", "one"), ("CHAPTER II", "two")]


def test_empty_tables(spark):
    p = spark.createDataFrame([], io.PASSAGES)
    assert stats.corpus_totals(p).first().passages == 0
    assert stats.theme_histogram(p).count() == 0
    assert segment.greedy_chunks(p).count() == 0
    assert registry.validation(p, ["author"]).count() == 0


def test_incremental_ingest_adds_each_key_once(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"file://{tmp_path}/out"
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int").coalesce(1).write.parquet(src)
    for n in range(2):
        stream = feeds.read_stream(spark, src, "k string, v int")
        feeds.ingest_new(stream, out, "k", lambda df: df, f"{tmp_path}/check{n}").awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_materialised_tables_live_in_the_shared_folder(spark):
    df = session.materialise(spark.range(5).toDF("n"), "test")
    assert df.count() == 5 and session.shared_dir(spark).split("file://")[1] in df.inputFiles()[0]


def test_stems_elisions_and_substitutions(spark):
    from corpusloom.operators import repair

    dictionary = spark.createDataFrame([("walk",), ("carry",), ("love",), ("stop",), ("sin",), ("fin",), (None,)], "word string")
    words = spark.createDataFrame([("walked", 1), ("carries", 1), ("loving", 1), ("stopped", 1), ("zzing", 1), ("walk", 1)], "word string, n long")
    got = {r.word: r.stem for r in repair.regular_inflections(words, dictionary).collect()}
    assert got == {"walked": "walk", "carries": "carry", "loving": "love", "stopped": "stop"}
    el = spark.createDataFrame([("lov'd",), ("'tis",), ("cat",)], "w string").select(repair.elided(F.col("w")).alias("x")).collect()
    assert [r.x for r in el] == [["lovd", "lovad", "loved", "lovid", "lovod", "lovud"], [], []]
    d2 = spark.createDataFrame([("sense",), ("fat",)], "word string")
    subs = repair.substitutions(spark.createDataFrame([("fenfe", 2), ("fat", 9), ("fog", 1)], "word string, n long"), d2)
    assert [tuple(r) for r in subs.select("garble", "fix", "n", "ambiguous").collect()] == [("fenfe", "sense", 2, False)]


def test_wording_and_loose_places(spark):
    from corpusloom.operators import repair

    assert repair.nearest_wording("a b c the old mill stood d e", "the old mill stood") == 1.0
    assert repair.nearest_wording("", "x") == 0.0 and repair.nearest_wording("ab", "xy") == 0.0
    assert repair.locate_loosely("He  came- to\nWhit-by.", "to whitby") == 10 and repair.locate_loosely("abc", "zz") == -1
    df = spark.createDataFrame([("the O-ld mill", "old"), (None, "x")], "text string, w string")
    assert [r.offset for r in repair.located(df, "text", "w").collect()] == [4, -1]


def test_ingest_and_api(spark, tmp_path):
    from corpusloom.api import Corpus, register_encoder
    from corpusloom.operators import ingest

    texts = spark.createDataFrame([("s1", "A", "sermon", "T", 1740, "word " * 450), ("h1", "A", "hymn", "H", 1741, "1. One\n\n2. Two"), ("e", "A", "sermon", "E", 1742, " ")], "source_id string, author string, source_type string, title string, year int, text string")
    rows = ingest.passages(texts, [("w", ["word"])])
    got = {r.id: (r.word_count, r.themes) for r in rows.collect()}
    assert got["h1-stanza-01"] == (1, []) and got["s1-000"][1] == ["w"] and sum(r.source_id == "e" for r in rows.collect()) == 0
    assert ingest.new_only(rows, spark.createDataFrame([("s1",)], "source_id string")).where("source_id = 's1'").count() == 0
    assert {r.source_id for r in ingest.log(rows).collect()} == {"s1", "h1"}
    rows.withColumn("created_at", F.lit("2024")).write.parquet(f"{tmp_path}/passages.parquet")
    c = Corpus(spark, str(tmp_path))
    assert c.search("two").count() == 1 and c.stats().first().passages == rows.count() and c.theme("w").count() > 0
    register_encoder("length", lambda ts: [[float(len(t))] for t in ts])
    assert c.encode(c.passage("h1-stanza-02"), "text", "length").first().embedding == [3.0]


def test_a_quote_is_found_wherever_it_begins():
    import difflib
    import random

    from corpusloom.operators import repair

    rng = random.Random(3)
    quote = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(16)]
    for before in range(8):
        for after in (0, 1, 5):
            text = " ".join(["x"] * before + quote + ["y"] * after)
            assert repair.nearest_wording(text, " ".join(quote)) == 1.0
    assert repair.nearest_wording("so “" + " ".join(quote) + ".” he said", " ".join(quote)) == 1.0
    for _ in range(40):
        q, t = ([rng.choice("abcde") for _ in range(rng.randrange(1, n))] for n in (9, 30))
        if " ".join(q) not in " ".join(t):
            ratio = lambda x, y: difflib.SequenceMatcher(None, x, y, False).ratio()
            starts = range(max(1, len(t) - len(q) + 1))
            nearest = max(ratio(t[k : k + len(q)], q) for k in starts)
            allowed = [ratio(" ".join(t[k : k + len(q)]), " ".join(q)) for k in starts if ratio(t[k : k + len(q)], q) == nearest]
            assert repair.nearest_wording(" ".join(t), " ".join(q)) in allowed


def test_suffixes_go_on_after_z_and_no_event_of_a_busy_day_is_left_out(spark, tmp_path):
    from corpusloom.plans import catalogue

    events = spark.range(1, 801).selectExpr("id AS event_id", "CAST(7 AS BIGINT) AS user_id", "TIMESTAMP '2026-01-05 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = {r.seq: r.suffix for r in catalogue.queries()["same_day_suffix"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(1, 801))
    assert [got[k] for k in (1, 2, 20, 26, 27, 28, 52, 53, 702, 703)] == ["", "b", "t", "z", "aa", "ab", "az", "ba", "zz", "aaa"]
