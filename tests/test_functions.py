import datetime
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import dates
from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import segment


def one(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in columns.items()))
    return df.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("text,n", [("", 0), ("   ", 0), (" a b ", 2), ("a b　c", 3), (None, 0), ("one\n\ntwo\tthree", 3)])
def test_word_count_splits_at_any_white_space(spark, text, n):
    assert one(spark, T.word_count(F.col("t")), t=text) == n


def test_overlapping_and_plain_counts(spark):
    assert one(spark, T.overlapping_count(F.col("t"), "aa"), t="aaaa") == 3
    assert one(spark, T.count_literal(F.col("t"), "aa"), t="aaaa") == 2
    assert one(spark, T.phrase_offsets(F.col("t"), "aa"), t="aaaa") == [0, 1, 2]
    assert one(spark, T.phrase_offsets(F.col("t"), "zz"), t="aaaa") == []


def test_literals_with_regex_characters(spark):
    assert one(spark, T.count_literal(F.col("t"), "a.b\\E("), t="a.b\\E( a.b\\E(") == 2


def test_highlight_escapes_and_marks(spark):
    assert one(spark, T.highlight(F.col("t"), ["éan", "x"]), t="<Éan> & x") == "&lt;<mark>Éan</mark>&gt; &amp; x"


def test_context_and_snippets(spark):
    assert one(spark, T.context(F.col("t"), "MID", 3), t="beginning mid ending") == "...ng mid en..."
    assert one(spark, T.context(F.col("t"), "zz", 3), t="abc") is None
    assert one(spark, T.snippet(F.col("t"), 9), t="one  two\nthree") == "one two…"
    assert one(spark, T.truncate(F.col("t"), 10), t="abcdefgh ijk lmn") == "abcdefgh i..."


def test_artifact_density(spark):
    assert one(spark, T.artifact_density(F.col("t")), t="") == 1.0
    assert one(spark, T.artifact_density(F.col("t")), t="ab~~") == 0.5


def test_html_is_stripped(spark):
    assert one(spark, T.strip_html(F.col("t")), t="<p>a<script>x<y</script> <b>b</b></p>") == "a b"


@pytest.mark.parametrize("n,v", [("iv", 4), ("XLII", 42), ("mcmxc", 1990), ("xviii", 18)])
def test_roman_numerals(spark, n, v):
    assert one(spark, T.roman_value(F.col("t")), t=n) == v


def test_nfkc_and_cleaning(spark):
    assert one(spark, T.nfkc(F.col("t")), t="ﬁne ①") == "fine 1"
    assert one(spark, T.nfkc(F.col("t")), t=None) is None
    assert one(spark, T.clean_page_text(F.col("t")), t="A HEADER\nsome com-\nmon text\n 12 \nends") == "some common text\nends"
    assert one(spark, T.clean_scan_text(F.col("t"), {"tbe": "the"}), t="tbe cat\n---\n~ tbe") == "the cat the"


def test_rules_are_counted_before_their_own_step(spark):
    rules = [("a", "b"), ("b", "c")]
    assert one(spark, T.rule_hits(F.col("t"), rules), t="aab") == [2, 3]
    assert one(spark, T.rule_fold(F.col("t"), rules), t="aab") == "ccc"


def test_ngrams_of_short_arrays_are_empty(spark):
    assert one(spark, T.ngrams(F.split("t", " "), 3), t="a b") == []
    assert one(spark, T.ngrams(F.split("t", " "), 2), t="a b c") == ["a b", "b c"]


def test_natural_order(spark):
    df = spark.createDataFrame([("s-10",), ("s-9",), ("s-100",)], "id string")
    assert [r.id for r in df.orderBy(T.natural_key(F.col("id"))).collect()] == ["s-9", "s-10", "s-100"]


def test_known_weekdays(spark):
    assert one(spark, dates.weekday(F.col("y"), F.col("m"), F.col("d")), y=1738, m=5, d=24) == 2
    assert one(spark, dates.weekday(F.col("y"), F.col("m"), F.col("d")), y=1752, m=9, d=14) == 3
    assert one(spark, dates.valid(F.col("y"), F.col("m"), F.col("d")), y=1700, m=2, d=29) is True
    assert one(spark, dates.valid(F.col("y"), F.col("m"), F.col("d")), y=1900, m=2, d=29) is False


def test_gregorian_days_follow_the_calendar(spark):
    days = [datetime.date(1753, 1, 1) + datetime.timedelta(days=97 * k) for k in range(400)]
    df = spark.createDataFrame([(d.year, d.month, d.day, d.weekday()) for d in days], "y int, m int, d int, w int")
    assert df.where(dates.weekday(F.col("y"), F.col("m"), F.col("d")) != F.col("w")).count() == 0


def test_vectors_guard_zero(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [4.0, 3.0])], "id int, v array<double>")
    top = V.top_k(df, F.lit([3.0, 4.0]), "v", "id", 3).collect()
    assert [r.id for r in top] == [1, 3, 2] and math.isclose(top[1].similarity, 0.96) and top[2].similarity == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "c.", "d!"]), min_size=0, max_size=60), max_size=8))
def test_chunks_keep_every_word_in_order(paragraphs):
    text = "\n\n".join(" ".join(p) for p in paragraphs)
    chunks = segment.greedy_pack(text, 20)
    words = text.split()
    at = 0
    for c in chunks:
        w = c.split()
        # a chunk continues where the last ended, or repeats the end of it
        back = next(k for k in range(len(words) + 1) if words[at - k : at - k + len(w)] == w)
        at = at - back + len(w)
    assert at == len(words)


def test_chunk_limits():
    assert segment.greedy_pack("") == []
    assert [len(c.split()) for c in segment.greedy_pack("w " * 400)] == [400]
    sentence = "w " * 150 + "end."
    cut = segment.greedy_pack(" ".join([sentence] * 5), 400)
    assert all(len(c.split()) <= 400 for c in cut) and cut[1].startswith("w")


def test_anchors_are_searched_in_order():
    assert segment.ordered_anchors("b a b", ["a", "b", "zz"]) == [2, 4, -1]
