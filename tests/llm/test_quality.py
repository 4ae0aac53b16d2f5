import numpy as np
import pytest

from corpusloom.llm import quality
from tests.llm import held_out_structures as written


def kind(t):
    return quality.verdicts([quality.describe(t)])[0][0]


@pytest.mark.parametrize("text,want", [
    ("The shepherd went home in the evening, and his wife asked him where he had been. He told her that the road was long.", "prose"),
    ("How quiet is the field at dawn,\nHow soft the morning light;\nThe shepherd wakes, and he is gone\nBefore the end of night.", "prose"),
    ("La viuda visitó al juez con paciencia y dejó la casa. ¿Por qué vino el molinero a la puerta?", "prose"),
    ("牧师安慰了病人。为什么士兵离开了村里的孩子？会众说：“我探望了邻舍。”", "prose"),
    ("Anger, 4, 19\nBread, 7\nCandle, 88, 91, 130\nDuty, 12\nEvil, 5, 77", "list"),
    ("• two brass lamps\n• 7 iron pots;\n• one old table,\n• 4 chairs", "list"),
    ("Leeds      12   44   7\nHull      101   20   9\nYork       33    8   1\nDerby      54   90  12", "table"),
    ("Town | Men | Women\nLeeds | 12 | 14\nHull | 9 | 30\nYork | 40 | 41", "table"),
    ("a91f0c 77be21 0c9d3e ff1a20 9b8c7d 1e2f3a 4b5c6d 7e8f90 0a1b2c 3d4e5f", "junk"),
    ("Home | Login | Search\nShare »\nMenu\nNext page\nBack to top\nPrint »\nLogin", "junk"),
    ("", "blank"), (" \n ", "blank"),
])
def test_verdicts(text, want):
    assert kind(text) == want


def test_divergence_is_zero_for_equal_and_one_for_disjoint():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.0, 1.0])
    assert quality.divergence(p[None], p)[0] == 0 and abs(quality.divergence(p[None], q)[0] - 1) < 1e-12


def test_statistics_of_rows(spark):
    rows = [("a", "The end of it.", 9), ("a", "The end of it.", 9), ("b", None, None), ("c", "", 3), (None, "x", 1)]
    df = spark.createDataFrame(rows, "id string, text string, word_count int").withColumnRenamed("none", "none")
    got = {r.id: r for r in quality.statistics(df).collect()}
    a = got["a"]
    assert (a.n_words, a.stated_words, a.stated_excess) == (4, 9, 5) and abs(a.mean_word_length - 11 / 4) < 1e-9 and a.punctuated_line_share == 1 and a.common_word_share == 0.75
    assert got["b"].verdict == "blank" and got["c"].n_words == 0
    assert quality.statistics(df.limit(0)).count() == 0 and quality.found(df).count() == 0


def test_found_counts_an_id_once(spark):
    t = "Anger, 4, 19\nBread, 7\nCandle, 88, 91, 130\nDuty, 12\nEvil, 5, 77"
    df = spark.createDataFrame([("a", t, "clash"), ("a", t, "clash"), ("b", "word " * 300_000, "")], "id string, text string, kind string")
    assert ("a", "list") in [tuple(r) for r in quality.found(df).collect()]


@pytest.mark.parametrize("token", ["a" * 5000 + "|", "x.y" * 3000 + "!", "-" * 5000])
def test_long_tokens_take_no_time(token):
    quality.word_kind(token)


@pytest.mark.parametrize("rows", [written.FIRST, written.SECOND])
def test_texts_written_without_the_tables(rows):
    assert sum(kind(t) == k for k, t in rows) >= len(rows) - 1


def test_function_words_count_for_the_language_of_the_text():
    words, *_, language, _ends = quality.describe("Der alte Müller ging mit seiner Frau in die Stadt und kaufte ein Brot für die Kinder.")
    assert quality.LANGUAGES[language] == "de" and words[0] >= 7
    assert quality.describe("Vanhus meni poikansa kanssa torille")[6] == -1
    # a word of another language only is a plain word here
    assert quality.describe("The miller and the weaver of the town were in the house und")[0][1] >= 1


def test_repetition_is_no_prose_and_refrains_are():
    assert kind("sing with us tonight " * 20) == "junk"
    verse = "The night is long, the road is cold,\nSing on, my soul, sing on;\n{0} the shepherd leaves the fold,\nSing on, my soul, sing on."
    assert kind("\n\n".join(verse.format(x) for x in ("At dawn", "At noon", "At eve"))) == "prose"
