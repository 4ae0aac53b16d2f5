import random
import re
from collections import Counter

import pytest

from corpusloom.llm import scan

VOCABULARY = "the old miller of ashby went down to river before dawn and found boat which his brother had left behind bridge where they waited while evening light was fading over quiet fields near chapel many people came with bread from market house garden window kitchen neighbour shepherd morning weather stranger servant patience mercy kindness".split()


def sentence(rng):
    return " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(8, 18))).capitalize() + "."


@pytest.fixture(scope="module")
def editor():
    rng = random.Random(2)
    rows = [(" ".join(sentence(rng) for _ in range(6)), rng.choice(["On Hope and Fear", "To Mr Hale", "Thornby"])) for _ in range(250)]
    counts = Counter(w for t, _ in rows for w in scan._COUNTED.findall(t))
    counts["fellow-labourer"] = counts["class-meeting"] = 40
    known = scan.with_parts(counts)
    compounds = [("The fellow-labourer came to the class-meeting. " * 3, "Thornby")] * 5
    return scan.Editor(known, scan.train_lines(rows), scan.train_all(rows + compounds, scan.Lexicon(dict(known))))


def cases(editor, text, title="On Hope and Fear"):
    return set(editor.examine(text, title)[0])


def test_cut_words(editor):
    t = "The neigh-\nbour and the shep¬\nherd went to the class-\nmeeting near the chapel."
    assert cases(editor, t) == {("break", t.index("-\nb")), ("break", t.index("¬"))}
    assert editor.repaired(t)[0] == "The neighbour and the shepherd went to the class-meeting near the chapel." or "class- meeting" in editor.repaired(t)[0]


@pytest.mark.parametrize("seen,meant", [("rniller", "miller"), ("6ridge", "bridge"), ("evcning", "evening"), ("wbich", "which"), ("ftranger", "stranger"), ("ga|den", None), ("serv ant", "servant"), ("kindnefs", "kindness"), ("shepherrd", "shepherd"), ("evning", "evening")])
def test_misread_words(editor, seen, meant):
    t = f"They came with the {seen} from the market."
    got = {p for k, p in cases(editor, t) if k == "char"}
    assert got == ({t.index(seen)} if meant else got)
    if meant:
        assert editor.repaired(t)[0] == f"They came with the {meant} from the market."


def test_joins_are_scored_by_the_perceptron(editor):
    assert any(f.startswith("join:") and w for f, w in editor.edit_weights.items()) and any(f.startswith("space:") and w for f, w in editor.edit_weights.items())
    assert editor.cut("neigh", "-", "bour") and editor.cut("shep", "¬", "herd") and not editor.cut("class", "-", "meeting")
    assert editor.torn("serv", "ant", "ant") and not editor.torn("old", "miller", "miller")
    blank = scan.Editor(editor.lex.n, {}, {})
    assert not blank.cut("neigh", "-", "bour") and not blank.torn("serv", "ant", "ant")


def test_long_running_headers_are_furniture(editor):
    header = "ON HOPE AND FEAR" + " " * 70 + "245"
    t = f"the miller went down to the river and\n{header}\nfound the boat which his brother had left"
    assert cases(editor, t) == {("line", t.index("ON HOPE"))}


def test_furniture_and_what_is_not(editor):
    t = "the miller went down to the river and\n\nON HOPE AND FEAR.      245\n\nfound the boat which his brother had\n[Mar. 1784. 235\nleft behind the bridge where they\nB 2\nwaited."
    assert cases(editor, t) == {("line", t.index(x)) for x in ("ON HOPE", "[Mar", "B 2")}
    hymn = "1\nThe quiet fields and garden wait,\nThe shepherd came before the light.\n\n2\nMany people from the market came,\nThe river near the chapel waited."
    assert cases(editor, hymn, "Thornby") == set()
    heading = "Of Mercy and Patience\n\nThe miller went down to the river."
    assert cases(editor, heading) == set()


def test_sound_text_is_unchanged(editor):
    t = "The miller of Ashby went down.\n\nHe found 23 people, the 4th of them in the chapel, p. 5."
    assert editor.repaired(t) == (t, 0)
    assert editor.repaired("") == ("", 0)


def test_held_out_accuracy(editor):
    rng = random.Random(77)
    hit = miss = wrong = 0
    back = {m: s for s, m in scan.CONFUSIONS[:40]}
    for _ in range(300):
        words = sentence(rng)[:-1].lower().split()
        k = rng.randrange(len(words))
        spots = [(m, i) for m in back for i in range(len(words[k])) if words[k].startswith(m, i)]
        if not spots or len(words[k]) < 5:
            continue
        m, i = rng.choice(spots)
        clean = words[k]
        words[k] = clean[:i] + back[m] + clean[i + len(m) :]
        if editor.lex.known(words[k]):
            continue
        text = " ".join(words)
        got = {p for kind, p in cases(editor, text) if kind == "char"}
        at = len(" ".join(words[:k])) + (k > 0)
        hit += at in got
        miss += at not in got
        wrong += len(got - {at})
    assert hit / (hit + miss) > 0.9 and wrong <= 0.05 * hit


def test_tables(spark):
    rng = random.Random(3)
    rows = [(f"s{k}", " ".join(sentence(rng) for _ in range(5)), "On Hope") for k in range(150)]
    noisy = ("n", "The mil-\nler went down to the river before the dawn.", "On Hope")
    df = spark.createDataFrame([*rows, noisy, noisy, ("e", "", None), ("z", None, "t"), (None, "x", None)], "id string, text string, source_title string")
    got = [tuple(r) for r in scan.found(df, spark.createDataFrame([("n",), ("e",), ("z",), ("s1",)], "id string")).collect()]
    assert got == [("n", "break", 7)]
    fixed = {r.id: (r.text, r.n_cases) for r in scan.repaired(df).where("id in ('n', 'z', 's1')").collect()}
    assert fixed["n"] == ("The miller went down to the river before the dawn.", 1) and fixed["z"] == (None, 0) and fixed["s1"] == (rows[1][1], 0)
    empty = df.limit(0)
    assert scan.found(empty, empty.select("id")).count() == 0 and scan.repaired(empty).count() == 0


def test_page_lines_are_put_where_they_are_flagged():
    lines, flags = scan.page_of("The miller went down. " * 20, "On Hope", random.Random(1))
    assert len(lines) == len(flags) and any(flags) and re.sub(r"\s+", " ", " ".join(x for x, f in zip(lines, flags) if not f)).strip() == ("The miller went down. " * 20).strip()


def test_a_word_seen_twice_is_known_however_many_words_there_are(spark):
    from corpusloom.llm import scan

    much = spark.range(60).selectExpr("repeat('the old mill stood ', 20000) AS text")
    few = spark.createDataFrame([("A quorndle came.",), ("The quorndle went.",), ("One sprackle.",)], "text string")
    got = {r.word: r.n for r in scan.word_counts(much.unionByName(few)).collect()}
    assert got["quorndle"] == 2 and got["mill"] == 1_200_000 and "sprackle" not in got
