import random

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import sentences, splitting


def spans(t):
    return sentences.split([t])[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.integers(0, 10_000))
def test_pieces_cover_the_text_within_the_limit(sizes, seed):
    rng = random.Random(seed)
    text = " ".join(" ".join(["Word", *["w"] * (n - 1)]) + "." + rng.choice(["", "\n\n"]) for n in sizes)
    out, forced = splitting.pieces(text, spans(text), 50, 400)
    assert out[0][0] == 0 and out[-1][2] == len(text)
    for (_, _, end), (begin, own, _) in zip(out, out[1:]):
        assert own == end and begin <= own
    if splitting.over(len(text.split()), len(text), 50, 400):
        assert all(len(text[a:b].split()) <= 50 and b - a <= 400 for a, _, b in out)
        assert forced == any(n > 50 for n in sizes)


def test_overlap_repeats_the_last_sentence():
    text = " ".join(f"Sentence number {k} has seven words here." for k in range(100))
    out, forced = splitting.pieces(text, spans(text))
    assert not forced and len(out) > 1
    for (_, _, end), (begin, own, _) in zip(out, out[1:]):
        assert text[begin:own].strip().startswith("Sentence number") and text[begin:own].strip().endswith("here.") and own == end


def test_paragraph_ends_are_kept_over_sentence_ends():
    a = " ".join("Some words stand here now." for _ in range(50))
    text = a + "\n\n" + a
    out, _ = splitting.pieces(text, spans(text), 300, 3000)
    assert [own for _, own, _ in out][1] == len(a) + 2


def test_one_huge_sentence_or_word():
    for text in ("w " * 1000, "x" * 7000):
        out, forced = splitting.pieces(text, spans(text))
        assert forced and all(len(text[a:b].split()) <= 400 and b - a <= 3000 for a, _, b in out) and out[-1][2] == len(text)


def test_tables(spark):
    sound = [(f"s{k}", f"The mill stood by the old river number {k}, and nobody came to it before morning. " * 3, "On Hope", 5) for k in range(60)]
    long = " ".join(f"Sentence number {k} has seven words here." for k in range(100))
    rows = [*sound, ("long", long, None, 3), ("long", long, None, 3), ("exact", "w " * 400, None, None), ("wide", "w " * 401, None, 0), ("null", None, None, 9999), ("blank", " ", None, 9999)]
    df = spark.createDataFrame(rows, "id string, text string, source_title string, word_count int")
    assert {tuple(r) for r in splitting.found(df).collect()} == {("long", 0), ("wide", 1)}
    pieces = splitting.split_all(df).where("id = 'long'").orderBy("chunk_index").collect()
    assert [p.chunk_index for p in pieces] == list(range(len(pieces))) and all(p.word_count <= 400 for p in pieces)
    assert splitting.found(df.limit(0)).count() == 0 and splitting.split_all(df.limit(0)).count() == 0
