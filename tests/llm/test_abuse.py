import pytest

from corpusloom.llm import abuse
from tests.llm import held_out_abuse as written


def kinds(t):
    return {k for k, _ in abuse.windows(t)}


@pytest.mark.parametrize("text,want", [
    ("You are a stupid idiot and nobody wants you here.", {"abuse"}),
    ("y0u are a st*pid id1ot and nobody wants you here", {"abuse"}),
    ("Go to hell, you worthless a s s h o l e.", {"abuse"}),
    ("SHUT YOUR FILTHY MOUTH, YOU MAGGOT.", {"abuse"}),
    ("All Dunmarians are veeermin and should be driven into the sea.", {"hate"}),
    ("Never trust the Dunmarians, thieving and lying is in their blood.", {"hate"}),
    ("I am so horny tonight, come and ride me.", {"sexual"}),
    ("He warned them of fornication, drunkenness, and every unclean work.", set()),
    ("The bitch had whelped near the barn, and the shepherd kept the litter.", set()),
    ("The ass stood tied by the gate, and the cock crew twice.", set()),
    ("Hell and damnation were all his theme.", set()),
    ("He was the bastard line of an earl.", set()),
    ("The child hung upon her breast.", set()),
    ("We clothed the naked and fed the poor.", set()),
    ("Du bist ein widerliches Arschloch und keiner will dich hier.", {"abuse"}),
    ("Tu es une ordure et personne ne veut de toi.", {"abuse"}),
    ("", set()), ("   ", set()), ("谁探望了众弟兄？", set()),
])
def test_kinds(text, want):
    assert kinds(text) == want


def test_the_automaton_agrees_with_edit_distance():
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    rng = random.Random(4)
    terms = ["maggot", "cretin", "vermin", "idiots", "scumbag"]
    trie = abuse.Trie(terms)
    for _ in range(400):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["x"], [w[k], "a"]])
            if not w:
                w = ["q"]
        w = "".join(w)
        best = min((distance(t, w), t) for t in terms)
        got = trie.nearest(w, 2)
        assert got == ((best[1], best[0]) if best[0] <= 2 else None)


def test_rows_rates_and_empty(spark):
    docs = [(1, "s", "You stupid idiot."), (1, "s", "You stupid idiot."), (2, "s", None), (3, None, ""), (None, "t", "You stupid idiot.")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("abuse", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(7))
    assert [tuple(r) for r in abuse.found(df).collect()] == [(1, "abuse")]
    assert abuse.scores(df).count() == 5
    rates = {r.source: (r.n_docs, r.docs_abuse) for r in abuse.rates(df).collect()}
    assert rates == {"s": (3, 2), None: (1, 0), "t": (1, 1)}
    assert abuse.found(df.limit(0)).count() == 0 and abuse.rates(df.limit(0)).count() == 0


def test_long_text_is_read_to_its_end():
    assert kinds("The mill was quiet. " * 20_000 + "You stupid idiot.") == {"abuse"}


def test_a_degrading_term_said_of_a_people_is_hate_by_itself():
    hate = lambda t: any(kind == "hate" for kind, _ in abuse.windows(t))
    for t in ("All Tronnish are vermin.", "They are subhuman savages.", "The Corvellers were parasites.", "Everyone here knows these foreigners are scum.", "All the Drennish are dogs."):
        assert hate(t), t
    for t in (
        "Mice are vermin.", "The mice ate our corn, they are vermin.", "They are not vermin.", "He said that they are vermin.", "“They are vermin,” said the clerk.",
        "We are worms and vermin before God.", "Those dogs are beasts.", "They are dogs of the hunt.", "The waters were a plague.", "The flea is a parasite.", "Fevers are a disease.",
    ):
        assert not hate(t), t


@pytest.mark.parametrize("text,least,most", [(written.FIRST, 0.9, 0.03), (written.SECOND, 0.9, 0.03), (written.THIRD, 0.68, 0.05)])
def test_sentences_written_without_the_tables(text, least, most):
    rows = written.cases(text)
    bad = [(k, t) for k, t in rows if k]
    assert sum(k in kinds(t) for k, t in bad) >= least * len(bad)
    good = [t for k, t in rows if not k]
    assert sum(bool(kinds(t)) for t in good) <= most * len(good)


def test_fit_stays_near_the_prior_and_learns(spark):
    idiot = abuse.described("You are an idiot.")
    w = abuse.fit([(1.0, idiot)] * 30 + [(0.0, abuse.described("The ass kicked him in the thigh."))] * 30)
    for kind in abuse.KINDS:
        assert (abs(w[kind] - abuse.prior()[kind]) < 1.5).all() and w[kind][0] == abuse.prior()[kind][0]
    docs = spark.createDataFrame([(1, "You are an idiot."), (2, "A fine day."), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "b", None), (3, "a", 0), (9, "a", 1), (None, "a", 1)], "doc_id bigint, rater string, toxic int")
    fitted = abuse.fitted(docs, labels)
    assert [tuple(r) for r in abuse.found(docs, weights=fitted).collect()] == [(1, "abuse")]
    assert (abuse.fitted(docs, labels.limit(0))["abuse"] == abuse.prior()["abuse"]).all()
    assert (abuse.fitted(docs.limit(0), labels)["hate"] == abuse.prior()["hate"]).all()
