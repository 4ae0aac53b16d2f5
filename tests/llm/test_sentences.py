import random

import numpy as np
import pytest

from corpusloom.llm import sentences as S


def split(text, **kw):
    return [text[a:b] for a, b in S.split([text], **kw)[0]]


@pytest.mark.parametrize("text,want", [
    ("One. Two! Three?", ["One.", "Two!", "Three?"]),
    ("Mr. Hale and the Rev. J. P. Stone rode on. He paid £3. 4s. 2d. for it.", ["Mr. Hale and the Rev. J. P. Stone rode on.", "He paid £3. 4s. 2d. for it."]),
    ("It measured 3.5 feet, as in vol. ii. p. 11. The end.", ["It measured 3.5 feet, as in vol. ii. p. 11.", "The end."]),
    ("Bread, salt, etc. Many came. It closed at 7 p.m. Who knew?", ["Bread, salt, etc.", "Many came.", "It closed at 7 p.m.", "Who knew?"]),
    ("“Away with it!” cried the miller. He left.", ["“Away with it!” cried the miller.", "He left."]),
    ("“It is so. We know.” He left.", ["“It is so.", "We know.”", "He left."]),
    ("Alas! the mill is lost. What! shall we go?", ["Alas! the mill is lost.", "What! shall we go?"]),
    ("14. The mill stood. 2. The barn fell.", ["14. The mill stood.", "2. The barn fell."]),
    ("He rested.There were hymns.", ["He rested.", "There were hymns."]),
    ("And yet ... who knows? He wept, and then ... The end.", ["And yet ... who knows?", "He wept, and then ...", "The end."]),
    ("Of Hope\n\nThe mill stood.", ["Of Hope", "The mill stood."]),
    ("„Wer kam?“, fragte er. Am 3. Mai ging Hr. Dr. Bern, usw. z. B. am Tor.", ["„Wer kam?“, fragte er.", "Am 3. Mai ging Hr. Dr. Bern, usw. z. B. am Tor."]),
    ("« Qui vint ? » demanda M. Dor. Il dit : « Je vois. » Fin.", ["« Qui vint ? » demanda M. Dor.", "Il dit : « Je vois. »", "Fin."]),
    ("¿Quién vino? El Sr. Ol dijo: «Vi.» ¡Sí!", ["¿Quién vino?", "El Sr. Ol dijo: «Vi.»", "¡Sí!"]),
    ("Γιατί ήρθε; Ο κ. Βρανάς έφυγε· η χήρα έμεινε.", ["Γιατί ήρθε;", "Ο κ. Βρανάς έφυγε· η χήρα έμεινε."]),
    ("“谁来了？”他问道。他走了；她留下……结束。", ["“谁来了？”他问道。", "他走了；她留下……", "结束。"]),
    ("彼は「来た。」と答えた。終わり！", ["彼は「来た。」と答えた。", "終わり！"]),
    ("لماذا جاء؟ قال د. بر: «نعم.» ثم ذهب؛ وبقي.", ["لماذا جاء؟", "قال د. بر: «نعم.»", "ثم ذهب؛ وبقي."]),
    ("श्री. ओमल आया। “कौन आया?” उसने पूछा॥", ["श्री. ओमल आया।", "“कौन आया?” उसने पूछा॥"]),
    ("ለምን መጣ፧ ሄደ፤ ቀረ።", ["ለምን መጣ፧", "ሄደ፤ ቀረ።"]),
    ("ทหารมา ครูไป", ["ทหารมา", "ครูไป"]),
    ("", []), (" \n\n ", []),
])
def test_boundaries(text, want):
    assert split(text) == want


def test_chunked_scan_equals_the_plain_run():
    rng = random.Random(6)
    symbols = np.array([rng.randrange(len(S.SYMBOLS)) for _ in range(5000)], np.uint8)
    state, want = 0, []
    for s in symbols:
        want.append(bool(S.OUT[state, s]))
        state = S.AFTER[state, s]
    for chunk in (1, 7, 128, 6000):
        assert S.run(symbols, chunk).tolist() == want


def test_a_batch_gives_what_each_text_gives():
    texts = ["One. Two", None, "", "“Open", "Three. Four!", "x " * 1000 + "End. Last."]
    assert S.split(texts) == [S.split([t])[0] for t in texts]


def test_furniture_ends_nothing(spark):
    sound = [(f"s{k}", f"The mill of Ashby stood by the old river number {k}, and nobody came to it before the morning of that day. " * 3, "On Hope") for k in range(120)]
    noisy = ("n", "The miller of Ashby went down to the\n\nON HOPE      245\n\nriver before the dawn and saw the boats\nthat lay there in the morning light. He\nleft.", "On Hope")
    df = spark.createDataFrame([*sound, noisy, noisy, ("z", None, None), (None, "No id.", None)], "id string, text string, source_title string")
    got = [r.end_pos for r in S.found(df, spark.createDataFrame([("n",), ("n",), ("z",)], "id string")).orderBy("end_pos").collect()]
    t = noisy[1]
    assert got == [t.index("light.") + 6, len(t)]
    all_ = S.sentences(df)
    assert all_.where("id = 'n'").count() == 4 and all_.where("id is null").count() == 1
    assert S.sentences(df.limit(0)).count() == 0
