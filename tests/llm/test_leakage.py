import random

from corpusloom.llm import leakage

RNG = random.Random(9)
WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu ne pi".split() for b in "rn st ld mp th sk vel ton mar lin".split()]


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def test_stretches_are_found_and_short_ones_are_not(spark):
    item = text(80)
    w = item.split()
    edited = w[10:50]
    for k in (3, 9, 15, 21, 27, 33, 38):
        edited[k] = "zzz"
    docs = [
        (1, text(300) + " " + item + " " + text(50)),
        (2, text(100) + " " + " ".join(edited) + " " + text(10)),
        (3, text(100) + " " + " ".join(w[20:30]) + " " + text(100)),
        (4, text(200)),
        (5, "x " + " ".join(f"{x} [{k}]" for k, x in enumerate(w[5:45])).upper()),
        (6, text(20) + " " + " ".join(w[:30]).replace(w[8], w[8][:2] + "-\n" + w[8][2:])),
        (7, None), (8, ""), (None, item),
    ]
    d = spark.createDataFrame(docs + [docs[0]], "doc_id bigint, text string")
    items = spark.createDataFrame([("it", item), ("it", item), ("other", text(60)), ("blank", " "), (None, item)], "id string, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, items).collect()}
    assert got == {(1, "it"), (2, "it"), (5, "it"), (6, "it")}


def test_empty_sides(spark):
    d = spark.createDataFrame([(1, text(40))], "doc_id bigint, text string")
    items = spark.createDataFrame([("it", text(40))], "id string, text string")
    assert leakage.leaks(d.limit(0), items).count() == 0
    assert leakage.leaks(d, items.limit(0)).count() == 0


def test_the_aligned_stretch_is_the_brute_force_one():
    import numpy as np

    a = np.arange(10, 60, dtype=np.uint64)
    b = np.concatenate([np.arange(100, 105), a[:20], [999], a[21:40]]).astype(np.uint64)
    window = leakage._window(b, 5 - leakage.SLACK, len(a) + leakage.WIDTH - 1)
    assert leakage.align([a], [window]) == [(39, 40, 40)]


def test_changes_near_the_ends_do_not_shorten_a_stretch(spark):
    items = [(f"it{k}", text(80)) for k in range(6)]
    docs = [(100 + k, text(60)) for k in range(200)]
    for k, changed in enumerate([(2, 7, 12, 17), (0, 5, 10, 15), (4, 9, 14, 19), (1, 18), (0, 1, 18, 19)]):
        part = items[k][1].split()[30:50]
        for j in changed:
            part[j] = f"zz{chr(97 + j)}"
        docs.append((k, text(30) + " " + " ".join(part) + " " + text(30)))
    docs.append((5, text(30) + " " + " ".join(items[5][1].split()[30:44]) + " " + text(30)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, spark.createDataFrame(items, "id string, text string")).collect()}
    assert got == {(k, f"it{k}") for k in range(5)}


def test_turns_of_phrase_are_what_is_kept_while_the_rare_is_changed():
    import numpy as np

    match = np.array([1, 1, 1, 1, 0] * 4, bool)
    rare = np.full(20, 12.0)
    whole = np.lib.stride_tricks.sliding_window_view(match, leakage.SEED).all(axis=1)
    slots = np.where(np.append(whole, [False, False]), 4.0, 12.0)
    assert leakage.phrase(match, slots) and not leakage.phrase(match, rare) and not leakage.phrase(match, rare / 8)
    assert not leakage.phrase(np.ones(20, bool), slots)


def test_a_part_that_leaked_into_a_third_of_the_documents_is_found(spark):
    item = text(100)
    w = item.split()
    docs = [(k, text(60)) for k in range(200)]
    for k in range(100):
        part = w[40:62]
        for j in RNG.sample(range(22), 4) if k % 2 else ():
            part[j] = "zz" + RNG.choice(WORDS)
        docs.append((1000 + k, text(30) + " " + " ".join(part) + " " + text(20)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id for r in leakage.leaks(d, spark.createDataFrame([("it", item)], "id string, text string")).collect()}
    assert {k for k in range(1000, 1100, 2)} <= got and len(got) >= 98 and min(got) >= 1000
