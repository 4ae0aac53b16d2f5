import itertools
import random
import re

import pytest

from corpusloom.llm import neardup


def jaccard_pairs(rows, threshold):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if i is not None and len(w) >= 20:
            sets[i] = set(zip(w, w[1:], w[2:]))
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        words = rng.choices(vocabulary, k=rng.randint(25, 120))
        rows.append((f"d{k:03d}", " ".join(words)))
        for e in range(rng.choice([0, 0, 1, 2])):
            edited = list(words)
            for _ in range(rng.randint(0, 4)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append((f"d{k:03d}-{e}", ", ".join(edited).upper()))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id string, text string")
    got = {tuple(r) for r in neardup.pairs(df).collect()}
    assert got == jaccard_pairs(rows, 0.5) and len(got) > 20


def test_nulls_blanks_short_texts_repeats_and_other_columns(spark):
    long = " ".join(f"word{k}" for k in range(40))
    rows = [("a", long, 1), ("b", long + " more", 2), ("b", long + " more", 3), (None, long, 4), ("c", None, 5), ("d", "", 6), ("e", "too short", 7), ("f", "too short", 8)]
    df = spark.createDataFrame(rows, "id string, text string, cls int")
    assert [tuple(r) for r in neardup.pairs(df).collect()] == [("a", "b")]
    groups = {r.id: (r.group_id, r.n_links) for r in neardup.groups(df, 0.8).collect()}
    assert groups == {"a": ("a", 1), "b": ("a", 1), "c": ("c", 0), "d": ("d", 0), "e": ("e", 0), "f": ("f", 0)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert neardup.pairs(df).count() == 0 and neardup.groups(df).count() == 0


def test_a_hot_group_of_copies_is_one_class(spark):
    long = " ".join(f"word{k}" for k in range(40))
    df = spark.createDataFrame([(f"c{k:04d}", long) for k in range(300)] + [("z", long + " x y")], "id string, text string")
    got = neardup.groups(df, 0.8).collect()
    assert len(got) == 301 and {r.group_id for r in got} == {"c0000"} and {r.n_copies for r in got if r.id != "z"} == {299}
    pairs = {tuple(r) for r in neardup.pairs(df).collect()}
    # a star around the smallest id, which also stands for the class beside the other text
    assert len(pairs) == 299 + 1 and ("c0000", "c0299") in pairs and ("c0000", "z") in pairs


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_hot_keys_are_joined_in_cells_without_loss(spark, block):
    import pyspark.sql.functions as F

    rng = random.Random(block)
    rows = [(k, [1 if rng.random() < 0.7 else 2, rng.randint(3, 9)]) for k in range(60)] + [(5, [1, 4])]
    signed = spark.createDataFrame(rows, "cls long, keys array<long>")
    keys = {}
    for c, ks in rows:
        keys.setdefault(c, set()).update(ks)
    want = {(a, b) for a in keys for b in keys if a < b and keys[a] & keys[b]}
    got = neardup._candidates(signed, block).select(F.struct("a", "b").alias("p")).collect()
    assert {tuple(r.p) for r in got} == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(100, 101)], "a long, b long")
    roots = {r.node: r.root for r in neardup.components(links).collect()}
    assert {roots[k] for k in range(21)} == {0} and roots[101] == roots[100] == 100


@pytest.mark.parametrize("text", ["x " * 200_000, "one two " * 10])
def test_very_long_and_repetitive_texts(text):
    has, cls, keys, trace = neardup.signatures([text, text + " end"])
    assert len(has) == 2 and keys.shape == (2, neardup.BANDS)


def test_same_rows_as_sql(spark):
    from corpusloom.llm import queries
    from tests.compare import DATA, database, rows

    got = queries.queries()["p4_found"](spark, DATA).toPandas()
    assert rows(got) == rows(database().execute(queries.oracle_sql()["p4_found"]).df())


def stock(n=240):
    """Texts made of the same phrases, with a few near-duplicates: many share a key, few are alike."""
    rng = random.Random(8)
    phrases = [" ".join(rng.choices([f"v{k}" for k in range(300)], k=6)) for _ in range(24)]
    rows = [(f"s{k:03d}", " ".join(rng.sample(phrases, 5))) for k in range(n)]
    return rows + [(f"{i}-e", t + " one more") for i, t in rows[::12]]


@pytest.mark.parametrize("verified", [1 << 23, 100])
def test_pairs_that_share_phrases_are_ruled_out_before_they_are_written(spark, monkeypatch, verified):
    monkeypatch.setattr(neardup, "VERIFIED", verified)
    df = spark.createDataFrame(stock(), "id string, text string").repartition(3)
    signed = neardup.classes(df)
    every, thinned = ({tuple(r) for r in neardup._candidates(signed, 20, least).collect()} for least in (0, 60))
    assert thinned == {tuple(r) for r in neardup._candidates(signed, 1000, 60).collect()}
    assert thinned < every and len(thinned) * 5 < len(every)
    assert {tuple(r) for r in neardup.pairs(df).collect()} <= jaccard_pairs(stock(), 0.5)
    assert {(a, a + "-e") for a, _ in stock()[:240:12]} <= {tuple(r) for r in neardup.pairs(df).collect()}


def test_links_leave_next_to_no_shuffle_files(spark):
    def files():
        every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(f): f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(every) if "shuffle_" in str(f)}

    df = spark.createDataFrame(stock(), "id string, text string")
    signed = neardup.classes(df)
    before = files()
    assert neardup.class_links(df, signed).schema.names == ["a", "b", "similarity"]
    left = sum(n for f, n in files().items() if f not in before)
    assert left < 30_000, left  # counts leave a few bytes a task; 149,841 bytes were left before


@pytest.mark.parametrize("held", [4, 1 << 18])
def test_keys_that_come_in_batches(monkeypatch, held):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(neardup, "HELD", held)
    rng = random.Random(held)
    rows = [(rng.choice([1, 1, 2, 3, 4, 5, 6]), rng.randint(-20, 20)) for _ in range(90)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([c for _, c in part]), pa.array([np.int64(c).tobytes() for _, c in part], pa.binary())], names=["key", "cls", "trace"])
    out = pa.Table.from_batches(list(neardup._few(0, 10)([batch(rows[k : k + 7]) for k in range(0, 90, 7)]))).to_pylist()
    classes = {k: sorted({c for q, c in rows if q == k}) for k in range(1, 7)}
    assert {(r["a"], r["b"]) for r in out if r["a"] is not None} == {p for c in classes.values() if len(c) <= 10 for p in itertools.combinations(c, 2)}
    left = {(r["key"], r["cls"]) for r in out if r["key"] is not None}
    assert left == {(k, c) for k, own in classes.items() if len(own) > 10 for c in own} and left
    assert all(np.frombuffer(r["trace"], np.int64)[0] == r["cls"] for r in out if r["key"] is not None)
