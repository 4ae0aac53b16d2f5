import itertools
import random

import numpy as np

from corpusloom.llm import packing


def test_fullest_finds_the_best_sum():
    rng = random.Random(1)
    for _ in range(40):
        sizes = [rng.randint(1, 30) for _ in range(10)]
        counts = np.bincount(sizes, minlength=64)
        got = packing.fullest(47, counts, sorted(set(sizes), reverse=True))
        best = max(s for k in range(11) for c in itertools.combinations(sizes, k) if (s := sum(c)) <= 47)
        assert sum(got) == best and all(got.count(x) <= sizes.count(x) for x in got)


def test_every_item_is_packed_once_within_capacity():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 2049, 3000)
    bins = packing.pack(sizes, 2048)
    fill = np.bincount(bins, sizes)
    assert (bins >= 0).all() and fill.max() <= 2048
    assert len(fill) <= -(-int(sizes.sum()) // 2048) * 1.02 + 1


def test_pack_of_nothing():
    assert len(packing.pack(np.zeros(0, int), 2048)) == 0


def test_containers_divide_only_what_is_too_long(spark):
    rows = [(1, "word " * 5000), (2, "a few words"), (3, None), (4, ""), (5, " "), (6, "same"), (6, "same"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("x", "x")
    got = packing.containers(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.n_tokens for r in sorted(by[1], key=lambda r: r.piece)][:2] == [2048, 2048] and len(by[1]) == 3
    assert all(len(v) == 1 for k, v in by.items() if k in (2, 3, 4, 5)) and len(by[6]) == 2
    assert by[3][0].container is None and by[4][0].container is None and by[5][0].container is not None
    fill = {r.container: r.n_tokens for r in packing.fill_report(packing.containers(df)).collect()}
    assert max(fill.values()) <= 2048


def test_empty_table(spark):
    assert packing.containers(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_fill_report_and_the_number_of_containers(spark):
    rng = np.random.default_rng(5)
    rows = [(k, "word " * int(n)) for k, n in enumerate(rng.integers(1, 3000, 300))]
    packed = packing.containers(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    report = {r.container: r for r in packing.fill_report(spark.createDataFrame(packed)).collect()}
    for c, r in report.items():
        own = [p for p in packed if p.container == c]
        assert (r.n_items, r.n_tokens, r.slack) == (len(own), sum(p.n_tokens for p in own), 2048 - sum(p.n_tokens for p in own))
    least = -(-sum(p.n_tokens for p in packed) // 2048)
    assert least <= len(report) <= least * 1.02 + 1
