import random

from corpusloom.llm import topn
from tests.compare import DATA, database, rows


def test_ties_repeats_nulls_and_skew(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot"] * 8 + ["a", "b", None]), f"i{k:04d}", rng.choice([None, *range(20)]), "x") for k in range(800)]
    data += data[:100]
    df = spark.createDataFrame(data, "g string, id string, score int, rank string")
    got = {tuple(r) for r in topn.top_n(df, ["g"], "score", "id", 3).collect()}
    want = set()
    for g in ("hot", "a", "b"):
        items = sorted({(-s, i) for x, i, s, _ in data if x == g and s is not None})[:3]
        want |= {(g, i, -s) for s, i in items}
    assert got == want


def test_all_scores_equal_and_empty(spark):
    df = spark.createDataFrame([("g", f"i{k}", 5) for k in range(9)], "g string, id string, score int")
    assert sorted(r.id for r in topn.top_n(df, ["g"], "score", "id", 3).collect()) == ["i0", "i1", "i2"]
    assert topn.top_n(df.limit(0), ["g"], "score", "id", 3).count() == 0


def test_latest_score_counts(spark):
    s = spark.createDataFrame([("p", 9, "2024-01-01"), ("p", 3, "2024-02-01"), ("p", None, "2024-03-01"), ("q", 4, None), (None, 1, "2024-01-01")], "passage_id string, overall_score int, created_at string")
    assert {tuple(r) for r in topn.latest_scores(s).collect()} == {("p", 3), ("q", 4)}


def test_same_rows_as_sql(spark):
    from corpusloom.llm import queries

    got = queries.queries()["p6_found"](spark, DATA).toPandas()
    assert rows(got) == rows(database().execute(queries.oracle_sql()["p6_found"]).df())
