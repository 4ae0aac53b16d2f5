"""The N best items of every group, by descending score bands.

The scored rows are written range-partitioned by score and tie, so that a score that
many rows share is split over tasks, and a band is a run of files whose statistics let the scan skip the rest. From the top band down, rows of
groups that are already full are dropped by an anti-join, and the band's rows fill
what is left of the other groups by exact rank (score descending, tie ascending).
The rank is limited to N before the shuffle (Spark plans a WindowGroupLimit), so a
group that holds a third of all rows sends N rows from each task and no more. Only
rows of groups still open are looked at in the lower bands, and no band is skipped:
the last holds every remaining score.

Null group keys, scores or ties have no rank and are left out; repeated rows count
once; an empty input gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom import session

#: Shares of the scores above each band's lower edge; the last band has the rest.
BANDS = (0.1, 0.4)


def top_n(df: DataFrame, group: list[str], score: str, tie: str, n: int, bands: tuple[float, ...] = BANDS) -> DataFrame:
    """The rows (group..., tie, score) that rank among the first ``n`` of their group."""
    spark = df.sparkSession
    rows = df.select(*group, F.col(tie), F.col(score)).dropna()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scored = session.materialise(rows.repartitionByRange(parts, F.col(score).desc(), F.col(tie)), "topn")
    edges = sorted(set(scored.approxQuantile(score, [1 - b for b in bands], 0.01)), reverse=True)
    rank = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie).asc())
    kept, above = None, None
    for edge in [*edges, None]:
        band = scored
        if edge is not None:
            band = band.where(F.col(score) >= edge)
        if above is not None:
            band = band.where(F.col(score) < above)
        above = edge
        # repeated rows share a rank: dense_rank over (score, tie) counts an item once
        if kept is None:
            best = band.withColumn("_rank", F.dense_rank().over(rank)).where(F.col("_rank") <= n)
        else:
            have = kept.groupBy(*group).agg(F.count("*").alias("_have"))
            full = have.where(F.col("_have") >= n)
            some = have.where(F.col("_have") < n)
            best = band.join(full, group, "left_anti").withColumn("_rank", F.dense_rank().over(rank)).where(F.col("_rank") <= n)
            best = best.join(some, group, "left").where(F.col("_rank") + F.coalesce("_have", F.lit(0)) <= n)
        best = session.materialise(best.select(*group, tie, score).distinct(), "topn-band")
        kept = best if kept is None else kept.unionByName(best)
    return kept


def latest_scores(scores: DataFrame) -> DataFrame:
    """(id, score): each passage's non-null score with the latest ``created_at``; the highest of several at that time.

    A null ``created_at`` is older than any other.
    """
    known = scores.where("passage_id is not null and overall_score is not null")
    return known.groupBy(F.col("passage_id").alias("id")).agg(F.max(F.struct("created_at", "overall_score")).alias("m")).select("id", F.col("m.overall_score").alias("score"))


def top_by_theme(passages: DataFrame, scores: DataFrame, themes: DataFrame, n: int = 3) -> DataFrame:
    """The n best-scored passages for each source and each known theme its passages carry."""
    known = themes.select(F.col("theme_id").alias("theme")).where("theme is not null").distinct()
    carried = passages.select("id", "source_id", F.explode(F.array_distinct("themes")).alias("theme")).dropna().distinct()
    return top_n(carried.join(known, "theme").join(latest_scores(scores), "id"), ["source_id", "theme"], "score", "id", n)
