"""Dense vectors as arrays, in double precision; a zero vector has similarity 0 with everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def centroids(df: DataFrame, key: str, vector: str, label: str = "centroid") -> DataFrame:
    """(key, centroid): the mean of each key's vectors at length 1, as one array."""
    parts = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("pos", "v"))
    mean = parts.groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    whole = mean.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("m"))
    return whole.select(key, normalise(F.col("m")).alias(label))


def mean_vector(df: DataFrame, vector: str, label: str = "centroid") -> DataFrame:
    """One row: the mean of all vectors at length 1."""
    return centroids(df.select(F.lit(0).alias("_k"), vector), "_k", vector, label).select(label)


def member_centroids(vectors: DataFrame, members: DataFrame, key: str, group: str, vector: str, label: str = "centroid") -> DataFrame:
    """(group, centroid) over the vectors of each group's members (key, group): an inner join, members without a vector left out."""
    return centroids(members.select(key, group).dropna().distinct().join(vectors.select(key, vector), key), group, vector, label)


#: How many centroids go along with the rows as one array; more are met in blocks of this many.
BLOCK = 2048


def nearest(df: DataFrame, id_col: str, vector: str, groups: DataFrame, group: str, centroid: str, k: int = 1, block: int = BLOCK) -> DataFrame:
    """(id, place, group, similarity): the k nearest groups of each row; equal similarities by group.

    The groups are a stated set held against all rows. They are numbered and taken in
    blocks; the rows meet each block as one broadcast row, and keep k of it.
    """
    numbered = groups.select(group, centroid).withColumn("_b", F.floor((F.row_number().over(Window.orderBy(group)) - 1) / block))
    blocks = numbered.groupBy("_b").agg(F.sort_array(F.collect_list(F.struct(F.col(group).alias("g"), F.col(centroid).alias("c")))).alias("_all"))
    met = df.where(F.col(vector).isNotNull()).select(id_col, vector).join(F.broadcast(blocks))
    scored = F.transform("_all", lambda s: F.struct((-cosine(F.col(vector), s["c"])).alias("far"), s["g"].alias("g")))
    few = met.select(id_col, F.slice(F.array_sort(scored), 1, k).alias("_best"))
    best = few.groupBy(id_col).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_best"))), 1, k).alias("_best"))
    return best.select(id_col, F.posexplode("_best").alias("p", "b")).select(id_col, (F.col("p") + 1).alias("place"), F.col("b.g").alias(group), (-F.col("b.far")).alias("similarity"))


def semantic_score(df: DataFrame, id_col: str, vector: str, overall: Column) -> DataFrame:
    """(id, score): similarity with the overall mean vector as a whole number from 0 to 100; 0 for a missing vector."""
    sim = F.when(F.col(vector).isNull(), F.lit(0.0)).otherwise(cosine(F.col(vector), overall))
    return df.select(id_col, F.when(F.col(vector).isNull(), 0).otherwise(similarity_score(sim)).alias("score"))


def top_k(df: DataFrame, query: Column, vector: str, id_col: str, k: int) -> DataFrame:
    """The k most similar rows; equal similarities by id."""
    return df.withColumn("similarity", cosine(F.col(vector), query)).orderBy(F.col("similarity").desc(), id_col).limit(k)


def similarity_score(similarity: Column) -> Column:
    """A cosine on a scale of whole numbers from 0 to 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), similarity * 150 - 5)).cast("int")
