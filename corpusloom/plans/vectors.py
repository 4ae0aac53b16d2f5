"""Vector queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.plans.book import query
from corpusloom.session import read

_UNIT = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL)"


@query(f"""
WITH q AS (SELECT v FROM {_UNIT} WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id, round(sim, 4) AS similarity FROM (
  SELECT vec_id, CASE WHEN list_inner_product(u.v, u.v) = 0 THEN 0 ELSE list_inner_product(u.v, q.v) / sqrt(list_inner_product(u.v, u.v) * list_inner_product(q.v, q.v)) END AS sim FROM {_UNIT} u, q)
ORDER BY sim DESC, vec_id LIMIT 20""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings", "vec_id", "embedding").where("embedding is not null")
    q = e.orderBy("vec_id").first()["embedding"]
    return V.top_k(e, F.lit([float(x) for x in q]), "embedding", "vec_id", 20).select("vec_id", F.round("similarity", 4).alias("similarity"))


_CENTROIDS = """
c AS (SELECT label, list(m ORDER BY pos) AS m FROM (
  SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL) GROUP BY label, pos) GROUP BY label)"""


@query(f"""
WITH {_CENTROIDS}, u AS (SELECT label, unnest(range(len(m))) AS pos, unnest(m) / sqrt(list_inner_product(m, m)) AS x FROM c)
SELECT label, CAST(pos AS INT) AS pos, round(x, 4) AS x FROM u""")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    c = V.centroids(read(spark, d, "embeddings", "label", "embedding"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 4).alias("x"))


@query(f"""
WITH {_CENTROIDS}, s AS (SELECT vec_id, c.label, list_inner_product(u.v, c.m) / sqrt(list_inner_product(u.v, u.v) * list_inner_product(c.m, c.m)) AS sim FROM {_UNIT} u, c)
SELECT vec_id, r AS place, label, round(sim, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS r FROM s) WHERE r <= 5""")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's five nearest centroids, which are met in blocks."""
    e = read(spark, d, "embeddings", "vec_id", "label", "embedding").where("embedding is not null")
    c = V.centroids(e, "label", "embedding")
    return V.nearest(e, "vec_id", "embedding", c, "label", "centroid", 5).withColumn("similarity", F.round("similarity", 4))


@query(f"""
WITH m AS (SELECT vec_id, vec_id % 7 AS team FROM embeddings WHERE vec_id % 2 = 0), x AS (SELECT team, pos, avg(x) AS m FROM (SELECT team, unnest(range(len(v))) AS pos, unnest(v) AS x FROM {_UNIT} u JOIN m USING (vec_id)) GROUP BY team, pos),
c AS (SELECT team, list(m ORDER BY pos) AS m FROM x GROUP BY team), g AS (SELECT list(m ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(range(len(v))) AS pos, unnest(v) AS x FROM {_UNIT}) GROUP BY pos))
SELECT team, round(list_inner_product(c.m, g.m) / sqrt(list_inner_product(c.m, c.m) * list_inner_product(g.m, g.m)), 4) AS to_mean FROM c, g""")
def member_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Centroids of groups given by a table of members, and how near each is to the mean of all vectors."""
    e = read(spark, d, "embeddings", "vec_id", "embedding").where("embedding is not null")
    members = e.where("vec_id % 2 = 0").select("vec_id", (F.col("vec_id") % 7).alias("team"))
    c = V.member_centroids(e, members, "vec_id", "team", "embedding").withColumn("mean", V.mean_vector(e, "embedding").scalar())
    return c.select("team", F.round(V.cosine(F.col("centroid"), F.col("mean")), 4).alias("to_mean"))


@query(f"""
WITH g AS (SELECT list(m ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(range(len(v))) AS pos, unnest(v) AS x FROM {_UNIT}) GROUP BY pos))
SELECT vec_id, CAST(trunc(greatest(0, least(100, 150 * round(list_inner_product(v, g.m) / sqrt(list_inner_product(v, v) * list_inner_product(g.m, g.m)), 9) - 5))) AS INT) AS score FROM {_UNIT}, g""")
def semantic_scores(spark: SparkSession, d: str) -> DataFrame:
    """Similarity with the mean of all vectors as a score."""
    e = read(spark, d, "embeddings", "vec_id", "embedding").where("embedding is not null")
    return V.semantic_score(e.withColumn("mean", V.mean_vector(e, "embedding").scalar()), "vec_id", "embedding", F.col("mean"))


@query(f"""
WITH q AS (SELECT v FROM {_UNIT} WHERE vec_id = (SELECT max(vec_id) FROM embeddings)),
s AS (SELECT vec_id, CASE WHEN list_inner_product(u.v, u.v) = 0 THEN 0 ELSE list_inner_product(u.v, q.v) / sqrt(list_inner_product(u.v, u.v) * list_inner_product(q.v, q.v)) END AS sim FROM {_UNIT} u, q ORDER BY sim DESC, vec_id LIMIT 5),
d AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS f FROM documents)
SELECT vec_id, round(sim, 4) AS similarity, CASE WHEN length(f) <= 200 THEN f ELSE regexp_replace(substr(f, 1, 200), ' [^ ]*$', '') || '…' END AS snippet FROM s LEFT JOIN d ON doc_id = vec_id""")
def vector_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors with the beginnings of the documents of their ids."""
    from corpusloom.functions import text as T

    e = read(spark, d, "embeddings", "vec_id", "embedding").where("embedding is not null")
    q = e.orderBy(F.col("vec_id").desc()).first()["embedding"]
    top = V.top_k(e, F.lit([float(x) for x in q]), "embedding", "vec_id", 5)
    docs = read(spark, d, "documents", "doc_id", "text")
    return top.join(docs, F.col("doc_id") == F.col("vec_id"), "left").select("vec_id", F.round("similarity", 4).alias("similarity"), T.snippet(F.col("text"), 200).alias("snippet"))
