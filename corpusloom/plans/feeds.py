"""Structured Streaming queries, each run over all that is there into a table and compared with its batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.plans.book import query
from corpusloom.streaming import feeds


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = session.read(spark, d, "events").schema
    # a streaming source reads a folder; the pattern keeps it to the one table
    path = f"{d}/events.parquet"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_dir = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if is_dir else reader.option("pathGlobFilter", "events.parquet").parquet(d)


@query("SELECT event_id, user_id, event_type FROM events")
def stream_append_log(spark: SparkSession, d: str) -> DataFrame:
    return feeds.run_to_table(_events(spark, d).select("event_id", "user_id", "event_type"), "log")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def stream_daily_counter(spark: SparkSession, d: str) -> DataFrame:
    counts = _events(spark, d).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "n")
    return feeds.run_to_table(counts, "daily", "complete")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
s AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, k AS nth, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user (batch form of the streaming session window), numbered in order."""
    from pyspark.sql.window import Window

    s = session.read(spark, d, "events", "user_id", "ts").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("w.start")).alias("nth"), "n")


@query("SELECT event_id, len(event_type) AS size, count(*) AS n FROM events GROUP BY event_id, event_type")
def stream_new_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of new rows by a stand-in encoder; the same stream run once more finds nothing new."""
    base = f"{session.shared_dir(spark).rstrip('/')}/embedded-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    session._note(spark, base)
    session._note(spark, f"{base}/vectors-keys")
    encode = lambda df, text: df.withColumn("embedding", F.array(F.length(text).cast("float")))
    for run in ("first", "again"):
        feeds.embed_new(_events(spark, d).select("event_id", "event_type"), f"{base}/vectors", "event_id", "event_type", encode, f"{base}/check-{run}").awaitTermination()
    stored = spark.read.parquet(f"{base}/vectors")
    return stored.groupBy("event_id", F.col("embedding")[0].cast("int").alias("size")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL")
def stream_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """What a cache that lives as long as the stream doesn't answer: the first row of each key."""
    misses = feeds.first_within(_events(spark, d).where("user_id is not null").select("user_id", F.col("ts").cast("timestamp").alias("ts")), ["user_id"], "ts", "3650 days")
    return feeds.run_to_table(misses, "misses").select("user_id")
