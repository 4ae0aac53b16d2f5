"""Structured Streaming forms of append logs, incremental ingest, counters and caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom import session
from corpusloom.operators import joins


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every row once, whatever happens to the query in between."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ingest_new(stream: DataFrame, target: str, key: str, prepare: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Prepare and append the rows whose key the target doesn't have yet; a batch that is run again adds nothing.

    The keys that are there stand in a table of their own beside the target (``-keys``), so
    a batch reads keys only and never the target's rows.
    """

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = joins.latest_per_key(prepare(batch), [key], [F.col(key)])
        if _there(spark, f"{target}-keys"):
            fresh = joins.anti(fresh, spark.read.parquet(f"{target}-keys"), key)
        elif _there(spark, target):
            fresh = joins.anti(fresh, spark.read.parquet(target).select(key), key)
        fresh = session.materialise(fresh, "ingest")
        fresh.write.mode("append").parquet(target)
        fresh.select(key).write.mode("append").parquet(f"{target}-keys")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def embed_new(stream: DataFrame, target: str, key: str, text: str, encode: Callable[[DataFrame, str], DataFrame], checkpoint: str) -> StreamingQuery:
    """Vectors of the rows that have none yet: :func:`ingest_new` with an encoder (rows, text column) as its preparation."""
    return ingest_new(stream, target, key, lambda batch: encode(batch, text).select(key, "embedding"), checkpoint)


def first_within(stream: DataFrame, key: list[str], at: str, ttl: str) -> DataFrame:
    """The rows that a cache of the given time to live doesn't answer: the first of each key within ``ttl``."""
    return stream.withWatermark(at, ttl).dropDuplicatesWithinWatermark(key)


def daily_counts(stream: DataFrame, at: str, late: str = "1 day") -> DataFrame:
    """(day, n) per UTC day; rows later than ``late`` behind the newest are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 day")).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "n")


def capped(counts: DataFrame, cap: int) -> DataFrame:
    return counts.withColumn("over_cap", F.col("n") > cap)


def sessions(stream: DataFrame, key: str, at: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(key, begin, end, n) of each run of rows less than ``gap`` apart."""
    w = F.session_window(at, gap)
    return stream.withWatermark(at, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def run_to_table(query_input: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into a table in the shared folder, and read it."""
    spark = query_input.sparkSession
    base = f"{session.shared_dir(spark).rstrip('/')}/stream-{name}-{spark.sparkContext.applicationId}-{abs(hash(query_input))}"
    if mode == "append":
        q = query_input.writeStream.format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/check").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    else:

        def step(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/data")

        q = query_input.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/check").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    session._note(spark, base)
    return spark.read.schema(query_input.schema).parquet(f"{base}/data")
