"""Session helpers: reading tables, the shared folder, shipping code to executors.

Nothing here keeps state on a single machine: intermediate tables are written to
the folder named by ``spark.checkpoint.dir`` (shared by all executors), so that a
lost executor never loses a result.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting that deletes an execution's shuffle files at its end.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The table's Parquet files, projected to ``columns`` (all when none are named)."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Set by the cluster; a default only where unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "corpusloom-shared")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def materialise(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    ``clean``: delete the shuffle files of the write as it ends; nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN)
    if clean:
        spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.set(CLEAN, before)
    _note(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(spark: SparkSession) -> None:
    """Delete the tables this session wrote with :func:`materialise`."""
    jvm = spark.sparkContext._jvm
    for path in getattr(spark.sparkContext, "_corpusloom_tables", []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    spark.sparkContext._corpusloom_tables = []


def _note(spark: SparkSession, path: str) -> None:
    """Remember a written table; the file system removes it when the session's JVM ends."""
    sc = spark.sparkContext
    sc._corpusloom_tables = [*getattr(sc, "_corpusloom_tables", []), path]
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, p.relative_to(root.parent))
    target = f"{shared_dir(spark).rstrip('/')}/corpusloom-{uuid.uuid4().hex}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path)
    out.write(packed.getvalue())
    out.close()
    fs.deleteOnExit(path)
    sc.addPyFile(target)
    sc._corpusloom_shipped = True
