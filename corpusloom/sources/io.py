"""Readers and writers: JSON lines, CSV, whole texts, vectors, and what is derived from file names."""

from __future__ import annotations

import gzip
import io as _io
import tarfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

PASSAGES = "id string, author string, source_id string, source_title string, source_type string, year int, chunk_index int, text string, word_count int, source_url string, themes array<string>, created_at string, is_full_hymn boolean, stanza_number int"
THEMES = "theme_id string, theme_name string, description string, keywords string"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True) -> DataFrame:
    """One row per line; blank lines are skipped. Malformed lines fail the read, or are skipped if not strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_optional(spark: SparkSession, path: str, schema: str, fmt: str = "json", **options: str) -> DataFrame:
    """The table at ``path``, or an empty one of the schema if nothing is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    if there is None or not len(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; empty fields are null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def with_order(df: DataFrame) -> DataFrame:
    """Adds ``ord``, which follows the order of the rows in the files read."""
    return df.withColumn("ord", F.monotonically_increasing_id())


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, text) of every .txt file below a folder, or matching a pattern."""
    df = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True, recursiveFileLookup=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("name"), F.col("value").alias("text"))


def name_metadata(name: Column, authors: dict[str, str]) -> list[Column]:
    """author, source_type, source_id and title from a file name such as ``prefix-type-1739-some-title``."""
    prefix = F.regexp_extract(name, r"^([a-z]+)-", 1)
    author = F.try_element_at(F.create_map(*(F.lit(x) for pair in sorted(authors.items()) for x in pair)), prefix)
    kind = F.regexp_extract(name, r"^[a-z]+-(sermon|letter|journal|hymn|notes|minutes|treatise)", 1)
    rest = F.regexp_replace(name, r"^[a-z]+-(sermon|letter|journal|hymn|notes|minutes|treatise)-?(\d{4}-)?(\d+-)?", "")
    year = F.regexp_extract(name, r"-(1[678]\d\d)(?:-|$)", 1)
    return [
        F.coalesce(author, F.lit("unknown")).alias("author"),
        F.when(kind == "", "other").otherwise(kind).alias("source_type"),
        name.alias("source_id"),
        F.initcap(F.replace(rest, F.lit("-"), F.lit(" "))).alias("title"),
        F.when(year == "", None).otherwise(year).cast("int").alias("year"),
    ]


def keyword_list(column: Column) -> Column:
    """The trimmed, non-empty parts of a comma list; empty for null."""
    return F.coalesce(F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def dictionary(words: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Distinct lower-case words of the list and the supplement."""
    out = words.select(F.lower("word").alias("word")).where("word is not null and word <> ''")
    if extra:
        out = out.union(words.sparkSession.createDataFrame([(w.lower(),) for w in extra], "word string"))
    return out.distinct()


def read_vectors(spark: SparkSession, path: str, ids: str = "ids", vectors: str = "embeddings") -> DataFrame:
    """(id, embedding) from .npz files that hold an array of ids and a matrix, one task per file, rows at length 1."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with np.load(_io.BytesIO(content), allow_pickle=False) as z:
                    v = z[vectors].astype("float32")
                    n = np.linalg.norm(v, axis=1, keepdims=True)
                    yield pd.DataFrame({"id": z[ids].astype(str), "embedding": list(v / np.where(n == 0, 1, n))})

    return files.mapInPandas(run, "id string, embedding array<float>")


def allowed_url(url: Column) -> Column:
    """An https address with a host name that is neither local nor a number."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & ~host.rlike(r"^(localhost|[\d.]+|\[.*\]|.*\.local)$"), F.lit(False))


def content_type(path: str) -> str:
    kind = {"gz": "application/gzip", "json": "application/json", "txt": "text/plain; charset=utf-8", "md": "text/markdown; charset=utf-8", "csv": "text/csv; charset=utf-8", "xml": "application/xml"}
    return kind.get(urlsplit(path).path.rpartition(".")[2].lower(), "application/octet-stream")


# ---------------------------------------------------------------- sinks


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_export(works: DataFrame, passages: DataFrame, path: str) -> None:
    """Compressed JSON lines of open works and their passages."""
    works.where("open").write.mode("overwrite").option("compression", "gzip").json(f"{path}/works")
    passages.write.mode("overwrite").option("compression", "gzip").json(f"{path}/passages")


def write_if_sound(df: DataFrame, violations: DataFrame, path: str) -> int:
    """Write Parquet unless there are violations; returns how many there are, and writes nothing if any."""
    n = violations.count()
    if n == 0:
        df.write.mode("overwrite").parquet(path)
    return n


def write_reports(df: DataFrame, key: str, text: str, path: str) -> None:
    """One folder of text per key."""
    df.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def markdown_rows(df: DataFrame, columns: list[str], order: list[Column], key: str) -> DataFrame:
    """Per key a Markdown table of its rows in order."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    ordered = F.sort_array(F.collect_list(F.struct("_n", line.alias("line"))))
    return numbered.groupBy(key).agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(ordered, lambda s: s["line"]), "\n")).alias("report"))


def gunzip(content: bytes) -> str:
    return gzip.decompress(content).decode("utf-8")


# ---------------------------------------------------------------- nested documents, lookups, pages

NESTED = "map<string, map<string, array<struct<passage_id: string, source_title: string, author: string, verses: string>>>>"


def read_nested_index(spark: SparkSession, path: str) -> DataFrame:
    """(book, chapter, pos, passage_id, source_title, author, verses) of JSON documents book -> chapter -> entries; chapters as numbers."""
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", NESTED)).alias("book", "chapters"))
    chapters = docs.select("book", F.explode("chapters").alias("chapter", "entries"))
    return chapters.select("book", F.expr("try_cast(chapter as int)").alias("chapter"), F.posexplode("entries").alias("pos", "e")).select("book", "chapter", "pos", "e.*")


def typed_lookup(df: DataFrame, key: str, casts: dict[str, str], keep: dict[str, list[str]] | None = None) -> DataFrame:
    """A keyed lookup out of a table of strings: empty fields null, values cast where they can be, one row a key (the smallest), rows kept by value."""
    for column, values in (keep or {}).items():
        df = df.where(F.col(column).isin(*values))
    typed = df.select(F.col(key), *(F.expr(f"try_cast(nullif(trim(`{c}`), '') as {t})").alias(c) for c, t in casts.items())).where(F.col(key).isNotNull() & (F.col(key) != ""))
    return typed.groupBy(key).agg(F.min(F.struct(*casts)).alias("_m")).select(key, *(F.col(f"_m.{c}").alias(c) for c in casts))


LEXICON = "curated_phrases map<string, array<string>>, top_distinctive array<struct<term: string, count: bigint, distinctiveness: double>>"


def read_lexicon(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((group, phrase), (rank, term, count, distinctiveness)) of a JSON lexicon; both empty if there is none."""
    doc = read_optional(spark, path, LEXICON, multiLine="true")
    phrases = doc.select(F.explode("curated_phrases").alias("group", "phrases")).select("group", F.explode("phrases").alias("phrase"))
    terms = doc.select(F.posexplode("top_distinctive").alias("rank", "t")).select("rank", "t.*")
    return phrases, terms


def stem_title(stem: Column) -> Column:
    """A title from a file name: "sermon-12-on-hope" is "Sermon 12: On Hope", other names are their words with capitals."""
    number, rest = F.regexp_extract(stem, r"^sermon-(\d+)-", 1), F.regexp_replace(stem, r"^sermon-\d+-", "")
    words = lambda c: F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))
    return F.when(number != "", F.concat(F.lit("Sermon "), number.cast("int").cast("string"), F.lit(": "), words(rest))).otherwise(words(stem))


def stem_type(stem: Column) -> Column:
    """The kind of a text from its file name: the first kind named in it, else treatise."""
    kinds = F.regexp_extract(F.lower(stem), r"(sermon|hymn|journal|letter|notes|minutes)", 1)
    return F.when(kinds == "", "treatise").otherwise(kinds)


def body_paragraphs(html: Column, css: str = "bodytext") -> Column:
    """The text of a page's <p> elements of a class: tags taken off, entities resolved, white space collapsed, blank ones dropped."""
    raw = F.regexp_extract_all(html, F.lit(rf'(?is)<p\b[^>]*\bclass="[^"]*\b{css}\b[^"]*"[^>]*>(.*?)</p>'), F.lit(1))

    def plain(p: Column) -> Column:
        p = F.regexp_replace(F.regexp_replace(p, r"(?i)<br\s*/?>", " "), r"<[^>]+>", "")
        for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
            p = F.replace(p, F.lit(entity), F.lit(char))
        return F.trim(F.regexp_replace(p, r"\s+", " "))

    return F.filter(F.transform(raw, plain), lambda p: p != "")


def first_words(text: Column, n: int = 800) -> Column:
    """The first ``n`` words, a blank between them."""
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")


# ---------------------------------------------------------------- sinks of several files


def write_indexed(df: DataFrame, key: str, path: str) -> None:
    """Parquet in ranges of the key, sorted: a lookup of one key reads the files and row groups whose statistics hold it."""
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_vectors(df: DataFrame, path: str, id_col: str = "id", vector: str = "embedding", **about: str) -> None:
    """Vectors as Parquet, and one JSON row on the run beside them: number, dimensions, whatever else is told."""
    df.select(id_col, vector).write.mode("overwrite").parquet(f"{path}/vectors")
    stored = df.sparkSession.read.parquet(f"{path}/vectors")
    run = stored.agg(F.count("*").alias("count"), F.max(F.size(vector)).alias("dimensions")).withColumns({k: F.lit(v) for k, v in sorted(about.items())})
    run.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def publish(df: DataFrame, base: str) -> str:
    """Write a new version of a table beside the others and point to it; readers of the version before are not disturbed."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{version}")
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    pointer, fresh = jvm.org.apache.hadoop.fs.Path(f"{base}/CURRENT"), jvm.org.apache.hadoop.fs.Path(f"{base}/CURRENT-{version}")
    fs = pointer.getFileSystem(conf)
    out = fs.create(fresh)
    out.write(version.encode())
    out.close()
    fs.delete(pointer, False)
    if not fs.rename(fresh, pointer):
        raise RuntimeError(f"{base} could not be pointed to {version}")
    return version


def read_published(spark: SparkSession, base: str) -> DataFrame:
    version = spark.read.text(f"{base}/CURRENT").first()[0]
    return spark.read.parquet(f"{base}/{version}")


def tar_shards(df: DataFrame, name: str, text: str, shards: int, suffix: str = ".txt") -> DataFrame:
    """(shard, files, content): the texts as files of ``shards`` gzipped tar archives, dealt by a hash of the name, in order of names.

    A shard is made in one task, so their number bounds what a task holds. Null texts are left out.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for n, t in sorted(zip(pdf["n"], pdf["t"])):
                data = t.encode("utf-8")
                info = tarfile.TarInfo(n + suffix)
                info.size = len(data)
                tar.addfile(info, _io.BytesIO(data))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "files": [len(pdf)], "content": [out.getvalue()]})

    rows = df.where(F.col(text).isNotNull()).select(F.pmod(F.xxhash64(name), F.lit(shards)).cast("int").alias("shard"), F.col(name).alias("n"), F.col(text).alias("t"))
    return rows.groupBy("shard").applyInPandas(pack, "shard int, files int, content binary")


def tar_members(shards: DataFrame) -> DataFrame:
    """(name, text) of the files in rows of gzipped tar archives."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                with tarfile.open(fileobj=_io.BytesIO(content), mode="r:gz") as tar:
                    rows += [(m.name, tar.extractfile(m).read().decode("utf-8")) for m in tar.getmembers() if m.isfile()]
            yield pd.DataFrame(rows, columns=["name", "text"])

    return shards.select("content").mapInPandas(unpack, "name string, text string")


def export_readme(manifest: DataFrame, files: list[tuple[str, str]]) -> DataFrame:
    """The export's README as one text row: what is in it, and a line for each file (name, description)."""
    lines = "\n".join(f"- {n}: {d}" for n, d in files)
    head = F.concat(F.lit("# Export\n\n"), F.col("open_works").cast("string"), F.lit(" open works, "), F.col("passages").cast("string"), F.lit(" passages, "), F.col("words").cast("string"), F.lit(" words.\n\n"))
    return manifest.select(F.concat(head, F.lit(lines + "\n")).alias("value"))


def score_store(scores: DataFrame, key: str, stamp: Column) -> DataFrame:
    """Rows of the score store: one JSON object a score, and the number of files and time of the update in a last one."""
    each = scores.select(F.to_json(F.struct(*sorted(scores.columns))).alias("value"))
    return each.unionByName(scores.agg(F.countDistinct(key).alias("total_files")).select(F.to_json(F.struct("total_files", stamp.alias("last_updated"))).alias("value")))
