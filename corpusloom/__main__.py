"""Command line over a folder of tables: ``python -m corpusloom FOLDER COMMAND ...``.

Search: search, theme, themes, stats, random, citation. Ingest: clean, chunk, ingest,
status, validate, reembed. Results are printed as a table, or written with --out.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.api import Corpus
from corpusloom.functions import text as T
from corpusloom.operators import ingest, segment, stats
from corpusloom.sources import io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__.splitlines()[0])
    p.add_argument("folder", help="folder of the Parquet tables")
    p.add_argument("--out", help="write the result there (Parquet) instead of printing it")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="passages that hold all words, the best first")
    s.add_argument("query")
    s.add_argument("--author")
    s.add_argument("--type", dest="source_type")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--context", type=int, default=80)
    t = sub.add_parser("theme", help="passages of a theme")
    t.add_argument("theme")
    sub.add_parser("themes", help="themes by number of passages")
    sub.add_parser("stats", help="counts by author, source and type")
    r = sub.add_parser("random", help="a passage")
    r.add_argument("--seed", default="")
    c = sub.add_parser("citation", help='references such as "Matthew 5:3"')
    c.add_argument("reference")
    for name, what in (("clean", "texts cleaned"), ("chunk", "texts in chunks")):
        x = sub.add_parser(name, help=f"{what}: .txt files below a folder")
        x.add_argument("path")
        x.add_argument("--words", type=int, default=400)
    i = sub.add_parser("ingest", help="passages of .txt files whose sources aren't there yet")
    i.add_argument("path")
    i.add_argument("--force", action="store_true")
    sub.add_parser("status", help="what is there, by type and author")
    sub.add_parser("validate", help="repeated ids, blank and short texts, missing fields")
    e = sub.add_parser("reembed", help="vectors of all passages by a registered encoder")
    e.add_argument("encoder")
    return p


def texts_of(spark: SparkSession, path: str) -> DataFrame:
    """Source rows of the .txt files below a path; what their names tell."""
    files = io.read_texts(spark, path)
    return files.select(*io.name_metadata(F.col("name"), {}), "text")


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The result of a parsed command."""
    corpus = Corpus(spark, a.folder)
    if a.command == "search":
        found = corpus.scored(a.query, a.limit, author=a.author, source_type=a.source_type)
        return found.select("id", "source_title", "score", T.context(F.col("text"), a.query, a.context).alias("context"))
    if a.command == "theme":
        return corpus.theme(a.theme).select("id", "source_title", T.snippet(F.col("text"), 120).alias("snippet"))
    if a.command == "random":
        return corpus.random(a.seed).select("id", "source_title", "text")
    if a.command in ("clean", "chunk"):
        cleaned = texts_of(spark, a.path).withColumn("text", T.clean_page_text(F.col("text")))
        return cleaned if a.command == "clean" else segment.greedy_chunks(cleaned, "source_id", "text", a.words)
    if a.command == "ingest":
        rows = ingest.passages(texts_of(spark, a.path), [])
        return ingest.new_only(rows, corpus.sources(), a.force)
    if a.command == "status":
        return stats.status(corpus._table("passages"))
    if a.command == "reembed":
        return corpus.encode(corpus._table("passages"), "text", a.encoder).select("id", "embedding")
    plain = {"themes": corpus.themes, "stats": corpus.breakdown, "validate": corpus.validate}
    return plain[a.command]() if a.command in plain else corpus.citations(a.reference)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("corpusloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    result = run(spark, a)
    if a.out:
        result.write.mode("overwrite").parquet(a.out)
    else:
        result.show(50, truncate=100)


if __name__ == "__main__":
    main()
