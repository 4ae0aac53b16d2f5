"""One entry point over a folder of tables: the questions a reader, a service or a batch asks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import citations, joins, registry, scoring, search, stats
from corpusloom.session import read

_ENCODERS: dict[str, Callable[[list[str]], list[list[float]]]] = {}


def register_encoder(name: str, encode: Callable[[list[str]], list[list[float]]]) -> None:
    """Make a text encoder (texts to vectors) available to :meth:`Corpus.encode`; none is built in."""
    _ENCODERS[name] = encode


class Corpus:
    """Passages, works, themes, references and scores below one folder; every method is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str) -> DataFrame:
        return read(self.spark, self.folder, name)

    # search

    def search(self, query: str, limit: int = 50, **equal: str) -> DataFrame:
        return search.keyword(self._table("passages"), query, limit, **equal)

    def scored(self, query: str, limit: int = 20, **equal: str) -> DataFrame:
        return search.scored(self._table("passages"), query, limit, **equal)

    def theme(self, theme: str) -> DataFrame:
        return self._table("passages").where(search.has_theme(F.col("themes"), theme))

    def passage(self, passage_id: str) -> DataFrame:
        return self._table("passages").where(F.col("id") == passage_id)

    def random(self, seed: str = "") -> DataFrame:
        return search.random_rows(self._table("passages"), 1, seed)

    def citations(self, query: str) -> DataFrame:
        return search.citations(self._table("scripture_refs"), query)

    def semantic(self, vector: list[float], k: int = 20, id_col: str = "vec_id") -> DataFrame:
        return V.top_k(self._table("embeddings"), F.lit([float(x) for x in vector]), "embedding", id_col, k)

    def encode(self, df: DataFrame, text: str, encoder: str) -> DataFrame:
        """The rows with an ``embedding`` by a registered encoder, batch by batch."""
        f = _ENCODERS[encoder]

        @F.pandas_udf("array<float>")
        def vectors(s: pd.Series) -> pd.Series:
            return pd.Series(f([t or "" for t in s]))

        return df.withColumn("embedding", vectors(text))

    # overviews

    def stats(self) -> DataFrame:
        return stats.corpus_totals(self._table("passages"))

    def breakdown(self, *keys: str) -> DataFrame:
        return stats.grouped_counts(self._table("passages"), list(keys) or ["author", "source_id", "source_type"])

    def themes(self) -> DataFrame:
        return stats.theme_dimension(self._table("themes"), self._table("passages")).orderBy(F.col("n").desc(), "theme_id")

    def sources(self) -> DataFrame:
        return stats.source_rollup(self._table("passages"))

    def books(self) -> DataFrame:
        return citations.books(self._table("scripture_refs")).orderBy("canon", "book")

    # works

    def works(self, corpus: str | None = None) -> DataFrame:
        return search.equal_filters(self._table("works").where("open"), corpus=corpus)

    def work(self, work_id: str) -> DataFrame:
        """The work's passages in order."""
        one = self._table("works").where(F.col("id") == work_id)
        return joins.ordered_members(one, self._table("passages")).orderBy("pos")

    def work_text(self, work_id: str) -> DataFrame:
        return registry.text_export(self._table("works").where(F.col("id") == work_id), self._table("passages"))

    def neighbours(self) -> DataFrame:
        return registry.neighbours_in_corpus(self._table("works"))

    def redirects(self) -> DataFrame:
        return joins.redirects(self._table("works"))

    def sitemap(self, base: str) -> DataFrame:
        return registry.sitemap(self._table("works"), base)

    # scoring and gates

    def score(self, df: DataFrame, scale: scoring.Scale, text: str = "text") -> DataFrame:
        """A table of texts with the scores of a scale, its label, a summary and a note on short texts."""
        scored = scoring.with_scores(df, scale, text)
        return scored.withColumns({"summary": scoring.summary(scale), "advisory": scoring.advisory(F.col("words"))})

    def compare(self, df: DataFrame, scale: scoring.Scale, group: str, label: str) -> DataFrame:
        """Groups of two to five texts side by side."""
        return scoring.compared(df, scale, group, label)

    def score_cached(self, df: DataFrame, cache: DataFrame, scale: scoring.Scale, version: str) -> DataFrame:
        """Scores from the cache where it has them, else by rules."""
        return scoring.dispatched(df, cache, scale, version)

    def validate(self, *required: str) -> DataFrame:
        return registry.validation(self._table("passages"), list(required) or ["author", "source_id"])

    def gate(self) -> DataFrame:
        return registry.registry_gate(self._table("works"), self._table("passages"))

    @staticmethod
    def feedback(texts: DataFrame, text: str, score: Column) -> DataFrame:
        """Feedback rows as they are logged: the text's beginning (500 characters), the score and the time."""
        return texts.select(F.current_timestamp().alias("timestamp"), T.snippet(F.col(text), 500).alias("text_snippet"), score.cast("int").alias("overall_score"))

    @staticmethod
    def logged_feedback(log: DataFrame, limit: int = 100) -> DataFrame:
        """The latest feedback first; as many as the limit."""
        return log.orderBy(F.col("timestamp").desc(), "text_snippet").limit(limit)

    # the open layer

    def work_json(self, work_id: str) -> DataFrame:
        """(id, document): a work's record with its passages in order, as JSON."""
        works = self._table("works").where(F.col("id") == work_id)
        members = joins.ordered_members(works, self._table("passages")).groupBy(F.col("work_id").alias("id"))
        parts = members.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "passage_id", "text"))), lambda x: F.struct(x["passage_id"].alias("id"), x["text"].alias("text"))).alias("passages"))
        return works.join(parts, "id", "left").select("id", F.to_json(F.struct(*works.columns, "passages")).alias("document"))
