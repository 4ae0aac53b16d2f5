"""Table functions for SQL: chunks of a text, dated heads of a diary, named for ``SELECT * FROM name(...)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from corpusloom import session


@udtf(returnType="chunk_index int, text string, word_count int")
class ChunkText:
    """Chunks of at most ``most`` words; none for a null text."""

    def eval(self, text: str, most: int) -> Iterator[tuple]:
        from corpusloom.operators.segment import greedy_pack

        for k, chunk in enumerate(greedy_pack(text, most) if text is not None else []):
            yield k, chunk, len(chunk.split())


@udtf(returnType="position int, date string, status string, snippet string")
class DateWalk:
    """The entry heads of a diary with their dates; none for a null text."""

    def eval(self, text: str) -> Iterator[tuple]:
        from corpusloom.operators.journal import scan_text

        for row in scan_text(text, None) if text is not None else []:
            yield row["offset"], row["date"], row["status"], row["snippet"]


def register(spark: SparkSession) -> None:
    """Make chunk_text and date_walk available to SQL."""
    session.ship(spark)
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("date_walk", DateWalk)
