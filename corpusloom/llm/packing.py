"""Filling fixed-capacity containers by minimum bin slack.

Items are spread over shards by a hash of their id, sized so that a shard holds a
bounded number of tokens whatever the size of the input. A shard is packed one
container at a time: the largest remaining item opens it, and a bitset subset-sum
over the remaining lengths finds the fullest combination that still fits; those
items are removed. Once the leftovers of a shard can't fill a container they share
its last ones, so a shard wastes at most about one container.

An item beyond the capacity is cut into full pieces and a remainder, and only then.
Null and empty texts have no tokens: one row without a container. Repeated ids are
separate items, told apart by nothing else; ids are expected to be unique.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import session

CAPACITY = 2048
#: Tokens a shard holds on average.
SHARD_TOKENS = 1_000_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@functools.cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """(id, n_tokens) of every row; 0 for a null text.

    The vocabulary is read where the driver is and sent to the executors with the job;
    ``pattern`` is how it splits text, by default that of the public tokenizers.
    """
    session.ship(df.sparkSession)
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    df.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(SparkFiles.get(name), pattern)
        for b in batches:
            n = [len(enc.encode_to_numpy(t, disallowed_special=())) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["id", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, f"id {kind}, n_tokens int")


def fullest(free: int, counts: np.ndarray, lengths: list[int]) -> list[int]:
    """The lengths, of those available, whose sum comes nearest to ``free`` from below.

    ``lengths``: the distinct available lengths, descending; ``counts``: how many of each.
    """
    reach, steps, goal, fits = 1, [], 1 << free, (1 << (free + 1)) - 1
    for length in lengths:
        if length > free:
            continue
        left, lot = min(int(counts[length]), free // length), 1
        while left > 0:
            take = min(lot, left)
            after = (reach | reach << take * length) & fits
            if after != reach:
                steps.append((take, length, reach))
                reach = after
            left -= take
            lot *= 2
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, []
    for take, length, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= take * length
    return chosen


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of every item; each size is from 1 to ``capacity``."""
    out = np.full(len(sizes), -1, np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    stacks: dict[int, list[int]] = {}
    for i in by_size[::-1]:
        stacks.setdefault(int(sizes[i]), []).append(int(i))
    counts = np.bincount(sizes, minlength=capacity + 1) if len(sizes) else np.zeros(capacity + 1, int)
    lengths = sorted(stacks, reverse=True)
    k = 0
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        for length in [first, *fullest(capacity - first, counts, lengths)]:
            out[stacks[length].pop()] = k
        live = []
        for length in lengths:
            counts[length] = len(stacks[length])
            if counts[length]:
                live.append(length)
        lengths = live
        k += 1
    return out


def containers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: the id, piece number, first token, number of tokens and container."""
    spark = df.sparkSession
    sized = session.materialise(token_counts(df, id_col, text_col, vocabulary), "packing")
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    pieces = sized.select(
        "id",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(n_tokens - 1) div {capacity}"))), lambda k: F.least(F.lit(capacity), F.col("n_tokens") - k * capacity).cast("int"))).alias("piece", "n_tokens"),
    )
    none = pieces.where("n_tokens = 0").select("id", "piece", "n_tokens", F.lit(None).cast("string").alias("container"))
    some = pieces.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)))
    kind = df.schema[id_col].dataType.simpleString()

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "piece"], ascending=[False, True, True], kind="stable")
        n = pack(pdf.n_tokens.to_numpy(), capacity)
        pdf["container"] = [f"{s:06d}-{c:06d}" for s, c in zip(pdf["shard"], n)]
        return pdf[["id", "piece", "n_tokens", "container"]]

    packed = some.groupBy("shard").applyInPandas(fill, f"id {kind}, piece int, n_tokens int, container string")
    return packed.unionByName(none).select(F.col("id").alias(id_col), "piece", (F.col("piece") * capacity).alias("first_token"), "n_tokens", "container")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, n_items, n_tokens, slack) of every container."""
    used = packed.where("container is not null").groupBy("container").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    return used.withColumn("slack", F.lit(capacity) - F.col("n_tokens"))
