"""Cutting oversized passages into pieces within a limit.

A text over the limit (words at white space, characters) is first taken apart into
atomic segments: its sentences, and of a sentence that exceeds the limit by itself
runs of words, of a word that does runs of characters. Neighbouring pieces stand in a
heap by the strength of the boundary between them (word < clause < sentence <
paragraph) and their joint size; the weakest boundary goes first, as long as the joint
piece and the overlap it will carry stay within the limit. Every piece but the first
then repeats the last sentence of the one before, where that fits.

Null and blank texts and those within the limit are one piece as they stand (null: no
piece). Rows repeated under one id count once. The stated ``word_count`` is not used.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.llm import scan, sentences

MAX_WORDS = 400
MAX_CHARS = 3000
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
_CLAUSE = re.compile(r"[,;:，；：、؛،፤፣·—–]\s*$")


def over(words: int, chars: int, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> bool:
    return words > max_words or chars > max_chars


def atoms(text: str, spans: list[tuple[int, int]], max_words: int, max_chars: int) -> tuple[list[tuple[int, int]], list[int], bool]:
    """(segments covering the text, strength of the boundary after each, whether a sentence exceeds the limit by itself)."""
    out: list[tuple[int, int]] = []
    strength: list[int] = []
    forced = False
    # every character belongs to a segment: what stands between sentences goes with the one before
    edges = [0, *(b for b, _ in spans[1:]), len(text)] if spans else [0, len(text)]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        own = text[a:b]
        inner = own.strip()
        last = 3 if _PARAGRAPH.search(text[(spans[k][1] if k < len(spans) else b) : b]) else 2
        if not over(len(inner.split()), len(inner), max_words, max_chars):
            out.append((a, b))
            strength.append(last)
            continue
        forced = True
        # runs of at most an eighth of the limit, cut after words
        piece_chars, at = max(1, max_chars // 8), a
        for m in re.finditer(r"\S{1,%d}\s*" % piece_chars, own):
            out.append((at, a + m.end()))
            strength.append(1 if _CLAUSE.search(m[0]) else 0)
            at = a + m.end()
        if at < b and out:
            out[-1] = (out[-1][0], b)
        strength[-1] = last
    return out, strength, forced


def merge(text: str, segments: list[tuple[int, int]], strength: list[int], max_words: int, max_chars: int, overlap: bool = True) -> list[tuple[int, int]]:
    """Pieces (runs of segments as (first, last + 1)) by merging the weakest boundaries first."""
    n = len(segments)
    words = [len(text[a:b].split()) for a, b in segments]
    chars = [b - a for a, b in segments]
    # what a piece that begins at segment k carries over: the segment before it, if it is a whole sentence and fits at all
    carry_w, carry_c = [0] * n, [0] * n
    for k in range(1, n):
        if overlap and strength[k - 1] >= 2 and (k == 1 or strength[k - 2] >= 2) and words[k - 1] + words[k] <= max_words and chars[k - 1] + chars[k] <= max_chars:
            carry_w[k], carry_c[k] = words[k - 1], chars[k - 1]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    size_w, size_c, end, alive = words[:], chars[:], list(range(1, n + 1)), [True] * n
    heap = [(strength[k], words[k] + words[k + 1], k, k + 1, 0) for k in range(n - 1)]
    heapq.heapify(heap)
    version = [0] * n
    while heap:
        _, _, k, nxt, v = heapq.heappop(heap)
        if not alive[k] or right[k] != nxt or nxt >= n or v != version[k] + version[nxt]:
            continue
        w, c = size_w[k] + size_w[nxt], size_c[k] + size_c[nxt]
        if w + carry_w[k] > max_words or c + carry_c[k] > max_chars:
            continue
        size_w[k], size_c[k], end[k] = w, c, end[nxt]
        alive[nxt], right[k] = False, right[nxt]
        version[k] += 1
        if right[k] < n:
            left[right[k]] = k
            heapq.heappush(heap, (strength[end[k] - 1], w + size_w[right[k]], k, right[k], version[k] + version[right[k]]))
        if left[k] >= 0:
            j = left[k]
            heapq.heappush(heap, (strength[end[j] - 1], size_w[j] + w, j, k, version[j] + version[k]))
    return [(k, end[k]) for k in range(n) if alive[k]]


def pieces(text: str, spans: list[tuple[int, int]], max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> tuple[list[tuple[int, int, int]], bool]:
    """((begin, own begin, end) of every piece, whether a sentence exceeds the limit); begin to own begin is the overlap."""
    if not over(len(text.split()), len(text), max_words, max_chars):
        return [(0, 0, len(text))], False
    segments, strength, forced = atoms(text, spans, max_words, max_chars)
    out = []
    for first, last in merge(text, segments, strength, max_words, max_chars):
        a, b = segments[first][0], segments[last - 1][1]
        begin = a
        if first and strength[first - 1] >= 2 and (first == 1 or strength[first - 2] >= 2):
            before = segments[first - 1][0]
            if not over(len(text[before:b].split()), b - before, max_words, max_chars):
                begin = before
        out.append((begin, a, b))
    return out, forced


def _oversized(passages: DataFrame) -> DataFrame:
    """(id, text, title) of passages over the limit, once per id; decided in the JVM from the text alone."""
    words = F.size(F.filter(F.split("text", r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"), lambda w: w != ""))
    rows = passages.select(F.col("id").cast("string").alias("id"), "text", F.col("source_title").alias("title")).where("text is not null and id is not null")
    rows = rows.where((F.length("text") > MAX_CHARS) | (F.when(F.length("text") > MAX_WORDS * 2, words).otherwise(0) > MAX_WORDS))
    return rows.groupBy("id").agg(F.min(F.struct("text", "title")).alias("r")).select("id", "r.text", "r.title")


def _line_weights(passages: DataFrame) -> dict[str, float]:
    return scan.train(scan.prepared(passages), edit=False).line_weights


def found(passages: DataFrame) -> DataFrame:
    """(id, forced) of every passage over the limit; forced is 1 if a single sentence of it exceeds the limit."""
    spark = passages.sparkSession
    session.ship(spark)
    shared = spark.sparkContext.broadcast(_line_weights(passages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, titles = b.column(1).to_pylist(), b.column(2).to_pylist()
            flags = [int(pieces(t, spans)[1]) for t, spans in zip(texts, sentences.split(texts, titles, shared.value))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(flags, pa.int32())], names=["id", "forced"])

    return _oversized(passages).mapInArrow(run, "id string, forced int")


def split_all(passages: DataFrame) -> DataFrame:
    """(id, chunk_index, begin_pos, end_pos, overlap, text, word_count) of every piece of every passage over the limit."""
    spark = passages.sparkSession
    session.ship(spark)
    shared = spark.sparkContext.broadcast(_line_weights(passages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: tuple[list, ...] = tuple([] for _ in range(7))
            texts, titles = b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, t, spans in zip(b.column(0).to_pylist(), texts, sentences.split(texts, titles, shared.value)):
                for n, (begin, own, end) in enumerate(pieces(t, spans)[0]):
                    piece = t[begin:end].strip()
                    for c, v in zip(cols, (i, n, begin, end, own - begin, piece, len(piece.split()))):
                        c.append(v)
            types = (pa.string(), *[pa.int32()] * 4, pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=["id", "chunk_index", "begin_pos", "end_pos", "overlap", "text", "word_count"])

    return _oversized(passages).mapInArrow(run, "id string, chunk_index int, begin_pos int, end_pos int, overlap int, text string, word_count int")
