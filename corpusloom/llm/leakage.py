"""Evaluation items that leaked into documents.

Words are runs of letters or digits in the lower-cased text, without numbers, with
words rejoined over line-end marks and hyphens taken out. Runs of three words are the
seeds. A document and an item become a candidate where, near one diagonal, as many
seeds lie as any stretch of 5 m to 5 m + 4 words keeps of which m are changed, added or
missing: each spoils three seeds at most, so 2 m - 2 are left. How many documents hold
a seed does not matter, so an item or a part of one may have leaked into any share of
them. Each candidate is then aligned
word by word (Smith-Waterman), the alignment is carried on along its diagonals to both
ends of the item, and the best stretch of at least ``LEAST_SPAN`` words of which
``LEAST_SHARE`` agree decides, be its first and last words changed or not. A stretch
that keeps what is common and changes what is rare is a turn of phrase and no leak
(``PHRASE_BITS``); changes at random leave both alike, however often an item leaked.

The items are a stated query set, held against all documents in blocks of at most
``BLOCK_WORDS`` words, so that what is broadcast has a bound.

Null or blank texts and items hold nothing and give no row; repeated document ids
are united; items repeated under one id count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.llm import vec

SEED = 3
#: Diagonals of a candidate, those the alignment may stray beyond them, and both together.
BAND, SLACK = 16, 16
WIDTH = BAND + 2 * SLACK
BLOCK_WORDS = 1_000_000
ALIGNED_AT_ONCE = 64
#: Of a stretch: least words of the item, least share of matching words.
LEAST_SPAN, LEAST_SHARE = 20, 0.8
#: A stretch that is not nearly exact is a turn of phrase if its whole seeds are commoner than its changed ones by so many bits (medians).
EXACT_SHARE, PHRASE_BITS = 0.9, 3.0
_JOINS = re.compile(r"[-¬\xad=‐‑][ \t]*\n\s*|(?<=\w)[-¬\xad‐‑](?=\w)|\xad")
_DIGIT = None


def normalised(text: str | None) -> str:
    """The text with words rejoined over line-end marks and without hyphens."""
    return _JOINS.sub("", text) if text else ""


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, numbers left out, and where each text's begin (and the end)."""
    global _DIGIT
    if _DIGIT is None:
        _DIGIT = np.array([chr(c).isdigit() for c in range(vec.LIMIT)], dtype=bool)
    w = vec.Words([normalised(t) for t in texts])
    digits = np.concatenate(([0], np.cumsum(_DIGIT[w.raw])))
    words = digits[w.end] - digits[w.start] < w.end - w.start
    return w.hash[words], np.searchsorted(w.doc[words], np.arange(len(texts) + 1))


def seeds(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, position within the text) of every run of SEED words."""
    n = len(h) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.zeros(n, np.uint64)
    for j in range(SEED):
        s = vec.mix(s + h[j : j + n] * np.uint64(2 * j + 3))
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = doc[:n] == doc[SEED - 1 :]
    return s[whole], doc[:n][whole], (np.arange(n) - at[doc[:n]])[whole]


class Index:
    """The seeds of a block of items."""

    def __init__(self, ids: list[str], texts: list[str | None]):
        self.ids = ids
        self.words, self.at = word_hashes(texts)
        s, item, pos = seeds(self.words, self.at)
        order = np.argsort(s, kind="stable")
        self.hash, self.item, self.pos = s[order], item[order], pos[order]
        self.uniq, self.begin, self.count = np.unique(self.hash, return_index=True, return_counts=True)
        #: of the seed that begins at each word, the bits of its share of all documents
        self.rarity = np.zeros(len(self.words))

    def weigh(self, share: np.ndarray, least: float) -> None:
        """Set the rarity of every seed from the share of documents that hold each of ``uniq``; ``least`` is the share of one."""
        own = np.repeat(share, self.count)
        self.rarity[self.at[self.item] + self.pos] = -np.log2(np.clip(own, least, 1))

    def lookup(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the seeds ``s`` are in the index, and the number of each in ``uniq``."""
        if not len(self.uniq) or not len(s):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.uniq, s), len(self.uniq) - 1)
        hit = np.flatnonzero(self.uniq[k] == s)
        return hit, k[hit]


def paths(items: list[np.ndarray], windows: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each pair and word of the item: whether it matches, and where the words of the window that it takes begin and end.

    The best local alignment (a match scores 1, all else -1), carried on along the diagonals
    of its ends. Only a band of the matrix is filled: word i of the item meets words i to
    i + WIDTH - 1 of its window, which must be WIDTH - 1 words longer than the item.
    """
    n, c = max(map(len, items)), len(items)
    a, b = np.zeros((n, c), np.uint64), np.ones((c, n + WIDTH), np.uint64)
    for k, (x, y) in enumerate(zip(items, windows)):
        a[: len(x), k] = x
        b[k, : len(y)] = y
    # H[i, :, w]: word i of the item against word i + w of the window; one column of zeros at the right
    H = np.zeros((n + 1, c, WIDTH + 1), np.int16)
    slope = np.arange(WIDTH).astype(np.int16)
    for i in range(1, n + 1):
        row = np.maximum(H[i - 1, :, 1:] - 1, H[i - 1, :, :-1] + np.where(b[:, i - 1 : i - 1 + WIDTH] == a[i - 1][:, None], np.int16(1), np.int16(-1)))
        np.maximum(np.maximum.accumulate(np.maximum(row, 0) + slope, axis=1) - slope, 0, out=H[i, :, :-1])
    out = []
    for k, x in enumerate(items):
        h = H[:, k]
        i, w = divmod(int(h.argmax()), WIDTH + 1)
        match, begin, end = np.zeros(len(x), bool), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)

        def straight(lo: int, hi: int, w: int) -> None:
            begin[lo:hi] = np.arange(lo, hi) + w
            end[lo:hi] = begin[lo:hi] + 1
            match[lo:hi] = x[lo:hi] == b[k, begin[lo:hi]]

        straight(i, len(x), w)
        while i and h[i, w]:
            same = a[i - 1, k] == b[k, i - 1 + w]
            if h[i, w] == h[i - 1, w] + (1 if same else -1):
                i -= 1
                match[i], begin[i], end[i] = same, i + w, i + w + 1
            elif h[i, w] == h[i - 1, w + 1] - 1:
                i, w = i - 1, w + 1
                begin[i] = end[i] = i + w
            elif w:
                w -= 1
            else:
                break
        straight(0, i, w)
        out.append((match, begin, end))
    return out


def stretch(match: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[int, int, int, int] | None:
    """(first word, words of the item, matches, words of the window) of the best stretch (a match 1, all else -2) of LEAST_SPAN words or more and LEAST_SHARE."""
    n = len(match) - LEAST_SPAN + 1
    if n <= 0:
        return None
    total = np.concatenate(([0], np.cumsum(match)))
    # up to 39 words one in five changed are 7 at most, from 40 on some LEAST_SPAN words have no more than 5
    if (total[LEAST_SPAN:] - total[:-LEAST_SPAN]).max() < LEAST_SPAN - 7:
        return None
    last = np.arange(LEAST_SPAN - 1, len(match))
    span = last - np.arange(n)[:, None] + 1
    matches = total[last + 1] - total[:n, None]
    width = end[last] - begin[:n, None]
    size = np.maximum(span, width)
    score = np.where((span >= LEAST_SPAN) & (matches >= LEAST_SHARE * size), 3 * matches - 2 * size, np.iinfo(np.int64).min)
    p, q = divmod(int(score.argmax()), n)
    return (p, int(span[p, q]), int(matches[p, q]), int(width[p, q])) if span[p, q] >= LEAST_SPAN and matches[p, q] >= LEAST_SHARE * size[p, q] else None


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(matches, words of the item, words of the window) of each pair's best stretch; zeros if there is none."""
    found = [stretch(*p) for p in paths(items, windows)]
    return [(f[2], f[1], f[3]) if f else (0, 0, 0) for f in found]


def phrase(match: np.ndarray, rarity: np.ndarray) -> bool:
    """Whether a stretch is but a turn of phrase: not nearly exact, and what it keeps far commoner than what it changes."""
    if match.mean() >= EXACT_SHARE:
        return False
    whole = np.lib.stride_tricks.sliding_window_view(match, SEED).all(axis=1)
    bits = rarity[: len(whole)]
    return bool(whole.any() and not whole.all() and np.median(bits[~whole]) - np.median(bits[whole]) >= PHRASE_BITS)


def candidates(index: Index, s: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, item number, diagonal) where for some m 2 m - 2 seeds of 5 m + 4 words lie within a band of diagonals."""
    hit, k = index.lookup(s)
    times = index.count[k]
    row = np.repeat(np.arange(len(hit)), times)
    entry = np.repeat(index.begin[k], times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    d, item, place = doc[hit][row], index.item[entry], index.pos[entry]
    diagonal = pos[hit][row] - place + (1 << 20)
    found = []
    for shift in (0, BAND // 2):
        key = (d * (len(index.ids) + 1) + item) * (1 << 22) + (diagonal + shift) // BAND
        order = np.lexsort((place, key))
        band, at = key[order], place[order]
        good = [np.zeros(0, np.int64)]
        for m in range(LEAST_SPAN // 5, int(np.diff(index.at).max(initial=0)) // 5 + 1):
            first, last = slice(0, max(0, len(band) - 2 * m + 3)), slice(2 * m - 3, None)
            same = band[first] == band[last]
            if not same.any():
                break
            good.append(band[first][same & (at[last] - at[first] <= 5 * m + 4 - SEED)])
        band = np.unique(np.concatenate(good))
        found.append(np.stack([band >> 22, (band & ((1 << 22) - 1)) * BAND - shift - (1 << 20)]))
    pair, diag = np.concatenate(found, axis=1)
    return pair // (len(index.ids) + 1), pair % (len(index.ids) + 1), diag


def _window(words: np.ndarray, begin: int, length: int) -> np.ndarray:
    """``words[begin:begin + length]``, with 1 (no word's hash) where that is outside."""
    out = np.ones(length, np.uint64)
    lo, hi = max(0, begin), min(len(words), begin + length)
    if lo < hi:
        out[lo - begin : hi - begin] = words[lo:hi]
    return out


def stretches(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
    """(text number, item number, words of the item, matching words) of the longest leak of each pair."""
    h, at = word_hashes(texts)
    s, doc, pos = seeds(h, at)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    found = np.stack(candidates(index, s, doc, pos), axis=1)
    found = found[np.argsort(np.diff(index.at)[found[:, 1]], kind="stable")]
    for k in range(0, len(found), ALIGNED_AT_ONCE):
        part = found[k : k + ALIGNED_AT_ONCE]
        items = [index.words[index.at[i] : index.at[i + 1]] for _, i, _ in part]
        windows = [_window(h[at[d] : at[d + 1]], diag - SLACK, len(x) + WIDTH - 1) for (d, _, diag), x in zip(part, items)]
        for (d, i, _), path in zip(part, paths(items, windows)):
            if got := stretch(*path):
                first, span, matches, _ = got
                if not phrase(path[0][first : first + span], index.rarity[index.at[i] + first : index.at[i] + first + span]):
                    best[d, i] = max(best.get((d, i), (0, 0)), (span, matches))
    return [(int(d), int(i), span, matches) for (d, i), (span, matches) in sorted(best.items())]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[str], list[str]]]:
    ids, texts, size = [], [], 0
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).dropna().groupBy("id").agg(F.min("text").alias("text")).orderBy("id")
    for r in rows.toLocalIterator():
        ids.append(r.id)
        texts.append(r.text)
        size += len(r.text) // 5
        if size >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "id", item_text: str = "text") -> DataFrame:
    """One row per document and item of which it holds a stretch: ids, words of the stretch, matching words."""
    spark = docs.sparkSession
    session.ship(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).where("doc_id is not null and text is not null")
    kind = docs.schema[doc_id].dataType.simpleString()
    out = None
    for ids, texts in _blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(Index(ids, texts))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, total, n = shared.value, np.zeros(len(shared.value.uniq), np.int64), 0
            for b in batches:
                part = b.column(1).to_pylist()
                for lo, hi in vec.slices(part):
                    s, doc, _ = seeds(*word_hashes(part[lo:hi]))
                    hit, k = index.lookup(s)
                    total += np.bincount(np.unique(doc[hit] * len(index.uniq) + k) % max(1, len(index.uniq)), minlength=len(index.uniq))
                    n += hi - lo
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], n))], names=["k", "n"])

        # bounded: one row per seed of the block
        counted = rows.mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
        index = shared.value
        n_docs = int(counted.n[counted.k == -1].sum())
        share = np.zeros(len(index.uniq))
        seen = counted[counted.k >= 0]
        share[seen.k.to_numpy()] = seen.n.to_numpy() / max(1, n_docs)
        index.weigh(share, 1 / max(64, n_docs))
        weighed = spark.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], weighed=weighed) -> Iterator[pa.RecordBatch]:
            index = weighed.value
            for b in batches:
                part = b.column(1).to_pylist()
                for lo, hi in vec.slices(part):
                    got = stretches(index, part[lo:hi])
                    if got:
                        d, i, span, matches = map(list, zip(*got))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([lo + x for x in d])), pa.array([index.ids[x] for x in i]), pa.array(span, pa.int32()), pa.array(matches, pa.int32())], names=["doc_id", "item_id", "n_words", "n_matches"])

        found = rows.mapInArrow(find, f"doc_id {kind}, item_id string, n_words int, n_matches int")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"doc_id {kind}, item_id string, n_words int, n_matches int")
    return out.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max("n_matches").alias("n_matches"))
