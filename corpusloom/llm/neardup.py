"""Near-duplicate passages by filters over several global token orders.

A text's set is its distinct runs of three successive words. Each of ``BANDS *
ORDERS`` random global orders ranks all possible runs; the prefix of a set under an
order is its first run. Two texts are candidates if, in at least one band, their
prefixes agree under every order of the band: the filters of a band are intersected,
the bands are united. Texts with the same set are one class throughout, so that any
number of exact copies costs as much as one text.

For a similarity J a band lets a pair pass with probability J**ORDERS, hence a pair
is missed with probability (1 - J**ORDERS)**BANDS: 1.4e-2 at J = 0.5, 3e-3 at 0.55,
4e-4 at 0.6, 2e-8 at 0.75. Candidates are thinned where they are found by how many of all the
prefixes agree (a 4-bit trace of each, four standard deviations of slack), as the pairs that
share a key grow with the square of the table where texts are made of the same phrases; the rest
are verified exactly on whole sets.

Prefixes of one run are shorter than the length at which a single filter loses nothing,
so the filter is not exact; the figures above say what it loses.

Nulls, blank texts and texts with fewer than ``MIN_WORDS`` words have no partners.
Rows repeated under one id count once; the smaller text counts if they differ.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom import session
from corpusloom.llm import vec

SHINGLE = 3
MIN_WORDS = 20
ORDERS = 3
BANDS = 32
#: A band key that more classes share is worked on in cells of this many by this many.
BLOCK = 512
#: Bands that are exchanged at once, with the traces; a group's exchange is gone before the next begins.
BANDS_AT_ONCE = 8
#: Classes held back while the keys of a partition come in; pairs compared at once; pairs verified at once.
HELD = 1 << 18
COMPARED = 1 << 16
VERIFIED = 1 << 23
#: 64-bit words of the filter through which texts pass that may be needed.
FILTER = 1 << 20
#: Classes of more copies are given by their smallest id in :func:`pairs`, the copies as a star around it.
COPIES = 64


def _orders(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20250711)
    a = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def _sets(texts: list[str], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct run hashes by text: values, where each text's begin (and the end), word counts."""
    w = vec.Words(texts)
    h, doc = w.shingles(SHINGLE)
    n = w.counts()
    keep = n[doc] >= min_words
    h, doc = h[keep], doc[keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1)), n


def signatures(texts: list[str], min_words: int = MIN_WORDS, bands: int = BANDS, orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers of texts with a set, class, band keys of 32 bits, 4-bit traces) of the texts."""
    h, at, _ = _sets(texts, min_words)
    has = np.flatnonzero(np.diff(at))
    starts = at[:-1][has]
    if not len(has):
        return has, np.zeros(0, np.int64), np.zeros((0, bands), np.int64), np.zeros((0, bands * orders // 2), np.uint8)
    cls = vec.mix(np.add.reduceat(vec.mix(h ^ np.uint64(0xA5A5A5A5)), starts)).view(np.int64)
    a, b = _orders(bands * orders)
    keys = np.zeros((len(has), bands), np.uint64)
    trace = np.zeros((len(has), bands * orders), np.uint8)
    for i in range(bands):
        key = np.full(len(has), i + 1, np.uint64)
        for j in range(i * orders, (i + 1) * orders):
            first = np.minimum.reduceat(h * a[j] + b[j], starts)
            key = vec.mix(key ^ first)
            trace[:, j] = (vec.mix(first) & np.uint64(15)).astype(np.uint8)
        keys[:, i] = key >> np.uint64(32)
    return has, cls, keys.view(np.int64), trace[:, 0::2] | trace[:, 1::2] << 4


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for lo, hi in vec.slices(texts):
            has, cls, keys, trace = signatures(texts[lo:hi])
            if len(has):
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(has + lo)),
                        pa.array(cls),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.astype(np.uint32).view(np.int32).ravel())),
                        pa.array([t.tobytes() for t in trace], pa.binary()),
                    ],
                    names=["id", "cls", "keys", "trace"],
                )


def _traces(column: pa.Array) -> np.ndarray:
    """The traces, all of one length, as rows of 64-bit words."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data.view(np.uint64).reshape(len(column), -1) if len(data) else np.zeros((len(column), 0), np.uint64)


def _agree(x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Whether at least so many 4-bit parts of two traces are the same."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return 16 * x.shape[1] - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64) >= least


def _starts(*sorted_by: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before in any of the columns."""
    fresh = np.ones(len(sorted_by[0]), bool)
    fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_by])
    return fresh


def _pairs_within(fresh: np.ndarray, cls: np.ndarray, trace: np.ndarray, least: int, apart: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes of one group (each begins where ``fresh`` is set, sorted by class) whose traces agree.

    ``apart``: only rows that differ in it are paired, unless it is negative.
    """
    ends = np.append(np.flatnonzero(fresh), len(fresh))[np.cumsum(fresh)] if len(fresh) else np.zeros(0, np.int64)
    i, far = np.arange(len(fresh)), 1
    while len(i := i[ends[i] > i + far]):
        for lo in range(0, len(i), COMPARED):
            x = i[lo : lo + COMPARED]
            if apart is not None:
                x = x[(apart[x] < 0) | (apart[x] != apart[x + far])]
            x = x[_agree(trace[x], trace[x + far], least)]
            if len(x):
                yield cls[x], cls[x + far]
        far += 1


FOUND = "a bigint, b bigint, key bigint, cls bigint, trace binary"


def _found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, pa.nulls(len(a), pa.binary())], names=["a", "b", "key", "cls", "trace"])


def _left(key: np.ndarray, cls: np.ndarray, trace: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(key), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, pa.array(key), pa.array(cls), pa.array([t.tobytes() for t in trace], pa.binary())], names=["a", "b", "key", "cls", "trace"])


def _few(least: int, block: int):
    """Over whole keys (key, cls, trace): pairs of the keys that at most ``block`` classes share, rows of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        many, n, limit = np.zeros(0, np.int64), 0, HELD

        def settled() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            key, cls, trace = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((cls, key))
            order = order[_starts(key[order], cls[order])]
            key, cls, trace = key[order], cls[order], trace[order]
            group = np.cumsum(_starts(key)) - 1
            return key, cls, trace, (np.bincount(group)[group] > block) | np.isin(key, many)

        for batch in batches:
            if not len(batch):
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), _traces(batch.column(2))))
            n += len(batch)
            if n >= limit:
                key, cls, trace, hot = settled()
                many = np.union1d(many, key[hot])
                for at in np.array_split(np.flatnonzero(hot), hot.sum() // COMPARED + 1):
                    yield _left(key[at], cls[at], trace[at])
                held = [(key[~hot], cls[~hot], trace[~hot])]
                n = len(held[0][0])
                limit = max(HELD, 2 * n)
        if held:
            key, cls, trace, hot = settled()
            for at in np.array_split(np.flatnonzero(hot), hot.sum() // COMPARED + 1):
                yield _left(key[at], cls[at], trace[at])
            key, cls, trace = key[~hot], cls[~hot], trace[~hot]
            if len(key):
                for a, b in _pairs_within(_starts(key), cls, trace, least):
                    yield _found(a, b)

    return run


def _cells(least: int):
    """Over whole cells (key, i, j, own, cls, trace): pairs of rows of the two blocks, or of the one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [([b.column(k).to_numpy() for k in range(5)], _traces(b.column(5))) for b in batches if len(b)]
        if not got:
            return
        key, i, j, own, cls = (np.concatenate(x) for x in zip(*(c for c, _ in got), strict=True))
        trace = np.concatenate([t for _, t in got])
        order = np.lexsort((cls, j, i, key))
        key, i, j, own, cls, trace = (x[order] for x in (key, i, j, own, cls, trace))
        for a, b in _pairs_within(_starts(key, i, j), cls, trace, least, np.where(i == j, -1, own)):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for lo, hi in vec.slices(texts):
            h, at, _ = _sets(texts[lo:hi], 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], names=["cls", "shingles"])


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def classes(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row per text with a set: id, class, band keys, traces. Written to the shared folder."""
    session.ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    signed = rows.mapInArrow(_signed, "id string, cls bigint, keys array<int>, trace binary")
    return session.materialise(signed, "neardup")


def _candidates(signed: DataFrame, block: int = BLOCK, least: int = 0) -> DataFrame:
    """Pairs (a, b), a < b, of classes that share a band key and agree in ``least`` parts of their traces; with repeats.

    Some bands at a time are exchanged by key, with the traces, so that a pair that traces
    rule out is never written. The classes of a key that many share are dealt over blocks,
    and each pair of blocks is compared by itself: no task has them all.
    """
    if "trace" not in signed.columns:
        signed = signed.withColumn("trace", F.lit(b""))
    found = []
    for lo in range(0, BANDS, BANDS_AT_ONCE):
        keyed = signed.select("cls", "trace", F.posexplode(F.slice("keys", lo + 1, BANDS_AT_ONCE)).alias("band", "key"))
        keyed = keyed.select((F.shiftleft((F.col("band") + lo).cast("bigint"), 32) + F.col("key")).alias("key"), "cls", "trace").repartition("key")
        found.append(session.materialise(keyed.mapInArrow(_few(least, block), FOUND), "neardup-bands", clean=True))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    out = every.where("a is not null").select("a", "b")
    many = every.where("key is not null").select("key", "cls", "trace")
    if not many.limit(1).count():
        return out
    many = many.groupBy("key", "cls").agg(F.min("trace").alias("trace")).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    blocks = F.ceil(F.col("n") / block).cast("int")
    many = many.withColumn("own", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = many.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "trace").repartition("key", "i", "j")
    return out.unionByName(cells.mapInArrow(_cells(least), "a bigint, b bigint"))


def _may_need(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """The texts without most of those whose id isn't needed, told by a Bloom filter of one size, so that they needn't be exchanged."""
    word, bits = F.pmod(F.xxhash64("id"), F.lit(FILTER)).alias("word"), F.xxhash64("id", F.lit(1))
    mask = F.lit(0).cast("bigint")
    for k in range(3):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    words = needed.select(word, mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    return texts.withColumns({"word": word, "mask": mask}).join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).drop("word", "mask", "bits")


def class_links(df: DataFrame, signed: DataFrame, threshold: float = 0.5, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Pairs (a, b), a < b, of different classes whose similarity is at least ``threshold``, with it."""
    # a trace of 4 bits agrees by chance once in 16 times; four standard deviations below the threshold
    total = BANDS * ORDERS
    p = 1 / 16 + threshold * 15 / 16
    likely = session.materialise(_candidates(signed, least=int(total * p - 4 * (total * p * (1 - p)) ** 0.5)).distinct(), "neardup-pairs", clean=True)
    reps = signed.groupBy("cls").agg(F.min("id").alias("id"))
    needed = session.materialise(likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(reps, "cls"), "neardup-needed", clean=True)
    texts = _may_need(df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")), needed)
    texts = texts.join(needed, "id").groupBy("cls").agg(F.min("text").alias("text"))
    sets = session.materialise(texts.mapInArrow(_shingle_rows, "cls bigint, shingles array<bigint>"), "neardup-sets", clean=True)
    rounds = math.ceil(likely.count() / VERIFIED) or 1
    links = []
    for k in range(rounds):
        some = likely.where(F.pmod(F.xxhash64("a"), F.lit(rounds)) == k)
        linked = (
            some.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
            .select("a", "b", similarity(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)
        )
        links.append(session.materialise(linked, "neardup-linked", clean=True))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def pairs(df: DataFrame, threshold: float = 0.5, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """All pairs (id_a, id_b), id_a < id_b, of different ids whose similarity is at least ``threshold``.

    A class of more than ``COPIES`` copies of one text stands in by its smallest id: that
    id is paired with each copy and with the ids of the linked classes, from which every
    other pair of the class follows. :func:`groups` gives the class of every id.
    """
    signed = classes(df, id_col, text_col)
    links = class_links(df, signed, threshold, id_col, text_col)
    members = signed.select("cls", "id").distinct()
    counted = members.groupBy("cls").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    spoken = members.join(counted, "cls").where((F.col("n") <= COPIES) | (F.col("id") == F.col("least"))).select("cls", "id", "n")
    between = links.join(spoken.select(F.col("cls").alias("a"), F.col("id").alias("ia")), "a").join(spoken.select(F.col("cls").alias("b"), F.col("id").alias("ib")), "b")
    few = spoken.where((F.col("n") > 1) & (F.col("n") <= COPIES))
    within = few.alias("p").join(few.alias("q"), "cls").where("p.id < q.id").select(F.col("p.id").alias("ia"), F.col("q.id").alias("ib"))
    star = members.join(counted.where(F.col("n") > COPIES), "cls").where("id > least").select(F.col("least").alias("ia"), F.col("id").alias("ib"))
    out = between.select("ia", "ib").unionByName(within).unionByName(star)
    return out.where("ia <> ib").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the smallest node it is connected with.

    Alternates large-star and small-star steps; the table of each round is written to
    the shared folder, and no set of links is ever gathered in one task.
    """
    edges = session.materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = session.materialise(small, "components")
        changed = after.exceptAll(edges).limit(1).count() + edges.exceptAll(after).limit(1).count()
        edges = after
        if not changed:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
    raise RuntimeError("the components did not settle")


def groups(df: DataFrame, threshold: float = 0.5, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row per id: group_id (the smallest id of the group), its class, the links of its class and its copies.

    Ids without partners form groups of one. Null ids have no row.
    """
    signed = classes(df, id_col, text_col)
    links = session.materialise(class_links(df, signed, threshold, id_col, text_col), "neardup-links")
    root = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    members = signed.select("cls", "id").distinct().join(root.withColumnRenamed("node", "cls"), "cls", "left").join(degree, "cls", "left")
    members = members.select("id", "cls", F.coalesce("root", "cls").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    name = members.groupBy("root").agg(F.min("id").alias("group_id"))
    copies = members.groupBy("cls").agg((F.count("*") - 1).alias("n_copies"))
    ids = df.select(F.col(id_col).cast("string").alias("id")).where("id is not null").distinct()
    found = members.join(name, "root").join(copies, "cls").select("id", "group_id", "cls", "n_links", "n_copies")
    return ids.join(found, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), F.col("cls").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"))
