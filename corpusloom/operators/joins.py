"""Joins, set operations and updates by key. Spark picks the strategies; nothing is broadcast by hand but one-row totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import ordered


def latest_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def union_later_wins(tables: list[DataFrame], key: str) -> DataFrame:
    """All rows; of rows with one key those of the latest table, columns missing in a table null."""
    ranked = [t.withColumn("_rank", F.lit(k)) for k, t in enumerate(tables)]
    out = ranked[0]
    for t in ranked[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in ("_rank", key)]
    return latest_per_key(out, [key], [F.col("_rank").desc(), *(F.col(c).cast("string").asc_nulls_last() for c in rest)]).drop("_rank")


def bridge(works: DataFrame, id_col: str = "id", members: str = "passage_ids") -> DataFrame:
    """(work_id, pos, passage_id), positions from 0."""
    return works.select(F.col(id_col).alias("work_id"), F.posexplode(members).alias("pos", "passage_id"))


def ordered_members(works: DataFrame, passages: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """(work_id, pos, passage_id, text) of the members that exist, in order; the fallback table is asked for those that don't."""
    one = passages.groupBy("id").agg(F.max("text").alias("text"))
    out = bridge(works).join(one, F.col("passage_id") == F.col("id"), "left").drop("id")
    if fallback is not None:
        other = fallback.groupBy("id").agg(F.max("text").alias("_other"))
        out = out.join(other, F.col("passage_id") == F.col("id"), "left").withColumn("text", F.coalesce("text", "_other")).drop("id", "_other")
    return out.where("text is not null").select("work_id", "pos", "passage_id", "text")


def anti(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    return left.join(right.select(*([key] if isinstance(key, str) else key)).distinct(), key, "left_anti")


def semi_flag(left: DataFrame, right: DataFrame, key: str, flag: str) -> DataFrame:
    """Each left row with whether its key is in the right table."""
    there = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_there", F.lit(True))
    return left.join(there, key, "left").withColumn(flag, F.coalesce("_there", F.lit(False))).drop("_there")


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Base rows whose key is not among the new ones, and the new rows."""
    return anti(base, new, key).unionByName(new, allowMissingColumns=True)


def patch(base: DataFrame, patches: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """Base with the column replaced where a patch has the key; of several patches the last by ``order``."""
    last = latest_per_key(patches, [key], [F.col(order).desc(), F.col(column).desc()]).select(key, F.col(column).alias("_patch"))
    return base.join(last, key, "left").withColumn(column, F.coalesce("_patch", column)).drop("_patch")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, status): matched, left only or right only, for all keys of both."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_r", F.lit(1))
    status = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "matched").when(F.col("_r").isNull(), "left only").otherwise("right only")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


#: How many anchors :func:`containing` broadcasts; more are met through shuffled words.
FEW_ANCHORS = 10_000


def containing(texts: DataFrame, anchors: DataFrame, text: str, anchor: str, key: str = "id", few: int = FEW_ANCHORS) -> DataFrame:
    """Rows of texts with each anchor they contain as a substring, whatever the case; blank anchors are in none.

    An anchor of three words or more is met through its longest inner word, which must be a
    whole word of the text. The anchors are a stated set and are counted first. Up to
    ``few`` of them go along with the texts, which then aren't moved at all. More of them
    are joined with words and keys, and the texts are met once more by the keys of the
    candidates; anchors of one or two words through the words of the vocabulary that hold
    the first (one word) or end as it does (two). Anchors without letters and digits are
    held against every text. Rows without a key are left out.
    """
    tokens = lambda low: F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    stated = anchors.where(F.trim(anchor) != "").withColumn("_t", tokens(F.lower(anchor)))
    inner = F.array_max(F.transform(F.slice("_t", 2, F.greatest(F.size("_t") - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    long = stated.where(F.size("_t") >= 3).withColumn("_w", inner["w"])
    short = stated.where(F.size("_t") < 3)
    held = F.lower(F.col(text)).contains(F.lower(F.col(anchor)))
    keyed = texts.where(F.col(key).isNotNull())
    if stated.limit(few + 1).count() <= few:
        words = long.agg(F.collect_set("_w")).scalar()
        # lowered once a text, below the explosion, and not once a pair
        lowered = keyed.withColumns({"_all": words, "_low": F.lower(text)})
        hits = lowered.withColumn("_w", F.explode(F.array_intersect(F.split("_low", r"[^\p{L}\p{N}]+"), F.col("_all")))).drop("_all")
        met = hits.join(F.broadcast(long.drop("_t").withColumn("_la", F.lower(anchor))), "_w").where(F.col("_low").contains(F.col("_la"))).drop("_w", "_low", "_la")
        return met.unionByName(keyed.join(F.broadcast(short.drop("_t")), held))
    words = keyed.select(F.col(key).alias("_key"), F.explode(F.array_distinct(tokens(F.lower(text)))).alias("_w"))
    begins = F.get("_t", F.lit(0))
    worded = short.where(F.size("_t") > 0)
    spread = words.select("_w").distinct().join(worded, F.when(F.size("_t") == 1, F.col("_w").contains(begins)).otherwise(F.col("_w").endswith(begins))).select(*worded.columns, "_w")
    met = words.join(long.unionByName(spread).drop("_t"), "_w").drop("_w").distinct()
    found = keyed.join(met, F.col(key) == F.col("_key")).where(held).drop("_key")
    return found.unionByName(keyed.join(short.where(F.size("_t") == 0).drop("_t"), held))


def keyword_dimension(terms: DataFrame, keywords: DataFrame) -> DataFrame:
    """(term, dimension): the first dimension (by ordinal) of which a keyword contains the term or is contained in it.

    Both are small vocabularies; the pairs are those that share a three-letter run.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    a = terms.where("length(term) >= 3").select("term", F.explode(grams(F.col("term"))).alias("g"))
    b = keywords.where("length(keyword) >= 3").select("dimension", "ordinal", "keyword", F.explode(grams(F.col("keyword"))).alias("g"))
    hits = a.join(b, "g").where(F.col("term").contains(F.col("keyword")) | F.col("keyword").contains(F.col("term")))
    return hits.groupBy("term").agg(F.min(F.struct("ordinal", "dimension")).alias("m")).select("term", F.col("m.dimension").alias("dimension"))


def zip_by_position(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column], key: str, left_block: Column | None = None, right_block: Column | None = None) -> DataFrame:
    """Rows of both sides with equal key and equal position in their order within it; blocks as in :func:`ordered.numbered`."""
    a = ordered.numbered(left, [key], left_order, "_n", left_block)
    b = ordered.numbered(right, [key], right_order, "_n", right_block)
    return a.join(b, [key, "_n"]).withColumnRenamed("_n", "position")


def redirects(works: DataFrame) -> DataFrame:
    """(legacy_id, target): every old id with its work, or with the work that one is a duplicate of."""
    duplicate = F.regexp_extract(F.coalesce("closed_reason", F.lit("")), r"^duplicate-of:(\S+)", 1)
    target = F.when(duplicate != "", duplicate).otherwise(F.col("id"))
    pairs = works.select(target.alias("target"), F.explode("legacy_ids").alias("legacy_id")).where("legacy_id is not null")
    return pairs.groupBy("legacy_id").agg(F.min("target").alias("target"))


def redirects_filled(known: DataFrame, ids: DataFrame, rules: list[tuple[str, str]], id_col: str = "id") -> DataFrame:
    """The redirects (legacy_id, target), and for ids that have none the target of the first rule whose prefix the id begins with."""
    target = F.coalesce(*(F.when(F.col("legacy_id").startswith(prefix), F.lit(t)) for prefix, t in rules))
    loose = ids.select(F.col(id_col).alias("legacy_id")).where("legacy_id is not null").distinct().join(known.select("legacy_id"), "legacy_id", "left_anti")
    return known.select("legacy_id", "target").unionByName(loose.select("legacy_id", target.alias("target")).where("target is not null"))


def by_source(passages: DataFrame) -> DataFrame:
    """(source_id, pos, id): the ids of a source in the order of chunk index and id, numbered from 0; a repeated id once."""
    one = passages.where("source_id is not null").groupBy("source_id", "id").agg(F.min("chunk_index").alias("c"))
    return one.select("source_id", (F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("c").asc_nulls_last(), "id")) - 1).alias("pos"), "id")


def cache_state(cache: DataFrame, now: Column, ttl: str, key: str, at: str, value: str) -> DataFrame:
    """(key, value, state) of the last value of each key: fresh within ``ttl`` of ``now``, else stale, to be used only if a new one fails."""
    last = latest_per_key(cache.where(F.col(key).isNotNull() & F.col(at).isNotNull()), [key], [F.col(at).desc(), F.col(value).desc_nulls_last()])
    return last.select(key, value, F.when(F.col(at) + F.expr(f"interval {ttl}") > now, "fresh").otherwise("stale").alias("state"))


def union_unique(base: DataFrame, more: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(all rows, (key, in_base, in_more) of keys that are there more than once): a gate to look at before the union is written."""
    both = base.unionByName(more, allowMissingColumns=True)
    counts = base.groupBy(key).agg(F.count("*").alias("in_base")).join(more.groupBy(key).agg(F.count("*").alias("in_more")), key, "full_outer")
    twice = counts.select(key, F.coalesce("in_base", F.lit(0)).alias("in_base"), F.coalesce("in_more", F.lit(0)).alias("in_more")).where("in_base + in_more > 1")
    return both, twice
