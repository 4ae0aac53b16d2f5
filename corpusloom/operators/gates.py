"""Gates: tables of violations. An empty table lets a result through; nothing here writes or stops by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType
from pyspark.sql.window import Window

from corpusloom.operators import joins, repair

STANCES = ("advocacy", "refutation", "absent")


def block_counts(blocks: DataFrame, expected: int, key: str = "id", block: str = "block") -> DataFrame:
    """(key, expected, found) of documents that came apart into another number of blocks than expected."""
    return blocks.groupBy(key).agg(F.countDistinct(block).alias("found")).where(F.col("found") != expected).select(key, F.lit(expected).alias("expected"), "found")


def result_schema() -> StructType:
    """What an external judge's result must look like; fields are parsed leniently and then held against :func:`judge_problems`."""
    scored = StructType([StructField("score", IntegerType())])
    stanced = StructType([StructField("stance", StringType())])
    return StructType([
        StructField("overall_score", IntegerType()), StructField("label", StringType()), StructField("summary", StringType()),
        StructField("dimensions", MapType(StringType(), scored)), StructField("counter_indicators", MapType(StringType(), stanced)),
    ])


def json_schema(dimensions: list[str], counters: list[str]) -> dict:
    """The same as a JSON Schema document, to send along with a request."""
    closed = lambda properties: {"type": "object", "properties": properties, "required": sorted(properties), "additionalProperties": False}
    score = {"type": "integer", "minimum": 0, "maximum": 100}
    return closed({
        "overall_score": score, "label": {"type": "string"}, "summary": {"type": "string"},
        "dimensions": closed({d: closed({"score": score}) for d in dimensions}),
        "counter_indicators": closed({c: closed({"stance": {"enum": list(STANCES)}}) for c in counters}),
    })


def judge_problems(results: DataFrame, dimensions: list[str], counters: list[str], key: str = "id", payload: str = "payload") -> DataFrame:
    """(key, problem) of JSON results that miss keys, have other dimensions or indicators than asked for, or values out of range."""
    r = results.select(key, F.from_json(payload, result_schema()).alias("r")).select(key, "r.*")
    same = lambda column, wanted: F.size(F.array_except(F.map_keys(column), wanted)) + F.size(F.array_except(wanted, F.map_keys(column))) == 0
    wanted = {"dimensions": F.array(*map(F.lit, dimensions)), "counter_indicators": F.array(*map(F.lit, counters))}
    missing = [F.when(F.col(c).isNull(), f"missing {c}") for c in ("overall_score", "label", "summary", "dimensions", "counter_indicators")]
    keys = [F.when(F.col(c).isNotNull() & ~same(F.col(c), w), f"keys of {c}") for c, w in wanted.items()]
    bad = lambda s: s.isNull() | (s < 0) | (s > 100)
    ranges = [
        F.when(F.col("overall_score").isNotNull() & bad(F.col("overall_score")), "overall_score out of range"),
        F.when(F.exists(F.map_values("dimensions"), lambda x: bad(x["score"])), "dimension score out of range"),
        F.when(F.exists(F.map_values("counter_indicators"), lambda x: ~F.coalesce(x["stance"].isin(*STANCES), F.lit(False))), "unknown stance"),
    ]
    return r.select(key, F.explode(F.array_compact(F.array(*missing, *keys, *ranges))).alias("problem"))


def reextraction(old: DataFrame, new: DataFrame, key: str, text: str = "text", tolerance: float = 0.08, opening: int = 60, most: int = 15) -> DataFrame:
    """(key, reasons, halted) of texts whose new extraction fails: no question mark left, words off by more than the tolerance, another opening.

    ``halted`` on every row if more than ``most`` texts fail. A text missing on either side fails.
    """
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    flat = lambda c: F.substring(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")), 1, opening)
    a, b = old.select(key, F.col(text).alias("_old")), new.select(key, F.col(text).alias("_new"))
    both = a.join(b, key, "full_outer")
    there = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(~there, "missing"),
        F.when(there & F.col("_old").contains("?") & ~F.col("_new").contains("?"), "questions"),
        F.when(there & (F.abs(words(F.col("_new")) - words(F.col("_old"))) > tolerance * words(F.col("_old"))), "words"),
        F.when(there & (flat(F.col("_old")) != flat(F.col("_new"))), "opening"),
    ))
    failed = both.select(key, F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")
    return failed.withColumn("halted", failed.agg(F.count("*") > most).scalar())


def sentinel_verdicts(passages: DataFrame, sentinels: DataFrame, tolerance: float = 0.82, bonus: float = 0.05) -> DataFrame:
    """(id, verdict, passage_id, similarity, in_scope) of sentinels (id, expect, anchor, canonical, source_id).

    Among the passages that hold the anchor the one whose wording is nearest counts, those of
    the expected source (its id, or passage ids that begin with it) with a small bonus, the
    smallest id of equal ones. PASS from the tolerance on, WORDING below, FAIL without a
    passage. A sentinel expected to be absent passes only without one.
    """
    texts = passages.select(F.col("id").alias("passage_id"), F.col("source_id").alias("_source"), "text").where("text is not null")
    hits = joins.containing(texts, sentinels.select("id", "anchor", F.col("canonical").alias("quote"), F.col("source_id").alias("_wanted")), "text", "anchor", "passage_id")
    scope = F.coalesce((F.col("_source") == F.col("_wanted")) | F.col("passage_id").startswith(F.col("_wanted")), F.lit(False))
    scored = repair.wording(hits.select("id", "passage_id", "text", "quote", scope.alias("in_scope"))).drop("text", "quote").distinct()
    w = Window.partitionBy("id").orderBy((F.col("similarity") + F.when(F.col("in_scope"), bonus).otherwise(0.0)).desc(), "passage_id")
    best = scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    found = sentinels.select("id", F.coalesce("expect", F.lit("present")).alias("expect")).join(best, "id", "left")
    verdict = F.when(F.col("expect") == "absent", F.when(F.col("passage_id").isNull(), "PASS").otherwise("FAIL")).when(F.col("passage_id").isNull(), "FAIL").when(F.col("similarity") >= tolerance, "PASS").otherwise("WORDING")
    return found.select("id", verdict.alias("verdict"), "passage_id", F.round("similarity", 2).alias("similarity"), "in_scope")


def first_present(passages: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, ordinal, anchor, found): of each id's candidate anchors (id, ordinal, anchor) the first that any passage holds, and how many do; null if none is."""
    hits = joins.containing(passages.select(F.col("id").alias("passage_id"), "text").where("text is not null"), anchors.select("id", "ordinal", "anchor"), "text", "anchor", "passage_id")
    counted = hits.groupBy("id", "ordinal", "anchor").agg(F.countDistinct("passage_id").alias("found"))
    first = counted.groupBy("id").agg(F.min(F.struct("ordinal", "anchor", "found")).alias("m"))
    return anchors.select("id").distinct().join(first, "id", "left").select("id", "m.ordinal", "m.anchor", F.coalesce("m.found", F.lit(0)).alias("found"))


def required(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join by key; a left row without a partner is an error when it is read."""
    there = right.withColumn("_there", F.lit(True))
    joined = left.join(there, key, "left")
    checked: Column = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string")))).otherwise(F.col(key))
    return joined.withColumn(key, checked).drop("_there")


def ranked(df: DataFrame, verdict: str, order: list[str], weight: str, tie: str) -> DataFrame:
    """Adds ``place``: by the verdict's rank in ``order`` (unknown ones last), then by falling weight."""
    rank = F.coalesce(*(F.when(F.col(verdict) == v, k) for k, v in enumerate(order)), F.lit(len(order)))
    sums = df.withColumn("_rank", rank)
    return sums.withColumn("place", F.row_number().over(Window.partitionBy("_rank").orderBy(F.col(weight).desc(), tie))).withColumn("rank", F.col("_rank")).drop("_rank")
