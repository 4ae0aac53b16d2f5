"""Ordered analytics: neighbours, sessions, ranks, gaps. Partition by a key; never one global window over facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def neighbours(df: DataFrame, key: list[str], order: list[Column], id_col: str) -> DataFrame:
    """Each row with the ids before and after it within its key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumns({"prev_id": F.lag(id_col).over(w), "next_id": F.lead(id_col).over(w)})


def first_n(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= n)


# A key may hold a third of all rows, and its window would be one task. Where the order can be cut into
# blocks (a column that never falls in the order), windows run within blocks, and what they need from the
# blocks before is carried over in a table of one row a block. Keys must not be null then.


def _carried(blocks: DataFrame, key: list[str], over: Column, name: str) -> DataFrame:
    """(key, _b, name): an aggregate over the rows of all blocks before each."""
    return blocks.select(*key, "_b", over.over(Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias(name))


def strictly_increasing(df: DataFrame, key: list[str], order: list[Column], value: str, block: Column | None = None) -> DataFrame:
    """Rows whose value exceeds every value before it (the running greatest), starting from 0."""
    rows = df.withColumn("_b", F.lit(0) if block is None else block)
    inner = F.max(value).over(Window.partitionBy(*key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(inner, F.lit(0))
    if block is not None:
        tops = _carried(rows.groupBy(*key, "_b").agg(F.max(value).alias("_m")), key, F.max("_m"), "_above")
        rows = rows.join(tops, [*key, "_b"])
        before = F.greatest(before, F.coalesce("_above", F.lit(0)))
    return rows.withColumn("_before", before).where(F.col(value) > F.col("_before")).select(*df.columns)


def numbered(df: DataFrame, key: list[str], order: list[Column], name: str, block: Column | None = None) -> DataFrame:
    """Adds the row's number within its key, from 1."""
    rows = df.withColumn("_b", F.lit(0) if block is None else block)
    number = F.row_number().over(Window.partitionBy(*key, "_b").orderBy(*order))
    if block is not None:
        counts = _carried(rows.groupBy(*key, "_b").agg(F.count("*").alias("_m")), key, F.sum("_m"), "_rows")
        rows = rows.join(counts, [*key, "_b"])
        number = (number + F.coalesce("_rows", F.lit(0))).cast("int")
    return rows.withColumn(name, number).select(*df.columns, name)


def reset_sessions(df: DataFrame, key: list[str], order: list[Column], resets: Column) -> DataFrame:
    """Each row with the number of resets up to it."""
    return df.withColumn("session", F.sum(F.when(resets, 1).otherwise(0)).over(Window.partitionBy(*key).orderBy(*order)))


def first_of_repeats(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return first_n(df, key, order, 1).drop("rank")


def suffixed(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Each row with its number within the key and letters from the second on (b, c, ..., z, aa, ab, ...)."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    left, letters = F.col("seq"), []
    for _ in range(7):  # as many as the greatest row number has
        letters.append(F.when(left > 0, F.char(97 + (left - 1) % 26)).otherwise(""))
        left = F.floor((left - 1) / 26)
    return df.withColumn("seq", rn).withColumn("suffix", F.when(F.col("seq") > 1, F.concat(*reversed(letters))).otherwise(""))


def gaps(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, missing): the numbers from 0 to the greatest that a key lacks."""
    have = df.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(key, value).distinct()
    wanted = have.groupBy(key).agg(F.max(value).alias("m")).select(key, F.explode(F.sequence(F.lit(0), F.col("m"))).alias(value))
    return wanted.join(have, [key, value], "left_anti").withColumnRenamed(value, "missing")


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def neighbour_median(df: DataFrame, key: list[str], order: list[Column], value: str, around: int, least: int) -> DataFrame:
    """Each row with the median of up to ``around`` values before and after it (its own left out); null for fewer than ``least``.

    Neighbours are the rows of the key that have a value: rows without one form a window of their own.
    """
    w = Window.partitionBy(*key, F.col(value).isNull()).orderBy(*order)
    both = F.concat(F.collect_list(value).over(w.rowsBetween(-around, -1)), F.collect_list(value).over(w.rowsBetween(1, around)))
    s = F.sort_array(F.col("_near"))
    n = F.size("_near")
    mid = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return df.withColumn("_near", both).withColumn("near_median", F.when(n >= least, mid)).drop("_near")


def demote_outliers(df: DataFrame, key: list[str], order: list[Column], value: str, tolerance: float, around: int = 15, least: int = 3, passes: int = 4) -> DataFrame:
    """Values further than ``tolerance`` from the neighbours' median become null, up to ``passes`` times or until none does."""
    for _ in range(passes):
        near = neighbour_median(df, key, order, value, around, least)
        far = F.coalesce(F.abs(F.col(value) - F.col("near_median")) > tolerance, F.lit(False))
        df = near.withColumn(value, F.when(~far, F.col(value))).drop("near_median")
    return df


def as_of(events: DataFrame, checkpoints: DataFrame, key: list[str], at: str, value: str, block: Column | None = None) -> DataFrame:
    """Each event with the value of the last checkpoint at or before it (same key), in one sort and no range join."""
    marked = checkpoints.select(*key, at, F.col(value).alias("_value"), F.lit(0).alias("_kind")).unionByName(events.select(*events.columns, F.lit(1).alias("_kind")), allowMissingColumns=True)
    marked = marked.withColumn("_b", F.lit(0) if block is None else block)
    w = Window.partitionBy(*key, "_b").orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("_value", ignorenulls=True).over(w)
    if block is not None:
        lasts = marked.where("_kind = 0 and _value is not null").groupBy(*key, "_b").agg(F.max_by("_value", at).alias("_m"))
        every = marked.select(*key, "_b").distinct().join(lasts, [*key, "_b"], "left")
        marked = marked.join(_carried(every, key, F.last("_m", ignorenulls=True), "_last"), [*key, "_b"])
        found = F.coalesce(found, "_last")
    return marked.withColumn(f"as_of_{value}", found).where("_kind = 1").select(*events.columns, f"as_of_{value}")


def slices(text_df: DataFrame, bounds: DataFrame, key: str, text: str, offset: str) -> DataFrame:
    """The text between each boundary and the next (or the end)."""
    w = Window.partitionBy(key).orderBy(offset)
    spans = bounds.withColumn("_next", F.lead(offset).over(w))
    joined = spans.join(text_df.select(key, text), key)
    end = F.coalesce("_next", F.length(text))
    return joined.withColumn("slice", F.substring(F.col(text), F.col(offset) + 1, end - F.col(offset))).drop("_next", text)


def quota(df: DataFrame, unique: str, minority: Column, n: int, least_minority: int, seed: str) -> DataFrame:
    """``n`` rows with distinct ``unique``, first a quota of the minority, then the others, in the order of a hash."""
    order = F.sha2(F.concat(F.lit(seed), F.col("id")), 256)
    one = first_of_repeats(df.withColumn("_h", order), [unique], [F.col("_h"), F.col("id")]).withColumn("_minor", minority)
    quota_rows = one.where("_minor").orderBy("_h", "id").limit(least_minority)
    rest = one.where("not _minor").orderBy("_h", "id").limit(n - least_minority)
    return quota_rows.unionByName(rest).drop("_h", "_minor")
