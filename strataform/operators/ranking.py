"""Deterministic ranks, percentiles, classes and comparisons of rankings.

Ranks over a whole table never sort it in one task: values are counted first,
the counts of the distinct values are summed in order, and rows are numbered
within their value and range of keys. The values are decimals of a bounded scale, so the one
ordered sum is over a bounded domain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataform.functions.rounding import half_even

#: Bits of a whole-number key that are left out of its range: a value's rows are numbered by ranges of 65,536 keys.
RANGE_BITS = 16


def _before(df: DataFrame, value: str, descending: bool, times: str | None = None) -> DataFrame:
    """Each distinct value, how many rows come before it, and how many rows there are; a row stands for ``times`` rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg((F.sum(times) if times else F.count(F.lit(1))).alias("__n"))
    order = F.desc(value) if descending else F.asc(value)
    running = F.sum("__n").over(Window.orderBy(order)) - F.col("__n")
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("population"))
    return counts.select(F.col(value).alias("__v"), running.alias("__before")).crossJoin(F.broadcast(total))


def rank_all(df: DataFrame, value: str, key: str, rank: str = "rank", descending: bool = True) -> DataFrame:
    """Add ``rank``, 1-based in the total order of value and key, and ``population``. Null values aren't ranked.

    A value that many rows have is numbered in many tasks, one for each range of
    whole-number keys; other keys, and null ones, make one range, before the rest.
    """
    whole = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    bucket = F.shiftright(F.col(key).cast("long"), RANGE_BITS) if whole else F.lit(None).cast("long")
    ranged = df.where(F.col(value).isNotNull()).withColumn("__range", F.coalesce(bucket, F.lit(-(1 << 62))))
    counts = ranged.groupBy(value, "__range").agg(F.count(F.lit(1)).alias("__m"))
    before = _before(counts, value, descending, "__m")
    ahead = F.sum("__m").over(Window.partitionBy("__v").orderBy("__range")) - F.col("__m")
    places = counts.join(before, counts[value] == before["__v"]).select("__v", F.col("__range").alias("__r"), (F.col("__before") + ahead).alias("__before"), "population")
    joined = ranged.join(places, (ranged[value] == places["__v"]) & (ranged["__range"] == places["__r"]))
    within = F.row_number().over(Window.partitionBy("__v", "__r").orderBy(key))
    return joined.withColumn(rank, (F.col("__before") + within).cast("long")).drop("__v", "__r", "__range", "__before")


def percentile_rank(df: DataFrame, value: str, out: str = "percentile") -> DataFrame:
    """Add the share of the other rows that are strictly less, six places half-even; 0.5 for a single row, null for null."""
    before = _before(df, value, False)
    joined = df.join(before, df[value] == before["__v"], "left")
    n = F.col("population") - 1
    share = F.when(F.col("population") == 1, F.lit(0.5)).when(F.col("__v").isNotNull(), F.col("__before") / n)
    return joined.withColumn(out, half_even(share.cast("decimal(38,18)"), 6, 9)).drop("__v", "__before", "population")


def top_fraction(rank: Column, population: Column, share: float = 0.10) -> Column:
    """Whether a rank is within the first max(1, ceil(share * n)) rows."""
    return rank <= F.greatest(F.lit(1), F.ceil(population * F.lit(share)))


def quantile_breaks(df: DataFrame, value: str, classes: int) -> DataFrame:
    """One row: the distinct values at places round(step (n - 1) / classes), halves up, in order, as ``breaks``.

    Each place is found among the counts of the distinct values, so no task has
    all rows. Null values take no part; without values there are no breaks.
    """
    before = _before(df, value, False)
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__w")).agg(F.count(F.lit(1)).alias("__n"))
    held = before.join(counts, F.col("__v") == F.col("__w"))
    places = F.array(*[F.floor(F.lit(step) * (F.col("population") - 1) / classes + 0.5) for step in range(1, classes)])
    within = F.exists(places, lambda p: (p >= F.col("__before")) & (p < F.col("__before") + F.col("__n")))
    return held.where(within).agg(F.sort_array(F.collect_list("__v")).alias("breaks"))


def class_index(value: Column, breaks: Column) -> Column:
    """How many breaks a value reaches."""
    return F.size(F.filter(breaks, lambda b: value >= b))


def rank_diff(a: DataFrame, b: DataFrame, key: str, top: int) -> DataFrame:
    """Two served lists (key, rank) by key: delta, movement, direction, and why a side is absent."""
    left = a.where(F.col("rank") <= top).select(key, F.col("rank").alias("rank_a"))
    right = b.where(F.col("rank") <= top).select(key, F.col("rank").alias("rank_b"))
    both = left.join(right, key, "full")
    delta = F.col("rank_b") - F.col("rank_a")
    return both.select(
        key,
        "rank_a",
        "rank_b",
        delta.alias("delta"),
        F.abs(delta).alias("movement"),
        F.when(delta < 0, "rose").when(delta > 0, "fell").when(delta == 0, "held").when(F.col("rank_a").isNull(), "entered").otherwise("left").alias("direction"),
    )


def largest_remainder(df: DataFrame, group: Sequence[str], value: str, key: str, whole: int = 100) -> DataFrame:
    """Integer shares of each group that add up to ``whole``: floors, then one more to the largest fractions."""
    w = Window.partitionBy(*group)
    total = F.sum(value).over(w)
    scaled = F.col(value).cast("decimal(20,0)") * whole
    low = F.floor(F.try_divide(scaled, total))
    rest = scaled - low * total
    at = F.row_number().over(w.orderBy(F.desc("__rest"), key))
    out = df.withColumn("__low", low).withColumn("__rest", rest).withColumn("__short", F.lit(whole) - F.sum("__low").over(w))
    return out.withColumn("share", (F.col("__low") + F.when(at <= F.col("__short"), 1).otherwise(0)).cast("long")).drop("__low", "__rest", "__short")
