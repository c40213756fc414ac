"""Joins whose cardinality is part of the result.

A missing or ambiguous match is a value with a reason, never a dropped row and
never a zero, and a lookup never multiplies the rows that it looks up for.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def all_of(*conditions: Column | None) -> Column:
    """AND of the conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def checked_lookup(facts: DataFrame, side: DataFrame, on: Sequence[str], value: str, missing: str, ambiguous: str) -> DataFrame:
    """``facts`` with the single value of their key, or a reason why there is none.

    The side is aggregated to one row a key before the join, so facts can't fan
    out. Null keys find nothing.
    """
    found = side.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"), F.first(value).alias("__v"))
    joined = facts.join(found, list(on), "left")
    n = F.coalesce(F.col("__n"), F.lit(0))
    return joined.withColumn(value, F.when(n == 1, F.col("__v"))).withColumn("reason", F.when(n == 0, missing).when(n > 1, ambiguous)).drop("__n", "__v")


def reconcile(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row a key of either side: both, left_only, right_only or duplicate."""
    a = left.groupBy(*on).agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.groupBy(*on).agg(F.count(F.lit(1)).alias("right_rows"))
    both = a.join(b, list(on), "full")
    many = (F.coalesce("left_rows", F.lit(0)) > 1) | (F.coalesce("right_rows", F.lit(0)) > 1)
    state = F.when(many, "duplicate").when(F.col("right_rows").isNull(), "left_only").when(F.col("left_rows").isNull(), "right_only").otherwise("both")
    return both.select(*on, state.alias("state"))


#: Bands and kinds that may be sent to all tasks, and cuts of the axis for more bands than that.
FEW, CUTS = 2_000, 1_000


def _in_band(b: Column, x: Column) -> Column:
    above = b["low"].isNull() | (x > b["low"]) | (~b["low_open"] & (x == b["low"]))
    below = b["high"].isNull() | (x < b["high"]) | (~b["high_open"] & (x == b["high"]))
    return F.coalesce(above & below, F.lit(False))


def band_join(facts: DataFrame, bands: DataFrame, value: Column, none: str = "NO_BAND", many: str = "SEVERAL_BANDS") -> DataFrame:
    """The single band of each row: bands (band, low, high, low_open, high_open), null bounds unbounded.

    Up to ``FEW`` bands are gathered into one array, so that each row is matched
    where it is. More of them meet the distinct values in an equi-join on the
    parts of the axis between quantiles of their bounds. No row fans out.
    """
    joined = facts.withColumn("__x", value)
    if len(bands.take(FEW + 1)) <= FEW:
        held = bands.agg(F.array_sort(F.collect_list(F.struct("band", "low", "high", "low_open", "high_open"))).alias("__bands"))
        joined = joined.crossJoin(F.broadcast(held)).withColumn("__hits", F.filter("__bands", lambda b: _in_band(b, F.col("__x"))))
        joined = joined.withColumns({"__n": F.size("__hits"), "__band": F.get(F.col("__hits"), 0)["band"]}).drop("__bands", "__hits")
    else:
        ends = bands.select(F.explode(F.array(F.col("low").cast("double"), F.col("high").cast("double"))).alias("end")).where("end IS NOT NULL")
        cuts = sorted(set(ends.approxQuantile("end", [i / CUTS for i in range(CUTS + 1)], 1 / CUTS)))
        between = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
        part = lambda v: F.size(F.filter(between, lambda c: c <= v.cast("double")))
        first, last = F.when(F.col("low").isNull(), 0).otherwise(part(F.col("low"))), F.when(F.col("high").isNull(), len(cuts)).otherwise(part(F.col("high")))
        spread = bands.where(first <= last).select(F.struct("band", "low", "high", "low_open", "high_open").alias("b"), F.explode(F.sequence(first, last)).alias("__part"))
        asked = joined.where("__x IS NOT NULL").select("__x").distinct().withColumn("__part", part(F.col("__x")))
        met = asked.join(spread, "__part").where(_in_band(F.col("b"), F.col("__x"))).groupBy("__x").agg(F.count(F.lit(1)).cast("int").alias("__n"), F.min("b.band").alias("__band"))
        # null values have null bounds only, as many as there are bands without any
        free = bands.where("low IS NULL AND high IS NULL").agg(F.count(F.lit(1)).cast("int").alias("__n"), F.min("band").alias("__band")).select(F.lit(None).cast(joined.schema["__x"].dataType).alias("__y"), "__n", "__band")
        met = met.withColumnRenamed("__x", "__y").union(free)
        joined = joined.join(met, F.col("__x").eqNullSafe(F.col("__y")), "left").withColumn("__n", F.coalesce("__n", F.lit(0))).drop("__y")
    n = F.col("__n")
    return joined.withColumn("band", F.when(n == 1, F.col("__band"))).withColumn("reason", F.when(n == 0, none).when(n > 1, many)).drop("__n", "__band", "__x")


def missing_combinations(keys: DataFrame, kinds: DataFrame, observed: DataFrame, on: Sequence[str], reason: str = "SOURCE_NOT_REPORTED") -> DataFrame:
    """Pairs of every key and every kind that aren't observed: as many rows as keys times kinds, less those observed.

    Up to ``FEW`` kinds are sent to all tasks; more of them stay where they are.
    """
    few = len(kinds.take(FEW + 1)) <= FEW
    pairs = keys.crossJoin(F.broadcast(kinds) if few else kinds)
    return pairs.join(observed.select(*on).distinct(), list(on), "left_anti").withColumn("reason", F.lit(reason))


def longest_prefix(names: DataFrame, registry: DataFrame, name: str, prefix: str, scope: Sequence[str] = ()) -> DataFrame:
    """``names`` with their longest registered prefix within their scope.

    An equi-join on the prefixes that a name can have: its own leading parts of
    the lengths that the registry uses, so nothing is compared pair by pair. Only
    the distinct lengths are sent to all tasks, no more than the longest has letters.
    """
    lengths = registry.agg(F.array_sort(F.collect_set(F.length(prefix))).alias("__lengths"))
    # names repeat, and what else their rows have doesn't matter: each is looked up once
    asked = names.select(*scope, F.col(name).alias("__name")).distinct()
    parts = asked.crossJoin(F.broadcast(lengths)).select(*scope, "__name", F.explode(F.transform("__lengths", lambda n: F.substring(F.col("__name"), F.lit(1), n))).alias("__part")).where(F.length("__part") > 0).distinct()
    reg = registry.select(*scope, F.col(prefix).alias("__part")).distinct()
    best = parts.join(reg, [*scope, "__part"]).groupBy(*scope, "__name").agg(F.max_by("__part", F.length("__part")).alias("matched_prefix"))
    keys = {c: f"__{i}" for i, c in enumerate(scope)}
    best = best.withColumnsRenamed(keys)
    met = F.col(name) == F.col("__name")
    for c, k in keys.items():
        met = met & (names[c] == F.col(k))
    return names.join(best, met, "left").drop("__name", *keys.values())


def complete_sum(members: DataFrame, values: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """Sum of a value over all members of a group, null with a reason unless each member has exactly one."""
    one = values.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.first(value).alias("__v"))
    joined = members.join(one, key, "left")
    out = joined.groupBy(group).agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("__n") == 1).alias("found"), F.sum(F.when(F.col("__n") == 1, F.col("__v"))).alias("__s"))
    full = F.col("expected") == F.col("found")
    return out.select(group, "expected", "found", F.when(full, F.col("__s")).alias(value), F.when(~full, "INCOMPLETE_MEMBERS").alias("reason"))
