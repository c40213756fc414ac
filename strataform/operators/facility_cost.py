"""The cost scenario of a local facility: quantity, capacity, unit cost, construction, subsidy, share of a person."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Nominal rates of national subsidy, bounds of the scenario, lifetimes.
SUBSIDY_RATES = {"seoul_special_city": "0.30", "metropolitan_city": "0.40", "city_or_county": "0.30", "joint_regional_facility": "0.50"}
MULTIPLIER_MIN, MULTIPLIER_MAX, MAX_DAYS = "1.00", "1.40", 366
TYPES = ("INCINERATION", "SORTING")
SMALL_CAPACITY, SHORT_LIFE, LONG_LIFE = 50, 15, 20

#: A band: facility type, exclusive lower and inclusive upper capacity (None: open), cost of a ton a day.
Band = tuple[str, str | None, str | None, str]


def _dec(c: Column, precision: int, scale: int) -> Column:
    return c.cast(f"decimal({precision},{scale})")


def _fits(band: Band) -> Column:
    kind, low, high, _ = band
    fits = F.col("facility_type") == kind
    if low is not None:
        fits &= F.col("capacity_tpd") > F.lit(low).cast("decimal(18,6)")
    if high is not None:
        fits &= F.col("capacity_tpd") <= F.lit(high).cast("decimal(18,6)")
    return fits


def facility_cost(df: DataFrame, bands: Sequence[Band]) -> DataFrame:
    """Add the steps of the cost scenario to rows of facility_type, annual_ton, share, days, multiplier,
    scheme and population.

    Each step is rounded half to even before the next. ``reason`` names the first fault
    (a null input is a fault of its kind); rows with one have no costs. Without a population only the
    share of a person is null, and ``population_reason`` says so. Bands are a short list that
    becomes part of the expression: there is no join.
    """
    rate = F.create_map(*[F.lit(x) for pair in SUBSIDY_RATES.items() for x in pair])[F.col("scheme")]
    ok = lambda c: F.coalesce(c, F.lit(False))
    valid_share = ok((F.col("share") > 0) & (F.col("share") <= 1))
    valid_days = ok(F.col("days").between(1, MAX_DAYS))
    out = df.withColumn("service_ton", F.when(valid_share & ok(F.col("annual_ton") >= 0), F.bround(_dec(F.col("annual_ton"), 20, 6) * _dec(F.col("share"), 5, 4), 6)))
    out = out.withColumn("capacity_tpd", F.when(valid_days, _dec(F.bround(_dec(F.col("service_ton"), 21, 6) / _dec(F.col("days"), 4, 0), 6), 18, 6)))
    n_bands, unit = F.lit(0), F.lit(None).cast("decimal(8,4)")
    for band in bands:
        n_bands = n_bands + F.when(ok(_fits(band)), 1).otherwise(0)
        unit = F.when(ok(_fits(band)), F.lit(band[3]).cast("decimal(8,4)")).otherwise(unit)
    out = out.withColumn(
        "reason",
        F.when(~ok(F.col("facility_type").isin(*TYPES)), "UNSUPPORTED_FACILITY_TYPE")
        .when(~valid_share, "INVALID_PROCESSING_SHARE")
        .when(~ok(F.col("multiplier").between(F.lit(MULTIPLIER_MIN).cast("decimal(4,2)"), F.lit(MULTIPLIER_MAX).cast("decimal(4,2)"))), "INVALID_UNDERGROUND_MULTIPLIER")
        .when(rate.isNull(), "UNKNOWN_SUBSIDY_SCHEME")
        .when(~ok(F.col("annual_ton") >= 0), "INVALID_QUANTITY")
        .when(~valid_days, "INVALID_OPERATING_DAYS")
        .when(n_bands == 0, "NO_MATCHING_COST_BAND")
        .when(n_bands > 1, "OVERLAPPING_COST_BAND"),
    )
    good = F.col("reason").isNull()
    out = out.withColumn("unit_cost", F.when(good, unit))
    out = out.withColumn("construction", _dec(F.bround(F.col("unit_cost") * F.col("capacity_tpd") * _dec(F.col("multiplier"), 4, 2), 6), 20, 6))
    out = out.withColumn("lifetime_years", F.when(good, F.when((F.col("facility_type") == TYPES[0]) & (F.col("capacity_tpd") > SMALL_CAPACITY), LONG_LIFE).otherwise(SHORT_LIFE)))
    out = out.withColumn("annualised", F.bround(F.col("construction") / _dec(F.col("lifetime_years"), 2, 0), 6))
    out = out.withColumn("subsidy", _dec(F.bround(F.col("construction") * rate.cast("decimal(3,2)"), 6), 20, 6))
    out = out.withColumn("local_share", _dec(F.col("construction") - F.col("subsidy"), 20, 6))
    counted = ok(F.col("population") > 0)
    won = F.bround(F.col("local_share") * F.lit("100000000").cast("decimal(9,0)") / _dec(F.col("population"), 10, 0), 2)
    return out.withColumn("won_per_person", F.when(counted, won)).withColumn("population_reason", F.when(good & ~counted, "NO_OFFICIAL_SERVICE_POPULATION"))
