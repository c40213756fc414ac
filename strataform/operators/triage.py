"""Rule cascades over deliveries: schema contracts, facility rows, file resolution, coverage, retries, stale keys.

Each is a chain of conditions in one order, the first that holds names the
outcome, over rows that joins have brought together; nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataform.functions.quantities import blank_to_null, parse_quantity

#: Fields of quantities by kind of facility, with the name that they get.
LANDFILL_FIELDS = {"throughput": "LANDFILL_QTY", "fill_area_m2": "FILL_AREA", "total_capacity_m3": "TOTAL_CAPA", "remaining_capacity_m3": "REMAIN_CAPA", "fill_quantity_m3": "FILL_QTY_M3"}
PROCESSING_FIELDS = {"throughput": "DISPOSAL_QTY", "residue_recycling": "RESIDUE_RECY", "residue_incineration": "RESIDUE_INCI", "residue_landfill": "RESIDUE_LAND"}


def schema_contract(declared: Column, required: list[str], pid: Column, wanted_pid: str, year: Column, wanted_year: int, unit: Column, wanted_unit: str) -> tuple[Column, Column]:
    """The first breach of a response's contract, and the required fields that it doesn't declare, in order; null and an empty list for a good one."""
    missing = F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce(declared, F.array().cast("array<string>"))))
    reason = (
        F.when(declared.isNull(), "HEADER_MISSING")
        .when(F.size(missing) > 0, "FIELDS_MISSING")
        .when(~pid.eqNullSafe(F.lit(wanted_pid)), "PID_MISMATCH")
        .when(~year.eqNullSafe(F.lit(wanted_year)), "YEAR_MISMATCH")
        .when(~unit.eqNullSafe(F.lit(wanted_unit)), "UNIT_MISMATCH")
    )
    return reason, missing


def facility_rows(rows: DataFrame, file_col: str, order_col: str) -> DataFrame:
    """Rows of facility deliveries with outcome, reason and the quantities of their kind.

    ``rows`` has kind (LANDFILL or another), sido, sigungu, name, address and the
    quantity fields as texts. Rows for whole regions (a region's total stands
    where a name or district should) are AGGREGATE; without name or address, or
    with a quantity that is none, REJECTED, by the first reason; else RECORD. A
    record has the quantities of its own kind, the others are null. ``index``
    numbers what isn't an aggregate within its file, rejected rows too, so that a
    row keeps its number when another is mended.
    """
    name, address = blank_to_null(F.col("name")), blank_to_null(F.col("address"))
    total = F.trim(F.coalesce("name", F.lit(""))).isin("합계", "소계", "총계") | F.trim(F.coalesce("sigungu", F.lit(""))).isin("합계", "소계")
    landfill = F.col("kind") == "LANDFILL"
    out = rows.withColumn("aggregate", total)
    asked = {f: (landfill, n) for n, f in LANDFILL_FIELDS.items()} | {f: (~landfill, n) for n, f in PROCESSING_FIELDS.items()}
    parsed = {f: parse_quantity(F.col(f)) for f in asked}
    wrong = [F.when(own & parsed[f][1].isNotNull() & (parsed[f][1] != "MISSING"), F.concat(F.lit(f"{f} "), parsed[f][1])) for f, (own, _) in asked.items()]
    reason = F.when(name.isNull(), "missing facility name").when(address.isNull(), "missing address").otherwise(F.coalesce(*wrong))
    out = out.withColumn("reason", F.when(~F.col("aggregate"), reason))
    outcome = F.when(F.col("aggregate"), "AGGREGATE").when(F.col("reason").isNotNull(), "REJECTED").otherwise("RECORD")
    place = F.sum(F.when(F.col("aggregate"), 0).otherwise(1)).over(Window.partitionBy(file_col).orderBy(order_col)) - 1
    out = out.withColumn("outcome", outcome).withColumn("index", F.when(~F.col("aggregate"), place))
    good = F.col("outcome") == "RECORD"
    names = dict.fromkeys([*LANDFILL_FIELDS, *PROCESSING_FIELDS])
    values = []
    for n in names:
        value = F.lit(None).cast("decimal(20,6)")
        if n in LANDFILL_FIELDS:
            value = F.when(landfill, parsed[LANDFILL_FIELDS[n]][0]).otherwise(value)
        if n in PROCESSING_FIELDS:
            value = F.when(~landfill, parsed[PROCESSING_FIELDS[n]][0]).otherwise(value)
        values.append(F.when(good, value).alias(n))
    return out.select(file_col, order_col, "kind", "outcome", "reason", "index", *values)


def resolve_files(files: DataFrame, rejections: DataFrame, reviewed: DataFrame, registry: DataFrame) -> DataFrame:
    """file, key (of the municipality), basis, decision and reason of each delivered file.

    In this order: a rule rejects the file; a reviewed map names its place; the
    name in the workbook and the one in the file name must not contradict each
    other; the workbook's wins, then the file name's; a name of a later division
    of the country, with nothing else to go by, is a boundary mismatch; all else
    is ambiguous.

    ``files``: file, metro, filename, file_name and workbook_name. ``rejections``
    (metro, filename, reason) and ``reviewed`` (metro, filename, name) have a row
    a file at most; ``registry``: metro, name, key, current (false: a name of a
    later division); names are distinct in a metro.
    """
    named = registry.where("current").select(F.col("metro").alias("m"), F.col("name").alias("n"), "key")

    def keyed(df: DataFrame, column: str, key: str) -> DataFrame:
        own = named.select(F.col("m").alias(f"__m_{key}"), F.col("n").alias(f"__n_{key}"), F.col("key").alias(key))
        return df.join(own, (F.col("metro") == F.col(f"__m_{key}")) & (F.col(column) == F.col(f"__n_{key}")), "left").drop(f"__m_{key}", f"__n_{key}")

    out = files.join(rejections.withColumnRenamed("reason", "rejected"), ["metro", "filename"], "left").join(reviewed.withColumnRenamed("name", "reviewed_name"), ["metro", "filename"], "left")
    out = keyed(keyed(keyed(out, "reviewed_name", "reviewed_key"), "workbook_name", "workbook_key"), "file_name", "filename_key")
    later = registry.where("NOT current").select("metro", F.col("name").alias("file_name"), F.lit(True).alias("later"))
    out = out.join(later, ["metro", "file_name"], "left")
    by_book, by_file = F.col("workbook_key"), F.col("filename_key")
    step = (
        F.when(F.col("rejected").isNotNull(), F.struct(F.lit(None).cast("string").alias("key"), F.lit("UNRESOLVED").alias("basis"), F.col("rejected").alias("reason")))
        .when(F.col("reviewed_key").isNotNull(), F.struct(F.col("reviewed_key").alias("key"), F.lit("REVIEWED_MAPPING").alias("basis"), F.lit(None).cast("string").alias("reason")))
        .when(by_book.isNull() & F.col("later"), F.struct(F.lit(None).cast("string").alias("key"), F.lit("UNRESOLVED").alias("basis"), F.lit("BOUNDARY_MISMATCH").alias("reason")))
        .when(by_book != by_file, F.struct(F.lit(None).cast("string").alias("key"), F.lit("UNRESOLVED").alias("basis"), F.lit("AMBIGUOUS_REGION_MAPPING").alias("reason")))
        .when(by_book.isNotNull(), F.struct(by_book.alias("key"), F.lit("WORKBOOK_NAME").alias("basis"), F.lit(None).cast("string").alias("reason")))
        .when(by_file.isNotNull(), F.struct(by_file.alias("key"), F.lit("FILENAME").alias("basis"), F.lit(None).cast("string").alias("reason")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("key"), F.lit("UNRESOLVED").alias("basis"), F.lit("AMBIGUOUS_REGION_MAPPING").alias("reason")))
    )
    out = out.withColumn("s", step)
    return out.select("file", "s.key", "s.basis", F.when(F.col("s.key").isNotNull(), "ACCEPTED").otherwise("REJECTED").alias("decision"), "s.reason")


def layer_coverage(present: Column, unpublished: Column, failed: Column, evaluated: Column, features: Column) -> Column:
    """What is known of a layer in a region: a source that was read and holds nothing isn't one that wasn't read."""
    return (
        F.when(~present & unpublished, "OFFICIAL_SOURCE_UNAVAILABLE")
        .when(~present, "SOURCE_MISSING")
        .when(failed, "VALIDATION_FAILURE")
        .when(~evaluated, "NOT_EVALUATED")
        .when(features > 0, "EVALUATED_WITH_FEATURES")
        .otherwise("EVALUATED_ZERO_FEATURES")
    )


def geocode_skip(status: Column, asked_before: Column, asking: Column, has_place: Column, retry_failed: bool) -> Column:
    """Why an address needs no call: it has its place, or failed before; null if it is to be asked. Another address is always asked."""
    same = asked_before.eqNullSafe(asking)
    failed = F.lit(not retry_failed) & (status == "FAILED") & same
    return F.when((status == "SUCCEEDED") & same & has_place, "already_geocoded").when(failed, "previously_failed")


def stale_keys(asked: DataFrame, stored: DataFrame, release: int, grid: str) -> DataFrame:
    """key and finding: FOUND in the active release and grid, CANDIDATE_KEY_NOT_IN_ACTIVE_RELEASE with the oldest release that has it, or CANDIDATE_CELL_NOT_FOUND."""
    here = (F.col("release") == release) & (F.col("grid") == grid)
    known = stored.groupBy("key").agg(F.bool_or(here).alias("active"), F.min(F.struct("release", "grid")).alias("oldest"))
    out = asked.select("key").join(known, "key", "left")
    finding = F.when(F.col("active"), "FOUND").when(F.col("oldest").isNotNull(), "CANDIDATE_KEY_NOT_IN_ACTIVE_RELEASE").otherwise("CANDIDATE_CELL_NOT_FOUND")
    return out.select("key", finding.alias("finding"), F.when(~F.col("active"), F.col("oldest.release")).alias("elsewhere"))


def policy_faults(weights: Column, components: list[str], curve: Column, hard: Column, review: Column) -> Column:
    """The broken invariants of a policy: exact components that sum to 1, a curve that rises in distance and never in score, codes that are hard or reviewed but not both."""
    total = F.aggregate(F.map_values(weights), F.lit(0).cast("decimal(20,8)"), lambda t, w: (t + w).cast("decimal(20,8)"))
    steps = F.zip_with(F.slice(curve, 1, F.size(curve) - 1), F.slice(curve, F.lit(2), F.size(curve) - 1), lambda a, b: (b.distance > a.distance) & (b.score <= a.score))
    names = F.array_sort(F.map_keys(weights)) == F.array(*[F.lit(c) for c in sorted(components)])
    return F.array_compact(
        F.array(
            F.when(~names, "COMPONENTS"), F.when(total != 1, "WEIGHT_SUM"), F.when(~F.forall(steps, lambda s: s), "CURVE"), F.when(F.arrays_overlap(hard, review), "CODES_OVERLAP"),
        )
    )
