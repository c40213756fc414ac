"""Delivered files as tables: paged JSON, wide CSV, file inventories, GeoJSON."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from strataform.operators.triage import LANDFILL_FIELDS, PROCESSING_FIELDS, facility_rows

#: The name of a month's column, and the form of a region's cell, in population deliveries.
MONTH_COLUMN = r"^([0-9]{4})년([0-9]{2})월_총인구수$"
REGION_CELL = r"^(.*?)\s*\(\s*([0-9]+)\s*\)\s*$"


class IncompleteDelivery(ValueError):
    """A delivery lacks rows that it says it has, or doesn't say how many it has."""


def read_pages(spark: SparkSession, path: str, row_schema: str, rows: str = "data", total: str = "totalCount") -> DataFrame:
    """All rows of a paged JSON delivery, one document a file, with the file they came from.

    The pages are read by Spark. Every page must state the same total, and as
    many rows must be there; else IncompleteDelivery, and no partial table. A
    folder without pages is incomplete too. Nulls within rows stay.
    """
    pages = spark.read.schema(f"`{total}` long, `{rows}` array<struct<{row_schema}>>").option("multiLine", True).json(path)
    pages = pages.withColumn("file", F.input_file_name())
    seen = pages.agg(F.count(F.lit(1)).alias("pages"), F.count(total).alias("stated"), F.min(total).alias("low"), F.max(total).alias("high"), F.sum(F.coalesce(F.size(rows), F.lit(0))).alias("rows")).first()
    if not seen["pages"] or seen["stated"] < seen["pages"] or seen["low"] != seen["high"] or seen["rows"] != seen["low"]:
        raise IncompleteDelivery(f"{path}: {seen['pages']} pages state {seen['low']} to {seen['high']} rows and hold {seen['rows']}")
    return pages.select(F.explode(rows).alias("row"), "file").select("row.*", "file")


def read_wide_months(spark: SparkSession, path: str, region_col: str = "행정구역", encoding: str = "cp949") -> DataFrame:
    """name, code, month, population and reason, of a CSV with a block of columns for each month.

    Only the total of each block is read. Zero and blank cells are unpublished,
    texts that aren't whole numbers are rejected; a region cell without a code
    has a null one. All rows come back; an empty file gives an empty table.
    """
    # Spark's reader knows few encodings: it reads bytes as characters, which are decoded afterwards
    wide = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    wide = wide.toDF(*[c.encode("latin-1").decode(encoding).lstrip("\ufeff") for c in wide.columns])
    months = [c for c in wide.columns if _month(c)]
    if region_col not in wide.columns or not months:
        raise IncompleteDelivery(f"{path}: no column {region_col}, or none of a month")

    @pandas_udf(StringType())
    def decoded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else t.encode("latin-1").decode(encoding))

    region = decoded(F.col(f"`{region_col}`"))
    long = wide.select(
        F.when(region.rlike(REGION_CELL), F.regexp_extract(region, REGION_CELL, 1)).otherwise(F.trim(region)).alias("name"),
        F.when(region.rlike(REGION_CELL), F.regexp_extract(region, REGION_CELL, 2)).alias("code"),
        F.explode(F.array(*[F.struct(F.lit(_month(c)).alias("month"), F.col(f"`{c}`").alias("cell")) for c in months])).alias("m"),
    )
    plain = F.regexp_replace(F.trim(F.coalesce("m.cell", F.lit(""))), ",", "")
    value = F.when(plain.rlike("^[0-9]+$"), plain).try_cast("long")
    reason = F.when(plain.isin("", "0"), "UNPUBLISHED").when(value.isNull(), "NOT_INTEGER")
    return long.select("name", "code", F.col("m.month").alias("month"), F.when(reason.isNull(), value).alias("population"), reason.alias("reason"))


def _month(column: str) -> str | None:
    found = re.match(MONTH_COLUMN, column)
    return f"{found[1]}-{found[2]}" if found else None


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, bytes and sha256 of every file below a folder, but lock files (~$) and hidden ones; hashed by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    files = files.select("path", name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return files.where(~F.col("name").startswith("~$") & ~F.col("name").startswith("."))


#: Fields of a facility's row as text, and those that hold for all rows of a page.
FACILITY_FIELDS = ["name", "sido", "sigungu", "address", *LANDFILL_FIELDS.values(), *PROCESSING_FIELDS.values()]


def read_facilities(spark: SparkSession, path: str, kinds: dict[str, str], year: int) -> DataFrame:
    """Facility rows of paged deliveries of several data sets, sorted out by ``triage.facility_rows``; with file, pid and place in the file.

    ``kinds`` names the kind of facility of each data set. Pages say their data
    set, year and result code; a page of another data set or year is an error, a
    page without data (code NO_DATA) has no rows. Nothing else is dropped.
    """
    fields = ", ".join(f"`{f}` string" for f in FACILITY_FIELDS)
    schema = f"pid string, year int, code string, data array<struct<{fields}>>"
    pages = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("pid")]
    pages = pages.withColumn("kind", kind)
    wrong = pages.where(F.col("kind").isNull() | ~F.col("year").eqNullSafe(F.lit(year)) | ((F.col("code") != "NO_DATA") & F.col("data").isNull()))
    if not wrong.isEmpty():
        raise IncompleteDelivery(f"{path}: pages of another data set or year, or without rows")
    rows = pages.where("code <> 'NO_DATA'").select("file", "pid", "kind", F.posexplode("data").alias("place", "row")).select("file", "pid", "kind", "place", "row.*")
    return facility_rows(rows, "file", "place").join(pages.select("file", "pid").distinct(), "file")


def discover(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every layer that a manifest names and every file found: dataset, layer, path and state.

    ``manifest``: dataset, layer, folder, suffix, coverage (REQUIRED, OPTIONAL or
    UNPUBLISHED); ``files``: path. A layer has the files in its folder that end
    in its suffix. FOUND; DUPLICATE where a layer has several; MISSING and
    ABSENT for a required and an optional layer without any, UNPUBLISHED where
    none is expected; UNEXPECTED for a file of no layer, or of one that should
    have none.
    """
    folder = F.regexp_extract("path", "([^/]*)/[^/]*$", 1)
    own = files.select("path", folder.alias("__folder"))
    held = own.join(manifest, (F.col("__folder") == F.col("folder")) & F.col("path").endswith(F.col("suffix")), "full")
    several = F.count("path").over(Window.partitionBy("dataset", "layer")) > 1
    state = (
        F.when(F.col("layer").isNull(), "UNEXPECTED")
        .when(F.col("path").isNull(), F.when(F.col("coverage") == "REQUIRED", "MISSING").when(F.col("coverage") == "OPTIONAL", "ABSENT").otherwise("UNPUBLISHED"))
        .when(F.col("coverage") == "UNPUBLISHED", "UNEXPECTED")
        .when(several, "DUPLICATE")
        .otherwise("FOUND")
    )
    return held.select("dataset", "layer", "path", state.alias("state"))


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """The properties and the shape of each feature of GeoJSON files: polygons of rings of structs x, y, outer ring first.

    Polygons and multipolygons are read; a null geometry has a null shape. Any
    other kind of geometry, and one that can't be read, is an error. For spatial
    joins the rings of all polygons are one list: ``flatten(shape)``.
    """
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    features = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one = F.from_json(text, "array<array<array<double>>>", {"mode": "FAILFAST"})
    many = F.from_json(text, "array<array<array<array<double>>>>", {"mode": "FAILFAST"})
    numbers = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)
    # files repeat a ring's first point at its end
    ring = lambda r: F.transform(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    shape = F.transform(numbers, lambda polygon: F.transform(polygon, ring))
    known = kind.isNull() | kind.isin("Polygon", "MultiPolygon") & text.isNotNull()
    return features.select("f.properties.*", F.when(known, shape).otherwise(F.raise_error(F.concat(F.lit("not a polygon: "), kind)).cast(SHAPE)).alias("shape"))


#: Polygons of rings of points.
SHAPE = "array<array<array<struct<x:double,y:double>>>>"


def features_json(shapes: DataFrame, shape_col: str = "shape") -> DataFrame:
    """A GeoJSON feature for each row, as text: a polygon, or a multipolygon if the shape has several; a null or empty shape is an error."""
    ring = lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p.x, p.y))
    polygons = F.transform(shape_col, lambda polygon: F.transform(polygon, ring))
    one = F.struct(F.lit("Polygon").alias("type"), F.get(polygons, 0).alias("coordinates"))
    many = F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates"))
    size = F.coalesce(F.size(shape_col), F.lit(0))
    quiet = {"ignoreNullFields": "false"}
    geometry = F.when(size == 1, F.to_json(one, quiet)).when(size > 1, F.to_json(many, quiet)).otherwise(F.raise_error(F.lit("a feature without a shape")).cast("string"))
    rest = F.to_json(F.struct(*[c for c in shapes.columns if c != shape_col]), quiet)
    return shapes.select(F.concat(F.lit('{"type":"Feature","properties":'), rest, F.lit(',"geometry":'), geometry, F.lit("}")).alias("feature"))
