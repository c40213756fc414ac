"""Overlay of polygons: dissolve, overlap, land cover, coverage, clipping, gates.

The tables have no geometry: parts and suppliers are given shapes on a board of
unit squares by their keys (a rectangle, often with a hole), so that the SQL can
count squares; slanted shapes are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strataform.operators import clipping, grids, landcover, overlay
from strataform.operators.spatial import ring
from strataform.plans.registry import query, table

#: Side of the board, of a region and of a cell.
BOARD, REGION, CELL = 200, 40, 10

# each shape's rectangle and hole, by key k: in SQL and in the queries alike
_PARTS = f"p AS (SELECT p_partkey AS k, p_partkey * 37 % {BOARD} AS x, p_partkey * 91 % {BOARD} AS y, p_size % 9 + 1 AS w, p_partkey % 7 + 1 AS h, p_size, p_brand FROM part)"
_SUPPLIERS = f"s AS (SELECT s_suppkey AS k, s_suppkey * 53 % {BOARD} AS x, s_suppkey * 29 % {BOARD} AS y, s_suppkey % 11 + 3 AS w, s_suppkey % 13 + 3 AS h FROM supplier)"
_UNITS = "SELECT {cols}, x + i AS ux, y + j AS uy FROM {t}, (SELECT unnest(range(16)) AS i), (SELECT unnest(range(16)) AS j) WHERE i < w AND j < h AND NOT (w > 2 AND h > 2 AND i >= 1 AND i < w - 1 AND j >= 1 AND j < h - 1)"


def _rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def _framed(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A rectangle; if it has room, without all but its rim."""
    hole = F.when((w > 2) & (h > 2), _rectangle(x + 1, y + 1, w - 2, h - 2))
    return F.array_compact(F.array(_rectangle(x, y, w, h), hole))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), "p_size", "p_brand", _framed(k * 37 % BOARD, k * 91 % BOARD, F.col("p_size") % 9 + 1, k % 7 + 1).alias("rings"))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), _framed(k * 53 % BOARD, k * 29 % BOARD, k % 11 + 3, k % 13 + 3).alias("rings"))


def _squares(spark: SparkSession, side: int) -> DataFrame:
    """The board in squares, numbered by rows."""
    n = BOARD // side
    x, y = F.col("id") % n * side, F.floor(F.col("id") / n) * side
    return spark.range(n * n).select("id", F.array(_rectangle(x, y, F.lit(side), F.lit(side))).alias("rings"))


@query(
    "derived_city_union",
    """WITH c AS (SELECT p_brand AS g, p_partkey % 50 AS x, p_partkey // 50 AS y FROM part),
n AS (SELECT a.g, count(*) AS joints FROM c a JOIN c b ON a.g = b.g AND (b.x = a.x + 1 AND b.y = a.y OR b.x = a.x AND b.y = a.y + 1) GROUP BY 1)
SELECT g AS brand, CAST(count(*) AS DOUBLE) AS area, CAST(4 * count(*) - 2 * coalesce(min(joints), 0) AS DOUBLE) AS outline FROM c LEFT JOIN n USING (g) GROUP BY 1""",
)
def derived_city_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts dissolved to their city: area by the rings, and the outline's length."""
    k = F.col("p_partkey")
    districts = table(spark, sf_dir, "part").select("p_brand", F.array(_rectangle(k % 50, F.floor(k / 50), F.lit(1), F.lit(1))).alias("rings"))
    length = F.aggregate(overlay.edges(F.col("ring")), F.lit(0.0), lambda t, e: t + F.abs(e.x2 - e.x1) + F.abs(e.y2 - e.y1))
    # ring by ring: a city's rings needn't stand in one row to be added up
    rings = overlay.dissolved_rings(districts, "p_brand").select(F.col("g").alias("brand"), overlay.signed_area(F.col("ring")).alias("area"), length.alias("outline"))
    return rings.groupBy("brand").agg(F.abs(F.sum("area")).alias("area"), F.sum("outline").alias("outline"))


@query(
    "union_area_on_grid",
    f"WITH {_PARTS}, u AS (SELECT DISTINCT p_brand, ux, uy FROM ({_UNITS.format(cols='p_brand', t='p')})) SELECT p_brand, CAST(count(*) AS DOUBLE) AS area FROM u GROUP BY 1",
)
def union_area_on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area that the shapes of each maker cover together, wherever and however often they overlap."""
    parts = _parts(spark, sf_dir)
    makers = parts.select("id", F.col("p_brand"))
    pieces = overlay.atoms(parts).select("ids", F.explode("ids").alias("id"), "area")
    once = pieces.join(makers, "id").groupBy("p_brand", "ids").agg(F.first("area").alias("area"))
    return once.groupBy("p_brand").agg(F.round(F.sum("area"), 6).alias("area"))


@query(
    "intersect_positive_area",
    f"""WITH {_PARTS}, {_SUPPLIERS}, a AS ({_UNITS.format(cols="k AS part_id", t="p")}), b AS ({_UNITS.format(cols="k AS supplier_id", t="s")})
SELECT part_id, supplier_id, CAST(count(*) AS DOUBLE) AS area FROM a JOIN b USING (ux, uy) GROUP BY 1, 2""",
)
def intersect_positive_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of shapes that share an area: what only touches is left out (a hard exclusion needs a positive area)."""
    pairs = overlay.overlapping(_parts(spark, sf_dir), _suppliers(spark, sf_dir))
    return pairs.select(F.col("a_id").alias("part_id"), F.col("b_id").alias("supplier_id"), F.round("area", 6).alias("area"))


@query(
    "overlay_areas",
    f"""WITH {_PARTS}, {_SUPPLIERS}, a AS (SELECT DISTINCT ux, uy, 1 AS in_a FROM ({_UNITS.format(cols="k", t="p")})), b AS (SELECT DISTINCT ux, uy, 1 AS in_b FROM ({_UNITS.format(cols="k", t="s")}))
SELECT CAST(count(*) FILTER (WHERE in_a = 1 AND in_b = 1) AS DOUBLE) AS shared, CAST(count(*) FILTER (WHERE in_b IS NULL) AS DOUBLE) AS only_a, CAST(count(*) FILTER (WHERE in_a IS NULL) AS DOUBLE) AS only_b, CAST(count(*) AS DOUBLE) AS joint
FROM a FULL JOIN b USING (ux, uy)""",
)
def overlay_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, both differences and union of two sets of shapes."""
    found = overlay.overlay_areas(_parts(spark, sf_dir), _suppliers(spark, sf_dir))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


_COVER = f"""m AS (SELECT k, ux, uy, k % 3 + 1 AS level, 'c' || p_size % 10 AS code FROM ({_UNITS.format(cols="k, p_size", t="p")}) WHERE ux < {BOARD} AND uy < {BOARD}),
f AS (SELECT ux // {CELL} + uy // {CELL} * {BOARD // CELL} AS cell, max(level) AS level, min_by(code, (-level) * 1000 + CAST(substr(code, 2) AS INTEGER)) AS code FROM m GROUP BY ux, uy, 1)"""


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    maps = _parts(spark, sf_dir).select("id", "rings", (k % 3 + 1).cast("int").alias("level"), F.concat(F.lit("c"), (F.col("p_size") % 10).cast("string")).alias("code"))
    areas = landcover.cell_class_areas(_squares(spark, CELL), maps)
    return areas.withColumn("area", F.round("area", 6)).where("area > 0")


@query(
    "cell_classes",
    f"""WITH {_PARTS}, {_COVER} SELECT cell, CAST(level AS INTEGER) AS level, code, CAST(count(*) AS DOUBLE) AS area, count(*) / {CELL * CELL}.0::DOUBLE AS share FROM f GROUP BY ALL""",
)
def cell_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of each cell: what a finer map covers doesn't count for coarser ones."""
    return _areas(spark, sf_dir).where("level IS NOT NULL").select("cell", "level", "code", "area", (F.col("area") / (CELL * CELL)).alias("share"))


_WIDE = f"""g AS (SELECT cell, level, code, count(*) AS area FROM f GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY cell, level ORDER BY area DESC, code) AS n FROM g),
e AS (SELECT cell, CAST(sum(area) AS BIGINT) AS covered, {", ".join(f"CAST(coalesce(sum(area) FILTER (WHERE level = {n}), 0) AS DOUBLE) AS area_{n}, max(code) FILTER (WHERE level = {n} AND n = 1) AS dominant_{n}, count(*) FILTER (WHERE level = {n}) AS classes_{n}" for n in (1, 2, 3))} FROM d GROUP BY 1),
c AS (SELECT unnest(range({(BOARD // CELL) ** 2})) AS cell)"""
_STATUS = f"CASE WHEN covered IS NULL THEN 'NO_COVERAGE' WHEN covered = {CELL * CELL} THEN 'COMPLETE_EXACT' ELSE 'PARTIAL' END"


@query(
    "cells_page",
    f"""WITH {_PARTS}, {_COVER}, {_WIDE} SELECT cell, coalesce(covered, 0) / {CELL * CELL}.0::DOUBLE AS covered_share, {_STATUS} AS status,
{", ".join(f"coalesce(area_{n}, 0) AS area_{n}, dominant_{n}, coalesce(classes_{n}, 0) AS classes_{n}" for n in (1, 2, 3))}, CAST((cell // 50) AS BIGINT) AS page FROM c LEFT JOIN e USING (cell)""",
)
def cells_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide row for each cell, with the page of fifty that it stands on in the order of cells."""
    wide = landcover.cell_rows(_areas(spark, sf_dir))
    by_level = [f"{c}_{n}" for n in (1, 2, 3) for c in ("area", "dominant", "classes")]
    return wide.select("cell", "covered_share", "status", *by_level, F.floor(F.col("cell") / 50).alias("page"))


@query(
    "land_cover_summary",
    f"""WITH {_PARTS}, {_COVER}, {_WIDE} SELECT status, count(*) AS cells, CAST(coalesce(sum(covered), 0) AS DOUBLE) AS covered, coalesce(sum(covered), 0) / (count(*) * {CELL * CELL}.0::DOUBLE) AS share
FROM (SELECT covered, {_STATUS} AS status FROM c LEFT JOIN e USING (cell)) GROUP BY 1""",
)
def land_cover_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, covered area and its share of the cells' whole area, by status."""
    wide = landcover.cell_rows(_areas(spark, sf_dir))
    return wide.groupBy("status").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("covered"), 6).alias("covered"), (F.sum("covered") / F.sum("whole")).alias("share"))


@query(
    "footprint_coverage",
    f"""WITH {_SUPPLIERS}, u AS (SELECT ux // {REGION} + uy // {REGION} * {BOARD // REGION} AS region, ux, uy, count(*) AS n FROM ({_UNITS.format(cols="k", t="s")}) WHERE ux < {BOARD} AND uy < {BOARD} GROUP BY ALL),
r AS (SELECT unnest(range({(BOARD // REGION) ** 2})) AS region), t AS (SELECT region, count(ux) AS once, coalesce(sum(n), 0) AS every FROM r LEFT JOIN u USING (region) GROUP BY 1)
SELECT region, CAST(every AS DOUBLE) AS footprints, CAST(once AS DOUBLE) AS covered, CAST({REGION * REGION} - once AS DOUBLE) AS uncovered, CAST(every - once AS DOUBLE) AS overlap, once / {REGION * REGION}.0::DOUBLE AS ratio FROM t""",
)
def footprint_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By region: the sum of the footprints in it, what they cover, what they don't, and what they cover more than once."""
    regions = _squares(spark, REGION)
    both = regions.select((F.col("id") * 2).alias("id"), "rings").union(_suppliers(spark, sf_dir).select((F.col("id") * 2 + 1).alias("id"), "rings"))
    pieces = overlay.atoms(both).withColumn("n", F.size(F.filter("ids", lambda i: F.pmod(i, F.lit(2)) == 1)))
    pieces = pieces.select(F.explode(F.filter("ids", lambda i: F.pmod(i, F.lit(2)) == 0)).alias("r"), "n", "area").withColumn("region", (F.col("r") / 2).cast("long"))
    total = lambda c: F.round(F.sum(c), 6)
    once = F.when(F.col("n") > 0, F.col("area")).otherwise(0.0)
    return pieces.groupBy("region").agg(
        total(F.col("n") * F.col("area")).alias("footprints"), total(once).alias("covered"), total(F.col("area") - once).alias("uncovered"),
        total(F.col("n") * F.col("area") - once).alias("overlap"), F.round(F.sum(once) / (REGION * REGION), 12).alias("ratio"),
    )


@query(
    "clip_lines_to_regions",
    f"""WITH l AS (SELECT s_suppkey AS k, s_suppkey * 31 % {BOARD} AS x, s_suppkey * 17 % {BOARD} AS y, s_suppkey % 90 + 1 AS w FROM supplier),
u AS (SELECT k, x + i AS ux, y AS uy, w FROM l, (SELECT unnest(range(90)) AS i) WHERE i < w),
h AS (SELECT k, w, ux, CASE WHEN ux < {BOARD} AND NOT (ux % {REGION} >= 10 AND ux % {REGION} < 30 AND uy % {REGION} >= 10 AND uy % {REGION} < 30) THEN ux // {REGION} + uy // {REGION} * {BOARD // REGION} END AS region FROM u),
n AS (SELECT *, ux - row_number() OVER (PARTITION BY k, region ORDER BY ux) AS run FROM h WHERE region IS NOT NULL),
t AS (SELECT k, region, run, min(ux) AS first_x, count(*) AS len, any_value(w) AS w FROM n GROUP BY 1, 2, 3)
SELECT k AS id, region, row_number() OVER (PARTITION BY k, region ORDER BY first_x) - 1 AS part, CAST(len AS DOUBLE) AS length, sum(len) OVER (PARTITION BY k, region) < w AS clipped FROM t""",
)
def clip_lines_to_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut to regions with lakes: a part for each stretch on land, and whether the region lacks any of the line."""
    k = F.col("s_suppkey")
    x, y = (k * 31 % BOARD).cast("double"), (k * 17 % BOARD).cast("double")
    w = (k % 90 + 1).cast("double")
    points = F.array(*[F.struct((x + d).alias("x"), y.alias("y")) for d in (F.lit(0.0), F.floor(w / 2).cast("double"), w)])
    lines = table(spark, sf_dir, "supplier").select(k.alias("id"), points.alias("points"))
    n = BOARD // REGION
    rx, ry = F.col("id") % n * REGION, F.floor(F.col("id") / n) * REGION
    regions = spark.range(n * n).select(F.col("id").alias("region"), F.array(_rectangle(rx, ry, F.lit(REGION), F.lit(REGION)), _rectangle(rx + 10, ry + 10, F.lit(20), F.lit(20))).alias("rings"))
    return clipping.clip_lines(lines, regions, size=float(REGION)).select("id", "region", "part", "length", "clipped")


@query(
    "clip_polygons_to_regions",
    f"""WITH {_PARTS}, u AS ({_UNITS.format(cols="k", t="p")}), w AS (SELECT k, count(*) AS whole FROM u GROUP BY 1),
c AS (SELECT k, ux // {REGION} + uy // {REGION} * {BOARD // REGION} AS region, count(*) AS area FROM u WHERE ux < {BOARD} AND uy < {BOARD} GROUP BY ALL)
SELECT k AS id, region, CAST(area AS DOUBLE) AS area, area < whole AS clipped FROM c JOIN w USING (k)""",
)
def clip_polygons_to_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes cut to regions; those that stick out of the board lose what is out."""
    found = clipping.clip_polygons(_parts(spark, sf_dir), _squares(spark, REGION))
    return found.select("id", "region", F.round("area", 6).alias("area"), "clipped")


def _grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delivered grid: a cell for each part, some empty, missing, crossed, out of the scope, or twice with another shape."""
    k = F.col("p_partkey")
    x, y = k * 37 % BOARD, k * 91 % BOARD
    good = _rectangle(x, y, F.lit(4), F.lit(4))
    bow = ring((x, y), (x + 4, y + 4), (x + 4, y), (x, y + 4))
    kind = k % 10
    rings = F.when(kind == 1, F.lit(None)).when(kind == 2, F.array().cast(overlay_type())).when(kind == 3, F.array(bow)).when(kind == 4, F.array(_rectangle(x + 1000, y, F.lit(4), F.lit(4)))).when(kind == 5, F.array(F.slice(good, 1, 2))).otherwise(F.array(good))
    first = table(spark, sf_dir, "part").select(k.alias("id"), rings.alias("rings"))
    again = table(spark, sf_dir, "part").where("p_partkey % 10 IN (6, 7)").select(k.alias("id"), F.array(F.when(kind == 6, F.reverse(good)).otherwise(_rectangle(x, y, F.lit(4), F.lit(5)))).alias("rings"))
    return first.union(again)


def overlay_type() -> str:
    return "array<array<struct<x:double,y:double>>>"


@query(
    "grid_gate",
    """SELECT CASE p_partkey % 10 WHEN 1 THEN 'NULL_GEOMETRY' WHEN 2 THEN 'EMPTY_GEOMETRY' WHEN 3 THEN 'INVALID_GEOMETRY' WHEN 4 THEN 'OUT_OF_SCOPE' WHEN 5 THEN 'NOT_A_POLYGON' WHEN 7 THEN 'CONFLICTING_SHAPES' ELSE 'OK' END AS state,
  count(*) AS cells, CAST(sum(CASE WHEN p_partkey % 10 IN (6, 7) THEN 2 ELSE 1 END) AS BIGINT) AS n_rows FROM part GROUP BY 1""",
)
def grid_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of each cell of a grid: shapes of one cell must be the same, however they are written."""
    rows = _grid_rows(spark, sf_dir)
    shape = F.struct(F.col("rings").isNull().alias("no"), overlay.fingerprint(F.col("rings")).alias("hash"))
    cells = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(shape).alias("shapes"), F.min("rings").alias("rings"))
    crossed = overlay.self_crossing(cells.where("rings IS NOT NULL AND size(rings) > 0"), 8.0).withColumn("crosses", F.lit(True))
    x0, y0, x1, y1 = overlay.box(F.col("rings"))
    outside = (x0 < 0) | (y0 < 0) | (x1 > BOARD + 8) | (y1 > BOARD + 8)
    few = F.exists("rings", lambda r: F.size(F.array_distinct(r)) < 3)
    state = (
        F.when(F.col("rings").isNull(), "NULL_GEOMETRY")
        .when(F.size("rings") == 0, "EMPTY_GEOMETRY")
        .when(F.col("shapes") > 1, "CONFLICTING_SHAPES")
        .when(few, "NOT_A_POLYGON")
        .when(F.col("crosses"), "INVALID_GEOMETRY")
        .when(outside, "OUT_OF_SCOPE")
        .otherwise("OK")
    )
    return cells.join(crossed, "id", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n_rows"))


@query(
    "grid_500m",
    """WITH r AS (SELECT s_suppkey AS k, s_suppkey * 9000 + 137 AS x, 1900000 + s_suppkey % 3 * 9000 + 211 AS y, 2600 + s_suppkey % 7 * 550 AS w, 2100 + s_suppkey % 5 * 650 AS h FROM supplier),
c AS (SELECT *, x // 500 + a AS i, y // 500 + b AS j FROM r, (SELECT unnest(range(16)) AS a), (SELECT unnest(range(16)) AS b)),
d AS (SELECT *, i * 500 + 250 AS mx, j * 500 + 250 AS my, greatest(0, least(x + w, i * 500 + 500) - greatest(x, i * 500)) * greatest(0, least(y + h, j * 500 + 500) - greatest(y, j * 500)) AS whole,
  greatest(0, least(x + 1700, i * 500 + 500) - greatest(x + 700, i * 500)) * greatest(0, least(y + 1600, j * 500 + 500) - greatest(y + 600, j * 500)) AS lake FROM c)
SELECT 'v1:' || i || '_' || j AS key, i, j, CAST(sum(whole - lake) AS DOUBLE) AS area FROM d WHERE mx >= x AND mx < x + w AND my >= y AND my < y + h AND NOT (mx >= x + 700 AND mx < x + 1700 AND my >= y + 600 AND my < y + 1600) GROUP BY 1, 2, 3""",
)
def grid_500m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 500 m from the grid's origin on, kept by their centre, clipped to regions with lakes, in square metres."""
    k = F.col("s_suppkey")
    x, y, w, h = k * 9000 + 137, 1_900_000 + k % 3 * 9000 + 211, 2600 + k % 7 * 550, 2100 + k % 5 * 650
    regions = table(spark, sf_dir, "supplier").select(F.array(_rectangle(x, y, w, h), _rectangle(x + 700, y + 600, F.lit(1000), F.lit(1000))).alias("rings"))
    return grids.square_grid(regions, 500.0, "v1").withColumn("area", F.round("area", 3))
