"""The whole suitability build over a board of cells, with every reason in the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataform.operators import suitability
from strataform.plans.overlay import _PARTS, _UNITS, BOARD, REGION, _parts, _rectangle, _squares
from strataform.plans.registry import query, table
from strataform.plans.scoring import WEIGHTS

#: Side of a candidate cell; metres of a unit of the board.
SIDE, UNIT = 2, 500.0
RULES = {"Z0": ("HARD", None, None), "Z1": ("REVIEW", None, "ZONE_REVIEW"), "Z2": ("PENALTY", "60", None), "Z3": ("PENALTY", "85.5", None)}

_W = BOARD // SIDE
_BUILD = f"""WITH {_PARTS}, c AS (SELECT i + j * {_W} AS cell, i * {SIDE} AS x0, j * {SIDE} AS y0 FROM range({_W}) a(i), range({_W}) b(j)),
u AS ({_UNITS.format(cols="p_size", t="p")}),
hit AS (SELECT ux // {SIDE} + uy // {SIDE} * {_W} AS cell, bool_or(p_size % 10 = 0) AS h0, bool_or(p_size % 10 = 1) AS h1, bool_or(p_size % 10 = 2) AS r2 FROM u WHERE ux < {BOARD} AND uy < {BOARD} GROUP BY 1),
z AS (SELECT 'Z' || s_suppkey % 5 AS zone, s_suppkey * 53 % {BOARD} AS x, s_suppkey * 29 % {BOARD} AS y, s_suppkey % 11 + 3 AS w, s_suppkey % 13 + 3 AS h FROM supplier),
zh AS (SELECT DISTINCT cell, true AS z0 FROM c JOIN z ON zone = 'Z0' AND x0 < x + w AND x0 + {SIDE} > x AND y0 < y + h AND y0 + {SIDE} > y),
zc AS (SELECT cell, min(zone) AS zone FROM c JOIN z ON x0 + 1 >= x AND x0 + 1 < x + w AND y0 + 1 >= y AND y0 + 1 < y + h GROUP BY 1),
n AS (SELECT n_nationkey AS code, n_regionkey AS parent, n_nationkey % 5 * {REGION} AS x, n_nationkey // 5 * {REGION} AS y, {REGION} + CASE WHEN n_nationkey % 6 = 0 THEN 4 ELSE 0 END AS w FROM nation WHERE n_nationkey % 11 <> 10),
rg AS (SELECT cell, min(code) AS region, count(*) AS held FROM c JOIN n ON x0 + 1 >= x AND x0 + 1 < x + w AND y0 + 1 >= y AND y0 + 1 < y + {REGION} GROUP BY 1),
s AS (SELECT (c_custkey * 7907 % 2003) * 0.1e0 AS sx, (c_custkey * 6101 % 1999) * 0.1e0 AS sy FROM customer),
rd AS (SELECT cell, CAST(min(sqrt((sx - (x0 + 1)) * (sx - (x0 + 1)) + (sy - (y0 + 1)) * (sy - (y0 + 1)))) * {UNIT}e0 AS DECIMAL(18,6)) AS d FROM c, s GROUP BY 1),
e AS (SELECT code, CAST((1 - CAST(round_even(p, 6) AS DECIMAL(9,6))) * 100 AS DECIMAL(9,4)) AS equity FROM (SELECT s_nationkey AS code, percent_rank() OVER (ORDER BY count(*)) AS p FROM supplier GROUP BY 1)),
m AS (SELECT code, CAST(CAST(round_even(p, 6) AS DECIMAL(9,6)) * 100 AS DECIMAL(9,4)) AS demand FROM (SELECT c_nationkey AS code, percent_rank() OVER (ORDER BY count(*)) AS p FROM customer GROUP BY 1)),
f AS (SELECT c.cell, region, concat_ws('|', CASE WHEN h0 THEN 'EXCLUDED:H0' END, CASE WHEN h1 THEN 'EXCLUDED:H1' END, CASE WHEN z0 THEN 'EXCLUDED:Z0' END) AS exclusions,
  concat_ws('|', CASE WHEN zone IS NULL THEN 'NO_ZONING_COVERAGE' WHEN zone = 'Z4' THEN 'UNMAPPED_ZONING' WHEN zone = 'Z1' THEN 'ZONE_REVIEW' END, CASE WHEN r2 THEN 'LAYER_R2' END, CASE WHEN parent = 3 THEN 'COVERAGE_GAP_H1' END,
    CASE WHEN held IS DISTINCT FROM 1 THEN 'AMBIGUOUS_OR_MISSING_REGION' END, CASE WHEN equity IS NULL THEN 'MISSING_EQUITY' END, CASE WHEN demand IS NULL THEN 'MISSING_DEMAND' END) AS reviews,
  CASE zone WHEN 'Z2' THEN CAST(60 AS DECIMAL(7,4)) WHEN 'Z3' THEN CAST(85.5 AS DECIMAL(7,4)) END AS zoning,
  round_even(CASE WHEN d <= 250 THEN 100 WHEN d <= 1000 THEN CAST(100 - (d - 250) * 0.04 AS DECIMAL(18,6)) WHEN d <= 3000 THEN CAST(70 - (d - 1000) * 0.025 AS DECIMAL(18,6)) WHEN d <= 5000 THEN CAST(20 - (d - 3000) * 0.01 AS DECIMAL(18,6)) ELSE 0 END, 4) AS road, equity, demand
  FROM c LEFT JOIN hit USING (cell) LEFT JOIN zh USING (cell) LEFT JOIN zc USING (cell) LEFT JOIN rg USING (cell) LEFT JOIN rd USING (cell) LEFT JOIN n ON n.code = region LEFT JOIN e ON e.code = region LEFT JOIN m ON m.code = region),
g AS (SELECT *, CASE WHEN exclusions <> '' THEN 'EXCLUDED' WHEN reviews <> '' OR zoning IS NULL OR road IS NULL THEN 'REVIEW_REQUIRED' ELSE 'ELIGIBLE' END AS status,
  coalesce(zoning * 0.35, 0) + coalesce(road * 0.25, 0) + coalesce(equity * 0.25, 0) + coalesce(demand * 0.15, 0) AS num,
  CASE WHEN zoning IS NULL THEN 0 ELSE 0.35 END + CASE WHEN road IS NULL THEN 0 ELSE 0.25 END + CASE WHEN equity IS NULL THEN 0 ELSE 0.25 END + CASE WHEN demand IS NULL THEN 0 ELSE 0.15 END AS den FROM f),
t AS (SELECT *, CASE WHEN status = 'ELIGIBLE' THEN round_even(num, 4) END AS total, CAST(num * 1000000 AS BIGINT) AS a, CAST(den * 100 AS BIGINT) AS b FROM g)"""


@query(
    "suitability_build",
    _BUILD + """ SELECT cell, region, status, exclusions, CASE WHEN status = 'EXCLUDED' THEN '' ELSE reviews END AS reviews, CASE WHEN status <> 'EXCLUDED' THEN CAST(road AS DOUBLE) END AS road, CAST(total AS DOUBLE) AS total,
  CASE WHEN status = 'REVIEW_REQUIRED' AND den > 0 THEN (a // b + CASE WHEN 2 * (a % b) > b OR 2 * (a % b) = b AND a // b % 2 = 1 THEN 1 ELSE 0 END) / 10000e0 END AS provisional, CASE WHEN status = 'ELIGIBLE' THEN row_number() OVER (PARTITION BY status ORDER BY total DESC, cell) END AS rank FROM t""",
)
def suitability_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a board against protected layers, zones, regions, roads and region scores: reasons, status, totals and rank."""
    tenth = F.col("p_size") % 10
    layer = F.when(tenth == 0, "H0").when(tenth == 1, "H1").when(tenth == 2, "R2")
    layers = _parts(spark, sf_dir).select("id", layer.alias("layer"), (tenth < 2).alias("hard"), "rings").where("layer IS NOT NULL")
    k = F.col("s_suppkey")
    supplier, customer, nation = (table(spark, sf_dir, n) for n in ("supplier", "customer", "nation"))
    zones = supplier.select(k.alias("id"), F.concat(F.lit("Z"), (k % 5).cast("string")).alias("zone"), F.array(_rectangle(k * 53 % BOARD, k * 29 % BOARD, k % 11 + 3, k % 13 + 3)).alias("rings"))
    nk = F.col("n_nationkey")
    wide = F.lit(REGION) + F.when(nk % 6 == 0, 4).otherwise(0)
    regions = nation.where(nk % 11 != 10).select(nk.alias("code"), F.array(_rectangle(nk % 5 * REGION, F.floor(nk / 5) * REGION, wide, F.lit(REGION))).alias("rings"))
    c = F.col("c_custkey")
    roads = customer.select(c.alias("road"), ((c * 7907 % 2003) * 0.1).alias("x"), ((c * 6101 % 1999) * 0.1).alias("y"))
    flat = lambda x, y, sx, sy: F.sqrt((sx - x) * (sx - x) + (sy - y) * (sy - y)) * UNIT
    facts = suitability.cell_facts(_squares(spark, SIDE), layers, zones, regions, roads, RULES, flat)
    count = lambda df, by: df.groupBy(F.col(by).alias("code")).agg(F.count(F.lit(1)).alias("v"))
    scores = suitability.region_scores(count(supplier, "s_nationkey"), count(customer, "c_nationkey"))
    parents = nation.select(nk.alias("code"), F.col("n_regionkey").alias("parent"))
    gaps = table(spark, sf_dir, "region").where("r_regionkey = 3").select(F.col("r_regionkey").alias("parent"), F.lit("H1").alias("layer"))
    built = suitability.suitability_build(facts, scores, parents, gaps, RULES, WEIGHTS)
    lines = {c: F.array_join(c, "|") for c in ("exclusions", "reviews")}
    return built.select(F.col("id").alias("cell"), "region", "status", *[v.alias(c) for c, v in lines.items()], *[F.col(c).cast("double").alias(c) for c in ("road", "total", "provisional")], F.col("rank").cast("long").alias("rank"))
