"""Scenario scoring over candidate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strataform.functions.rounding import dec, half_even
from strataform.plans.registry import query, table

#: Weights of the four components in the default scenario.
WEIGHTS = {"zoning": "0.35", "road": "0.25", "equity": "0.25", "demand": "0.15"}


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as candidate rows with four exact component scores in 0..100."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("candidate_key"),
        "p_brand",
        "p_type",
        "p_size",
        dec((size * 2), 7, 4).alias("zoning"),
        dec(100 - size * 2, 7, 4).alias("road"),
        dec(F.col("p_partkey") % 101, 7, 4).alias("equity"),
        dec(F.round(F.col("p_retailprice") * 100).cast("long") % 10001, 12, 4).cast("decimal(14,4)").alias("cents"),
    ).withColumn("demand", half_even(F.col("cents") * F.lit("0.01").cast("decimal(4,2)"), 4, 7)).drop("cents")


CANDIDATES_SQL = """
SELECT p_partkey AS candidate_key, p_brand, p_type, p_size,
       CAST(p_size * 2 AS DECIMAL(7,4)) AS zoning,
       CAST(100 - p_size * 2 AS DECIMAL(7,4)) AS road,
       CAST(p_partkey % 101 AS DECIMAL(7,4)) AS equity,
       CAST(CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 10001 AS DECIMAL(14,4)) * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(7,4)) AS demand
FROM part
"""


@query(
    "scenario_preview",
    f"""
WITH c AS ({CANDIDATES_SQL}),
s AS (SELECT candidate_key,
  round_even(zoning * CAST(0.35 AS DECIMAL(3,2)) + road * CAST(0.25 AS DECIMAL(3,2))
    + equity * CAST(0.25 AS DECIMAL(3,2)) + demand * CAST(0.15 AS DECIMAL(3,2)), 4) AS composite FROM c)
SELECT candidate_key, CAST(composite AS DOUBLE) AS composite_score,
  row_number() OVER (ORDER BY composite DESC, candidate_key) AS scenario_rank,
  count(*) OVER () AS ranking_population
FROM s ORDER BY composite DESC, candidate_key LIMIT 200
""",
)
def scenario_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite by the scenario's weights, total order, population, top 200."""
    c = candidates(spark, sf_dir)
    composite = sum((F.col(k) * F.lit(w).cast("decimal(3,2)") for k, w in WEIGHTS.items()), F.lit(0).cast("decimal(3,2)"))
    scored = c.select("candidate_key", half_even(composite, 4, 9).alias("composite"))
    population = scored.agg(F.count(F.lit(1)).alias("ranking_population"))
    # top-k first, then number only those rows: no global single-partition window over all candidates
    top = scored.orderBy(F.desc("composite"), "candidate_key").limit(200)
    ranked = top.withColumn("scenario_rank", F.row_number().over(Window.orderBy(F.desc("composite"), "candidate_key")).cast("long"))
    return ranked.crossJoin(F.broadcast(population)).select(
        "candidate_key", F.col("composite").cast("double").alias("composite_score"), "scenario_rank", "ranking_population"
    )
