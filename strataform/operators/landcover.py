"""Land cover by cells: which class covers a place, from maps of several levels of detail.

Maps overlap; a place has the class of the most detailed level that covers it
(of several classes of that level, the least code). Areas come from one overlay
of cells and maps, so a level counts exactly where no more detailed one does,
and the parts of a cell never add up to more than the cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataform.functions.staging import staged
from strataform.operators.overlay import atoms

#: What of a cell may be uncovered by rounding, as a share of it.
EXACT = 1e-9


def cell_class_areas(cells: DataFrame, maps: DataFrame, size: float | None = None) -> DataFrame:
    """cell, level, code and area of what each class covers of each cell; with a null level and code what none does.

    ``cells`` has id and rings and its cells don't overlap; ``maps`` has id,
    rings, level (the higher the finer) and code. Cells and maps without a shape
    take no part. Of maps with one shape only the one that rules stays, and the
    overlay is of different shapes; a piece's ids stay in one row.
    """
    order = (-F.col("level")).alias("minus_level")
    maps = maps.where("rings IS NOT NULL").groupBy("rings", "level", "code").agg(F.min("id").alias("id"))
    maps = staged(maps.groupBy("rings").agg(F.min(F.struct(order, "code", "id")).alias("m")).select("rings", F.col("m.id").alias("id"), (-F.col("m.minus_level")).alias("level"), "m.code"))
    both = cells.select((F.col("id") * 2).alias("id"), "rings").union(maps.select((F.col("id") * 2 + 1).alias("id"), "rings"))
    pieces = atoms(both, size).withColumn("piece", F.monotonically_increasing_id())
    pieces = staged(pieces)
    covers = pieces.select("piece", F.explode(F.filter("ids", lambda i: F.pmod(i, F.lit(2)) == 1)).alias("map"))
    classes = maps.select((F.col("id") * 2 + 1).alias("map"), order, "code")
    rules = covers.join(classes, "map").groupBy("piece").agg(F.min(F.struct("minus_level", "code")).alias("rule"))
    own = pieces.select("piece", F.explode(F.filter("ids", lambda i: F.pmod(i, F.lit(2)) == 0)).alias("cell"), "area")
    ruled = own.join(rules, "piece", "left")
    return ruled.groupBy((F.col("cell") / 2).cast("long").alias("cell"), (-F.col("rule.minus_level")).alias("level"), F.col("rule.code").alias("code")).agg(F.sum("area").alias("area"))


def coverage_status(covered: Column, whole: Column) -> Column:
    """NO_COVERAGE, COMPLETE_EXACT if nothing is left, else PARTIAL."""
    return F.when(covered <= 0, "NO_COVERAGE").when(whole - covered <= whole * EXACT, "COMPLETE_EXACT").otherwise("PARTIAL")


def cell_rows(areas: DataFrame, levels: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One wide row for each cell of ``cell_class_areas``: whole area, covered share and status, and by level its area, dominant class and number of classes."""
    best = Window.partitionBy("cell", "level").orderBy(F.desc("area"), "code")
    ranked = areas.withColumn("__rank", F.when(F.col("level").isNotNull(), F.row_number().over(best)))
    of = lambda level: F.col("level") == level
    by_level = [
        column
        for level in levels
        for column in (
            F.coalesce(F.sum(F.when(of(level), F.col("area"))), F.lit(0.0)).alias(f"area_{level}"),
            F.max(F.when(of(level) & (F.col("__rank") == 1), F.col("code"))).alias(f"dominant_{level}"),
            F.count_if(of(level)).alias(f"classes_{level}"),
        )
    ]
    covered = F.coalesce(F.sum(F.when(F.col("level").isNotNull(), F.col("area"))), F.lit(0.0))
    wide = ranked.groupBy("cell").agg(F.sum("area").alias("whole"), covered.alias("covered"), *by_level)
    return wide.withColumn("covered_share", F.col("covered") / F.col("whole")).withColumn("status", coverage_status(F.col("covered"), F.col("whole")))
