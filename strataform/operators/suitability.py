"""The suitability build: candidate cells to facts, reasons, component scores, status, totals and rank."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from strataform.functions.rounding import half_even
from strataform.functions.staging import staged
from strataform.operators.overlay import box, overlapping, shapes_of
from strataform.operators.ranking import percentile_rank, rank_all
from strataform.operators.scoring import composite, curve, provisional, resolve_status
from strataform.operators.spatial import nearest_sites, points_in_shapes

#: zone: (effect, score, reason), the effect HARD, REVIEW or PENALTY.
Rules = Mapping[str, tuple[str, str | None, str | None]]


def region_scores(burden: DataFrame, demand: DataFrame) -> DataFrame:
    """code, equity and demand from burden (code, v) and demand (code, v): 100 less the percentile rank, and the rank; null values have none."""
    e = percentile_rank(burden.where("v IS NOT NULL"), "v").select("code", half_even((1 - F.col("percentile")) * 100, 4, 7).alias("equity"))
    d = percentile_rank(demand.where("v IS NOT NULL"), "v").select("code", half_even(F.col("percentile") * 100, 4, 7).alias("demand"))
    return e.join(d, "code", "full")


def cell_facts(cells: DataFrame, layers: DataFrame, zones: DataFrame, regions: DataFrame, roads: DataFrame, rules: Rules, metres: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """id, hard and review layers that share an area with the cell, the zone and region at its middle, how many regions hold it, metres to a road.

    Of several zones or regions at the middle the first by code counts. The road
    is the nearest in metres of the five nearest by planar distance. One overlay
    finds the layers and the zones that exclude; a touch alone is no hit.
    """
    hard_zones = [z for z, (effect, _, _) in rules.items() if effect == "HARD"]
    sources = layers.select((F.col("id") * 2).alias("id"), "layer", "hard", "rings").union(
        zones.where(F.col("zone").isin(hard_zones)).select((F.col("id") * 2 + 1).alias("id"), F.col("zone").alias("layer"), F.lit(True).alias("hard"), "rings")
    )
    # of shapes of one layer that are equal one tells all
    sources = sources.where("rings IS NOT NULL").groupBy("layer", "hard", "rings").agg(F.min("id").alias("id"))
    reps, members = shapes_of(sources)
    kinds_of = staged(members.join(sources.select("id", "layer", "hard"), "id").select(F.col("shape").alias("b_id"), "layer", "hard"))
    pairs = overlapping(cells.select("id", "rings"), reps)
    kinds = pairs.join(kinds_of, "b_id").groupBy(F.col("a_id").alias("id"))
    hits = kinds.agg(F.array_sort(F.collect_set(F.when(F.col("hard"), F.col("layer")))).alias("hard_layers"), F.array_sort(F.collect_set(F.when(~F.col("hard"), F.col("layer")))).alias("review_layers"))
    x0, y0, x1, y1 = box(F.col("rings"))
    middle = cells.select("id", ((x0 + x1) / 2).alias("x"), ((y0 + y1) / 2).alias("y"))
    zone = points_in_shapes(middle, zones.select("zone", "rings").distinct()).groupBy("id").agg(F.min("zone").alias("zone"))
    region = points_in_shapes(middle, regions.select("code", "rings")).groupBy("id").agg(F.min("code").alias("region"), F.count(F.lit(1)).alias("n_regions"))
    near = nearest_sites(middle, roads, "id", "road", k=5)
    road = near.groupBy("id").agg(F.min(metres(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"))).alias("metres"))
    out = cells.select("id")
    for part in (hits, zone, region, road):
        out = out.join(part, "id", "left")
    return out


def suitability_build(facts: DataFrame, scores: DataFrame, parents: DataFrame, gaps: DataFrame, rules: Rules, weights: Mapping[str, str]) -> DataFrame:
    """Facts to id, region, status, exclusions, reviews, the four components, total, provisional and rank.

    All exclusions are recorded, and an excluded cell keeps nothing else. Any
    review reason or missing component makes a cell one to review, with a
    provisional score; the rest are eligible, have a total and are ranked by it
    and by their id. ``parents`` (code, parent) and ``gaps`` (parent, layer) say
    which layers have no source where; ``scores`` has a row a region.
    """
    lacking = gaps.groupBy("parent").agg(F.array_sort(F.collect_set("layer")).alias("lacking"))
    where = parents.join(lacking, "parent", "left").select(F.col("code").alias("region"), "lacking")
    rows = facts.join(scores.withColumnRenamed("code", "region"), "region", "left").join(where, "region", "left")

    def by_zone(place: int, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for z, rule in rules.items():
            out = F.when(F.col("zone") == z, F.lit(rule[place]).cast(kind)).otherwise(out)
        return out

    none = F.array().cast("array<string>")
    listed = lambda c, head: F.transform(F.coalesce(c, none), lambda v: F.concat(F.lit(head), v))
    effect = by_zone(0, "string")
    of_zone = F.when(F.col("zone").isNull(), "NO_ZONING_COVERAGE").when(effect.isNull(), "UNMAPPED_ZONING").when(effect == "REVIEW", by_zone(2, "string"))
    many = F.when(F.col("region").isNull() | (F.col("n_regions") != 1), "AMBIGUOUS_OR_MISSING_REGION")
    reviews = F.concat(F.array(of_zone), listed("review_layers", "LAYER_"), listed("lacking", "COVERAGE_GAP_"), F.array(many, F.when(F.col("equity").isNull(), "MISSING_EQUITY"), F.when(F.col("demand").isNull(), "MISSING_DEMAND")))
    rows = rows.withColumns({
        "zoning": F.when(effect == "PENALTY", by_zone(1, "decimal(7,4)")), "road": curve(F.col("metres")).cast("decimal(7,4)"),
        "exclusions": listed("hard_layers", "EXCLUDED:"), "reviews": F.array_compact(reviews),
    })
    rows = rows.withColumn("status", resolve_status(F.col("exclusions"), F.col("reviews"), list(weights)))
    out_ = F.col("status") == "EXCLUDED"
    rows = rows.withColumns({c: F.when(~out_, F.col(c)) for c in weights} | {"reviews": F.when(out_, none).otherwise(F.col("reviews"))})
    rows = rows.withColumns({"total": F.when(F.col("status") == "ELIGIBLE", composite(weights)), "provisional": F.when(F.col("status") == "REVIEW_REQUIRED", provisional(weights))})
    ranked = rank_all(rows.where("status = 'ELIGIBLE'").select("id", "total"), "total", "id").select("id", "rank")
    return rows.join(ranked, "id", "left").select("id", "region", "status", "exclusions", "reviews", *weights, "total", "provisional", "rank")
