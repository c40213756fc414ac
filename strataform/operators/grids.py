"""Square grids over regions: cells aligned to the origin, kept by their centre, clipped to the regions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strataform.functions.staging import staged
from strataform.operators.overlay import Tile, atoms, box
from strataform.operators.spatial import in_shape, ring, shape_cells

#: Cells on a side of the plane that ids have room for, each way from the origin.
REACH = 1 << 28
#: Cells of a region's box up to which it is swept by itself if it shares none with others.
ALONE_CELLS = 1024


def square_grid(regions: DataFrame, side: float, version: str) -> DataFrame:
    """key (version, column and row), i, j and area of each cell whose centre a region covers, clipped to all regions together.

    ``regions`` has rings in the unit of ``side``; they may overlap. A centre on
    a border belongs to the region above or to the right of it. Regions that
    share no cell of their boxes with others are swept one by one with their own
    cells; all others meet in an overlay.
    """
    regions = staged(regions.where("rings IS NOT NULL").select(F.monotonically_increasing_id().alias("id"), "rings"))
    met = shape_cells(regions, "rings", side).groupBy("__cx", "__cy").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    # a region is alone if it has as many cells of its own as its box
    own = met.where("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    wide = regions.withColumn("cells", _box_cells(F.col("rings"), side))
    wide = staged(wide.join(own, "id", "left").withColumn("alone", F.coalesce(F.col("own") == F.col("cells"), F.lit(False)) & (F.col("cells") <= ALONE_CELLS)))
    # few small rows would be left to few tasks
    tasks = 4 * regions.sparkSession.sparkContext.defaultParallelism
    alone = wide.where("alone").select("id", "rings").repartition(tasks, "id").mapInArrow(_clipped(side), "i long, j long, area double")
    out = alone.union(_overlaid(wide.where("NOT alone").select("rings"), side))
    return out.select(F.concat(F.lit(f"{version}:"), "i", F.lit("_"), "j").alias("key"), "i", "j", "area")


def _box_cells(rings: Column, side: float) -> Column:
    """The cells that a shape's box meets, as many as ``shape_cells`` has rows."""
    x0, y0, x1, y1 = box(rings)
    span = lambda low, high: F.floor(high / side) - F.floor(low / side) + 1
    return span(x0, x1) * span(y0, y1)


def _clipped(side: float) -> Callable:
    """i, j and area of the cells of regions that share no cell with others: a sweep over each region and its own cells."""

    def cells_of(rings: list) -> list[tuple[int, int, float]]:
        lines = np.array([(p["x"], p["y"], q["x"], q["y"]) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1])], np.float64).reshape(-1, 4)
        x1, y1, x2, y2 = lines.T
        i0, j0 = int(np.floor(x1.min() / side)), int(np.floor(y1.min() / side))
        i1, j1 = int(np.floor(x1.max() / side)), int(np.floor(y1.max() / side))
        i, j = (a.ravel() for a in np.meshgrid(np.arange(i0, i1 + 1), np.arange(j0, j1 + 1)))
        x, y = ((i + 0.5) * side)[:, None], ((j + 0.5) * side)[:, None]
        spans = (y1 > y) != (y2 > y)
        at = (x2 - x1) * (y - y1) / np.where(y1 != y2, y2 - y1, 1.0) + x1
        kept = np.flatnonzero((spans & (x < at)).sum(axis=1) % 2 == 1)
        i, j = i[kept], j[kept]
        level = [np.stack([i * side, (j + up) * side, (i + 1) * side, (j + up) * side]) for up in (0, 1)]
        turned = np.where(x1 < x2, lines.T, lines.T[[2, 3, 0, 1]])[:, x1 != x2]
        ids = np.concatenate([np.full(turned.shape[1], -1), np.arange(len(kept)), np.arange(len(kept))])
        tile = Tile((i0 * side, j0 * side, (i1 + 1) * side, (j1 + 1) * side), ids, np.concatenate([turned, *level], axis=1))
        # the region's own number comes first; cells don't overlap
        return [(int(i[key[1]]), int(j[key[1]]), area) for key, area in tile.areas().items() if len(key) == 2]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for rings in batch.column(1).to_pylist() for row in cells_of(rings)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["i", "j", "area"])

    return run


def _overlaid(regions: DataFrame, side: float) -> DataFrame:
    """i, j and area of the cells of regions that may share cells, by one overlay of all."""
    found = shape_cells(regions, "rings", side)
    found = found.where(in_shape(F.col("rings"), (F.col("__cx") + 0.5) * side, (F.col("__cy") + 0.5) * side))
    cells = found.select(F.col("__cx").alias("i"), F.col("__cy").alias("j")).distinct()
    x, y = F.col("i") * F.lit(side), F.col("j") * F.lit(side)
    x1, y1 = (F.col("i") + 1) * F.lit(side), (F.col("j") + 1) * F.lit(side)
    numbered = cells.select(((F.col("i") + REACH) * (2 * REACH) + F.col("j") + REACH).alias("n"), F.array(ring((x, y), (x1, y), (x1, y1), (x, y1))).alias("rings"))
    shapes = regions.select((F.monotonically_increasing_id() * 2 + 1).alias("id"), "rings")
    pieces = atoms(numbered.select((F.col("n") * 2).alias("id"), "rings").union(shapes))
    even = F.filter("ids", lambda i: F.pmod(i, F.lit(2)) == 0)
    covered = pieces.where(F.size(even) < F.size("ids")).select(F.explode(even).alias("id"), "area").groupBy("id").agg(F.sum("area").alias("area"))
    n = F.shiftright("id", 1)
    return covered.select((F.floor(n / (2 * REACH)) - REACH).alias("i"), (F.pmod(n, F.lit(2 * REACH)) - REACH).alias("j"), "area")
