"""Spatial joins over points and shapes, by grid cells.

A ring is an array of structs x, y (degrees), its last point not repeated; a
shape is an array of rings, parts, holes and islands alike: a point is inside
where a ray crosses an odd number of edges. Candidates meet in an equi-join on
grid cells; the exact predicate follows, in higher-order functions. A cell with
a third of all points makes a skewed key, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strataform.functions.staging import staged

#: Fixed value: the mean radius of the earth in metres.
EARTH = 6371008.8
DEGREE = EARTH * 3.141592653589793 / 180
#: A latitude beyond which meridians are too near each other for cells of degrees.
POLAR = 89.0
#: Sites that a leaf of the tree of sites holds, for each that is looked for.
CROWD = 8
#: Halvings of the extent, in all and between a node and its children.
DEPTH, STEP = 30, 2
#: Places that walk down the tree of sites together, and sites that they are held against at a time.
GROUP, POOL = 256, 4096


def ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def edges(points: Column) -> Column:
    """Each point of a ring with the next one."""
    return F.transform(points, lambda p, i: F.struct(p.x.alias("x1"), p.y.alias("y1"), F.get(points, (i + 1) % F.size(points)).x.alias("x2"), F.get(points, (i + 1) % F.size(points)).y.alias("y2")))


def ring_area(points: Column) -> Column:
    """The area by the shoelace formula, in the square of the points' unit."""
    doubled = F.aggregate(edges(points), F.lit(0.0), lambda t, e: t + (e.x1 * e.y2 - e.x2 * e.y1))
    return F.abs(doubled) / 2


def shape_edges(rings: Column) -> Column:
    """The edges of all rings of a shape."""
    return F.flatten(F.transform(rings, edges))


def in_edges(lines: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right crosses the edges an odd number of times; a point on a lower or left edge is inside."""

    def crossed(e: Column) -> Column:
        spans = (e.y1 > y) != (e.y2 > y)
        # an edge that the ray can't cross may be level: no division for it
        at = F.when(spans, (e.x2 - e.x1) * (y - e.y1) / F.when(spans, e.y2 - e.y1).otherwise(1.0) + e.x1)
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(lines, F.lit(0), lambda n, e: n + crossed(e)) % 2 == 1


def in_ring(points: Column, x: Column, y: Column) -> Column:
    return in_edges(edges(points), x, y)


def in_shape(rings: Column, x: Column, y: Column) -> Column:
    return in_edges(shape_edges(rings), x, y)


def metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """The distance on a sphere (haversine), within 0.5 % of that on a spheroid."""
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b)))


def shape_metres(rings: Column, x: Column, y: Column) -> Column:
    """The distance to a shape's nearest edge on a plane that touches the earth at the point; 0 inside."""
    flat = F.cos(F.radians(y))

    def to_edge(e: Column) -> Column:
        ax, ay, bx, by = (e.x1 - x) * flat, e.y1 - y, (e.x2 - x) * flat, e.y2 - y
        dx, dy = bx - ax, by - ay
        square = dx * dx + dy * dy
        t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.when(square > 0, square).otherwise(1.0)))).otherwise(0.0)
        return F.sqrt((ax + t * dx) * (ax + t * dx) + (ay + t * dy) * (ay + t * dy))

    nearest = F.array_min(F.transform(shape_edges(rings), to_edge)) * DEGREE
    return F.when(in_shape(rings, x, y), 0.0).otherwise(nearest)


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def shape_cells(shapes: DataFrame, rings_col: str, size: float, dx: Column | float = 0.0, dy: float = 0.0) -> DataFrame:
    """A row for each grid cell that a shape's box, widened by ``dx`` and ``dy`` degrees, meets."""
    points = F.flatten(rings_col)
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    out = shapes.withColumn("__cx", F.explode(F.sequence(_cell(F.array_min(xs) - dx, size), _cell(F.array_max(xs) + dx, size))))
    return out.withColumn("__cy", F.explode(F.sequence(_cell(F.array_min(ys) - dy, size), _cell(F.array_max(ys) + dy, size))))


def points_in_shapes(points: DataFrame, shapes: DataFrame, x: str = "x", y: str = "y", rings_col: str = "rings", size: float | None = None) -> DataFrame:
    """A row for each pair of a point and a shape that holds it. Points and shapes that are null meet nothing.

    The side of a grid cell is half a shape's on average unless it is given, so
    a shape has about nine rows. How many they are isn't seen by the planner,
    which would send them to all tasks: they are joined by sorting.
    """
    if size is None:
        points_of = F.flatten(rings_col)
        ends = [F.transform(points_of, lambda p: p.x), F.transform(points_of, lambda p: p.y)]
        found = shapes.agg(F.avg(F.greatest(*[F.array_max(e) - F.array_min(e) for e in ends]))).first()[0]
        size = found / 2 if found else 1.0
    own = points.withColumn("__cx", _cell(F.col(x), size)).withColumn("__cy", _cell(F.col(y), size))
    return own.join(shape_cells(shapes, rings_col, size).hint("merge"), ["__cx", "__cy"]).where(in_shape(F.col(rings_col), F.col(x), F.col(y))).drop("__cx", "__cy")


def points_near_shapes(points: DataFrame, shapes: DataFrame, within: float, x: str = "x", y: str = "y", rings_col: str = "rings") -> DataFrame:
    """A row for each pair of a point and a shape at most ``within`` metres away, with the distance.

    How many degrees of longitude that is follows from each shape's own latitude;
    shapes that reach beyond 89 degrees of latitude, with the distance added, are
    an error, and so is a distance over the date line not seen.
    """
    dy = within / DEGREE
    ys = F.transform(F.flatten(rings_col), lambda p: p.y)
    edge = F.greatest(F.abs(F.array_min(ys)), F.abs(F.array_max(ys))) + dy
    dx = dy / F.cos(F.radians(F.when(edge <= POLAR, edge).otherwise(F.raise_error(F.lit("a shape is too near to a pole")).cast("double"))))
    size = max(dy, 0.05)
    own = points.withColumn("__cx", _cell(F.col(x), size)).withColumn("__cy", _cell(F.col(y), size))
    both = own.join(shape_cells(shapes, rings_col, size, dx, dy), ["__cx", "__cy"]).drop("__cx", "__cy")
    return both.withColumn("metres", shape_metres(F.col(rings_col), F.col(x), F.col(y))).where(F.col("metres") <= within)


def _site_tree(sites: DataFrame, cap: int) -> DataFrame:
    """The nodes of a quadtree of sites with places ix, iy of DEPTH bits: level, cx, cy, px, py, n, box, split.

    A node with more than ``cap`` sites has up to 4^STEP children; boxes are
    those of the sites, so that distances to them need no rounding.
    """
    cells = sites.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"), F.min("sx").alias("x1"), F.max("sx").alias("x2"), F.min("sy").alias("y1"), F.max("sy").alias("y2"))
    up = _at_levels(cells, DEPTH)
    nodes = up.groupBy("level", "cx", "cy").agg(F.sum("n").alias("n"), F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.max("y2").alias("y2"))
    nodes = nodes.select("*", F.shiftright("cx", STEP).alias("px"), F.shiftright("cy", STEP).alias("py"), ((F.col("n") > cap) & (F.col("level") < DEPTH)).alias("split"))
    parents = nodes.where("split").select((F.col("level") + STEP).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    return nodes.where("level = 0").union(nodes.join(parents, ["level", "px", "py"], "left_semi").select(*nodes.columns))


def _at_levels(rows: DataFrame, deepest: int) -> DataFrame:
    """Each row once a level of the tree, with the cell that its place is in."""
    out = rows.withColumn("level", F.explode(F.array(*[F.lit(n) for n in range(0, deepest + 1, STEP)])))
    return out.withColumns({"cx": F.expr(f"shiftright(ix, {DEPTH} - level)"), "cy": F.expr(f"shiftright(iy, {DEPTH} - level)")})


def _measured(nodes: Column, box: Column) -> Column:
    """Nodes with the distances from a box to the farthest and to the nearest place of theirs, the farthest first."""

    def far_near(n: Column) -> Column:
        fx, fy = F.greatest(n.x2 - box.x1, box.x2 - n.x1), F.greatest(n.y2 - box.y1, box.y2 - n.y1)
        nx, ny = F.greatest(n.x1 - box.x2, box.x1 - n.x2, F.lit(0.0)), F.greatest(n.y1 - box.y2, box.y1 - n.y2, F.lit(0.0))
        return F.struct(F.sqrt(fx * fx + fy * fy).alias("far"), F.sqrt(nx * nx + ny * ny).alias("near"), n.n.alias("n"), n.alias("node"))

    return F.transform(nodes, far_near)


def _pruned(rows: DataFrame, k: int) -> DataFrame:
    """Rows of a group (g, box, bound) with nodes: the bound falls to a distance within which each place has k sites, and nodes beyond it go."""
    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(float("inf")).alias("bound"))
    step = lambda a, m: F.struct((a.seen + m.n).alias("seen"), F.when(a.seen >= k, a.bound).otherwise(m.far).alias("bound"))
    within = F.aggregate(F.array_sort("measured"), zero, step, lambda a: F.when(a.seen >= k, a.bound).otherwise(float("inf")))
    rows = rows.withColumn("measured", _measured(F.col("nodes"), F.col("box"))).withColumn("bound", F.least("bound", within))
    kept = F.filter("measured", lambda m: m.near <= F.col("bound"))
    return rows.select("g", "box", "bound", F.transform(kept, lambda m: m.node).alias("nodes"))


def _morton() -> Column:
    """The bits of ix and iy in turn: places in this order are by the cells of all levels."""

    def spread(v: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(spread(F.col("ix").cast("long")), 1).bitwiseOR(spread(F.col("iy").cast("long")))


def _grouped(cap: int) -> Callable:
    """For batches of places and sites by their Morton codes: each place with its group, a cell with at most GROUP places and, unless it has but one, ``cap`` sites."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() << 40
        for batch in batches:
            code, site = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("z", "site"))
            own, others = code[~site], code[site]
            groups = np.empty(len(own), np.int64)
            todo = [(0, len(own), 0, 1 << 2 * DEPTH)]
            while todo:
                start, end, low, width = todo.pop()
                if start == end:
                    continue
                crowd = np.subtract(*np.searchsorted(others, [low + width, low]))
                if width == 1 or end - start == 1 or end - start <= GROUP and crowd <= cap:
                    groups[start:end] = group + np.arange(end - start) // GROUP
                    group = int(groups[end - 1]) + 1
                else:
                    lows = low + np.arange(4) * (width // 4)
                    cuts = [*(start + np.searchsorted(own[start:end], lows)).tolist(), end]
                    todo += [(cuts[n], cuts[n + 1], int(lows[n]), width // 4) for n in range(4)]
            kept = pa.array(~site)
            yield pa.RecordBatch.from_arrays([pa.array(groups), *(batch.column(c).filter(kept) for c in ("x", "y"))], names=["g", "x", "y"])

    return run


def _nearest_of(x: np.ndarray, y: np.ndarray, ids: np.ndarray, sx: np.ndarray, sy: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Place, site, degrees and rank of the k nearest, as numbers of rows; ties by the smaller id."""
    by_id = np.argsort(ids, kind="stable")
    dx, dy = sx[by_id] - x[:, None], sy[by_id] - y[:, None]
    degrees = np.sqrt(dx * dx + dy * dy)
    most = min(k, len(ids))
    at, site = np.nonzero(degrees <= np.partition(degrees, most - 1, axis=1)[:, most - 1 : most])
    found = degrees[at, site]
    order = np.lexsort((site, found, at))
    at, site, found = at[order], site[order], found[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at) + 1
    kept = rank <= k
    return at[kept], by_id[site[kept]], found[kept], rank[kept]


def _ranked(k: int, id_type: pa.DataType) -> Callable:
    """For rows of groups, each group's places before its sites: the k nearest sites of each place. Of the sites read so far only those stay that are nearest to one."""
    names = ["x", "y", "s", "sx", "sy", "degrees", "rank"]

    def found(places: list[np.ndarray], sites: list[np.ndarray]) -> list[np.ndarray]:
        at, site, degrees, rank = _nearest_of(*places, *sites, k)
        return [places[0][at], places[1][at], *(c[site] for c in sites), degrees, rank]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, places, sites, done = None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            g, site, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "site", "x", "y"))
            ids, before = batch.column("s").filter(pa.array(site)).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(site)])
            starts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
            for start, end in zip(starts[:-1], starts[1:]):
                middle = end - int(before[end] - before[start])
                if g[start] != group:
                    if group is not None and len(sites[0]):
                        done.append(found(places, sites))
                    group, places, sites = g[start], [x[:0], y[:0]], [ids[:0], x[:0], y[:0]]
                places = [np.concatenate([c, new[start:middle]]) for c, new in zip(places, (x, y))]
                for n in range(middle, end, POOL):
                    m = min(n + POOL, end)
                    sites = [np.concatenate([c, new]) for c, new in zip(sites, (ids[before[n] : before[m]], x[n:m], y[n:m]))]
                    if len(sites[0]) > POOL:
                        near = np.unique(_nearest_of(*places, *sites, k)[1])
                        sites = [c[near] for c in sites]
            if done:
                yield _batch(done)
                done = []
        if group is not None and len(sites[0]):
            yield _batch([found(places, sites)])

    def _batch(done: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*done)]
        return pa.RecordBatch.from_arrays([pa.array(c, id_type if n == "s" else None) for n, c in zip(names, columns)], names=names)

    return run


def _placed(rows: DataFrame) -> DataFrame:
    return rows.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")


def nearest_to_places(points: DataFrame, sites: DataFrame, site_id: str, k: int = 5) -> DataFrame:
    """The ``k`` sites nearest to each different place by planar degrees, ties by the smaller site id: x, y, site, sx, sy, degrees and rank.

    Points and sites have columns x and y; a place that many points share is
    looked for once. Sites are held in a quadtree whose leaves have at most
    ``CROWD * k`` of them, of a place only the ``k`` with the smallest ids; where
    more places than that lie within 2^-DEPTH of the extent, a leaf has them all.
    Places are sorted by cells into groups of at most ``GROUP``, smaller ones
    where sites are dense. Groups, not places, walk down the tree, level by
    level, each with the nodes that can still hold a site that is nearest to one
    of its places, checkpointed on the way; then its places are held against the
    sites of the leaves that are left, ``POOL`` at a time. A group that is as far
    from many sites as from its k-th meets all of these. Where there are fewer
    than ``k`` sites, all are found. Null ids and null places meet nothing. Site
    ids are numbers, dates, binary or plain texts.
    """
    p = staged(_placed(points).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct())
    s = _placed(sites).where(F.col(site_id).isNotNull()).select(F.col(site_id).alias("s"), F.col("x").cast("double").alias("sx"), F.col("y").cast("double").alias("sy"))
    s = staged(s.withColumn("__n", F.row_number().over(Window.partitionBy("sx", "sy").orderBy("s"))).where(F.col("__n") <= k).drop("__n"))
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))
    ends = [f(finite(c)) for c in "xy" for f in (F.min, F.max)]
    x1, x2, y1, y2, n = p.select("x", "y", F.lit(0).alias("n")).union(s.select("sx", "sy", F.lit(1))).agg(*ends, F.sum("n")).first()
    cap = CROWD * k
    side = max(x2 - x1, y2 - y1) if x1 is not None and y1 is not None else 0.0
    place = lambda c, origin: F.floor(F.least(F.greatest((F.col(c) - F.lit(origin or 0.0)) / F.lit(side or 1.0) * F.lit(float(1 << DEPTH)), F.lit(0.0)), F.lit(float((1 << DEPTH) - 1)))).cast("int")
    s = s.withColumns({"ix": place("sx", x1), "iy": place("sy", y1)})
    tree = staged(_site_tree(s, cap))
    node = F.struct("level", "cx", "cy", "x1", "x2", "y1", "y2", "n", "split")
    kids = tree.where("level > 0").groupBy((F.col("level") - STEP).alias("level"), F.col("px").alias("cx"), F.col("py").alias("cy")).agg(F.collect_list(node).alias("kids"))

    both = p.withColumns({"ix": place("x", x1), "iy": place("y", y1)}).select(_morton().alias("z"), F.lit(False).alias("site"), "x", "y").union(s.select(_morton(), F.lit(True), "sx", "sy"))
    grouped = staged(both.repartitionByRange("z").sortWithinPartitions("z").mapInArrow(_grouped(cap), "g long, x double, y double"))
    box = F.struct(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))
    groups = grouped.groupBy("g").agg(box.alias("box"))

    # the first nodes of all groups: the root, or its 4^STEP children at most
    top = tree.where(F.col("level") == (STEP if (n or 0) > cap else 0)).agg(F.collect_list(node).alias("nodes"))
    walking = _pruned(groups.withColumn("bound", F.lit(float("inf"))).crossJoin(F.broadcast(top)), k)
    arrived = None
    for _ in range(STEP, DEPTH + 1, STEP):
        walking = staged(walking)
        open_ = F.exists("nodes", lambda n: n.split)
        own = walking.where(~open_)
        arrived = own if arrived is None else arrived.union(own)
        walking = walking.where(open_)
        if walking.isEmpty():
            break
        each = walking.select("g", "box", "bound", F.explode("nodes").alias("node"))
        each = each.withColumns({c: F.col("node")[c] for c in ("level", "cx", "cy")}).join(kids, ["level", "cx", "cy"], "left")
        near = F.filter(_measured(F.coalesce("kids", F.array("node")), F.col("box")), lambda m: m.near <= F.col("bound"))
        each = each.select("g", "box", "bound", F.transform(near, lambda m: m.node).alias("nodes"))
        walking = _pruned(each.groupBy("g").agg(F.first("box").alias("box"), F.min("bound").alias("bound"), F.flatten(F.collect_list("nodes")).alias("nodes")), k)
    deepest = tree.agg(F.max("level")).first()[0] or 0
    leaves = tree.where("NOT split").select("level", "cx", "cy")
    held = _at_levels(s, deepest).join(leaves, ["level", "cx", "cy"]).select("level", "cx", "cy", "s", "sx", "sy")
    met = arrived.select("g", "box", "bound", F.explode("nodes").alias("node")).withColumns({c: F.col("node")[c] for c in ("level", "cx", "cy")}).join(held, ["level", "cx", "cy"])
    spot = F.array(F.struct(F.col("sx").alias("x1"), F.col("sx").alias("x2"), F.col("sy").alias("y1"), F.col("sy").alias("y2"), F.lit(1).alias("n")))
    met = met.where(_measured(spot, F.col("box"))[0].near <= F.col("bound"))
    id_type = s.schema["s"].dataType
    rows = grouped.select("g", F.lit(False).alias("site"), F.lit(None).cast(id_type).alias("s"), "x", "y").union(met.select("g", F.lit(True), "s", "sx", "sy"))
    rows = rows.repartition("g").sortWithinPartitions("g", "site")
    kinds = f"x double, y double, s {id_type.simpleString()}, sx double, sy double, degrees double, rank long"
    return rows.mapInArrow(_ranked(k, to_arrow_type(id_type)), kinds).withColumnRenamed("s", site_id)


def nearest_sites(points: DataFrame, sites: DataFrame, point_id: str, site_id: str, k: int = 5) -> DataFrame:
    """The ``nearest_to_places`` of each point: point, x, y, site, sx, sy, degrees and rank. Point ids are distinct; null ids meet nothing."""
    p = _placed(points).where(F.col(point_id).isNotNull()).select(F.col(point_id).alias("__p"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    found = p.join(nearest_to_places(p, sites, site_id, k), ["x", "y"])
    return found.select(F.col("__p").alias(point_id), "x", "y", site_id, "sx", "sy", "degrees", "rank")
