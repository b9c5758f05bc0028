"""Spatial joins on grid keys: containment, radius, nearest neighbour, adjacency and portals.

A cell key turns a range join into an equi join that shuffles on (cell) and
can be split; the exact predicate then runs on what shares a cell. A point has
one cell; a region or a ball is emitted in every cell that its box touches, so
nothing on a border is lost, and duplicates cannot arise because the point's
cell is unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import rings
from .lineage import cut


def _cells(low: str, high: str, size: float) -> str:
    return f"sequence(cast(floor(({low}) / {size}) as bigint), cast(floor(({high}) / {size}) as bigint))"


def points_in_regions(points: DataFrame, vertices: DataFrame, *, point: str = "pid", region: str = "id", cell: float = 10.0, tol: float = g.TOL) -> DataFrame:
    """(point, region) for every region that contains the point, boundaries included.

    ``points`` has (point, x, y), ``vertices`` the regions' rings. Parity of the
    edges that a ray crosses, or a touch of any edge. Null coordinates match nothing.
    """
    box = vertices.groupBy(region).agg(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"))
    spread = box.selectExpr("*", f"explode({_cells(f'lx - {tol}', f'hx + {tol}', cell)}) as gx").selectExpr("*", f"explode({_cells(f'ly - {tol}', f'hy + {tol}', cell)}) as gy")
    placed = points.selectExpr(point, "x as px", "y as py", f"cast(floor(x / {cell}) as bigint) as gx", f"cast(floor(y / {cell}) as bigint) as gy")
    near = placed.join(spread, ["gx", "gy"]).where(f"px >= lx - {tol} and px <= hx + {tol} and py >= ly - {tol} and py <= hy + {tol}").select(point, "px", "py", region)
    lined = near.join(rings.edges(vertices, [region]), region)
    hits = lined.groupBy(point, "px", "py", region).agg(
        F.expr(f"count_if({g.crosses_ray('px', 'py', 'ax', 'ay', 'bx', 'by')})").alias("crossed"),
        F.expr(f"bool_or({g.point_on_segment('px', 'py', 'ax', 'ay', 'bx', 'by', tol)})").alias("touches"),
    )
    return hits.where("touches or crossed % 2 = 1").select(point, region)


def first_region(points: DataFrame, vertices: DataFrame, *, point: str = "pid", region: str = "id", cell: float = 10.0) -> DataFrame:
    """(point, region): the smallest id, as text, of the regions that contain the point."""
    return points_in_regions(points, vertices, point=point, region=region, cell=cell).groupBy(point).agg(F.min(region).alias(region))


def clearance(points: DataFrame, segments: DataFrame, *, point: str = "pid") -> DataFrame:
    """(point, clearance): the distance to the nearest of ``segments`` (ax, ay, bx, by), a map's walls, which are broadcast by Spark's own size check."""
    d = g.point_segment_distance("x", "y", "ax", "ay", "bx", "by")
    return points.crossJoin(segments.select("ax", "ay", "bx", "by")).groupBy(point).agg(F.expr(f"min({d})").alias("clearance"))


def within_radius(left: DataFrame, right: DataFrame, radius: float, *, left_id: str = "a", right_id: str = "b") -> DataFrame:
    """(left_id, right_id, d2) for pairs at most ``radius`` apart (closed ball); both have (id, x, y)."""
    placed = left.selectExpr(left_id, "x as ax", "y as ay", f"cast(floor(x / {radius}) as bigint) as gx", f"cast(floor(y / {radius}) as bigint) as gy")
    spread = right.selectExpr(right_id, "x as bx", "y as by", f"explode(sequence(cast(floor(x / {radius}) as bigint) - 1, cast(floor(x / {radius}) as bigint) + 1)) as gx", "y").selectExpr(right_id, "bx", "by", "gx", f"explode(sequence(cast(floor(y / {radius}) as bigint) - 1, cast(floor(y / {radius}) as bigint) + 1)) as gy")
    d2 = "(ax - bx) * (ax - bx) + (ay - by) * (ay - by)"
    return placed.join(spread, ["gx", "gy"]).selectExpr(left_id, right_id, f"{d2} as d2").where(f"d2 <= {radius * radius}")


def k_nearest(queries: DataFrame, points: DataFrame, k: int, *, query: str = "q", point: str = "p", cell: float = 1.0) -> DataFrame:
    """(query, rank, point, d2): the k nearest, ties to the smaller point, whatever their distance.

    A query asks its own cell and the ring around it, then rings twice as wide,
    until it has k points nearer than the ring's inside; only unfinished queries
    go on, and a ring that spans the whole extent ends the search.
    """
    extent = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if extent[0] is None:
        return queries.limit(0).selectExpr(query, "cast(1 as int) as rank").crossJoin(points.limit(0).select(point)).withColumn("d2", F.lit(0.0))
    reach, out, asked = cell, None, queries.select(query, "x", "y")
    far = asked.agg(F.max(F.expr(f"greatest(abs(x - {extent[0]}), abs(x - {extent[1]}))")), F.max(F.expr(f"greatest(abs(y - {extent[2]}), abs(y - {extent[3]}))"))).first()
    whole = 0.0 if far[0] is None else float((far[0] ** 2 + far[1] ** 2) ** 0.5)
    while True:
        got = within_radius(asked.withColumnRenamed(query, "_q"), points.withColumnRenamed(point, "_p"), reach, left_id="_q", right_id="_p")
        ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy("_q").orderBy("d2", "_p"))).where(F.col("rank") <= k)
        ranked = ranked.select(F.col("_q").alias(query), "rank", F.col("_p").alias(point), "d2")
        last = reach >= whole
        full = ranked.groupBy(query).agg(F.count("*").alias("n")).where(F.col("n") >= (0 if last else k)).select(query)
        done = ranked.join(full, query, "left_semi")
        out = done if out is None else out.union(done)
        if last:
            return out
        asked = cut(asked.join(full, query, "left_anti"))
        if asked.isEmpty():
            return out
        reach *= 2


def shared_portals(vertices: DataFrame, *, clearance_: float = 0.0, region: str = "id", cell: float = 10.0, tol: float = g.TOL) -> DataFrame:
    """(source, target, portal ends, portal_width, safe ends, safe_portal_width): pairs source < target.

    The longest overlap of two collinear edges, the first of equals; the safe
    portal is trimmed by the clearance at both ends and null when nothing is
    left. Edges meet through the cells of their boxes. Point contact is no portal.
    """
    e = rings.edges(vertices, [region])
    grid = e.selectExpr(region, "ord", "ax", "ay", "bx", "by", f"explode({_cells('least(ax, bx)', 'greatest(ax, bx)', cell)}) as gx").selectExpr("*", f"explode({_cells('least(ay, by)', 'greatest(ay, by)', cell)}) as gy")
    a = grid.selectExpr(f"{region} as source", "ord as o1", "ax", "ay", "bx", "by", "gx", "gy")
    b = grid.selectExpr(f"{region} as target", "ord as o2", "ax as cx", "ay as cy", "bx as dx", "by as dy", "gx", "gy")
    low, high, collinear = g.overlap_on_axis(("ax", "ay"), ("bx", "by"), ("cx", "cy"), ("dx", "dy"), tol)
    met = a.join(b, ["gx", "gy"]).where("source < target").drop("gx", "gy").distinct().where(collinear)
    met = met.selectExpr("source", "target", "o1", "o2", "ax", "ay", "bx", "by", f"{low} as lo", f"{high} as hi", f"{g.distance('ax', 'ay', 'bx', 'by')} as len").where(f"(hi - lo) * len > {tol}")
    best = met.selectExpr("source", "target", "o1", "o2", "(hi - lo) * len as width", "ax + lo * (bx - ax) as px", "ay + lo * (by - ay) as py", "ax + hi * (bx - ax) as qx", "ay + hi * (by - ay) as qy")
    best = best.groupBy("source", "target").agg(F.expr("max_by(struct(px, py, qx, qy, width), struct(width, -o1, -o2))").alias("p")).select("source", "target", "p.*")
    safe = f"width - 2 * {clearance_} > {tol}"
    trim = f"{clearance_} / width"
    return best.selectExpr(
        "source", "target", "px", "py", "qx", "qy", "width as portal_width",
        *(f"case when {safe} then {s} + {trim} * ({t} - {s}) end as {n}" for n, s, t in (("safe_px", "px", "qx"), ("safe_py", "py", "qy"), ("safe_qx", "qx", "px"), ("safe_qy", "qy", "py"))),
        f"case when {safe} then width - 2 * {clearance_} end as safe_portal_width",
    )


def region_descriptors(vertices: DataFrame, portals: DataFrame, *, region: str = "id") -> DataFrame:
    """Measures with degree, safe_degree and (safe) conductance, the portals' widths over the perimeter; regions without portals have degree 0."""
    both = portals.selectExpr(f"source as {region}", "target as other", "portal_width", "safe_portal_width").union(portals.selectExpr(f"target as {region}", "source as other", "portal_width", "safe_portal_width"))
    sums = both.groupBy(region).agg(F.countDistinct("other").alias("degree"), F.expr("count(distinct case when safe_portal_width is not null then other end)").alias("safe_degree"), F.sum("portal_width").alias("w"), F.sum("safe_portal_width").alias("sw"))
    m = rings.measures(vertices, [region]).select(region, "area", "perimeter", "centroid_x", "centroid_y")
    return m.join(sums, region, "left").selectExpr(region, "area", "perimeter", "centroid_x", "centroid_y", "coalesce(degree, 0) as degree", "coalesce(safe_degree, 0) as safe_degree", "coalesce(w, 0.0e0) / perimeter as conductance", "coalesce(sw, 0.0e0) / perimeter as safe_conductance")


def portal_costs(portals: DataFrame, descriptors: DataFrame, *, region: str = "id") -> DataFrame:
    """(source, target, cost): from centroid to centroid through the middle of the safe portal; edges without a safe portal go."""
    s = descriptors.selectExpr(f"{region} as source", "centroid_x as sx", "centroid_y as sy")
    t = descriptors.selectExpr(f"{region} as target", "centroid_x as tx", "centroid_y as ty")
    mid = portals.where("safe_portal_width is not null").selectExpr("source", "target", "(safe_px + safe_qx) / 2 as mx", "(safe_py + safe_qy) / 2 as my")
    return mid.join(s, "source").join(t, "target").selectExpr("source", "target", f"{g.distance('sx', 'sy', 'mx', 'my')} + {g.distance('mx', 'my', 'tx', 'ty')} as cost")
