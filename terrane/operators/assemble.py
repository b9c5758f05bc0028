"""What a map's graph is put together from and checked by: clearance means, metrics, endpoint regions, sequences, label lists, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import rings
from . import spatial

#: A recorded path length may differ from the path's by less.
LENGTH_ERROR = 1e-3


def mean_clearance(vertices: DataFrame, walls: DataFrame, subdivisions: int = 12, region: str = "id") -> DataFrame:
    """(region, mean_clearance): the area-weighted mean distance from the walls over equal-area samples of each region's triangles."""
    samples = rings.triangle_samples(rings.fan(vertices, [region]), subdivisions).selectExpr(f"struct({region}, sx, sy) as pid", "sx as x", "sy as y", "area")
    near = spatial.clearance(samples.select("pid", "x", "y").distinct(), walls)
    return samples.join(near, "pid").groupBy(F.col(f"pid.{region}").alias(region)).agg(F.expr("sum(area * clearance) / sum(area)").alias("mean_clearance"))


def traversability(portals: DataFrame, means: DataFrame, region: str = "id") -> DataFrame:
    """Portals with traversability and safe_traversability: a width times the smaller mean clearance of its two regions, null if either is unknown."""
    a, b = (means.selectExpr(f"{region} as {end}", f"mean_clearance as {end}_mean") for end in ("source", "target"))
    known = "source_mean is not null and target_mean is not null"
    out = portals.join(a, "source", "left").join(b, "target", "left")
    for width, name in (("portal_width", "traversability"), ("safe_portal_width", "safe_traversability")):
        out = out.withColumn(name, F.expr(f"case when {known} then {width} * least(source_mean, target_mean) end"))
    return out.drop("source_mean", "target_mean")


def map_metrics(boundary: DataFrame, obstacles: DataFrame) -> DataFrame:
    """(boundary_area, obstacle_area, obstacle_area_ratio) of rings (id, ord, x, y); without obstacles their area is 0."""
    inner = rings.measures(obstacles).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("obstacle_area"))
    outer = rings.measures(boundary).agg(F.sum("area").alias("boundary_area"))
    return outer.crossJoin(inner).withColumn("obstacle_area_ratio", F.expr("obstacle_area / nullif(boundary_area, 0)"))


def endpoint_regions(ends: DataFrame, vertices: DataFrame, cell: float = 10.0) -> DataFrame:
    """(graph, role, id): the regions of each start and goal, each once.

    ``ends`` has (graph, role, x, y, ids); coordinates, where there are any, win
    over the ids that are named.
    """
    placed = ends.where("x is not null and y is not null").selectExpr("struct(graph, role, x, y) as pid", "x", "y")
    found = spatial.points_in_regions(placed, vertices, cell=cell).selectExpr("pid.graph as graph", "pid.role as role", "id")
    named = ends.where("x is null or y is null").selectExpr("graph", "role", "explode(ids) as id")
    return found.union(named.join(vertices.select("id").distinct(), "id", "left_semi").select("graph", "role", "id")).distinct()


def sequence_steps(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, rank, step, source, target, cost): each returned path's edges in order."""
    steps = paths.where("size(path) > 1").selectExpr("graph", "rank", "posexplode(transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] as source, path[i] as target))) as (step, hop)").select("graph", "rank", "step", "hop.*")
    return steps.join(edges.select("graph", "source", "target", "cost"), ["graph", "source", "target"]).select("graph", "rank", "step", "source", "target", "cost")


def corridor_ends(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """(graph, rank, valid): whether a path's first region holds the start and its last the goal; ``ends`` as from ``endpoint_regions``."""
    first, last = (ends.where(f"role = '{role}'").selectExpr("graph", f"id as {name}", f"true as {role}").distinct() for role, name in (("start", "first"), ("goal", "last")))
    out = paths.selectExpr("graph", "rank", "path[0] as first", "element_at(path, -1) as last")
    return out.join(first, ["graph", "first"], "left").join(last, ["graph", "last"], "left").selectExpr("graph", "rank", "start is not null and goal is not null as valid")


def active_labels(labelled: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Adds ``labels``, the names whose level is active or very, in their order."""
    return labelled.withColumn("labels", F.array_compact(F.array(*(F.when(F.col(f"{n}_level").isin("active", "very"), n) for n in names))))


def missing_labels(labelled: DataFrame, names: tuple[str, ...], key: str = "id") -> DataFrame:
    """(key, label) for each label that is unavailable."""
    found = F.array_compact(F.array(*(F.when(F.col(f"{n}_level") == "unavailable", n) for n in names)))
    return labelled.select(key, F.explode(found).alias("label"))


def protected_regions(named: DataFrame, goals: DataFrame, vertices: DataFrame, cell: float = 10.0) -> DataFrame:
    """(id): the named regions and all that hold a goal (pid, x, y), each once."""
    return named.select("id").union(spatial.points_in_regions(goals, vertices, cell=cell).select("id")).distinct()


def cheapest(rows: DataFrame, by: str, *score: str) -> DataFrame:
    """One row for each ``by``: that with the lexicographically least ``score``."""
    rest = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.min_by(F.struct(*rest), F.struct(*score)).alias("best")).select(by, "best.*")


def restored(vertices: DataFrame, boxes: DataFrame, key: str = "id") -> DataFrame:
    """Rings (key, ord, x, y) moved and scaled, each axis for itself, onto the boxes (key, lx, ly, hx, hy) that they came from; a flat axis keeps its place."""
    have = vertices.groupBy(key).agg(F.min("x").alias("ax"), F.max("x").alias("bx"), F.min("y").alias("ay"), F.max("y").alias("by_"))
    move = "case when {b} > {a} then {l} + ({c} - {a}) * ({h} - {l}) / ({b} - {a}) else {l} end as {c}"
    both = vertices.join(have, key).join(boxes, key)
    return both.selectExpr(key, "ord", move.format(a="ax", b="bx", c="x", l="lx", h="hx"), move.format(a="ay", b="by_", c="y", l="ly", h="hy"))


def infill_ratio(voxels: DataFrame) -> DataFrame:
    """(occupied, ratio): distinct voxels (i, j, k) over those of their bounding box; none: 0 and null."""
    box = " * ".join(f"(max({c}) - min({c}) + 1)" for c in "ijk")
    return voxels.select("i", "j", "k").distinct().agg(F.count("*").alias("occupied"), F.expr(f"count(*) / ({box})").alias("ratio"))


def verification(runs: DataFrame, lengths: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row on recorded runs (keys, success, path_length) and their paths' lengths (keys, measured).

    recorded, repeated (rows whose keys an earlier row has), failed, checked,
    unmeasured (successes without a path), stray (failures with a length),
    max_error and sound: no repeat, nothing unmeasured or stray, and every
    length within LENGTH_ERROR of its path's.
    """
    out = runs.join(lengths, list(keys), "left").withColumn("error", F.when(F.col("success"), F.abs(F.col("path_length") - F.col("measured"))))
    sums = out.agg(
        F.count("*").alias("recorded"), F.count_if(~F.col("success")).alias("failed"), F.count("error").alias("checked"),
        F.count_if(F.col("success") & F.col("error").isNull()).alias("unmeasured"), F.count_if(~F.col("success") & F.col("path_length").isNotNull()).alias("stray"), F.max("error").alias("max_error"),
    )
    twice = runs.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated"))
    return sums.crossJoin(twice).withColumn("sound", F.expr(f"repeated = 0 and unmeasured = 0 and stray = 0 and coalesce(max_error, 0) < {LENGTH_ERROR}"))


def running_total(value: str, by: str, order: str) -> Column:
    """A sum of all rows up to this one, by key."""
    return F.sum(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
