"""Validity of map geometry, robot states and segments, and generated maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import rings
from . import spatial


def state_validity(points: DataFrame, boundary: DataFrame, obstacles: DataFrame, clearance: float, *, tol: float = g.TOL, cell: float = 10.0) -> DataFrame:
    """(pid, inside, blocked, clearance, valid): in the boundary, in no obstacle, and far enough from every wall.

    ``points`` has (pid, x, y); rings are (id, ord, x, y). Touching the boundary
    is inside; with a clearance of 0 it is also valid.
    """
    inside = spatial.points_in_regions(points, boundary, cell=cell).select("pid").distinct().withColumn("inside", F.lit(True))
    blocked = spatial.points_in_regions(points, obstacles, cell=cell).select("pid").distinct().withColumn("blocked", F.lit(True))
    walls = rings.edges(boundary).unionByName(rings.edges(obstacles))
    near = spatial.clearance(points, walls, point="pid")
    out = points.select("pid").join(inside, "pid", "left").join(blocked, "pid", "left").join(near, "pid", "left")
    return out.selectExpr("pid", "coalesce(inside, false) as inside", "coalesce(blocked, false) as blocked", "clearance", f"coalesce(inside, false) and not coalesce(blocked, false) and clearance + {tol} >= {clearance} as valid")


def segment_validity(segments: DataFrame, walls: DataFrame, clearance: float) -> DataFrame:
    """(sid, distance, free): the least distance of each segment (sid, ax, ay, bx, by) from any wall, and whether its swept disk fits; ends are checked by ``state_validity``."""
    w = walls.selectExpr("ax as cx", "ay as cy", "bx as dx", "by as dy")
    d = g.segment_distance(("ax", "ay"), ("bx", "by"), ("cx", "cy"), ("dx", "dy"))
    return segments.crossJoin(w).groupBy("sid").agg(F.expr(f"min({d})").alias("distance")).selectExpr("sid", "distance", f"distance + {g.TOL} >= {clearance} as free")


def path_acceptance(points: DataFrame, start: tuple[float, float], goal: tuple[float, float], walls: DataFrame, clearance: float) -> DataFrame:
    """(path, ends_match, free, accepted) of ordered (path, ord, x, y) rows: ends within 1e-6, every segment free."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("ord")
    steps = points.withColumns({"bx": F.lead("x").over(w), "by": F.lead("y").over(w)}).where("bx is not null").selectExpr("struct(path, ord) as sid", "x as ax", "y as ay", "bx", "by")
    free = segment_validity(steps, walls, clearance).groupBy("sid.path").agg(F.expr("bool_and(free)").alias("free"))
    ends = points.groupBy("path").agg(F.expr("min_by(struct(x, y), ord)").alias("s"), F.expr("max_by(struct(x, y), ord)").alias("t"))
    match = f"{g.distance('s.x', 's.y', repr(start[0]), repr(start[1]))} <= 1e-6 and {g.distance('t.x', 't.y', repr(goal[0]), repr(goal[1]))} <= 1e-6"
    return ends.join(free, "path", "left").selectExpr("path", f"{match} as ends_match", "coalesce(free, true) as free", f"({match}) and coalesce(free, true) as accepted")


def ring_problems(vertices: DataFrame) -> DataFrame:
    """(id, problem) of rings that are no simple polygons: under three vertices, coordinates not finite, no area, edges that cross."""
    few = vertices.groupBy("id").agg(F.count("*").alias("n"), F.expr("bool_or(x is null or y is null or isnan(x) or isnan(y) or abs(x) = double('infinity') or abs(y) = double('infinity'))").alias("odd"))
    a = rings.edges(vertices)
    b = a.selectExpr("id", "ord as o2", "ax as cx", "ay as cy", "bx as dx", "by as dy")
    apart = "ord < o2 and not (cx = bx and cy = by) and not (ax = dx and ay = dy)"
    meets = g.segments_intersect(("ax", "ay"), ("bx", "by"), ("cx", "cy"), ("dx", "dy"))
    crossed = a.join(b, "id").where(f"{apart} and {meets}").select("id").distinct()
    flat = rings.measures(vertices).where(f"not area > {g.TOL}").select("id")
    return (
        few.where("n < 3").select("id", F.lit("vertices").alias("problem"))
        .union(few.where("odd").select("id", F.lit("coordinates")))
        .union(flat.select("id", F.lit("area")))
        .union(crossed.select("id", F.lit("crossing")))
    )


def overlapping(vertices: DataFrame, cell: float = 10.0) -> DataFrame:
    """(a, b) of rings, a < b, that share more than touching edges: an edge crossing, or a vertex of one strictly in the other."""
    e = rings.edges(vertices)
    box = "explode(sequence(cast(floor(least(ax, bx) / {c}) as bigint), cast(floor(greatest(ax, bx) / {c}) as bigint))) as gx".format(c=cell)
    boy = "explode(sequence(cast(floor(least(ay, by) / {c}) as bigint), cast(floor(greatest(ay, by) / {c}) as bigint))) as gy".format(c=cell)
    grid = e.selectExpr("id", "ax", "ay", "bx", "by", box).selectExpr("*", boy)
    other = grid.selectExpr("id as b", "ax as cx", "ay as cy", "bx as dx", "by as dy", "gx", "gy")
    s = [g.cross(*p) for p in (("ax", "ay", "bx", "by", "cx", "cy"), ("ax", "ay", "bx", "by", "dx", "dy"), ("cx", "cy", "dx", "dy", "ax", "ay"), ("cx", "cy", "dx", "dy", "bx", "by"))]
    crossing = grid.withColumnRenamed("id", "a").join(other, ["gx", "gy"]).where(f"a < b and {s[0]} * {s[1]} < -{g.TOL} and {s[2]} * {s[3]} < -{g.TOL}").select("a", "b")
    middle = rings.measures(vertices).selectExpr("id as pid", "centroid_x as x", "centroid_y as y")
    within = spatial.points_in_regions(middle, vertices, cell=cell).where("pid <> id").selectExpr("least(pid, id) as a", "greatest(pid, id) as b")
    return crossing.union(within).distinct()


def noise_cloud(spark: SparkSession, size: tuple[int, int, int], *, seed: int = 42, frequency: float = 0.1, octaves: int = 2, attenuation: float = 0.5) -> DataFrame:
    """(i, j, k, value): fractal gradient noise for each voxel of a box, gradients by hash of the lattice point."""
    grid = spark.range(size[0]).selectExpr("cast(id as int) as i").crossJoin(spark.range(size[1]).selectExpr("cast(id as int) as j")).crossJoin(spark.range(size[2]).selectExpr("cast(id as int) as k"))
    total = []
    for octave in range(octaves):
        f = frequency * 2**octave
        corners = []
        for a, b, c in [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]:
            at = [f"(floor({n} * {f}e0) + {o})" for n, o in zip("ijk", (a, b, c), strict=True)]
            away = [f"({n} * {f}e0 - {p})" for n, p in zip("ijk", at, strict=True)]
            slope = " + ".join(f"(pmod(xxhash64({', '.join(at)}, {seed + octave}, {axis}), 2001) / 1000e0 - 1) * {d}" for axis, d in enumerate(away))
            fade = " * ".join(f"(1 - abs({d}) * abs({d}) * abs({d}) * (abs({d}) * (abs({d}) * 6 - 15) + 10))" for d in away)
            corners.append(f"({slope}) * {fade}")
        total.append(f"{attenuation**octave} * ({' + '.join(corners)})")
    return grid.selectExpr("i", "j", "k", " + ".join(total) + " as value")


def maze_walls(seeds: DataFrame, width: int, height: int) -> DataFrame:
    """(seed, i, j): the wall cells of a maze by recursive division, one kernel for each seed; every open cell can reach every other."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for seed in frame["seed"]:
            r = np.random.default_rng(int(seed))
            walls: set[tuple[int, int]] = set()
            todo = [(0, 0, width, height)]
            while todo:
                x, y, w, h = todo.pop()
                if w < 3 or h < 3:
                    continue
                # Walls stand on odd lines and doors on even places, so no wall closes a door.
                if w >= h:
                    at = x + 1 + 2 * int(r.integers(0, (w - 1) // 2))
                    door = y + 2 * int(r.integers(0, (h + 1) // 2))
                    walls |= {(at, j) for j in range(y, y + h) if j != door}
                    todo += [(x, y, at - x, h), (at + 1, y, x + w - at - 1, h)]
                else:
                    at = y + 1 + 2 * int(r.integers(0, (h - 1) // 2))
                    door = x + 2 * int(r.integers(0, (w + 1) // 2))
                    walls |= {(i, at) for i in range(x, x + w) if i != door}
                    todo += [(x, y, w, at - y), (x, at + 1, w, y + h - at - 1)]
            rows += [(seed, i, j) for i, j in sorted(walls)]
        return pd.DataFrame(rows, columns=["seed", "i", "j"])

    return seeds.groupBy("seed").applyInPandas(solve, "seed bigint, i int, j int")


def box_cloud(boxes: DataFrame, resolution: float) -> DataFrame:
    """(id, x, y, z): grid points of boxes (id, x0, y0, z0, x1, y1, z1), from which rooms with doors and furniture are put together."""
    out = boxes
    for c in "xyz":
        out = out.selectExpr("*", f"explode(transform(sequence(cast(ceil({c}0 / {resolution}e0) as int), cast(floor({c}1 / {resolution}e0) as int)), n -> n * {resolution}e0)) as {c}")
    return out.select("id", "x", "y", "z")


def cylinder_cloud(cylinders: DataFrame, resolution: float) -> DataFrame:
    """(id, x, y, z): grid points of upright cylinders (id, cx, cy, r, z0, z1)."""
    boxes = cylinders.selectExpr("*", "cx - r as x0", "cx + r as x1", "cy - r as y0", "cy + r as y1")
    points = box_cloud(boxes.select("id", "x0", "y0", "z0", "x1", "y1", "z1"), resolution)
    return points.join(cylinders, "id").where("(x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r").select("id", "x", "y", "z")


def door_wall(length: float, height: float, at: float, width: float, top: float) -> list[tuple[float, ...]]:
    """The three boxes (x0, z0, x1, z1) of a wall with one door."""
    return [(0.0, 0.0, at, height), (at + width, 0.0, length, height), (at, top, at + width, height)]
