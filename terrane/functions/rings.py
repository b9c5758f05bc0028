"""Rings as rows: one row for each vertex (key columns, ord, x, y), open and in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import geometry as g


def edges(vertices: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """keys, ord, ax, ay, bx, by: each vertex with the next, the last with the first."""
    ring = Window.partitionBy(*keys).orderBy("ord")
    first = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return vertices.select(
        *keys,
        "ord",
        F.col("x").alias("ax"),
        F.col("y").alias("ay"),
        F.coalesce(F.lead("x").over(ring), F.first("x").over(first)).alias("bx"),
        F.coalesce(F.lead("y").over(ring), F.first("y").over(first)).alias("by"),
    )


def measures(vertices: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """keys, signed_area, area, perimeter, centroid_x, centroid_y, box, n: from edges, shifted to the ring's box for precision.

    The centroid is area-weighted; of a ring without area the mean vertex.
    """
    box = vertices.groupBy(*keys).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.count("*").alias("n"))
    e = edges(vertices, keys).join(box, list(keys))
    e = e.selectExpr(*keys, "n", "min_x", "min_y", "max_x", "max_y", "mean_x", "mean_y", "ax - min_x as ax", "ay - min_y as ay", "bx - min_x as bx", "by - min_y as by")
    c = "(ax * by - bx * ay)"
    out = e.groupBy(*keys, "n", "min_x", "min_y", "max_x", "max_y", "mean_x", "mean_y").agg(
        F.expr(f"sum({c}) / 2").alias("signed_area"),
        F.expr(f"sum({g.distance('ax', 'ay', 'bx', 'by')})").alias("perimeter"),
        F.expr(f"sum((ax + bx) * {c})").alias("mx"),
        F.expr(f"sum((ay + by) * {c})").alias("my"),
    )
    flat = "abs(6 * signed_area) < 1e-12"
    return out.selectExpr(
        *keys,
        "n",
        "signed_area",
        "abs(signed_area) as area",
        "perimeter",
        f"case when {flat} then mean_x else min_x + mx / (6 * signed_area) end as centroid_x",
        f"case when {flat} then mean_y else min_y + my / (6 * signed_area) end as centroid_y",
        "min_x",
        "min_y",
        "max_x",
        "max_y",
    )


def normalized(vertices: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """The rings without a repeated closing vertex, counter-clockwise; rings of under three vertices or without area go."""
    last = Window.partitionBy(*keys)
    marked = vertices.withColumns({"_end": F.max("ord").over(last), "_x0": F.expr("min_by(x, ord)").over(last), "_y0": F.expr("min_by(y, ord)").over(last), "_n": F.count("*").over(last)})
    open_ = marked.where("not (_n > 1 and ord = _end and x = _x0 and y = _y0)").select(*keys, "ord", "x", "y")
    size = measures(open_, keys).where(f"n >= 3 and area > {g.TOL}").select(*keys, "signed_area", "n")
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("ord")) - 1
    turned = open_.withColumn("ord", at).join(size, list(keys))
    return turned.select(*keys, F.expr("cast(case when signed_area < 0 then n - 1 - ord else ord end as int)").alias("ord"), "x", "y")


def convexity(vertices: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """keys, convex, reflex (turns against the ring's winding), straight: from each vertex's turn."""
    ring = Window.partitionBy(*keys).orderBy("ord")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = vertices.select(
        *keys,
        "x",
        "y",
        F.coalesce(F.lag("x").over(ring), F.last("x").over(whole)).alias("px"),
        F.coalesce(F.lag("y").over(ring), F.last("y").over(whole)).alias("py"),
        F.coalesce(F.lead("x").over(ring), F.first("x").over(whole)).alias("nx"),
        F.coalesce(F.lead("y").over(ring), F.first("y").over(whole)).alias("ny"),
    ).withColumn("turn", F.expr(g.cross("px", "py", "x", "y", "nx", "ny")))
    out = turns.groupBy(*keys).agg(F.expr(f"count_if(turn > {g.TOL})").alias("left_turns"), F.expr(f"count_if(turn < -{g.TOL})").alias("right_turns"), F.expr(f"count_if(abs(turn) <= {g.TOL})").alias("straight"))
    return out.selectExpr(*keys, "left_turns", "right_turns", "straight", "(left_turns > 0) <> (right_turns > 0) as convex")


def moments(vertices: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """measures plus compactness (perimeter^2 / 4 pi area), diameter and the ratio of the area's covariance eigenvalues."""
    m = measures(vertices, keys)
    e = edges(vertices, keys).join(m.select(*keys, "centroid_x", "centroid_y", "signed_area"), list(keys))
    e = e.selectExpr(*keys, "signed_area", "ax - centroid_x as ax", "ay - centroid_y as ay", "bx - centroid_x as bx", "by - centroid_y as by")
    c = "(ax * by - bx * ay)"
    second = e.groupBy(*keys).agg(
        F.expr(f"sum({c} * (ax * ax + ax * bx + bx * bx)) / (12 * first(signed_area))").alias("sxx"),
        F.expr(f"sum({c} * (ay * ay + ay * by + by * by)) / (12 * first(signed_area))").alias("syy"),
        F.expr(f"sum({c} * (ax * by + 2 * ax * ay + 2 * bx * by + bx * ay)) / (24 * first(signed_area))").alias("sxy"),
    )
    other = vertices.select(*keys, F.col("ord").alias("ord2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    diameter = vertices.join(other, list(keys)).where("ord < ord2").groupBy(*keys).agg(F.expr(f"max({g.distance('x', 'y', 'x2', 'y2')})").alias("diameter"))
    spread = "sqrt((sxx - syy) * (sxx - syy) / 4 + sxy * sxy)"
    return (
        m.join(second, list(keys))
        .join(diameter, list(keys))
        .selectExpr(*keys, "area", "perimeter", "diameter", "centroid_x", "centroid_y", "perimeter * perimeter / (4 * pi() * area) as compactness", f"(sxx + syy) / 2 + {spread} as eigen_major", f"(sxx + syy) / 2 - {spread} as eigen_minor", f"((sxx + syy) / 2 + {spread}) / ((sxx + syy) / 2 - {spread}) as eigen_ratio")
    )


def fan(vertices: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """keys, part, ax..cy, area: the triangles from the first vertex of a convex ring."""
    e = edges(vertices, keys)
    first = vertices.where("ord = 0").select(*keys, F.col("x").alias("cx0"), F.col("y").alias("cy0"))
    last = vertices.groupBy(*keys).agg(F.max("ord").alias("_last"))
    inner = e.join(last, list(keys)).where("ord > 0 and ord < _last").join(first, list(keys))
    return inner.selectExpr(*keys, "ord as part", "cx0 as ax", "cy0 as ay", "ax as bx", "ay as by", "bx as cx", "by as cy", f"abs({g.cross('cx0', 'cy0', 'ax', 'ay', 'bx', 'by')}) / 2 as area")


def triangle_samples(triangles: DataFrame, n: int, keys: Sequence[str] = ("id",)) -> DataFrame:
    """keys, part, area, sx, sy: the centroids of the n x n equal triangles of each triangle; ``area`` is that of one."""
    up = f"explode(flatten(transform(sequence(0, {n - 1}), i -> transform(sequence(0, {n - 1} - i), j -> struct((i + 1 / 3.0e0) / {n} as u, (j + 1 / 3.0e0) / {n} as v)))))"
    down = f"explode(flatten(transform(sequence(0, {max(n - 2, 0)}), i -> transform(sequence(0, {max(n - 2, 0)} - i), j -> struct((i + 2 / 3.0e0) / {n} as u, (j + 2 / 3.0e0) / {n} as v)))))"
    parts = [triangles.selectExpr("*", f"{up} as s")] + ([triangles.selectExpr("*", f"{down} as s")] if n > 1 else [])
    both = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return both.selectExpr(*keys, "part", f"area / {n * n} as area", "ax + s.u * (bx - ax) + s.v * (cx - ax) as sx", "ay + s.u * (by - ay) + s.v * (cy - ay) as sy")
