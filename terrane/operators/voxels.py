"""Voxel grids: codecs, occupancy, ray traversal, voxelised polygons and generated clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def occupied(cloud: DataFrame, resolution: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """The distinct voxels (i, j, k) that hold a point (x, y, z); null or non-finite points hold none."""
    return cloud.where("x is not null and y is not null and z is not null and not isnan(x) and not isnan(y) and not isnan(z)").selectExpr(*(f"{g.voxel(c, repr(o), repr(resolution))} as {n}" for c, n, o in zip("xyz", "ijk", origin, strict=True))).distinct()


def centres(voxels: DataFrame, resolution: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    return voxels.selectExpr("i", "j", "k", *(f"{g.voxel_centre(n, repr(o), repr(resolution))} as {c}" for c, n, o in zip("xyz", "ijk", origin, strict=True)))


def ray_cells(rays: DataFrame, key: str = "ray") -> DataFrame:
    """(ray, step, i, j): the unit cells that a segment (ax, ay)-(bx, by) passes, the end's cell left out.

    The crossings with the grid lines are listed in closed form, sorted along
    the ray, and each stretch between two of them lies in its middle's cell.
    """
    def crossings(a: str, b: str) -> str:
        low, high = f"cast(floor(least({a}, {b})) + 1 as int)", f"cast(ceil(greatest({a}, {b})) - 1 as int)"
        return f"case when {low} <= {high} then transform(sequence({low}, {high}), n -> (n - {a}) / ({b} - {a})) else cast(array() as array<double>) end"

    t = rays.selectExpr(key, "ax", "ay", "bx", "by", f"array_sort(array_distinct(concat(array(0.0e0), {crossings('ax', 'bx')}, {crossings('ay', 'by')}, array(1.0e0)))) as t")
    parts = t.selectExpr(key, "ax", "ay", "bx", "by", "posexplode(transform(slice(t, 1, size(t) - 1), (v, n) -> (v + t[n + 1]) / 2)) as (step, m)")
    cells = parts.selectExpr(key, "step", "cast(floor(ax + m * (bx - ax)) as int) as i", "cast(floor(ay + m * (by - ay)) as int) as j", "cast(floor(bx) as int) as ei", "cast(floor(by) as int) as ej")
    return cells.where("not (i = ei and j = ej)").drop("ei", "ej")


def blocked_rays(rays: DataFrame, voxels: DataFrame, key: str = "ray") -> DataFrame:
    """(ray, blocked): whether a passed cell is among the occupied (i, j)."""
    hit = ray_cells(rays, key).join(voxels.select("i", "j").distinct(), ["i", "j"], "left_semi").select(key).distinct()
    return rays.select(key).join(hit.withColumn("blocked", F.lit(True)), key, "left").select(key, F.coalesce("blocked", F.lit(False)).alias("blocked"))


def voxelize(edges: DataFrame, step: float, key: str = "id") -> DataFrame:
    """(id, x, y): grid points inside each ring by the even-odd rule, from its box's lower corner; ``edges`` as from ``rings.edges``."""
    box = edges.groupBy(key).agg(F.min("ax").alias("lx"), F.max("ax").alias("hx"), F.min("ay").alias("ly"), F.max("ay").alias("hy"))
    grid = box.selectExpr(key, f"ly", "hy", f"explode(transform(sequence(0, cast(floor((hx - lx) / {step}) as int)), n -> lx + n * {step})) as x").selectExpr(key, "x", f"explode(transform(sequence(0, cast(floor((hy - ly) / {step}) as int)), n -> ly + n * {step})) as y")
    inside = grid.join(edges, key).groupBy(key, "x", "y").agg(F.expr(f"count_if({g.crosses_ray('x', 'y', 'ax', 'ay', 'bx', 'by')})").alias("n"))
    return inside.where("n % 2 = 1").select(key, "x", "y")


def exposed(voxels: DataFrame) -> DataFrame:
    """The voxels that are not enclosed by all 26 neighbours."""
    shifts = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(d, ("di", "dj", "dk"), strict=True))) for d in [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])))
    near = voxels.select(shifts.alias("s"), "i", "j", "k").selectExpr("i + s.di as i", "j + s.dj as j", "k + s.dk as k").groupBy("i", "j", "k").count().where("count >= 27").select("i", "j", "k")
    return voxels.join(near, ["i", "j", "k"], "left_anti")


def halton_centres(spark: SparkSession, n: int, width: float, height: float, start: int = 1) -> DataFrame:
    """(n, x, y): Halton points in bases 2 and 3 over a centred box."""
    ids = spark.range(start, start + n).withColumnRenamed("id", "n")
    return ids.selectExpr("n", f"({g.radical_inverse('n', 2)} - 0.5e0) * {width!r} as x", f"({g.radical_inverse('n', 3)} - 0.5e0) * {height!r} as y")


def two_nearest(points: DataFrame, seeds: DataFrame, point: str = "p", seed: str = "s") -> DataFrame:
    """(p, s1, d1, s2, d2): the two nearest seeds of each point, ties to the smaller; the walls of a Voronoi maze are where d2 - d1 is small."""
    d = points.crossJoin(seeds.selectExpr(seed, "x as sx", "y as sy")).selectExpr(point, seed, f"{g.distance('x', 'y', 'sx', 'sy')} as d")
    ranked = d.withColumn("turn", F.row_number().over(Window.partitionBy(point).orderBy("d", seed))).where("turn <= 2")
    return ranked.groupBy(point).agg(*(F.expr(f"max(case when turn = {k} then {c} end)").alias(f"{n}{k}") for k in (1, 2) for c, n in ((seed, "s"), ("d", "d"))))


def shell(spark: SparkSession, box: tuple[int, int, int]) -> DataFrame:
    """The surface voxels of a box of so many voxels."""
    grid = spark.range(box[0]).selectExpr("cast(id as int) as i").crossJoin(spark.range(box[1]).selectExpr("cast(id as int) as j")).crossJoin(spark.range(box[2]).selectExpr("cast(id as int) as k"))
    return grid.where(f"i * j * k * ({box[0] - 1} - i) * ({box[1] - 1} - j) * ({box[2] - 1} - k) = 0")


#: Values that are sorted to find an order statistic; more are narrowed down by quantiles first.
SORTED = 100_000


def order_statistic(values: DataFrame, value: str, rank: int) -> float:
    """The value of ``rank`` (from 0) in ascending order: bracketed by quantile sketches and exact counts, then sorted within the bracket."""
    inside, below = values.select(F.col(value).cast("double").alias("v")).where("v is not null"), 0
    n = inside.count()
    while n > SORTED:
        at = (rank - below) / n
        low, high = inside.approxQuantile("v", [max(0.0, at - 0.01), min(1.0, at + 0.01)], 0.004)
        under, upto = inside.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v") <= high)).first()
        if not under <= rank - below < upto or upto - under == n:
            break
        if low == high:
            return low
        inside, below, n = inside.where(F.col("v").between(low, high)), below + under, upto - under
    return inside.orderBy("v").offset(rank - below).limit(1).first()[0]


def threshold_at_fill(values: DataFrame, value: str, fill: float) -> DataFrame:
    """The rows above the (1 - fill) order statistic of ``value``."""
    n = values.where(F.col(value).isNotNull()).count()
    if not n:
        return values.limit(0)
    return values.where(F.col(value) > F.lit(order_statistic(values, value, min(max(int((1 - fill) * n), 0), n - 1))))
