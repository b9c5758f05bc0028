"""Weighted sampling from stored uniforms, and density decay of region scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

#: Production values of the decay: strength, reference density, least score, nodes between updates.
STRENGTH, PROTECTED_STRENGTH, REFERENCE, LEAST, INTERVAL = 0.4, 0.1, 2.0, 0.05, 100


def decayed(base: str, nodes: str, area: str, strength: str = str(STRENGTH)) -> str:
    """The score after decay: base less strength times density over density plus the reference, LEAST at least."""
    density = f"(({nodes}) / ({area}))"
    return f"greatest({LEAST}e0, ({base}) - ({strength}) * {density} / ({density} + {REFERENCE}e0))"


def density_decay(regions: DataFrame, visits: DataFrame, *, interval: int = INTERVAL) -> DataFrame:
    """Scores after the last whole epoch: id, nodes, density, base, adjusted, probability.

    ``regions`` has (id, area, base[, protected]); ``visits`` (seq, id) lists the
    added nodes in order, a null id lying in no region but counting for the epoch.
    Scores change every ``interval`` nodes, so nodes after the last whole epoch
    do not count, and before the first the base stands.
    """
    total = visits.count()
    whole = total // interval * interval
    # The last nodes that fill no epoch are fewer than the interval: a top-k, not a sort of all.
    late = visits.orderBy(F.desc("seq")).limit(total - whole).agg(F.min("seq")).first()[0] if whole != total else None
    counted = visits if late is None else visits.where(F.col("seq") < F.lit(late))
    counts = counted.where("id is not null").groupBy("id").agg(F.count("*").alias("nodes"))
    protected = f"case when protected then {PROTECTED_STRENGTH} else {STRENGTH} end" if "protected" in regions.columns else str(STRENGTH)
    out = regions.join(counts, "id", "left").selectExpr("id", "coalesce(nodes, 0) as nodes", "coalesce(nodes, 0) / area as density", "base", f"{decayed('base', 'coalesce(nodes, 0)', 'area', protected) if whole else 'base'} as adjusted")
    return out.withColumn("probability", F.col("adjusted") / F.sum("adjusted").over(Window.partitionBy()))


def cumulative(weights: DataFrame, weight: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds lo and hi, the half-open share of [0, 1) of each row in ``order``."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(weight).over(Window.partitionBy(*keys))
    hi = F.sum(weight).over(before) / total
    return weights.withColumns({"hi": hi}).withColumn("lo", F.coalesce(F.lag("hi").over(Window.partitionBy(*keys).orderBy(order)), F.lit(0.0)))


#: Equal parts of [0, 1) on which draws and shares meet.
PARTS = 1024


def pick(draws: DataFrame, shares: DataFrame, u: str = "u1") -> DataFrame:
    """Each draw with the row whose share holds its uniform number: inverse-CDF lookup.

    Draws and shares meet on equal parts of [0, 1), so the join has a key; a
    share goes to each part that it touches, PARTS rows more than shares in all.
    """
    placed = draws.withColumn("_part", F.expr(f"cast(floor({u} * {PARTS}) as int)"))
    spread = shares.withColumn("_part", F.expr(f"explode(sequence(cast(floor(lo * {PARTS}) as int), cast(floor(least(hi, 1e0) * {PARTS}) as int)))"))
    return placed.join(spread, "_part").where((F.col(u) >= F.col("lo")) & (F.col(u) < F.col("hi"))).drop("_part")


def barycentric(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str], u: str = "u2", v: str = "u3") -> tuple[str, str]:
    """A uniform point of a triangle from two uniforms."""
    return tuple(f"((1 - sqrt({u})) * ({a[k]}) + sqrt({u}) * (1 - {v}) * ({b[k]}) + sqrt({u}) * {v} * ({c[k]}))" for k in (0, 1))  # type: ignore[return-value]


def corridor_samples(draws: DataFrame, triangles: DataFrame) -> DataFrame:
    """draw, id, x, y: a triangle by area, then a uniform point of it; triangles as from ``rings.fan``."""
    shares = cumulative(triangles.withColumn("_order", F.struct("id", "part")), "area", "_order")
    x, y = barycentric(("ax", "ay"), ("bx", "by"), ("cx", "cy"))
    return pick(draws, shares).selectExpr("draw", "id", f"{x} as x", f"{y} as y")


def prior_samples(draws: DataFrame, regions: DataFrame, triangles: DataFrame) -> DataFrame:
    """draw, id, x, y: a region by score (uniform u1), its triangle by area (u4), then a uniform point."""
    chosen = pick(draws, cumulative(regions.select("id", "score"), "score", "id").select("id", "lo", "hi")).drop("lo", "hi")
    parts = cumulative(triangles, "area", "part", ("id",))
    x, y = barycentric(("ax", "ay"), ("bx", "by"), ("cx", "cy"))
    return chosen.join(parts, "id").where("u4 >= lo and u4 < hi").selectExpr("draw", "id", f"{x} as x", f"{y} as y")


def portal_samples(draws: DataFrame, portals: DataFrame) -> DataFrame:
    """draw, portal, x, y: a portal of equal share (u1), then a uniform place on it (u2); portals are (portal, ax, ay, bx, by)."""
    shares = cumulative(portals.withColumn("_one", F.lit(1.0)), "_one", "portal")
    return pick(draws, shares).selectExpr("draw", "portal", "ax + u2 * (bx - ax) as x", "ay + u2 * (by - ay) as y")


def informed_samples(draws: DataFrame, best: float, start: tuple[float, float], goal: tuple[float, float]) -> DataFrame:
    """draw, x, y: the plane's part of a uniform draw from the ball (radius by u1, height by u2, heading by u3), stretched to the ellipse of paths no longer than ``best``."""
    e = g.informed_set(f"{best!r}", *(f"{v!r}" for v in (*start, *goal)))
    ball = draws.selectExpr("draw", "pow(u1, 0.33333e0) as r", "2 * u2 - 1 as h", "2 * pi() * u3 as t")
    out = ball.selectExpr("draw", f"{e['major']} * r * sqrt(1 - h * h) * cos(t) as ex", f"{e['minor']} * r * sqrt(1 - h * h) * sin(t) as ey")
    return out.selectExpr("draw", f"{e['centre_x']} + ex * cos({e['heading']}) - ey * sin({e['heading']}) as x", f"{e['centre_y']} + ex * sin({e['heading']}) + ey * cos({e['heading']}) as y")


def box_samples(draws: DataFrame, origin: tuple[float, float], size: tuple[float, float]) -> DataFrame:
    return draws.selectExpr("draw", f"{origin[0]!r} + u1 * {size[0]!r} as x", f"{origin[1]!r} + u2 * {size[1]!r} as y")
