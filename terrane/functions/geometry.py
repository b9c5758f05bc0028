"""Plane geometry as Catalyst expressions.

Every function takes SQL expressions (strings) for coordinates and returns the
SQL of the result, so formulas nest, stay inside whole-stage code generation
and can be given to ``F.expr`` or to a SQL text. One tolerance, ``TOL``, is
compared with unnormalised cross products. Nulls propagate unless said.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOL = 1e-9


def col(sql: str) -> Column:
    return F.expr(sql)


def cross(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    """Twice the signed area of the triangle a b c."""
    return f"((({bx}) - ({ax})) * (({cy}) - ({ay})) - (({by}) - ({ay})) * (({cx}) - ({ax})))"


def distance(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt((({bx}) - ({ax})) * (({bx}) - ({ax})) + (({by}) - ({ay})) * (({by}) - ({ay})))"


def distance3(ax: str, ay: str, az: str, bx: str, by: str, bz: str) -> str:
    return f"sqrt((({bx}) - ({ax})) * (({bx}) - ({ax})) + (({by}) - ({ay})) * (({by}) - ({ay})) + (({bz}) - ({az})) * (({bz}) - ({az})))"


def point_segment_distance(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Distance to the nearest point of a segment; to its point if it has no length."""
    length2 = f"((({bx}) - ({ax})) * (({bx}) - ({ax})) + (({by}) - ({ay})) * (({by}) - ({ay})))"
    along = f"((({px}) - ({ax})) * (({bx}) - ({ax})) + (({py}) - ({ay})) * (({by}) - ({ay})))"
    t = f"(case when {length2} = 0 then 0.0e0 when {along} <= 0 then 0.0e0 when {along} >= {length2} then 1.0e0 else {along} / {length2} end)"
    return distance(px, py, f"({ax}) + {t} * (({bx}) - ({ax}))", f"({ay}) + {t} * (({by}) - ({ay}))")


def point_on_segment(px: str, py: str, ax: str, ay: str, bx: str, by: str, tol: float = TOL) -> str:
    """Collinear within the tolerance and inside the bounding box widened by it."""
    return (
        f"(abs({cross(ax, ay, bx, by, px, py)}) <= {tol}"
        f" and ({px}) >= least({ax}, {bx}) - {tol} and ({px}) <= greatest({ax}, {bx}) + {tol}"
        f" and ({py}) >= least({ay}, {by}) - {tol} and ({py}) <= greatest({ay}, {by}) + {tol})"
    )


def segments_intersect(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str], d: tuple[str, str], tol: float = TOL) -> str:
    """Proper crossing, or an end of one on the other."""
    s1, s2 = cross(*a, *b, *c), cross(*a, *b, *d)
    s3, s4 = cross(*c, *d, *a), cross(*c, *d, *b)
    straddle = f"(({s1} > {tol} and {s2} < -{tol}) or ({s1} < -{tol} and {s2} > {tol})) and (({s3} > {tol} and {s4} < -{tol}) or ({s3} < -{tol} and {s4} > {tol}))"
    touch = " or ".join(point_on_segment(*p, *u, *v, tol=tol) for p, u, v in ((c, a, b), (d, a, b), (a, c, d), (b, c, d)))
    return f"(({straddle}) or {touch})"


def segment_distance(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str], d: tuple[str, str]) -> str:
    """0 if they meet, else the least of the four point-to-segment distances."""
    ends = ", ".join(point_segment_distance(*p, *u, *v) for p, u, v in ((a, c, d), (b, c, d), (c, a, b), (d, a, b)))
    return f"(case when {segments_intersect(a, b, c, d)} then 0.0e0 else least({ends}) end)"


def crosses_ray(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Whether an edge crosses the ray to the right of a point (even-odd rule)."""
    return f"((({ay}) > ({py})) <> (({by}) > ({py})) and ({px}) < (({bx}) - ({ax})) * (({py}) - ({ay})) / (case when ({by}) = ({ay}) then 1.0e0 else ({by}) - ({ay}) end) + ({ax}))"


def overlap_on_axis(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str], d: tuple[str, str], tol: float = TOL) -> tuple[str, str, str]:
    """(low, high, collinear): the overlap of two collinear segments as parameters 0..1 along a b."""
    (ax, ay), (bx, by) = a, b
    dx, dy = f"(({bx}) - ({ax}))", f"(({by}) - ({ay}))"
    wide = f"abs({dx}) >= abs({dy})"

    def along(p: tuple[str, str]) -> str:
        return f"(case when {wide} then (({p[0]}) - ({ax})) / nullif({dx}, 0) else (({p[1]}) - ({ay})) / nullif({dy}, 0) end)"

    low = f"greatest(0.0e0, least({along(c)}, {along(d)}))"
    high = f"least(1.0e0, greatest({along(c)}, {along(d)}))"
    collinear = f"(abs({cross(*a, *b, *c)}) <= {tol} and abs({cross(*a, *b, *d)}) <= {tol})"
    return low, high, collinear


def line_intersection(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str], d: tuple[str, str], tol: float = TOL) -> tuple[str, str]:
    """Where the line a b meets the line c d; b if they are parallel."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = a, b, c, d
    det = f"((({bx}) - ({ax})) * (({dy}) - ({cy})) - (({by}) - ({ay})) * (({dx}) - ({cx})))"
    t = f"(((({cx}) - ({ax})) * (({dy}) - ({cy})) - (({cy}) - ({ay})) * (({dx}) - ({cx}))) / nullif({det}, 0))"
    return tuple(f"(case when abs({det}) <= {tol} then ({e}) else ({s}) + {t} * (({e}) - ({s})) end)" for s, e in ((ax, bx), (ay, by)))  # type: ignore[return-value]


def steer(fx: str, tx: str, length: str, reach: str) -> str:
    """One coordinate of the point at most ``reach`` from f towards t; ``length`` is their distance."""
    return f"(case when ({length}) <= ({reach}) then ({tx}) else ({fx}) + (({tx}) - ({fx})) * ({reach}) / ({length}) end)"


def informed_set(best: str, sx: str, sy: str, gx: str, gy: str) -> dict[str, str]:
    """The ellipse of points on paths no longer than ``best``: centre, radii and heading."""
    focal = distance(sx, sy, gx, gy)
    return {
        "centre_x": f"(({sx}) + ({gx})) / 2",
        "centre_y": f"(({sy}) + ({gy})) / 2",
        "major": f"({best}) / 2",
        "minor": f"sqrt(greatest(({best}) * ({best}) - {focal} * {focal}, 0.0e0)) / 2",
        "heading": f"atan2(({gy}) - ({sy}), ({gx}) - ({sx}))",
    }


def inside_informed(px: str, py: str, best: str, sx: str, sy: str, gx: str, gy: str) -> str:
    """Whether a point lies in that ellipse: the sum of its distances to both foci is at most ``best``; a flat ellipse needs the point on its axis."""
    return f"({distance(px, py, sx, sy)} + {distance(px, py, gx, gy)} <= ({best}) * (1 + 1e-12))"


def voxel(x: str, origin: str, resolution: str) -> str:
    return f"cast(floor((({x}) - ({origin})) / ({resolution})) as int)"


def voxel_centre(index: str, origin: str, resolution: str) -> str:
    return f"((({index}) + 0.5e0) * ({resolution}) + ({origin}))"


def sigmoid(value: str, threshold: str, softness: str, decreasing: bool = False) -> str:
    """A logistic step that overflows on neither side."""
    z = f"((({threshold}) - ({value})) / ({softness}))" if decreasing else f"((({value}) - ({threshold})) / ({softness}))"
    return f"(case when {z} >= 0 then 1 / (1 + exp(-{z})) else exp({z}) / (1 + exp({z})) end)"


def membership(value: str, active_at: float = 0.5, very_at: float = 0.9) -> str:
    """'very', 'active', 'inactive'; 'unavailable' for null, which is neither false nor 0."""
    return f"(case when ({value}) is null then 'unavailable' when ({value}) >= {very_at} then 'very' when ({value}) >= {active_at} then 'active' else 'inactive' end)"


def radical_inverse(index: str, base: int, digits: int = 24) -> str:
    """Halton's radical inverse of a non-negative integer, digit by digit."""
    terms = [f"pmod(floor(({index}) / {base**k}.0e0), {base}) * cast({1 / base ** (k + 1)!r} as double)" for k in range(digits)]
    return "(" + " + ".join(terms) + ")"
