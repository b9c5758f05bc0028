"""Structural labels with unknown values: null is neither false nor 0, and crisp conditions may force 0 first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions import geometry as g


@dataclass(frozen=True)
class Rules:
    """Thresholds and softnesses of the labels; the production values."""

    active_at: float = 0.5
    very_at: float = 0.9
    open: tuple[float, float] = (5.0, 1.0)
    corridor: tuple[float, float] = (3.0, 0.5)
    corridor_degree: int = 2
    junction: tuple[float, float] = (0.3, 0.1)
    junction_degree: int = 3
    dead_end_degree: int = 1
    narrow: tuple[float, float] = (2.0, 0.3)
    critical: tuple[float, float] = (0.8, 0.05)

    def problems(self) -> list[str]:
        out = [] if 0 <= self.active_at <= self.very_at <= 1 else ["0 <= active_at <= very_at <= 1"]
        out += [f"{n}: a positive softness" for n in ("open", "corridor", "junction", "narrow", "critical") if not getattr(self, n)[1] > 0]
        return out + [f"{n}: an integer degree" for n in ("corridor_degree", "junction_degree", "dead_end_degree") if type(getattr(self, n)) is not int]


def region_labels(regions: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Memberships and levels of open, corridor, junction, dead_end, pocket and alternative_route.

    Reads id, degree, inradius, robot_radius, ellipse_ratio, fraction,
    is_endpoint, in_pocket and on_alternative. Openness is the inscribed radius
    in robot radii, unknown without positive ones; an unknown input leaves its membership null and the
    level 'unavailable', unless the degree alone decides.
    """
    if found := rules.problems():
        raise ValueError("; ".join(found))
    value = {
        "open": _by_width("inradius", rules.open),
        "corridor": f"case when degree <> {rules.corridor_degree} then 0.0e0 else {g.sigmoid('ellipse_ratio', str(rules.corridor[0]), str(rules.corridor[1]))} end",
        "junction": f"case when degree < {rules.junction_degree} then 0.0e0 else {g.sigmoid('fraction', str(rules.junction[0]), str(rules.junction[1]))} end",
        "dead_end": f"case when degree <> {rules.dead_end_degree} or is_endpoint then 0.0e0 else 1.0e0 end",
        "pocket": "case when in_pocket is null then null when in_pocket then 1.0e0 else 0.0e0 end",
        "alternative_route": "case when on_alternative is null then null when on_alternative then 1.0e0 else 0.0e0 end",
    }
    out = regions.selectExpr("*", *(f"{v} as {n}" for n, v in value.items()))
    return out.selectExpr("*", *(f"{g.membership(n, rules.active_at, rules.very_at)} as {n}_level" for n in value))


def _by_width(radius: str, rule: tuple[float, float], decreasing: bool = False) -> str:
    """The step of a radius in robot radii; null unless both are positive and finite."""
    known = " and ".join(f"{x} > 0 and {x} < double('infinity')" for x in (radius, "robot_radius"))
    return f"case when {known} then {g.sigmoid(f'{radius} / robot_radius', str(rule[0]), str(rule[1]), decreasing)} end"


def connection_labels(connections: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Memberships and levels of narrow, critical and alternative_route; reads portal_inradius, robot_radius, fraction and on_alternative.

    Width is the portal's inscribed radius in robot radii, never its length; unknown without positive ones.
    """
    value = {
        "narrow": _by_width("portal_inradius", rules.narrow, True),
        "critical": g.sigmoid("fraction", str(rules.critical[0]), str(rules.critical[1])),
        "alternative_route": "case when on_alternative is null then null when on_alternative then 1.0e0 else 0.0e0 end",
    }
    out = connections.selectExpr("*", *(f"{v} as {n}" for n, v in value.items()))
    return out.selectExpr("*", *(f"{g.membership(n, rules.active_at, rules.very_at)} as {n}_level" for n in value))


def fractions(members: DataFrame, sequences: DataFrame, member: str = "id") -> DataFrame:
    """(member, hits, returned, fraction, in_all): how many of the returned paths hold each member; null when there are none."""
    n = sequences.selectExpr("count(*) as returned")
    steps = sequences.selectExpr("rank", f"explode(array_distinct(path)) as {member}").groupBy(member).count()
    return members.join(steps, member, "left").crossJoin(n).selectExpr(member, "coalesce(count, 0) as hits", "returned", "coalesce(count, 0) / nullif(returned, 0) as fraction", "case when returned > 0 then coalesce(count, 0) = returned end as in_all")


def query_status(starts: int, goals: int, paths: int) -> str:
    """'missing_endpoint_regions', 'disconnected' or 'connected'."""
    return "missing_endpoint_regions" if not starts or not goals else "connected" if paths else "disconnected"
