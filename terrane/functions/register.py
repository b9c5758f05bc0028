"""The geometry expressions as SQL functions of a session: plain SQL bodies, inlined by the optimizer, no Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import geometry as g

_P = ("px", "py")
_A, _B, _C, _D = ("ax", "ay"), ("bx", "by"), ("cx", "cy"), ("dx", "dy")

#: name: (arguments, result type, body)
FUNCTIONS: dict[str, tuple[tuple[str, ...], str, str]] = {
    "plane_cross": ((*_A, *_B, *_C), "double", g.cross(*_A, *_B, *_C)),
    "plane_distance": ((*_A, *_B), "double", g.distance(*_A, *_B)),
    "point_segment_distance": ((*_P, *_A, *_B), "double", g.point_segment_distance(*_P, *_A, *_B)),
    "point_on_segment": ((*_P, *_A, *_B), "boolean", g.point_on_segment(*_P, *_A, *_B)),
    "segments_intersect": ((*_A, *_B, *_C, *_D), "boolean", g.segments_intersect(_A, _B, _C, _D)),
    "segment_distance": ((*_A, *_B, *_C, *_D), "double", g.segment_distance(_A, _B, _C, _D)),
    "crosses_ray": ((*_P, *_A, *_B), "boolean", g.crosses_ray(*_P, *_A, *_B)),
    "soft_step": (("value", "threshold", "softness"), "double", g.sigmoid("value", "threshold", "softness")),
    "soft_step_down": (("value", "threshold", "softness"), "double", g.sigmoid("value", "threshold", "softness", True)),
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions for this session and gives their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({', '.join(f'{a} double' for a in arguments)}) returns {result} return {body}")
    spark.sql(f"create or replace temporary function membership_level(value double) returns string return {g.membership('value')}")
    return [*FUNCTIONS, "membership_level"]
