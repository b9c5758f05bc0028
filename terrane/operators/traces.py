"""Planner traces: replayed trees, capped rings, sliding rows, chains of queries, first clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PHASES = ("sample", "sample_reject", "nearest", "steer", "add_node", "rewire", "collision_clear", "collision_reject")
MOST_EVENTS = 10_000


def replayed(trace: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """keys, seq, child, parent, now: each link event with the child's parent before it; the last writer of a child wins."""
    before = Window.partitionBy(*keys, "child").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return trace.withColumn("before", F.last("parent").over(before)).select(*keys, "seq", "child", "parent", "before")


def tree_at_end(trace: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """keys, child, parent: the tree after all link events."""
    return trace.groupBy(*keys, "child").agg(F.max_by("parent", "seq").alias("parent"))


def capped(trace: DataFrame, most: int = MOST_EVENTS, keys: tuple[str, ...] = ("run",)) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` events of each run, and how many were left out; a feature of the trace's viewer."""
    ranked = trace.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("seq")))
    dropped = trace.groupBy(*keys).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("dropped"))
    return ranked.where(F.col("_n") <= most).drop("_n"), dropped


def sliding(rows: DataFrame, n: int, value: str, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """Adds ``held`` and ``mean`` of ``value`` over the last n rows."""
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(1 - n, 0)
    return rows.withColumns({"held": F.count("*").over(w), "mean": F.avg(value).over(w)})


def chained_starts(goals: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """Each query starts where the last one ended; the first where the run says (column ``start``)."""
    return goals.withColumn("start", F.coalesce(F.lag("goal").over(Window.partitionBy(*keys).orderBy("seq")), F.col("start")))


def without_repeats(points: DataFrame, tol: float, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Points of ordered (ord, x, y) rows that are farther than ``tol`` from the one before."""
    w = Window.partitionBy(*keys).orderBy("ord")
    before = points.withColumns({"_x": F.lag("x").over(w), "_y": F.lag("y").over(w)})
    return before.where(f"_x is null or (x - _x) * (x - _x) + (y - _y) * (y - _y) > {tol * tol}").drop("_x", "_y")


def nested_parameters(parameters: DataFrame) -> DataFrame:
    """(node, settings): 'node/name' parameters as a map for each node; of a repeated name the last by ``ord`` counts, a name without a node stands under ''."""
    split = parameters.selectExpr("ord", "case when instr(name, '/') > 0 then substring_index(name, '/', 1) else '' end as node", "substring_index(name, '/', -1) as leaf", "value")
    last = split.groupBy("node", "leaf").agg(F.max_by("value", "ord").alias("value"))
    return last.groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("leaf", "value")))).alias("settings"))


def first_accepted(candidates: DataFrame, accepted: str, most: int = 256) -> DataFrame:
    """(draw, x, y): each draw's first accepted candidate of (draw, attempt, x, y) among its first ``most``; null if none is."""
    tried = candidates.where(F.col("attempt") < most)
    return tried.groupBy("draw").agg(F.expr(f"min_by(struct(x, y), case when {accepted} then attempt end)").alias("_c")).selectExpr("draw", "_c.x as x", "_c.y as y")
