"""Relations over the bundled tables that the registered queries run on; each has its twin in SQL (``SQL``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, id, x0, y0: one 10 x 10 square for each nation on a grid of five columns."""
    return table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as int) as k", "n_name as id", "cast(n_nationkey % 5 as double) * 10 as x0", "floor(cast(n_nationkey as double) / 5) * 10.0e0 as y0")


def cell_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).selectExpr("id", "stack(4, 0, x0, y0, 1, x0 + 10, y0, 2, x0 + 10, y0 + 10, 3, x0, y0 + 10) as (ord, x, y)")


def cell_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, cost: grid neighbours both ways, a seventh of the walls shut."""
    a, b = (cells(spark, sf_dir).selectExpr(f"k as {n}k", f"id as {n}", f"x0 as {n}x", f"y0 as {n}y") for n in ("source", "target"))
    return a.join(b, (a.sourcek != b.targetk)).where("abs(sourcex - targetx) + abs(sourcey - targety) = 10 and (sourcek + targetk) % 7 <> 3").selectExpr("source", "target", "cast(10 + (sourcek + targetk) * 7 % 5 as double) as cost")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, x, y: each event as a point of the grid, steps of a tenth, some on borders."""
    return table(spark, sf_dir, "events").selectExpr("event_id as pid", "cast((user_id * 7 + event_id) % 501 as double) / 10 as x", "cast((event_id * 13) % 501 as double) / 10 as y")


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ord, x, y: a sheared quadrilateral for each supplier, every third clockwise, every fifth closed twice."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "cast(s_suppkey % 97 as double) as x", "cast(s_suppkey % 83 as double) as y", "cast(1 + s_suppkey % 7 as double) as w", "cast(2 + s_nationkey % 5 as double) as h", "s_suppkey % 3 as turned")
    return s.selectExpr("id", "turned", "stack(4, 0, x, y, 1, x + w, y + 0.5, 2, x + w + 0.5, y + h + 0.5, 3, x, y + h) as (o, x, y)").selectExpr("id", "cast(case when turned = 0 then 3 - o else o end as int) as ord", "x", "y")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y: the first two components of each embedding."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "cast(embedding[0] as double) as x", "cast(embedding[1] as double) as y")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map, planner, mode, seed, success and metrics, from orders."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('map', cast(o_custkey % 4 as string)) as map", "concat('planner', cast(o_orderkey % 6 as string)) as planner", "case when o_orderkey % 2 = 0 then 'none' else 'region_prior' end as mode",
        "cast(floor(cast(o_orderkey as double) / 2) as bigint) as seed", "o_custkey % 5 <> 0 as success", "cast(o_custkey % 1000 as double) as planning_time_ms",
        "case when o_custkey % 5 <> 0 then cast(o_totalprice as double) / 1000 end as path_length", "cast(o_orderkey % 5000 as double) as iterations",
    )


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """draw and four stored uniforms in (0, 1), from customers."""
    u = ", ".join(f"(cast((c_custkey * {m}) % 9973 as double) + 0.5) / 9973 as u{k}" for k, m in enumerate((7919, 104729, 1299709, 15485863), 1))
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as draw", *u.split(", "))


#: The same relations in the oracle's SQL.
SQL = {
    "cells": "select cast(n_nationkey as int) as k, n_name as id, cast(n_nationkey % 5 as double) * 10 as x0, floor(cast(n_nationkey as double) / 5) * 10.0e0 as y0 from nation",
    "cell_edges": "select a.id as source, b.id as target, cast(10 + (a.k + b.k) * 7 % 5 as double) as cost from cells a join cells b on a.k <> b.k where abs(a.x0 - b.x0) + abs(a.y0 - b.y0) = 10 and (a.k + b.k) % 7 <> 3",
    "points": "select event_id as pid, cast((user_id * 7 + event_id) % 501 as double) / 10 as x, cast((event_id * 13) % 501 as double) / 10 as y from events",
    "quads0": "select s_suppkey as id, cast(s_suppkey % 97 as double) as x, cast(s_suppkey % 83 as double) as y, cast(1 + s_suppkey % 7 as double) as w, cast(2 + s_nationkey % 5 as double) as h, case when s_suppkey % 3 = 0 then -1 else 1 end as winding from supplier",
    "vectors": "select vec_id as id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings",
    "runs": "select 'map' || (o_custkey % 4) as map, 'planner' || (o_orderkey % 6) as planner, case when o_orderkey % 2 = 0 then 'none' else 'region_prior' end as mode, cast(floor(cast(o_orderkey as double) / 2) as bigint) as seed, o_custkey % 5 <> 0 as success, cast(o_custkey % 1000 as double) as planning_time_ms, case when o_custkey % 5 <> 0 then cast(o_totalprice as double) / 1000 end as path_length, cast(o_orderkey % 5000 as double) as iterations from orders",
    "draws": "select c_custkey as draw, " + ", ".join(f"(cast((c_custkey * {m}) % 9973 as double) + 0.5) / 9973 as u{k}" for k, m in enumerate((7919, 104729, 1299709, 15485863), 1)) + " from customer",
}


def sql(text: str, *names: str, recursive: bool = False) -> str:
    """``text`` with the named relations, and those that they need, as common tables in front."""
    needed = [n for n in SQL if n in names or (n == "cells" and "cell_edges" in names)]
    head = ", ".join(f"{n} as ({SQL[n]})" for n in needed)
    return f"with {'recursive ' if recursive else ''}{head}{', ' if head and text.startswith(',') else ' '}{text.removeprefix(',')}"
