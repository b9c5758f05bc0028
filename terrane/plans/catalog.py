"""Registered queries: each applies library operators to the bundled tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import rings
from ..operators import assemble, decompose, graph, labels, maps, planners, prepare, runs, sampling, scoring, spatial, traces, voxels
from ..streaming import decay
from . import relations as rel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


_NEIGHBOURS = "cells a join cells b on a.id < b.id and abs(a.x0 - b.x0) + abs(a.y0 - b.y0) = 10"


# Regions, portals, descriptors.


@query(rel.sql(f"select a.id as source, b.id as target, 10.0e0 as portal_width, 7.0e0 as safe_portal_width, case when a.x0 = b.x0 then a.x0 + 5 else greatest(a.x0, b.x0) end as mx, case when a.y0 = b.y0 then a.y0 + 5 else greatest(a.y0, b.y0) end as my from {_NEIGHBOURS}", "cells"))
def spatial_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spatial.shared_portals(rel.cell_vertices(spark, sf_dir), clearance_=1.5)
    return _rounded(p.selectExpr("source", "target", "portal_width", "safe_portal_width", "(safe_px + safe_qx) / 2 as mx", "(safe_py + safe_qy) / 2 as my"), "portal_width", "safe_portal_width", "mx", "my")


@query(rel.sql("select c.id, 100.0e0 as area, 40.0e0 as perimeter, c.x0 + 5 as centroid_x, c.y0 + 5 as centroid_y, count(o.id) as degree, count(o.id) as safe_degree, round(count(o.id) * 10 / 40.0e0, 6) as conductance, round(count(o.id) * 7 / 40.0e0, 6) as safe_conductance from cells c left join cells o on abs(c.x0 - o.x0) + abs(c.y0 - o.y0) = 10 group by c.id, c.x0, c.y0", "cells"))
def region_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rel.cell_vertices(spark, sf_dir)
    d = spatial.region_descriptors(v, spatial.shared_portals(v, clearance_=1.5))
    return _rounded(d, "area", "perimeter", "centroid_x", "centroid_y", "conductance", "safe_conductance")


@query(rel.sql(f"select a.id as source, b.id as target, 10.0e0 as cost from {_NEIGHBOURS}", "cells"))
def portal_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rel.cell_vertices(spark, sf_dir)
    p = spatial.shared_portals(v, clearance_=1.5)
    return _rounded(spatial.portal_costs(p, spatial.region_descriptors(v, p)), "cost")


_SHOELACE = "abs(w * h)"


@query(
    rel.sql(
        "select id, round(winding * area, 6) as signed_area, round(area, 6) as area, round(2 * sqrt(w * w + 0.25) + h + sqrt(0.25 + (h) * (h)), 6) as perimeter from (select *, ((x * (y + 0.5) - (x + w) * y) + ((x + w) * (y + h + 0.5) - (x + w + 0.5) * (y + 0.5)) + ((x + w + 0.5) * (y + h) - x * (y + h + 0.5)) + (x * y - x * (y + h))) / 2 as area, 0 as z from quads0) q",
        "quads0",
    ).replace("2 * sqrt(w * w + 0.25) + h + sqrt(0.25 + (h) * (h))", "sqrt(w * w + 0.25) + sqrt(0.25 + h * h) + sqrt((w + 0.5) * (w + 0.5) + 0.25) + h")
)
def ring_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rings.measures(rel.quads(spark, sf_dir)).select("id", "signed_area", "area", "perimeter"), "signed_area", "area", "perimeter")


@query(rel.sql("select id, winding = 1 as left_only, true as convex, cast(0 as bigint) as straight from quads0", "quads0"))
def ring_convexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings.convexity(rel.quads(spark, sf_dir)).selectExpr("id", "right_turns = 0 as left_only", "convex", "straight")


@query(rel.sql("select id, true as ccw, cast(4 as bigint) as n from quads0", "quads0"))
def ring_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rel.quads(spark, sf_dir)
    closed = v.union(v.where("ord = 0 and id % 5 = 0").withColumn("ord", F.lit(4)))
    return rings.measures(rings.normalized(closed)).selectExpr("id", "signed_area > 0 as ccw", "n")


@query(
    rel.sql(
        "select id, round(greatest(sqrt((w + 0.5) * (w + 0.5) + (h + 0.5) * (h + 0.5)), sqrt(w * w + (h - 0.5) * (h - 0.5)), sqrt(w * w + 0.25), sqrt(0.25 + h * h), sqrt((w + 0.5) * (w + 0.5) + 0.25), h), 6) as diameter from quads0",
        "quads0",
    )
)
def ring_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rings.moments(rel.quads(spark, sf_dir)).select("id", "diameter"), "diameter")


@query(rel.sql("select id, round(100.0e0, 6) as area, round(4 / pi(), 6) as compactness, 1.0e0 as eigen_ratio, round(100 / 12.0e0, 6) as eigen_major from cells", "cells"))
def ring_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rings.moments(rel.cell_vertices(spark, sf_dir)).select("id", "area", "compactness", "eigen_ratio", "eigen_major"), "area", "compactness", "eigen_ratio", "eigen_major")


@query(rel.sql("select id, cast(288 as bigint) as samples, 100.0e0 as area, round(x0 + 5, 6) as mean_x, round(y0 + 5, 6) as mean_y from cells", "cells"))
def triangle_quadrature(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rings.triangle_samples(rings.fan(rel.cell_vertices(spark, sf_dir)), 12)
    out = s.groupBy("id").agg(F.count("*").alias("samples"), F.sum("area").alias("area"), F.expr("sum(sx * area) / sum(area)").alias("mean_x"), F.expr("sum(sy * area) / sum(area)").alias("mean_y"))
    return _rounded(out, "area", "mean_x", "mean_y")


# Spatial joins.


@query(rel.sql("select p.pid, c.id from points p join cells c on p.x >= c.x0 and p.x <= c.x0 + 10 and p.y >= c.y0 and p.y <= c.y0 + 10", "cells", "points"))
def points_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.points_in_regions(rel.points(spark, sf_dir), rel.cell_vertices(spark, sf_dir))


@query(rel.sql("select p.pid, min(c.id) as id from points p join cells c on p.x >= c.x0 and p.x <= c.x0 + 10 and p.y >= c.y0 and p.y <= c.y0 + 10 group by p.pid", "cells", "points"))
def first_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.first_region(rel.points(spark, sf_dir), rel.cell_vertices(spark, sf_dir))


@query(rel.sql("select pid, round(least(x, y, 50 - x, 50 - y), 6) as clearance from points where x <= 50 and y <= 50", "points"))
def wall_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    walls = spark.createDataFrame([(0.0, 0.0, 50.0, 0.0), (50.0, 0.0, 50.0, 50.0), (50.0, 50.0, 0.0, 50.0), (0.0, 50.0, 0.0, 0.0)], "ax double, ay double, bx double, by double")
    return _rounded(spatial.clearance(rel.points(spark, sf_dir), walls), "clearance")


@query(rel.sql("select a.id as a, b.id as b, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 9) as d2 from vectors a join vectors b on (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.05e0 * 0.05e0", "vectors"))
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rel.vectors(spark, sf_dir)
    return _rounded(spatial.within_radius(v.withColumnRenamed("id", "a"), v.withColumnRenamed("id", "b"), 0.05), "d2", digits=9)


@query(rel.sql("select q, cast(rank as int) as rank, p, round(d2, 9) as d2 from (select q.id as q, p.id as p, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) as d2, row_number() over (partition by q.id order by (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y), p.id) as rank from vectors q, vectors p) n where rank <= 3", "vectors"))
def nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rel.vectors(spark, sf_dir)
    return _rounded(spatial.k_nearest(v.withColumnRenamed("id", "q"), v.withColumnRenamed("id", "p"), 3, cell=0.05), "d2", digits=9)


@query(rel.sql("select pid, round(case when d <= 6 then x else 25 + (x - 25) * 6 / d end, 6) as x, round(case when d <= 6 then y else 25 + (y - 25) * 6 / d end, 6) as y, (sqrt((x - 10) * (x - 10) + (y - 10) * (y - 10)) + sqrt((x - 40) * (x - 40) + (y - 40) * (y - 40))) <= 60 as informed from (select *, sqrt((x - 25) * (x - 25) + (y - 25) * (y - 25)) as d from points) p", "points"))
def steering(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = g.distance("25.0e0", "25.0e0", "x", "y")
    out = rel.points(spark, sf_dir).selectExpr("pid", f"{g.steer('25.0e0', 'x', d, '6.0e0')} as sx", f"{g.steer('25.0e0', 'y', d, '6.0e0')} as sy", f"{g.inside_informed('x', 'y', '60.0e0', '10', '10', '40', '40')} as informed")
    return _rounded(out.withColumnsRenamed({"sx": "x", "sy": "y"}), "x", "y")


@query(rel.sql("select pid, round(case when x + y <= 0 then sqrt(x * x + y * y) when x + y >= 60 then sqrt((x - 30) * (x - 30) + (y - 30) * (y - 30)) else abs(x - y) / sqrt(2.0e0) end, 6) as d, x = y and x <= 30 as touches, (x - y) * (50 - 0) > 0 as below from points", "points"))
def segment_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rel.points(spark, sf_dir).selectExpr("pid", f"{g.point_segment_distance('x', 'y', '0.0e0', '0.0e0', '30.0e0', '30.0e0')} as d", f"{g.point_on_segment('x', 'y', '0.0e0', '0.0e0', '30.0e0', '30.0e0')} as touches", f"{g.cross('0.0e0', '0.0e0', '50.0e0', '50.0e0', 'x', 'y')} < 0 as below")
    return _rounded(out, "d")


@query(rel.sql("select pid, (x <= 20 and y >= 0) and (x >= 0) and y <= 40 as meets from points", "points").replace("(x <= 20 and y >= 0) and (x >= 0) and y <= 40", "(y - 20) * (x - 20) * 0 = 0 and ((y <= 20) or x = 0 and y <= 50 and y = 20) and x >= 0"))
def segment_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the vertical segment from (x, 50) down to the point meets the horizontal one through y = 20."""
    meets = g.segments_intersect(("x", "y"), ("x", "50.0e0"), ("0.0e0", "20.0e0"), ("60.0e0", "20.0e0"))
    return rel.points(spark, sf_dir).selectExpr("pid", f"{meets} as meets")


# Graphs.

_CLOSURE = ", walk(start, id) as (select id, id from cells union select w.start, e.target from walk w join cell_edges e on e.source = w.id) "


@query(rel.sql(_CLOSURE + "select id, min(start) as component from walk group by id", "cells", "cell_edges", recursive=True))
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(rel.cells(spark, sf_dir), rel.cell_edges(spark, sf_dir))


@query(rel.sql(_CLOSURE + "select id from walk where start = 'NATION_0'", "cells", "cell_edges", recursive=True))
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(rel.cell_edges(spark, sf_dir), rel.cells(spark, sf_dir).where("k = 0")).select("id")


_PATHS = ", walk(here, path, cost) as (select id, [id], 0.0e0 from cells where k = 0 union all select e.target, list_append(w.path, e.target), w.cost + e.cost from walk w join cell_edges e on e.source = w.here where w.here <> 'NATION_24' and not list_contains(w.path, e.target)) "


@query(rel.sql(", best(id, cost) as (select id, 0.0e0 from cells where k = 0 union select e.target, b.cost + e.cost from best b join cell_edges e on e.source = b.id where b.cost + e.cost < 200) select id, min(cost) as cost from best group by id", "cells", "cell_edges", recursive=True))
def best_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.best_costs(rel.cell_edges(spark, sf_dir), rel.cells(spark, sf_dir).where("k = 0"))


@query(rel.sql(_PATHS + "select 'grid' as graph, cast(row_number() over (order by cost, path) as int) as rank, cost, path from walk where here = 'NATION_24' order by cost, path limit 5", "cells", "cell_edges", recursive=True))
def k_loopless_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.cell_edges(spark, sf_dir).withColumn("graph", F.lit("grid"))
    return graph.k_paths(e, spark.createDataFrame([("grid", "NATION_0", "NATION_24")], "graph string, start string, goal string"), 5)


@query(rel.sql(_PATHS + "select path, cost from walk where here = 'NATION_24' and len(path) <= 11", "cells", "cell_edges", recursive=True))
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = graph.simple_paths_sql("{e}", "'NATION_0'", "'NATION_24'", 11)
    return spark.sql(text, e=rel.cell_edges(spark, sf_dir))


@query(rel.sql(_PATHS + "select 'grid' as graph, a, b from (select distinct least(path[i], path[i + 1]) as a, greatest(path[i], path[i + 1]) as b from (select path, unnest(range(1, len(path))) as i from walk where here = 'NATION_24')) s", "cells", "cell_edges", recursive=True))
def simple_route_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.cell_edges(spark, sf_dir).withColumn("graph", F.lit("grid"))
    ends = spark.createDataFrame([("grid", "NATION_0", "start"), ("grid", "NATION_24", "goal")], "graph string, id string, role string")
    return graph.route_structure(e, ends).where("on_route").select("graph", "a", "b")


@query()
def route_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.cell_edges(spark, sf_dir).withColumn("graph", F.lit("grid"))
    ends = spark.createDataFrame([("grid", "NATION_0", "start"), ("grid", "NATION_24", "goal")], "graph string, id string, role string")
    return graph.route_structure(e, ends)


@query(rel.sql("select distinct least(source, target) as a, greatest(source, target) as b from cell_edges", "cell_edges"))
def undirected_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.undirected(rel.cell_edges(spark, sf_dir))


@query(rel.sql("select source, target from cell_edges where source < target", "cell_edges"))
def one_way_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.one_way(rel.cell_edges(spark, sf_dir).where("source < target")).select("source", "target")


@query(rel.sql("select source, target, 'unknown target' as problem from cell_edges where target in ('NATION_3', 'NATION_4') and source <> target", "cell_edges"))
def edge_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = rel.cell_edges(spark, sf_dir)
    return graph.integrity(rel.cells(spark, sf_dir).where("k not in (3, 4)"), e.where("source not in ('NATION_3', 'NATION_4')")).union(graph.integrity(rel.cells(spark, sf_dir).where("k not in (3, 4)"), e.where("source in ('NATION_3', 'NATION_4') and target in ('NATION_3', 'NATION_4')")).where("problem = 'unknown target'"))


@query("with recursive n as (select n_nationkey as id, case when n_nationkey = 0 then null else (n_nationkey - 1) // 2 end as parent, cast(1 + n_nationkey % 3 as double) as step from nation), d(id, cost, depth, path) as (select id, 0.0e0, 0, [id] from n where parent is null union all select n.id, d.cost + n.step, d.depth + 1, list_append(d.path, n.id) from d join n on n.parent = d.id) select id, cost, depth, path from d")
def tree_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = rel.table(spark, sf_dir, "nation").selectExpr("n_nationkey as id", "case when n_nationkey = 0 then null else cast(floor((n_nationkey - 1) / 2) as int) end as parent", "cast(1 + n_nationkey % 3 as double) as step")
    return graph.tree_costs(spark, n)


# Labels.

_FEATURES = "select s_suppkey as id, s_suppkey % 5 as degree, case when s_suppkey % 7 = 0 then null else cast(s_suppkey % 11 as double) end as inradius, case when s_suppkey % 9 = 0 then 0.0e0 when s_suppkey % 10 = 0 then null else 0.5e0 + s_suppkey % 3 end as robot_radius, case when s_suppkey % 6 = 0 then null else cast(s_suppkey % 9 as double) / 2 end as ellipse_ratio, case when s_suppkey % 8 = 0 then null else cast(s_suppkey % 4 as double) / 3 end as fraction, s_suppkey % 10 = 0 as is_endpoint, s_suppkey % 3 = 0 as in_pocket, case when s_suppkey % 4 = 0 then null else s_suppkey % 2 = 0 end as on_alternative"


def _level(v: str) -> str:
    return f"case when {v} is null then 'unavailable' when {v} >= 0.9 then 'very' when {v} >= 0.5 then 'active' else 'inactive' end"


@query(
    f"select *, {', '.join(_level(n) + f' as {n}_level' for n in ('open', 'corridor', 'junction', 'dead_end', 'pocket', 'alternative_route'))} from (select id, round(case when inradius > 0 and robot_radius > 0 then 1 / (1 + exp(-(inradius / robot_radius - 5) / 1.0)) end, 6) as open, round(case when degree <> 2 then 0.0 else 1 / (1 + exp(-(ellipse_ratio - 3) / 0.5)) end, 6) as corridor, round(case when degree < 3 then 0.0 else 1 / (1 + exp(-(fraction - 0.3) / 0.1)) end, 6) as junction, case when degree = 1 and not is_endpoint then 1.0e0 else 0.0e0 end as dead_end, case when in_pocket then 1.0e0 else 0.0e0 end as pocket, case when on_alternative is null then null when on_alternative then 1.0e0 else 0.0e0 end as alternative_route from ({_FEATURES} from supplier) f) l"
)
def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.sql(_FEATURES + " from {supplier}", supplier=rel.table(spark, sf_dir, "supplier"))
    out = labels.region_labels(f).drop("degree", "inradius", "robot_radius", "ellipse_ratio", "fraction", "is_endpoint", "in_pocket", "on_alternative")
    return _rounded(out, "open", "corridor", "junction")


_CONNECTIONS = "select c_custkey as id, case when c_custkey % 7 = 0 then null else cast(c_custkey % 13 as double) / 10 end as portal_inradius, case when c_custkey % 9 = 0 then 0.0e0 else 0.25e0 end as robot_radius, case when c_custkey % 5 = 0 then null else cast(c_custkey % 4 as double) / 3 end as fraction, c_custkey % 2 = 0 as on_alternative"


@query(f"select *, {_level('narrow')} as narrow_level, {_level('critical')} as critical_level from (select id, round(case when robot_radius > 0 and portal_inradius > 0 then 1 / (1 + exp((portal_inradius / robot_radius - 2) / 0.3)) end, 6) as narrow, round(1 / (1 + exp(-(fraction - 0.8) / 0.05)), 6) as critical from ({_CONNECTIONS} from customer) c) l")
def connection_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.sql(_CONNECTIONS + " from {customer}", customer=rel.table(spark, sf_dir, "customer"))
    return _rounded(labels.connection_labels(f).select("id", "narrow", "critical", "narrow_level", "critical_level"), "narrow", "critical")


@query(rel.sql(_PATHS + ", best as (select path from walk where here = 'NATION_24' order by cost, path limit 5) select c.id, count(b.path) as hits, cast(5 as bigint) as returned, round(count(b.path) / 5.0e0, 6) as fraction, count(b.path) = 5 as in_all from cells c left join best b on list_contains(b.path, c.id) group by c.id", "cells", "cell_edges", recursive=True))
def sequence_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(labels.fractions(rel.cells(spark, sf_dir).select("id"), k_loopless_paths(spark, sf_dir)), "fraction")


# Sampling.


@query(
    rel.sql(
        ", hits as (select p.pid, min(c.id) as id from points p left join cells c on p.x >= c.x0 and p.x <= c.x0 + 10 and p.y >= c.y0 and p.y <= c.y0 + 10 group by p.pid), counted as (select id, count(*) as nodes from (select *, row_number() over (order by pid) as n, count(*) over () as total from hits) h where n <= total // 100 * 100 and id is not null group by id), scored as (select c.id, coalesce(n.nodes, 0) as nodes, coalesce(n.nodes, 0) / 100.0e0 as density, cast(0.2 + 0.03 * c.k as double) as base from cells c left join counted n using (id)), final as (select *, greatest(0.05e0, base - 0.4e0 * density / (density + 2.0e0)) as adjusted from scored) select id, nodes, round(density, 6) as density, round(base, 6) as base, round(adjusted, 6) as adjusted, round(adjusted / sum(adjusted) over (), 6) as probability from final",
        "cells", "points",
    )
)
def density_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rel.points(spark, sf_dir)
    visits = p.select(F.col("pid").alias("seq")).join(spatial.first_region(p, rel.cell_vertices(spark, sf_dir)).withColumnRenamed("pid", "seq"), "seq", "left")
    regions = rel.cells(spark, sf_dir).selectExpr("id", "100.0e0 as area", "cast(0.2 + 0.03 * k as double) as base")
    return _rounded(sampling.density_decay(regions, visits), "density", "base", "adjusted", "probability")


@query(rel.sql("select draw, round(5 + u1 * 40, 6) as x, round(2 + u2 * 30, 6) as y from draws", "draws"))
def box_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sampling.box_samples(rel.draws(spark, sf_dir), (5.0, 2.0), (40.0, 30.0)), "x", "y")


_SHARES = "(select k, id, x0, y0, coalesce(lag(hi) over (order by id), 0) as lo, hi from (select *, sum(cast(1 + k as double)) over (order by id) / sum(cast(1 + k as double)) over () as hi from cells) s) s"


@query(rel.sql(f"select d.draw, s.id, s.x0 <= 40 as inside from draws d join {_SHARES} on d.u1 >= s.lo and d.u1 < s.hi", "cells", "draws"))
def prior_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample's region, and whether the point drawn lies in it."""
    v = rel.cell_vertices(spark, sf_dir)
    out = sampling.prior_samples(rel.draws(spark, sf_dir), rel.cells(spark, sf_dir).selectExpr("id", "cast(1 + k as double) as score"), rings.fan(v))
    c = rel.cells(spark, sf_dir)
    return out.join(c, "id").selectExpr("draw", "id", "x between x0 and x0 + 10 and y between y0 and y0 + 10 as inside")


@query(rel.sql("select draw, id, x0 <= 40 as inside from (select d.draw, c.id, c.x0, row_number() over (partition by d.draw order by c.id) - 1 as turn, floor(d.u1 * 25 + 1e-9) as want from draws d, cells c) t where turn = want", "cells", "draws"))
def corridor_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of equal area, so each has an equal share; whether the point lies in the region."""
    out = sampling.corridor_samples(rel.draws(spark, sf_dir), rings.fan(rel.cell_vertices(spark, sf_dir)))
    return out.join(rel.cells(spark, sf_dir), "id").selectExpr("draw", "id", "x between x0 and x0 + 10 and y between y0 and y0 + 10 as inside")


@query(rel.sql("select draw, cast(floor(u1 * 4 + 1e-12) as int) as portal, round(floor(u1 * 4 + 1e-12) + u2 * 2, 6) as x, round(u2, 6) as y from draws", "draws"))
def portal_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    portals = spark.createDataFrame([(k, float(k), 0.0, float(k + 2), 1.0) for k in range(4)], "portal int, ax double, ay double, bx double, by double")
    return _rounded(sampling.portal_samples(rel.draws(spark, sf_dir), portals), "x", "y")


@query(rel.sql("select draw, round(25 + 30 * r * cos(t), 6) as x, round(25 + sqrt(60.0e0 * 60 - 40 * 40) / 2 * r * sin(t), 6) as y from (select draw, pow(u1, 0.33333e0) * sqrt(1 - (2 * u2 - 1) * (2 * u2 - 1)) as r, 2 * pi() * u3 as t from draws) d", "draws"))
def informed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sampling.informed_samples(rel.draws(spark, sf_dir), 60.0, (5.0, 25.0), (45.0, 25.0)), "x", "y")


# Runs.

_MEANS = "count(*) as runs, cast(count_if(success) as bigint) as successes, round(count_if(success) / count(*), 6) as success_rate, round(avg(path_length), 6) as path_length_mean, round(case count(path_length) when 1 then 0.0 else stddev_samp(path_length) end, 6) as path_length_stdev, round(avg(iterations), 6) as iterations_mean, round(case count(iterations) when 1 then 0.0 else stddev_samp(iterations) end, 6) as iterations_stdev"


@query(rel.sql(f"select planner, mode, {_MEANS} from runs group by planner, mode", "runs"))
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.summarize(rel.runs(spark, sf_dir), metrics=("path_length", "iterations"))
    return _rounded(out, "success_rate", "path_length_mean", "path_length_stdev", "iterations_mean", "iterations_stdev")


@query(rel.sql(f"select map, planner, mode, {_MEANS} from runs group by map, planner, mode", "runs"))
def run_summary_by_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.summarize(rel.runs(spark, sf_dir), ("map", "planner", "mode"), ("path_length", "iterations"))
    return _rounded(out, "success_rate", "path_length_mean", "path_length_stdev", "iterations_mean", "iterations_stdev")


@query(rel.sql("select map, planner, count(*) as runs, round(count_if(success) / count(*), 6) as success_rate, round(avg(iterations), 6) as iterations_mean from runs group by grouping sets ((map, planner), (map), ())", "runs"))
def run_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runs.summarize_sets(rel.runs(spark, sf_dir), [["map", "planner"], ["map"], []], ("map", "planner"), "iterations"), "success_rate", "iterations_mean")


_PAIR = "select a.seed, a.path_length as pa, b.path_length as pb, a.seed % 3 as planner from runs a join runs b on a.seed = b.seed where a.mode = 'none' and b.mode = 'region_prior' and a.success and b.success"


@query(rel.sql(f"select planner, count(*) as pairs, round(avg(100 * (pb - pa) / pa), 6) as path_length_change_percent from ({_PAIR}) p group by planner", "runs"))
def paired_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rel.runs(spark, sf_dir).drop("planner").withColumn("planner", F.col("seed") % 3)
    return _rounded(runs.paired(r, "none", "region_prior", ("planner", "seed")), "path_length_change_percent")


@query(rel.sql("select planner, mode, seed, path_length from (select *, min(path_length) over (partition by planner, mode order by seed rows between unbounded preceding and 1 preceding) as best from (select * from runs where path_length is not null) r) s where best is null or path_length < best", "runs"))
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rel.runs(spark, sf_dir).where("path_length is not null")
    return runs.running_best(r, ("planner", "mode"), "seed", "path_length").select("planner", "mode", "seed", "path_length")


@query(
    rel.sql(
        "select seed, case when sound then 'p' || seed end as planner, case when sound then mode end as guidance, case when sound then won end as success, case when sound then round(planning_time_ms, 6) end as planning_time_ms, case when sound and won then 1.5e0 end as time_to_first_solution_ms, case when sound and won then round(path_length, 6) end as path_length, case when sound then 2.0e0 end as straight_line_distance, case when sound and won then 3.0e0 end as path_length_ratio, case when sound then iterations end as iterations, case when sound then 7.0e0 end as nodes_added from (select seed, mode, success and seed % 13 <> 0 as won, seed % 11 not in (0, 1) as sound, planning_time_ms, round(coalesce(path_length, -1), 3) as path_length, iterations from runs) r",
        "runs",
    )
)
def parsed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines written by the library and read back; a noise line, colours and an earlier record stand around each, some lack a field or a finite number."""
    r = rel.runs(spark, sf_dir).selectExpr("seed", "concat('p', cast(seed as string)) as planner", "mode as guidance", "case when seed % 13 = 0 then 2 else cast(success as int) end as success", "planning_time_ms", "1.5e0 as time_to_first_solution_ms", "cast(round(coalesce(path_length, -1), 3) as decimal(18,3)) as path_length", "2.0e0 as straight_line_distance", "3.0e0 as path_length_ratio", "iterations", "case when seed % 11 = 0 then 'nan' else '7' end as nodes_added")
    line = F.regexp_replace(runs.result_line("planner", "guidance", "success", *runs.METRICS), " ", "  ")
    line = F.when(F.expr("seed % 11 = 1"), F.regexp_replace(line, "guidance=", "guided=")).otherwise(line)
    lines = r.select("seed", F.concat(F.lit("noise\n[RESULT] planner=old success=0\n\x1b[1;32m"), line, F.lit("\x1b[0m planner_note=x\ndone")).alias("text"))
    return _rounded(runs.parse_results(lines).drop("text"), "planning_time_ms", "path_length")


@query("select user_id as path, count(*) as points, round(coalesce(sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))), 0), 6) as path_length from (select *, lead(x) over w as nx, lead(y) over w as ny from (select user_id, event_id, cast((event_id * 13) % 501 as double) as x, value as y from events) e window w as (partition by user_id order by event_id)) s group by user_id")
def path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rel.table(spark, sf_dir, "events").selectExpr("user_id as path", "event_id as ord", "cast((event_id * 13) % 501 as double) as x", "value as y")
    return _rounded(runs.path_lengths(p).select("path", "points", "path_length"), "path_length")


_SETS = "select c_custkey as id, {array}(c_custkey % 3, c_custkey % 5, c_custkey % 7) as a, {array}(c_custkey % 5, c_custkey % 3, c_custkey % 4) as b from "


@query("select id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as jaccard from (" + _SETS.format(array="list_value") + "customer) s")
def region_set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.sql(_SETS.replace("{array}", "array") + "{customer}", customer=rel.table(spark, sf_dir, "customer"))
    return _rounded(s.select("id", runs.jaccard("a", "b").alias("jaccard")), "jaccard")


@query("select id, cast(greatest(cast(a[1] in (b[1], b[2], b[3]) as int), cast(a[2] in (b[1], b[2], b[3]) as int), cast(a[3] in (b[1], b[2], b[3]) as int), 2 * cast(a[1] = b[1] and (a[2] in (b[2], b[3]) or a[3] in (b[2], b[3])) or a[1] = b[2] and (a[2] = b[3] or a[3] = b[3]) or a[2] = b[1] and a[3] in (b[2], b[3]) or a[2] = b[2] and a[3] = b[3] as int), 3 * cast(a[1] = b[1] and a[2] = b[2] and a[3] = b[3] as int)) as int) as lcs from (" + _SETS.format(array="list_value") + "customer) s")
def region_sequence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.sql(_SETS.replace("{array}", "array") + "{customer}", customer=rel.table(spark, sf_dir, "customer"))
    return s.select("id", runs.common_subsequence("a", "b").alias("lcs"))


@query("select row_number() over (order by seed, map, planner, mode) as job, seed, map, planner, mode from (select unnest(range(42, 52)) as seed) s, (select 'm' || r_regionkey as map from region) m, (select unnest(['rrt', 'rrt*']) as planner) p, (select unnest(['none', 'region_prior']) as mode) o")
def job_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = rel.table(spark, sf_dir, "region").selectExpr("concat('m', cast(r_regionkey as string)) as map")
    one = [spark.createDataFrame([(x,) for x in v], f"{n} string") for n, v in (("planner", ("rrt", "rrt*")), ("mode", ("none", "region_prior")))]
    return runs.job_matrix(maps, *one, spark.range(42, 52).withColumnRenamed("id", "seed")).selectExpr("cast(job as bigint) as job", "seed", "map", "planner", "mode")


@query("""select conv_id, turn, '"' || replace(role, '"', '""') || '"' as quoted, case when turn % 2 = 0 then '—' else printf('%.2f', turn / 4.0e0) end as shown from conversations""")
def report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rel.table(spark, sf_dir, "conversations").withColumn("v", F.expr("case when turn % 2 = 0 then null else turn / 4.0e0 end"))
    return c.select("conv_id", "turn", runs.csv_field("role").alias("quoted"), runs.shown("v", 2).alias("shown"))


# Scoring.

_ANSWERS = "select doc_id, case doc_id % 4 when 0 then 'insufficient_data' when 3 then 'odd' else 'scored' end as status, case when doc_id % 3 = 0 then null else cast(doc_id % 13 as int) end as score, case when doc_id % 11 = 0 then '' else source end as reason"


@query(f"select doc_id, {scoring.answer_problems()} as problem from ({_ANSWERS} from documents) a")
def answer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ANSWERS + " from {documents}", documents=rel.table(spark, sf_dir, "documents")).selectExpr("doc_id", f"{scoring.answer_problems()} as problem")


_OPENINGS = ("", "not ", "There is no ", "A wide ", "Without any doubt, after a long and winding tale, ", "Unavailable here: ", "This is nothing but a ")
_WORDS = ("open", "corridor", "junction", "dead-end", "dead end", "pocket", "narrow", "critical", "alternative route", "alternative way", "mandatory", "unavoidable", "required on all", "every path", "must be crossed", "opening")
_ENDINGS = (" region.", ", not a corridor", " and open", ".", ", no, an unavoidable one")


def _picked(words: tuple[str, ...], by: str) -> str:
    return f"case {by} % {len(words)} " + " ".join(f"when {k} then '{w}'" for k, w in enumerate(words)) + " end"


_REASONS = f"select c_custkey as id, concat({_picked(_OPENINGS, 'c_custkey')}, {_picked(_WORDS, '(c_custkey % 97)')}, {_picked(_ENDINGS, '(c_custkey % 89)')}) as reason, c_custkey % 2 = 0 as connection, case when c_custkey % 3 = 0 then null else c_custkey % 7 = 0 end as mandatory, c_custkey % 5 = 0 as wide"


def _claimed(pattern: str, back: int, negation: str) -> str:
    """A match that begins at i with no negation in the characters before it."""
    plain_ = pattern.removeprefix("\\b")
    at = f"regexp_matches(substr(t, i), '^{plain_}') and not regexp_matches(substr(t, i - 1, case when i > 1 then 1 else 0 end), '[0-9a-z_]')"
    return f"len(list_filter(range(1, length(t) + 1), lambda i: {at} and not regexp_matches(substr(t, greatest(i - {back}, 1), least({back}, i - 1)), '{negation}'))) > 0"


_FLAGS = ", ".join(f"case when {_claimed(p, 45, scoring.NEGATION)} and not {'wide' if n == 'open' else 'true' if n == 'corridor' else 'false'} then '{n}' end" for n, p in scoring.CLAIMS.items())


@query(f"select id, list_filter([{_FLAGS}, case when connection and not coalesce(mandatory, false) and {_claimed(scoring.NECESSITY, 30, scoring.NECESSITY_NEGATION)} then 'necessity' end], lambda f: f is not null) as flags from (select *, lower(reason) as t from ({_REASONS} from customer) c) x")
def explanation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.sql(_REASONS + " from {customer}", customer=rel.table(spark, sf_dir, "customer")).selectExpr("*", "map('corridor', 'active', 'open', case when wide then 'very' else 'inactive' end) as levels")
    return scoring.review_flags(items).select("id", "flags")


@query(rel.sql("select 'region' as kind, id as item from cells union all select distinct 'connection', least(source, target) || '|' || greatest(source, target) from cell_edges", "cells", "cell_edges"))
def task_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = graph.undirected(rel.cell_edges(spark, sf_dir)).withColumn("shut", F.lit(False))
    return scoring.task_list(rel.cells(spark, sf_dir), c).select("kind", "item")


@query(rel.sql("select 'region' as kind, id as item from cells where k % 3 <> 0", "cells"))
def resumed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rel.cells(spark, sf_dir)
    tasks = c.selectExpr("'region' as kind", "id as item")
    done = c.where("k % 3 = 0 or k = 1").selectExpr("'region' as kind", "id as item", "case when k = 1 then 'old' else 'now' end as fingerprint")
    return scoring.remaining(tasks, done, "now")


@query(rel.sql("select kind, item, 'scored' as status, cast(length(item) % 11 as int) as score, cast(null as varchar) as problem from (select 'region' as kind, id as item from cells) t", "cells"))
def scored_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in scorer's replies, parsed and checked."""
    c = rel.cells(spark, sf_dir).selectExpr("'region' as kind", "id as item", "to_json(struct(id)) as context")
    replies = scoring.score(c, lambda kind, context: {"status": "scored", "score": (len(context) - len('{"id":""}')) % 11, "reason": kind})
    return scoring.parsed_answers(replies).select("kind", "item", "status", "score", "problem")


# Voxels and generators.


@query("select distinct cast(floor(x / 0.1e0) as int) as i, cast(floor(y / 0.1e0) as int) as j, cast(floor(z / 0.1e0) as int) as k from (select cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings) e")
def occupied_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = rel.table(spark, sf_dir, "embeddings").selectExpr(*(f"cast(embedding[{k}] as double) as {c}" for k, c in enumerate("xyz")))
    return voxels.occupied(cloud, 0.1)


@query("select i, j, k from (select unnest(range(5)) as i) a, (select unnest(range(5)) as j) b, (select unnest(range(5)) as k) c where i in (0, 4) or j in (0, 4) or k in (0, 4)")
def exposed_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(125).selectExpr("id % 5 as i", "cast(floor(id / 5) as bigint) % 5 as j", "cast(floor(id / 25) as bigint) as k")
    return voxels.exposed(grid)


@query("select cast(i as int) as i, cast(j as int) as j, cast(k as int) as k from (select unnest(range(6)) as i) a, (select unnest(range(4)) as j) b, (select unnest(range(3)) as k) c where i in (0, 5) or j in (0, 3) or k in (0, 2)")
def box_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.shell(spark, (6, 4, 3))


@query(rel.sql("select pid as ray, cast(floor(x) as int) as cells from points where y = 0.5", "points").replace("where y = 0.5", ""))
def ray_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a level ray from the left wall passes before its end's cell."""
    p = rel.points(spark, sf_dir).selectExpr("pid as ray", "0.25e0 as ax", "0.5e0 as ay", "x as bx", "0.5e0 as by")
    n = voxels.ray_cells(p).groupBy("ray").agg(F.count("*").alias("n"))
    return p.select("ray").join(n, "ray", "left").selectExpr("ray", "cast(coalesce(n, 0) as int) as cells")


@query(rel.sql("select pid as ray, x >= 21 as blocked from points", "points"))
def blocked_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rel.points(spark, sf_dir).selectExpr("pid as ray", "0.25e0 as ax", "0.5e0 as ay", "x as bx", "0.5e0 as by")
    return voxels.blocked_rays(p, spark.createDataFrame([(20, 0, 0)], "i int, j int, k int"))


@query(rel.sql("select id, x0 + cast(a as double) as x, y0 + cast(b as double) as y from cells, (select unnest(range(0, 10, 2)) as a) s, (select unnest(range(0, 10, 2)) as b) t", "cells"))
def voxelized_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.voxelize(rings.edges(rel.cell_vertices(spark, sf_dir)), 2.0)


def _halton(base: int, digits: int) -> str:
    return " + ".join(f"(n // {base**k}) % {base} * {1 / base ** (k + 1)!r}" for k in range(digits))


@query(f"select n, round(({_halton(2, 24)} - 0.5e0) * 40, 6) as x, round(({_halton(3, 24)} - 0.5e0) * 20, 6) as y from (select unnest(range(1, 301)) as n) s")
def halton_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(voxels.halton_centres(spark, 300, 40.0, 20.0), "x", "y")


@query(rel.sql("select p, max(case when turn = 1 then s end) as s1, round(max(case when turn = 1 then d end), 6) as d1, max(case when turn = 2 then s end) as s2, round(max(case when turn = 2 then d end), 6) as d2 from (select p.pid as p, c.id as s, sqrt((p.x - c.x0) * (p.x - c.x0) + (p.y - c.y0) * (p.y - c.y0)) as d, row_number() over (partition by p.pid order by sqrt((p.x - c.x0) * (p.x - c.x0) + (p.y - c.y0) * (p.y - c.y0)), c.id) as turn from points p, cells c) n where turn <= 2 group by p", "cells", "points"))
def two_nearest_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = rel.cells(spark, sf_dir).selectExpr("id as s", "x0 as x", "y0 as y")
    return _rounded(voxels.two_nearest(rel.points(spark, sf_dir).withColumnRenamed("pid", "p"), seeds), "d1", "d2")


@query("select c_custkey, c_acctbal from customer where c_acctbal > (select c_acctbal from customer order by c_acctbal limit 1 offset (select cast(floor(0.75 * count(*)) as int) from customer))")
def fill_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.threshold_at_fill(rel.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 0.25)


# Kernels for maps.

_ROOM = ([[0.0, 0.0], [16.0, 0.0], [16.0, 10.0], [0.0, 10.0]], [[[3.0, 2.0], [5.0, 2.0], [4.0, 6.0]], [[8.0, 3.0], [11.0, 3.0], [11.0, 7.0], [8.0, 7.0]]])


def _room(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "boundary array<array<double>>, obstacles array<array<array<double>>>, clearance double, start array<double>, goal array<double>"
    one = spark.createDataFrame([(*_ROOM, 0.2, [1.0, 1.0], [15.0, 9.0])], schema)
    return rel.table(spark, sf_dir, "region").selectExpr("concat('m', cast(r_regionkey as string)) as map").crossJoin(one)


@query("select 'm' || r_regionkey as map, 144.0e0 as area, true as convex from region")
def convex_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the regions of a room with two obstacles, and whether all are convex."""
    parts = decompose.decompose_maps(_room(spark, sf_dir))
    v = parts.selectExpr("map", "id", "area", "posexplode(polygon) as (ord, p)").selectExpr("map", "id", "ord", "p[0] as x", "p[1] as y")
    convex = rings.convexity(v, ("map", "id")).groupBy("map").agg(F.expr("bool_and(convex)").alias("convex"))
    return parts.groupBy("map").agg(F.round(F.sum("area"), 6).alias("area")).join(convex, "map")


@query()
def planner_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _room(spark, sf_dir)
    one = [spark.createDataFrame([(x,) for x in v], f"{n} string") for n, v in (("planner", planners.PLANNERS), ("mode", ("none",)))]
    jobs = runs.job_matrix(maps.select("map"), *one, spark.range(42, 44).withColumnRenamed("id", "seed"))
    return planners.run_jobs(jobs, maps, iterations=400)


_HOLE = ((20.0, 20.0), (30.0, 20.0), (30.0, 30.0), (20.0, 30.0))


def _rings(spark: SparkSession, **named: tuple) -> DataFrame:
    return spark.createDataFrame([(k, o, x, y) for k, ring in named.items() for o, (x, y) in enumerate(ring)], "id string, ord int, x double, y double")


_TO_HOLE = "sqrt(greatest(20 - x, x - 30, 0) * greatest(20 - x, x - 30, 0) + greatest(20 - y, y - 30, 0) * greatest(20 - y, y - 30, 0))"


_IN_HOLE = "x between 20 and 30 and y between 20 and 30"


@query(rel.sql(f"select *, inside and not blocked and clearance + 1e-9 >= 1 as valid from (select pid, x <= 50 and y <= 50 as inside, {_IN_HOLE} as blocked, round(least(x, y, 50 - x, 50 - y, case when {_IN_HOLE} then least(x - 20, 30 - x, y - 20, 30 - y) else {_TO_HOLE} end), 6) as clearance from points) p", "points"))
def state_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    boundary = _rings(spark, b=((0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0)))
    return _rounded(maps.state_validity(rel.points(spark, sf_dir), boundary, _rings(spark, h=_HOLE), 1.0), "clearance")


@query(rel.sql("select pid as sid, round(sqrt(dx * dx + dy * dy), 6) as distance, sqrt(dx * dx + dy * dy) + 1e-9 >= 1 as free from (select pid, greatest(20 - x, x - 30, 0) as dx, greatest(20 - y, 0) as dy from points) p", "points"))
def segment_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertical segments from the floor up to each point against the walls of a square hole."""
    p = rel.points(spark, sf_dir).selectExpr("pid as sid", "x as ax", "0.0e0 as ay", "x as bx", "y as by")
    return _rounded(maps.segment_validity(p, rings.edges(_rings(spark, h=_HOLE)), 1.0), "distance")


@query(rel.sql("select cast(id as varchar) as id, 'crossing' as problem from quads0 where id % 4 = 1", "quads0"))
def ring_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth ring with two vertices exchanged, so that its edges cross."""
    v = rel.quads(spark, sf_dir).selectExpr("cast(id as string) as id", "cast(case when id % 4 = 1 and ord in (1, 2) then 3 - ord else ord end as int) as ord", "x", "y")
    return maps.ring_problems(v).where("problem = 'crossing'")


@query("select 'a' as a, 'b' as b")
def overlapping_obstacles(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = lambda x, y, s: ((x, y), (x + s, y), (x + s, y + s), (x, y + s))
    return maps.overlapping(_rings(spark, a=square(0.0, 0.0, 4.0), b=square(2.0, 3.0, 4.0), c=square(6.0, 3.0, 4.0), d=square(30.0, 30.0, 1.0)))


@query()
def noise_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.threshold_at_fill(maps.noise_cloud(spark, (12, 12, 4)), "value", 0.3)


@query()
def maze_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.maze_walls(spark.range(42, 45).withColumnRenamed("id", "seed"), 21, 15)


@query("select 'b' as id, x, y, z from (select unnest([0.0, 0.5, 1.0]) as x) a, (select unnest([0.0, 0.5]) as y) b, (select unnest([1.0, 1.5, 2.0]) as z) c union all select 'c', x, y, z from (select unnest([-1.0, -0.5, 0.0, 0.5, 1.0]) as x) a, (select unnest([-1.0, -0.5, 0.0, 0.5, 1.0]) as y) b, (select unnest([0.0, 0.5]) as z) c where x * x + y * y <= 1")
def furniture_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spark.createDataFrame([("b", 0.0, 0.0, 1.0, 1.0, 0.5, 2.0)], "id string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    posts = spark.createDataFrame([("c", 0.0, 0.0, 1.0, 0.0, 0.5)], "id string, cx double, cy double, r double, z0 double, z1 double")
    return maps.box_cloud(boxes, 0.5).union(maps.cylinder_cloud(posts, 0.5))


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = rel.cell_edges(spark, sf_dir).withColumn("graph", F.lit("grid"))
    ends = spark.createDataFrame([("grid", "NATION_0", "start"), ("grid", "NATION_24", "goal")], "graph string, id string, role string")
    features = rel.cells(spark, sf_dir).selectExpr("'grid' as graph", "id", "5.0e0 as inradius", "1.0e0 as robot_radius", "case when k % 5 = 0 then null else 1.0e0 + k % 4 end as ellipse_ratio")
    portals = graph.undirected(e).selectExpr("'grid' as graph", "a", "b", "5.0e0 as portal_inradius", "2.0e0 as robot_radius")
    return prepare.prepare(e, ends, features, portals)


@query(rel.sql(_PATHS + ", best as (select path from walk where here = 'NATION_24' order by cost, path limit 3) select c.id, cast(count(distinct b.path) as int) as hits, round(count(distinct b.path) / 3.0e0, 6) as fraction, cast((select count(*) from cell_edges e where e.source = c.id) as int) as degree, (select min(cost) from walk w where w.here = c.id) as from_start, 'active' as open_level from cells c left join best b on list_contains(b.path, c.id) group by c.id", "cells", "cell_edges", recursive=True))
def prepared_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_prepared(spark, sf_dir)[0].select("id", "hits", "fraction", "degree", "from_start", "open_level"), "fraction")


@query(
    rel.sql(
        _PATHS
        + ", whole as (select path, cost, row_number() over (order by cost, path) as rank from walk where here = 'NATION_24'), hops as (select distinct rank, least(path[i], path[i + 1]) as a, greatest(path[i], path[i + 1]) as b from (select rank, path, unnest(range(1, len(path))) as i from whole) s), links as (select distinct least(source, target) as a, greatest(source, target) as b from cell_edges), counted as (select l.a, l.b, cast(count_if(h.rank <= 3) as int) as hits, count(h.rank) as passes from links l left join hops h using (a, b) group by l.a, l.b)"
        + " select 'grid' as graph, a, b, hits, cast(3 as int) as returned, round(hits / 3.0e0, 6) as fraction, passes > 0 as on_route, passes = (select count(*) from whole) as mandatory, true as reciprocal, round(1 / (1 + exp((2.5e0 - 2) / 0.3e0)), 6) as narrow, round(1 / (1 + exp(-(hits / 3.0e0 - 0.8e0) / 0.05e0)), 6) as critical, 'inactive' as narrow_level, case when hits = 3 then 'very' else 'inactive' end as critical_level from counted",
        "cells", "cell_edges", recursive=True,
    )
)
def prepared_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _prepared(spark, sf_dir)[1]
    return _rounded(out.select("graph", "a", "b", "hits", "returned", "fraction", "on_route", "mandatory", "reciprocal", "narrow", "critical", "narrow_level", "critical_level"), "fraction", "narrow", "critical")


@query("select 'grid' as graph, 'connected' as status, 3 as returned")
def prepared_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir)[2]


# Assembly and verification of graphs.

_BOX = ((0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0))
_MEANS_OF_CELLS = "select c.id, avg(least(px, py, 50 - px, 50 - py)) as mean from (select c.id, c.x0 + 10 * case when half = 0 then u + v else u end as px, c.y0 + 10 * case when half = 0 then v else u + v end as py from cells c, (select (i + o) / 12 as u, (j + o) / 12 as v, half from (select unnest(range(12)) as i) a, (select unnest(range(12)) as j) b, (select unnest([1 / 3.0e0, 2 / 3.0e0]) as o) s, (select unnest([0, 1]) as half) h where i + j < case when o < 0.5 then 12 else 11 end) t) c group by c.id"


def _clearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.mean_clearance(rel.cell_vertices(spark, sf_dir), rings.edges(_rings(spark, b=_BOX)))


@query(rel.sql(f"select id, round(mean, 6) as mean_clearance from ({_MEANS_OF_CELLS}) m", "cells"))
def mean_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_clearances(spark, sf_dir), "mean_clearance")


@query(
    rel.sql(
        f", means as ({_MEANS_OF_CELLS}) select a.id as source, b.id as target, case when a.k % 7 <> 0 and b.k % 7 <> 0 then round(10 * least(m.mean, n.mean), 6) end as traversability, case when a.k % 7 <> 0 and b.k % 7 <> 0 then round(7 * least(m.mean, n.mean), 6) end as safe_traversability from {_NEIGHBOURS.replace(' on ', ' on true join means m on m.id = a.id join means n on n.id = b.id where ')}",
        "cells",
    )
)
def traversability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh region's clearance is unknown."""
    means = _clearances(spark, sf_dir).join(rel.cells(spark, sf_dir).select("id", "k"), "id").selectExpr("id", "case when k % 7 <> 0 then mean_clearance end as mean_clearance")
    out = assemble.traversability(spatial.shared_portals(rel.cell_vertices(spark, sf_dir), clearance_=1.5), means)
    return _rounded(out.select("source", "target", "traversability", "safe_traversability"), "traversability", "safe_traversability")


@query(
    rel.sql(
        "select 2500.0e0 as boundary_area, round(sum(area), 4) as obstacle_area, round(sum(area) / 2500, 6) as obstacle_area_ratio from (select ((x * (y + 0.5) - (x + w) * y) + ((x + w) * (y + h + 0.5) - (x + w + 0.5) * (y + 0.5)) + ((x + w + 0.5) * (y + h) - x * (y + h + 0.5)) + (x * y - x * (y + h))) / 2 as area from quads0) q",
        "quads0",
    )
)
def map_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assemble.map_metrics(_rings(spark, b=_BOX), rel.quads(spark, sf_dir))
    return out.select("boundary_area", F.round("obstacle_area", 4).alias("obstacle_area"), F.round("obstacle_area_ratio", 6).alias("obstacle_area_ratio"))


_ENDS = "select cast(pid % 50 as varchar) as graph, case when pid % 2 = 0 then 'start' else 'goal' end as role, case when pid % 3 > 0 then x end as x, y, pid from points where pid % 97 < 5"


@query(
    rel.sql(
        f"select e.graph, e.role, c.id from ({_ENDS}) e join cells c on e.x >= c.x0 and e.x <= c.x0 + 10 and e.y >= c.y0 and e.y <= c.y0 + 10 union select e.graph, e.role, c.id from ({_ENDS}) e join cells c on c.k in (e.pid % 30, 3) where e.x is null",
        "cells", "points",
    )
)
def endpoint_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = rel.cells(spark, sf_dir).selectExpr("map_from_entries(collect_list(struct(k, id))) as names")
    ends = spark.sql(_ENDS.replace("varchar", "string").replace("from points", "from {points}"), points=rel.points(spark, sf_dir)).crossJoin(names)
    return assemble.endpoint_regions(ends.selectExpr("graph", "role", "x", "y", "array(names[cast(pid % 30 as int)], names[3]) as ids"), rel.cell_vertices(spark, sf_dir))


_BEST = _PATHS + ", best as (select path, cast(row_number() over (order by cost, path) as int) as rank from walk where here = 'NATION_24' order by cost, path limit 5)"


@query(rel.sql(_BEST + " select 'grid' as graph, s.rank, s.step, e.source, e.target, e.cost from (select rank, path, cast(unnest(range(len(path) - 1)) as int) as step from best) s join cell_edges e on e.source = s.path[s.step + 1] and e.target = s.path[s.step + 2]", "cells", "cell_edges", recursive=True))
def sequence_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.sequence_steps(k_loopless_paths(spark, sf_dir), rel.cell_edges(spark, sf_dir).withColumn("graph", F.lit("grid")))


@query(rel.sql(_BEST + " select 'grid' as graph, rank, path[1] = 'NATION_0' and path[-1] = 'NATION_24' as valid from best", "cells", "cell_edges", recursive=True))
def corridor_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = spark.createDataFrame([("grid", "start", 5.0, 5.0, None), ("grid", "goal", 50.0, 45.0, None)], "graph string, role string, x double, y double, ids array<string>")
    return assemble.corridor_ends(k_loopless_paths(spark, sf_dir), assemble.endpoint_regions(ends, rel.cell_vertices(spark, sf_dir)))


_LABELS = ("open", "corridor", "junction", "dead_end", "pocket", "alternative_route")
_ACTIVE = ", ".join(f"case when {n}_level in ('active', 'very') then '{n}' end" for n in _LABELS)


@query(f"select id, list_filter([{_ACTIVE}], lambda x: x is not null) as labels from ({ORACLES['region_labels']}) l")
def active_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.active_labels(region_labels(spark, sf_dir), _LABELS).select("id", "labels")


@query(" union all ".join(f"select id, '{n}' as label from ({ORACLES['region_labels']}) l where {n}_level = 'unavailable'" for n in _LABELS))
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.missing_labels(region_labels(spark, sf_dir), _LABELS)


@query(f"select count(*) as items, cast(count_if(len(flags) > 0) as bigint) as flagged from ({ORACLES['explanation_flags']}) f")
def flagged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explanation_flags(spark, sf_dir).agg(F.count("*").alias("items"), F.count_if(F.size("flags") > 0).alias("flagged"))


@query(rel.sql("select id from cells where k in (2, 7) union select c.id from points p join cells c on p.x >= c.x0 and p.x <= c.x0 + 10 and p.y >= c.y0 and p.y <= c.y0 + 10 where p.pid % 1000 = 3", "cells", "points"))
def protected_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.protected_regions(rel.cells(spark, sf_dir).where("k in (2, 7)"), rel.points(spark, sf_dir).where("pid % 1000 = 3"), rel.cell_vertices(spark, sf_dir))


@query(rel.sql("select source, target, cost from (select *, row_number() over (partition by source order by cost, target) as turn from cell_edges) e where turn = 1", "cells", "cell_edges"))
def cheapest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.cheapest(rel.cell_edges(spark, sf_dir), "source", "cost", "target")


@query(rel.sql("select id, cast(ord as int) as ord, round(case ord when 0 then 0.0e0 when 3 then 0.0e0 when 2 then 3.0e0 else 3 * w / (w + 0.5) end, 6) as x, round(case ord when 0 then 1.0e0 when 1 then 1 + 4 * 0.5 / (h + 0.5) when 2 then 5.0e0 else 1 + 4 * h / (h + 0.5) end, 6) as y from quads0, (select unnest(range(4)) as ord) o where winding = 1", "quads0"))
def restored_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anticlockwise rings stretched onto one box."""
    v = rel.quads(spark, sf_dir).where("id % 3 <> 0")
    boxes = v.select("id").distinct().selectExpr("id", "0.0e0 as lx", "1.0e0 as ly", "3.0e0 as hx", "5.0e0 as hy")
    return _rounded(assemble.restored(v, boxes), "x", "y")


@query(f"select count(*) as occupied, round(count(*) / cast((max(i) - min(i) + 1) * (max(j) - min(j) + 1) * (max(k) - min(k) + 1) as double), 9) as ratio from ({ORACLES['occupied_voxels']}) v")
def infill_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(assemble.infill_ratio(occupied_voxels(spark, sf_dir)), "ratio", digits=9)


@query(
    f"select count(*) as recorded, cast(count_if(path % 6 = 0) as bigint) as failed, cast(count_if(path % 6 <> 0) as bigint) as checked, cast(0 as bigint) as unmeasured, cast(0 as bigint) as stray, round(max(case when path % 6 <> 0 then abs(round(path_length, 3) - path_length) end), 6) as max_error, cast(0 as bigint) as repeated, true as sound from ({ORACLES['path_lengths']}) p"
)
def run_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a run whose length was recorded to three digits; a sixth of the runs failed."""
    measured = path_lengths(spark, sf_dir).selectExpr("path as run", "path_length as measured")
    recorded = measured.selectExpr("run", "run % 6 <> 0 as success", "case when run % 6 <> 0 then round(measured, 3) end as path_length")
    return _rounded(assemble.verification(recorded, measured, ("run",)), "max_error")


# Traces.

_TRACE = "select user_id as run, event_id as seq, event_id % 17 as child, event_id % 13 as parent, value from events"


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.table(spark, sf_dir, "events").selectExpr("user_id as run", "event_id as seq", "event_id % 17 as child", "event_id % 13 as parent", "value")


@query(f"select run, seq, child, parent, lag(parent) over (partition by run, child order by seq) as before from ({_TRACE}) t")
def trace_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.replayed(_trace(spark, sf_dir))


@query(f"select run, child, arg_max(parent, seq) as parent from ({_TRACE}) t group by run, child")
def trace_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.tree_at_end(_trace(spark, sf_dir))


@query(f"select run, greatest(count(*) - 20, 0) as dropped from ({_TRACE}) t group by run")
def trace_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.capped(_trace(spark, sf_dir), 20)[1]


@query(f"select run, seq, count(*) over w as held, round(avg(value) over w, 6) as mean from ({_TRACE}) t window w as (partition by run order by seq rows between 4 preceding and current row)")
def sliding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(traces.sliding(_trace(spark, sf_dir), 5, "value").select("run", "seq", "held", "mean"), "mean")


@query(f"select run, seq, coalesce(lag(child) over (partition by run order by seq), -1) as start, child as goal from ({_TRACE}) t")
def chained_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trace(spark, sf_dir).selectExpr("run", "seq", "cast(-1 as bigint) as start", "child as goal")
    return traces.chained_starts(t).select("run", "seq", "start", "goal")


@query("select id, ord, x, y from (select *, lag(x) over w as px, lag(y) over w as py from (select user_id as id, event_id as ord, cast(event_id % 3 as double) as x, cast(event_id % 2 as double) as y from events) e window w as (partition by id order by ord)) p where px is null or (x - px) * (x - px) + (y - py) * (y - py) > 0.25")
def without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rel.table(spark, sf_dir, "events").selectExpr("user_id as id", "event_id as ord", "cast(event_id % 3 as double) as x", "cast(event_id % 2 as double) as y")
    return traces.without_repeats(p, 0.5)


@query("select node, max(case when leaf = 'a' then v end) as a, max(case when leaf = 'b' then v end) as b from (select 'n' || (n_nationkey % 3) as node, case when n_nationkey % 2 = 0 then 'a' else 'b' end as leaf, arg_max('v' || n_nationkey, n_nationkey) as v from nation group by 1, 2) p group by node")
def nested_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rel.table(spark, sf_dir, "nation").selectExpr("n_nationkey as ord", "concat('n', cast(n_nationkey % 3 as string), '/', case when n_nationkey % 2 = 0 then 'a' else 'b' end) as name", "concat('v', cast(n_nationkey as string)) as value")
    return traces.nested_parameters(p).selectExpr("node", "settings['a'] as a", "settings['b'] as b")


@query("select draw, arg_min(x, attempt) filter (where x > 0.5) as x from (select c_custkey as draw, a as attempt, cast((c_custkey * 31 + a * 7) % 100 as double) / 100 as x from customer, (select unnest(range(3)) as a) s) c group by draw")
def rejection_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rel.table(spark, sf_dir, "customer").selectExpr("c_custkey as draw", "explode(sequence(0, 4)) as attempt").selectExpr("draw", "attempt", "cast((draw * 31 + attempt * 7) % 100 as double) / 100 as x", "0.0e0 as y")
    return traces.first_accepted(c, "x > 0.5", 3).select("draw", "x")


# Events (Spark-native).


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decay.event_windows(rel.table(spark, sf_dir, "events"))
    return _rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), "total")


@query("select user_id as key, max(event_id) as event_id from events group by user_id")
def latest_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decay.latest(rel.table(spark, sf_dir, "events").selectExpr("user_id as key", "event_id"), "key", "event_id")
