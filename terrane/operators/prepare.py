"""A map's prepared query: routes, facts, labels and status of every region and connection, in one pass over its graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, labels


def prepare(edges: DataFrame, endpoints: DataFrame, regions: DataFrame, portals: DataFrame, *, k: int = 3, rules: labels.Rules = labels.Rules()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(regions, connections, status) with facts, fractions, memberships and levels.

    ``regions`` has (graph, id, robot_radius, inradius, ellipse_ratio), those
    without edges too, ``portals`` (graph, a, b, robot_radius,
    portal_inradius); unknown features stay unknown. Fractions divide by the
    paths that were found, not by k. Pockets and alternatives are unknown where
    an edge lacks its reverse.
    """
    facts = graph.route_facts(edges, endpoints, k, regions).withColumn("fraction", F.expr("hits / nullif(returned, 0)"))
    of_regions = facts.where("b is null").drop("b", "mandatory").withColumnRenamed("a", "id").join(regions, ["graph", "id"], "left")
    of_connections = facts.where("b is not null").drop("degree", "is_endpoint", "in_pocket", "from_start", "to_goal").join(portals, ["graph", "a", "b"], "left")
    ends = endpoints.groupBy("graph").agg(F.count_if(F.col("role") == "start").alias("starts"), F.count_if(F.col("role") == "goal").alias("goals"))
    found = facts.groupBy("graph").agg(F.max("returned").alias("returned"))
    status = ends.join(found, "graph", "left").selectExpr("graph", "case when starts = 0 or goals = 0 then 'missing_endpoint_regions' when coalesce(returned, 0) = 0 then 'disconnected' else 'connected' end as status", "coalesce(returned, 0) as returned")
    return labels.region_labels(of_regions, rules), labels.connection_labels(of_connections, rules), status
