"""Readers and writers of maps, partitions, prepared graphs, guidance files and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RING = "array<array<double>>"
MAP = f"map struct<boundary:{RING},obstacles:array<{RING}>,start:array<double>,goal:array<double>,robot_radius:double,safety_margin:double>"
REGIONS = f"regions array<struct<id:string,polygon:{RING}>>"
PARTITION = f"schema string, source_sha256 string, geometry_sha256 string, {REGIONS}"
GUIDANCE = f"start_region string, goal_region string, guided_probability double, portal_probability_within_guidance double, sequence array<string>, regions array<struct<id:string,score:double,polygon:{RING}>>, portals array<struct<source:string,target:string,segment:{RING}>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.input_file_name())


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """file, boundary, obstacles, start, goal, required_clearance and problems of map documents; radius and margin default to 0."""
    m = _json(spark, path, MAP).selectExpr("file", "map.boundary", "coalesce(map.obstacles, array()) as obstacles", "map.start", "map.goal", "coalesce(map.robot_radius, 0.0e0) as robot_radius", "coalesce(map.safety_margin, 0.0e0) as safety_margin")
    rules = {
        "boundary": "boundary is null or size(boundary) < 3",
        "endpoints": "(start is null) <> (goal is null)",
        "clearance": "not (robot_radius >= 0 and safety_margin >= 0 and robot_radius + safety_margin < double('infinity'))",
    }
    problems = ", ".join(f"case when {rule} then '{name}' end" for name, rule in rules.items())
    return m.selectExpr("*", "robot_radius + safety_margin as required_clearance", f"filter(array({problems}), p -> p is not null) as problems")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, REGIONS)


def read_partition(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Recorded partitions with the digest of their bytes and problems: schema tag, repeated ids, coordinates that are not finite."""
    bytes_ = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))
    finite = "forall(regions, r -> forall(r.polygon, p -> size(p) = 2 and forall(p, v -> v is not null and abs(v) < double('infinity'))))"
    d = _json(spark, path, PARTITION).selectExpr("file", "schema", "source_sha256", "geometry_sha256", "regions", f"filter(array(case when schema <> '{tag}' or schema is null then 'schema' end, case when size(array_distinct(transform(regions, r -> r.id))) <> size(regions) then 'ids' end, case when not {finite} then 'coordinates' end), p -> p is not null) as problems")
    return d.join(bytes_.withColumn("file", F.regexp_replace("file", "^file:/+", "file:///")), "file", "left")


def read_guidance(spark: SparkSession, path: str) -> DataFrame:
    """Corridors, priors and sequence strategies with defaults and problems."""
    d = _json(spark, path, GUIDANCE).selectExpr("file", "start_region", "goal_region", "coalesce(guided_probability, 0.8e0) as guided_probability", "coalesce(portal_probability_within_guidance, 0.2e0) as portal_probability", "sequence", "regions", "portals", "transform(regions, r -> r.id) as ids")
    rules = {
        "ids": "size(array_distinct(ids)) <> size(ids)",
        "order": "sequence is not null and sequence <> ids",
        "scores": "exists(regions, r -> coalesce(r.score, 1.0e0) < 0 or coalesce(r.score, 1.0e0) > 1) or not exists(regions, r -> coalesce(r.score, 1.0e0) > 0)",
        "ends": "start_region is not null and not array_contains(ids, start_region) or goal_region is not null and not array_contains(ids, goal_region)",
        "probabilities": "not (guided_probability between 0 and 1 and portal_probability between 0 and 1)",
        "portals": "portals is not null and size(portals) > 0 and transform(portals, p -> array(p.source, p.target)) <> transform(sequence(1, size(ids) - 1), i -> array(ids[i - 1], ids[i]))",
    }
    return d.selectExpr("*", f"filter(array({', '.join(f'case when {r} then {chr(39)}{n}{chr(39)} end' for n, r in rules.items())}), p -> p is not null) as problems")


def vertices(documents: DataFrame, polygon: str = "polygon", *keys: str) -> DataFrame:
    """keys, ord, x, y of a ring column."""
    return documents.selectExpr(*keys, f"posexplode({polygon}) as (ord, p)").selectExpr(*keys, "ord", "p[0] as x", "p[1] as y")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """file and whole text of run logs."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def write_once(df: DataFrame, path: str, inputs: tuple[str, ...] = (), fmt: str = "json") -> None:
    """Writes by Spark's commit protocol; never over an input or an earlier result."""
    if path.rstrip("/") in {p.rstrip("/") for p in inputs}:
        raise ValueError("the output is one of the inputs")
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def append_results(df: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines; earlier rows are never rewritten."""
    df.write.mode("append").json(path)


def write_snapshot(df: DataFrame, path: str, order: tuple[str, ...]) -> None:
    """A sorted, gzip-compressed table of a tree's nodes, as JSON lines; an earlier snapshot stays."""
    df.orderBy(*order).write.mode("errorifexists").option("compression", "gzip").json(path)


def svg(vertices_: DataFrame, key: str = "id", width: float = 800.0) -> DataFrame:
    """(id, element): each ring as an SVG polygon, scaled into a panel of the given width, y upwards."""
    box = vertices_.agg(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"))
    scaled = vertices_.crossJoin(box).selectExpr(key, "ord", f"concat(format_number((x - lx) * {width} / nullif(hx - lx, 0), '0.##'), ',', format_number((hy - y) * {width} / nullif(hx - lx, 0), '0.##')) as at")
    return scaled.groupBy(key).agg(F.expr("concat('<polygon points=\"', array_join(transform(array_sort(collect_list(struct(ord, at))), s -> s.at), ' '), '\"/>')").alias("element"))
