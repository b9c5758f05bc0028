"""Planning-run analytics: log records, summaries, paired comparisons, path and solution series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

METRICS = ("planning_time_ms", "time_to_first_solution_ms", "path_length", "straight_line_distance", "path_length_ratio", "iterations", "nodes_added")
#: Metrics that a failed run does not have.
NULLED = ("time_to_first_solution_ms", "path_length", "path_length_ratio")


def result_line(*fields: str) -> Column:
    """'[RESULT] name=value ...' of the given columns."""
    return F.concat(F.lit("[RESULT] "), F.concat_ws(" ", *(F.concat(F.lit(f"{f}="), F.col(f).cast("string")) for f in fields)))


#: Fixed values of the log format: terminal sequences, the record's line and its fields, and a number.
TERMINAL = "\x1b\\[[0-?]*[ -/]*[@-~]"
RECORD, FIELD = r"\[RESULT\]\s+([^\r\n]*)", r"([A-Za-z_]+)=(\S+)"
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def parse_results(logs: DataFrame, text: str = "text") -> DataFrame:
    """Adds planner, guidance, success and the metrics of the last [RESULT] record of a log.

    Terminal sequences are taken out first; of a repeated key the last counts. A
    record that lacks a field, or has a metric that is no finite number, is null
    throughout. A success other than 1 is a failure, which has no solution time,
    length or ratio.
    """
    fields = ("planner", "guidance", "success", *METRICS)
    records = F.regexp_extract_all(F.regexp_replace(text, TERMINAL, ""), F.lit(RECORD), F.lit(1))
    out = logs.withColumn("_line", F.try_element_at(records, F.lit(-1)))
    out = out.withColumns({"_keys": F.regexp_extract_all("_line", F.lit(FIELD), F.lit(1)), "_values": F.regexp_extract_all("_line", F.lit(FIELD), F.lit(2))})
    out = out.withColumns({f: F.expr(f"try_element_at(filter(_values, (v, i) -> _keys[i] = '{f}'), -1)") for f in fields})
    sound = F.lit(True)
    for f in fields:
        sound = sound & F.col(f).isNotNull()
    for m in METRICS:
        sound = sound & F.col(m).rlike(NUMBER) & (F.abs(F.expr(f"try_cast({m} as double)")) < float("inf"))
    out = out.withColumn("_sound", F.coalesce(sound, F.lit(False)))
    known = {"planner": F.col("planner"), "guidance": F.col("guidance"), "success": F.col("success") == "1"}
    known |= {m: F.when((F.col("success") == "1") | F.lit(m not in NULLED), F.expr(f"try_cast({m} as double)")) for m in METRICS}
    return out.withColumns({f: F.when(F.col("_sound"), v) for f, v in known.items()}).drop("_line", "_keys", "_values", "_sound")


def summarize(runs: DataFrame, by: tuple[str, ...] = ("planner", "mode"), metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Runs, successes, success rate, and mean and sample deviation of each metric over its known values (one value: 0)."""
    out: list[Column] = [F.count("*").alias("runs"), F.count_if("success").alias("successes"), (F.count_if("success") / F.count("*")).alias("success_rate")]
    for m in metrics:
        out += [F.avg(m).alias(f"{m}_mean"), F.when(F.count(m) == 1, 0.0).otherwise(F.stddev_samp(m)).alias(f"{m}_stdev")]
    return runs.groupBy(*by).agg(*out)


def summarize_sets(runs: DataFrame, sets: list[list[str]], by: tuple[str, ...], metric: str) -> DataFrame:
    """One pass over several groupings (Spark-native): runs, success rate and the metric's mean, by grouping set."""
    return runs.groupingSets(sets, *by).agg(F.count("*").alias("runs"), (F.count_if("success") / F.count("*")).alias("success_rate"), F.avg(metric).alias(f"{metric}_mean"))


def paired(runs: DataFrame, base: str, other: str, keys: tuple[str, ...] = ("map", "planner", "seed"), metric: str = "path_length", by: tuple[str, ...] = ("planner",)) -> DataFrame:
    """Runs of two modes on equal keys that both succeeded: pairs and the mean of the relative changes in percent."""
    a = runs.where((F.col("mode") == base) & F.col("success")).select(*keys, F.col(metric).alias("_a"))
    b = runs.where((F.col("mode") == other) & F.col("success")).select(*keys, F.col(metric).alias("_b"))
    return a.join(b, list(keys)).groupBy(*by).agg(F.count("*").alias("pairs"), F.avg(F.expr("100 * (_b - _a) / nullif(_a, 0)")).alias(f"{metric}_change_percent"))


def running_best(solutions: DataFrame, keys: tuple[str, ...], order: str, cost: str) -> DataFrame:
    """The solutions that strictly improve on all before them."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return solutions.withColumn("_best", F.min(cost).over(before)).where(F.col("_best").isNull() | (F.col(cost) < F.col("_best"))).drop("_best")


def path_lengths(points: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """keys, points, path_length, straight_line_distance, path_length_ratio of ordered (ord, x, y) rows; a path without extent has no ratio."""
    w = Window.partitionBy(*keys).orderBy("ord")
    steps = points.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    out = steps.groupBy(*keys).agg(F.count("*").alias("points"), F.coalesce(F.sum(F.expr(g.distance("x", "y", "nx", "ny"))), F.lit(0.0)).alias("path_length"), F.expr("min_by(struct(x, y), ord)").alias("s"), F.expr("max_by(struct(x, y), ord)").alias("t"))
    return out.withColumn("straight_line_distance", F.expr(g.distance("s.x", "s.y", "t.x", "t.y"))).selectExpr(*keys, "points", "path_length", "straight_line_distance", "path_length / nullif(straight_line_distance, 0) as path_length_ratio")


def jaccard(a: str, b: str) -> Column:
    """Shared over all distinct elements of two arrays; null if both are empty."""
    return F.expr(f"size(array_intersect({a}, {b})) / nullif(size(array_union({a}, {b})), 0)")


def common_subsequence(a: str, b: str) -> Column:
    """The length of the longest common subsequence of two arrays: one fold over b's prefixes for each element of a."""
    row = f"aggregate(sequence(1, size({b})), named_struct('row', array(0), 'left', 0), (s, j) -> named_struct('row', array_append(s.row, greatest(s.left, element_at(prev, j + 1), element_at(prev, j) + int(x <=> element_at({b}, j)))), 'left', greatest(s.left, element_at(prev, j + 1), element_at(prev, j) + int(x <=> element_at({b}, j)))), s -> s.row)"
    return F.expr(f"case when size({a}) = 0 or size({b}) = 0 then 0 else element_at(aggregate({a}, array_repeat(0, size({b}) + 1), (prev, x) -> {row}), -1) end")


def job_matrix(maps: DataFrame, planners: DataFrame, modes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every map x planner x mode x seed, numbered with the seeds outermost so that configurations interleave."""
    # Lists of settings: one partition each, or the product would have as many tasks as their partitions' product.
    jobs = seeds.coalesce(1)
    for settings in (maps, planners, modes):
        jobs = jobs.crossJoin(settings.coalesce(1))
    return jobs.withColumn("job", F.row_number().over(Window.orderBy("seed", "map", "planner", "mode")))


def csv_field(column: str) -> Column:
    """A quoted field, quotes doubled."""
    return F.concat(F.lit('"'), F.replace(F.col(column).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))


def shown(column: str, digits: int = 3) -> Column:
    """A number with fixed digits, an em dash for null."""
    return F.when(F.col(column).isNull(), "—").otherwise(F.format_string(f"%.{digits}f", F.col(column)))
