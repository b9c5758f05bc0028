"""Streams: density decay as keyed state, latest goals, first clouds and windowed events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sampling import INTERVAL, LEAST, REFERENCE, STRENGTH

DECAY_SCHEMA = "run string, epoch bigint, id string, nodes bigint, adjusted double"
STATE_SCHEMA = "total bigint, last_seq bigint, ids array<string>, nodes array<bigint>"


def density_decay_stream(nodes: DataFrame, areas: dict[str, tuple[float, float]], *, interval: int = INTERVAL) -> DataFrame:
    """A row for each region of a run whenever an epoch of ``interval`` added nodes is full.

    ``nodes`` streams (run, seq, id); ``areas`` maps a region to (area, base
    score). State is a counter for each region; rows of a run come in the order
    of seq within a batch, and a seq at or before the last one seen is an error.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, last, ids, counts = state.get if state.exists else (0, -1, [], [])
        held = dict(zip(ids, counts, strict=True))
        rows = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            if r.seq <= last:
                raise ValueError(f"run {key[0]}: node {r.seq} after {last}")
            last, total = int(r.seq), total + 1
            if r.id in areas:
                held[r.id] = held.get(r.id, 0) + 1
            if total % interval == 0:
                for name, (area, base) in sorted(areas.items()):
                    density = held.get(name, 0) / area
                    rows.append((key[0], total // interval, name, held.get(name, 0), max(LEAST, base - STRENGTH * density / (density + REFERENCE))))
        state.update((total, last, list(held), list(held.values())))
        yield pd.DataFrame(rows, columns=["run", "epoch", "id", "nodes", "adjusted"])

    return nodes.groupBy("run").applyInPandasWithState(step, DECAY_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def latest(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of a micro-batch: a queue of depth one."""
    columns = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_v")).select(key, "_v.*")


def event_windows(events: DataFrame, *, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Spark-native: count and sum of ``value`` by tumbling window and type, late rows dropped after ``late``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_of(stream: DataFrame, key: str) -> DataFrame:
    """The first row of each key, for good: a latch."""
    return stream.dropDuplicates([key])
