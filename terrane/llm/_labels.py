"""A bounded, deterministic sample of labelled texts for training."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled texts that a classifier learns from.
SAMPLE_ROWS = 8000


def held_out(doc_id: object) -> bool:
    """crc32 of the id as text, mod 5, is 0; such rows are never learnt from."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[int]]:
    """Texts and 0/1 labels of up to ``rows`` documents that are not held out.

    Ids are taken from all labels in the order of their hash, so the sample is
    spread over the whole table and the same in every run; only these ids meet
    the documents. Rows without id, label or text are not learnt from. Of
    several labels for one id the largest counts; of several texts the first in
    order.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("key"), F.col(label).cast("int").alias("mark"))
        .where("key is not null and mark is not null")
        .where(F.crc32(F.col("key").cast("string").cast("binary")) % 5 != 0)
        .groupBy("key")
        .agg(F.max("mark").alias("mark"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(rows)
    )
    found = (
        docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").alias("words"))
        .where("words is not null")
        .join(F.broadcast(ids), "key")
        .groupBy("key", "mark")
        .agg(F.min("words").alias("words"))
        .orderBy("key")
        .toArrow()
    )
    return found["words"].to_pylist(), found["mark"].to_pylist()
