"""Helpers of the training-data operators."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadloom.sources.shared import materialize

__all__ = ["count_strips", "fresh", "materialize", "shuffle_width", "summed_counts", "texts"]

STRIPS = 16


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), whatever other columns the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fresh(name: str) -> str:
    """A column name that no input has: beside the columns of a table that stays whole."""
    return f"{name}_{uuid.uuid4().hex}"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def count_strips(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A task's table of counts as (strip, part) columns, for ``summed_counts``."""
    parts = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in np.array_split(counts, STRIPS)]
    return pa.array(range(STRIPS), pa.int32()), pa.array(parts, pa.binary())


def summed_counts(table: DataFrame) -> np.ndarray:
    """The sum of all tasks' tables, (strip, part) rows: of fixed size, whatever the corpus."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for strip, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = np.frombuffer(zlib.decompress(part), "<u4").astype(np.int64)
                sums[strip] = sums[strip] + value if strip in sums else value
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["strip", "part"])

    got = table.select("strip", "part").repartition("strip").mapInArrow(add, "strip int, part binary").collect()
    return np.concatenate([np.frombuffer(r["part"], np.int64) for r in sorted(got, key=lambda r: r["strip"])] or [np.zeros(0, np.int64)])
