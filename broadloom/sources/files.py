"""Dictionary and source-list files, round trips included, and log retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from broadloom.sources.shared import materialize


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, quoted so that line ends and quotes in text come back. Empty text and
    null differ: null is an empty cell, empty text is quoted."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", '""').option("nullValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("escape", '"').option("multiLine", "true").option("emptyValue", "").option("nullValue", "\x00").csv(path)


def purged(log: DataFrame, done: DataFrame, day: str) -> DataFrame:
    """The log without the days that are rolled up."""
    return log.join(done.select(day).distinct(), day, "left_anti")


def rewrite_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Put the rows in the place of what a table partitioned by ``by`` holds in their partitions;
    others are not touched. Rows are written beside the table first, so they may come from it,
    and a try that fails before the swap leaves the table as it was."""
    staged = materialize(rows)
    staged.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def purge_log(spark: SparkSession, path: str, done: DataFrame, keep_from: str) -> DataFrame:
    """Take the rows of finished days out of a log partitioned by ``month`` ('yyyy-MM') with a
    ``day`` column ('yyyy-MM-dd'); returns (month, kept, gone) of the months rewritten.

    A row goes if its day is before ``keep_from`` and among ``done`` (column day), or is no day
    at all; days that are not rolled up stay however old. Only months wholly before that of
    ``keep_from`` are looked at: nothing is appended to them any more, so a run may be broken
    off and repeated. A month without rows left stays as an empty partition."""
    log = spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
    closed = log.filter(F.col("month") < keep_from[:7])
    finished = done.select(F.col("day").cast("string").alias("day")).distinct().withColumn("_done", F.lit(True))
    judged = closed.join(finished, "day", "left")
    is_day = F.coalesce(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    goes = ~is_day | (F.coalesce("_done", F.lit(False)) & (F.col("day") < keep_from))
    judged = judged.withColumn("_goes", goes)
    months = materialize(judged.groupBy("month").agg(F.sum((~F.col("_goes")).cast("long")).alias("kept"), F.sum(F.col("_goes").cast("long")).alias("gone")).filter("gone > 0"))
    rows = judged.join(months.select("month"), "month", "left_semi").filter("NOT _goes").select(*log.columns)
    rewrite_partitions(rows, path, "month")
    bare = log.drop("month").schema
    for r in months.filter("kept = 0").select("month").collect():  # at most the months of the log
        spark.createDataFrame([], bare).write.mode("overwrite").parquet(f"{path}/month={r['month']}")
    return months
