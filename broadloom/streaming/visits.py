"""Structured Streaming forms of the visit operators.

Each takes a streaming DataFrame and gives one; ``run_to_table`` drives it over what there is
and returns the sink as a table. Sinks write a folder per batch id, so a batch that is run
again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from broadloom.sources.shared import new_path


def file_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream; ``name`` is a glob of file names."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_to_table(stream: DataFrame, mode: str, keep_last: bool = False) -> DataFrame:
    """Process what is there (availableNow), each batch into its own folder of the shared
    directory. ``keep_last``: the last batch is the whole result (complete mode)."""
    spark = stream.sparkSession
    out, state = new_path(spark), new_path(spark)
    seen: list[int] = []

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        seen.append(batch_id)

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(sink).start()
    q.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    folders = [f"{out}/batch={i}" for i in (seen[-1:] if keep_last else seen)]
    return spark.read.schema(stream.schema).parquet(*folders)


def session_stream(events: DataFrame, visitor: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by a gap. A pause of exactly the gap continues a session, as in the batch
    form; ``ended`` is the last event, not the end of the window."""
    at = F.col(ts).cast("timestamp")
    return events.withColumn("_at", at).withWatermark("_at", late).groupBy(F.session_window("_at", gap).alias("w"), visitor).agg(F.min("_at").alias("started"), F.max("_at").alias("ended"), F.count("*").alias("n_rows")).select(visitor, "started", "ended", "n_rows")


def tumbling_days(events: DataFrame, ts: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Counts per day and group; a day closes one hour after midnight."""
    at = F.col(ts).cast("timestamp")
    return events.withColumn("_at", at).withWatermark("_at", late).groupBy(F.window("_at", "1 day").alias("w"), *by).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), *by, "n")


def first_rows(events: DataFrame, key: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Add-only intake: the first row of a key within the watermark; later ones never update."""
    return events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(key).drop("_at")


def rate_limit_stream(events: DataFrame, visitor: str, row_id: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """(visitor, row_id, is_rejected): state per visitor is the instants of its last accepted
    hits, at most ``limit`` of them. A visitor's rows of a micro-batch come in frames cut
    anywhere, so they are sorted together: 16 bytes a row of the visitor at hand."""
    rows = events.select(F.col(visitor).alias("visitor"), F.col(row_id).alias("row_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))

    def step(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        kept = list(state.get[0]) if state.exists else []
        pdf = pd.concat([f[["at", "row_id"]] for f in frames]).sort_values(["at", "row_id"])
        flags = []
        for t in pdf["at"]:
            kept = [x for x in kept if t - x <= seconds * 1_000_000]
            flags.append(len(kept) >= limit)
            if not flags[-1]:
                kept.append(int(t))
        yield pd.DataFrame({"visitor": key[0], "row_id": pdf["row_id"], "is_rejected": flags})
        state.update((kept,))

    return rows.groupBy("visitor").applyInPandasWithState(step, "visitor long, row_id long, is_rejected boolean", "kept array<long>", "append", GroupStateTimeout.NoTimeout)
