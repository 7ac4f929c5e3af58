"""Incremental forms: job states, progress, resumable batches, daily counters and sessions.

Each takes a streaming (or batch) DataFrame of events: ``event_id, ts, user_id,
event_type, value``. Times become timestamps in UTC first, which watermarks need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tracking as T

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    """The events below a path as a stream, so many files to a micro-batch."""
    read = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counters(stream: DataFrame, late: str = "2 days") -> DataFrame:
    day = F.window("ts", "1 day")
    return stream.withWatermark("ts", late).groupBy(day.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of a user's events at most ``gap`` apart."""
    s = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy("user_id", s.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def job_states(events_of: DataFrame) -> DataFrame:
    """The latest state of each job, its progress held to 0-100, and when it ended, of a batch or a whole table of events."""
    done = F.col("event_type").isin("purchase", *T.TERMINAL)
    return events_of.groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max_by(T.clamp_percent(F.col("value")), F.struct("ts", "event_id")).alias("progress"),
        F.max(F.when(done, F.col("ts"))).alias("completed_at"), F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "event_id")).alias("last"),
    )


def merge_states(parts: DataFrame) -> DataFrame:
    """One row a job of several rows of ``job_states`` over disjoint events."""
    latest = lambda c: F.max_by(c, "last").alias(c)
    return parts.groupBy("user_id").agg(latest("state"), latest("progress"), F.max("completed_at").alias("completed_at"), F.sum("n").cast("bigint").alias("n"), F.max("last").alias("last"))


def states_into(folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step: the states of each batch's jobs go to a folder of the batch's number.

    No state is held between batches, so neither it nor the driver grows with the
    jobs ever seen; writing a batch again replaces it.
    """

    def step(batch: DataFrame, number: int) -> None:
        job_states(batch).write.mode("overwrite").parquet(f"{folder}/batch={number:08d}")

    return step


def states(spark: SparkSession, folder: str) -> DataFrame:
    """The states of all jobs over the batches written so far."""
    return merge_states(spark.read.parquet(folder).drop("batch")).drop("last")


def upsert_into(folder: str, key: str = "user_id") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step: each batch's latest rows by key go to a folder of the batch's own number.

    Writing the same batch again replaces it, so a restart changes nothing;
    ``current`` reads the latest of all batches.
    """

    def step(batch: DataFrame, number: int) -> None:
        T.upsert_latest(batch, key, [F.col("ts"), F.col("event_id")]).write.mode("overwrite").parquet(f"{folder}/batch={number:08d}")

    return step


def current(spark: SparkSession, folder: str, key: str = "user_id") -> DataFrame:
    """The latest row of each key over all batches written so far."""
    return T.upsert_latest(spark.read.parquet(folder).drop("batch"), key, [F.col("ts"), F.col("event_id")])


def replay(stream: DataFrame, folder: str, step: Callable[[DataFrame, int], None]) -> None:
    """Run all that is there through ``step``, resuming behind the last finished batch of the checkpoint below ``folder``."""
    query = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(step).start()
    query.awaitTermination()


def to_files(result: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Run a windowed aggregate over all that is there and read its result.

    Each batch's changed rows (update mode) go to a folder of the batch's number,
    by the executors; the last row of a key counts. State older than the
    watermark is dropped.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={number:08d}")

    query = result.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(step).start()
    query.awaitTermination()
    rows = result.sparkSession.read.parquet(f"{folder}/result")
    rest = [c for c in result.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*(F.col(c) if c in keys else F.col("r")[c].alias(c) for c in result.columns))


def append_files(result: DataFrame, folder: str) -> DataFrame:
    """Run an aggregate over all that is there into files in append mode, each group once the watermark has passed it.

    What the watermark has not passed at the end is still open and not written.
    """
    query = result.writeStream.format("parquet").option("path", f"{folder}/result").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.read.parquet(f"{folder}/result")
