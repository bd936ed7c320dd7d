"""Micro-batch jobs: routing, dead letters, idempotent stores, windowed counts."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators.deliveries import DeliveryStore, identified, message_roots
from tidewell.sources.sinks import append_once

JOB = T.StructType([T.StructField("entry_id", T.LongType()), T.StructField("job_id", T.StringType()), T.StructField("telegram_update_id", T.LongType()), T.StructField("job_type", T.StringType()), T.StructField("chat_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("received_at", T.StringType())])
KINDS = ["start", "query", "paste", "skip", "blocked", "ingest"]


def validated(jobs: DataFrame) -> DataFrame:
    """Jobs plus `error`, null where they can run."""
    return jobs.withColumn("error", F.when(F.col("entry_id").isNull(), "no entry_id").when(~F.coalesce(F.col("job_type").isin(KINDS), F.lit(False)), "unknown type").when((F.col("job_type") != "start") & (F.trim(F.coalesce("text", F.lit(""))) == ""), "empty text"))


def read_jobs(spark: SparkSession, path: str, max_files: int = 1, latest: bool = False) -> DataFrame:
    """JSON lines arriving as files; a file is the smallest batch. A new stream starts with the files that are there, or with `latest` with those that come after its start."""
    rows = spark.readStream.schema(JOB).option("maxFilesPerTrigger", max_files).json(path)
    return rows.where(F.col("_metadata.file_modification_time") >= F.lit(datetime.now(timezone.utc))) if latest else rows


def decoded(bodies: DataFrame) -> DataFrame:
    """bodies (value: bytes or text of one JSON object) -> jobs; one that can't be read has no entry_id and ends among the dead letters."""
    return bodies.select(F.from_json(F.col("value").cast("string"), JOB).alias("j")).select("j.*")


def route(jobs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Good jobs to one folder per kind in each batch, others with their error to dead_letters.

    A batch is committed only after both writes; repeated after a failure it replaces its own rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        told = validated(batch).persist()
        append_once(told.where("error is null").drop("error"), f"{out}/jobs", batch_id, by=["job_type"])
        append_once(told.where("error is not null"), f"{out}/dead_letters", batch_id)
        told.unpersist()

    return jobs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicate(jobs: DataFrame, store: DeliveryStore, checkpoint: str) -> StreamingQuery:
    """Upsert every batch into the bucketed store; messages are the connected groups of what it holds."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store.upsert(identified(batch, "jobs"), f"b{batch_id}")

    return jobs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_entries(store: DeliveryStore) -> DataFrame:
    """The smallest entry of each message in the store."""
    return message_roots(store.compact()).select("tbl", F.col("root").alias("entry_id")).distinct()


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per type and window of event time; what comes later than `late` is dropped in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
