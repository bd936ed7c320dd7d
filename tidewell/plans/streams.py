"""Queries on job and event streams; the first two run the stream itself on the tables as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.session import scratch_path
from tidewell.streaming import jobs as J
from tidewell.tables import table


def dead_letter_split(spark, sf_dir):
    rows = table(spark, sf_dir, "query_jobs", "entry_id", "job_type", "text")
    return J.validated(rows).select("entry_id", F.coalesce("error", F.lit("ok")).alias("outcome"))


def job_micro_batches(spark, sf_dir):
    """query_jobs written as files, streamed through the router, and counted by kind."""
    root = scratch_path(spark, "jobs")
    rows = table(spark, sf_dir, "query_jobs", "entry_id", "job_id", "telegram_update_id", "job_type", "chat_id", "text").withColumn("received_at", F.lit(None).cast("string"))
    rows.repartition(3).write.json(f"{root}/in")
    J.route(J.read_jobs(spark, f"{root}/in"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out/jobs").groupBy("job_type").agg(F.count(F.lit(1)).alias("n"))


def event_windows(spark, sf_dir):
    return J.windowed_counts(table(spark, sf_dir, "events", "ts", "event_type", "value"))


QUERIES = {f.__name__: f for f in (dead_letter_split, job_micro_batches, event_windows)}

_ERROR = "case when entry_id is null then 'no entry_id' when coalesce(job_type, '') not in ('start', 'query', 'paste', 'skip', 'blocked', 'ingest') then 'unknown type' when job_type <> 'start' and trim(coalesce(text, '')) = '' then 'empty text' else 'ok' end"
ORACLE_SQL = {
    "dead_letter_split": f"select entry_id, {_ERROR} as outcome from query_jobs",
    "job_micro_batches": f"select job_type, count(*) as n from query_jobs where {_ERROR} = 'ok' group by 1",
    "event_windows": "select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all",
}
