"""Queries of the general problems: written instants and repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.operators.deliveries import surplus_entries
from tidewell.operators.instants import InstantDictionary, normalise_instants, stamps
from tidewell.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = stamps(
        table(spark, sf_dir, "messages", "msg_id", "source_id", "datetime_iso"),
        table(spark, sf_dir, "ingest_requests", "entry_id", "received_at"),
        table(spark, sf_dir, "drive_watch_state", "channel_id", "expiration"),
        table(spark, sf_dir, "ingestion_sources", "source_id", "tz_name"),
    )
    return normalise_instants(written, InstantDictionary(spark), parts=["messages", "ingest_requests", "drive_watch_state"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surplus_entries({t: table(spark, sf_dir, t, "entry_id", "job_id", "telegram_update_id") for t in ("ingest_requests", "query_jobs")})


QUERIES = {"p3_found": p3_found, "p7_found": p7_found}

_NUMBERED = """
  select '{t}' as tbl, entry_id,
         nullif(regexp_extract(coalesce(job_id, ''), '^\\s*\\+?0*([1-9][0-9]*)\\s*$', 1), '') as job,
         case when telegram_update_id > 0 then cast(cast(telegram_update_id as bigint) as varchar) end as upd
  from {t}"""

ORACLE_SQL = {
    "p7_found": "with recursive e as (" + " union all ".join(_NUMBERED.format(t=t) for t in ("ingest_requests", "query_jobs")) + """),
ident as (
  select tbl, entry_id, 'j' || job as id from e where job is not null
  union select tbl, entry_id, 'u' || upd from e where upd is not null),
near as (
  select distinct a.tbl, a.entry_id, b.entry_id as other
  from ident a join ident b using (tbl, id)),
reach as (
  select tbl, entry_id, other from near
  union
  select r.tbl, r.entry_id, n.other from reach r join near n on r.tbl = n.tbl and r.other = n.entry_id)
select tbl, entry_id from reach group by tbl, entry_id having min(other) < entry_id"""
}
