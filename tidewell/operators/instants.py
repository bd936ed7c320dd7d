"""Mixed timestamp formats and time zones: one UTC instant per written stamp.

The distinct (raw, zone) pairs form a dictionary that is parsed once and kept; rows get their
instants by a join with it. A pair that very many rows share is salted, so no task holds it whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidewell.functions.instants import read_instant
from tidewell.session import broadcast_if_small, hot_salt, materialise, replicate_hot, scratch_path

#: A pair is hot when more rows than this carry it and more than one in HOT_SHARE of all rows: fewer than HOT_SHARE pairs can be.
HOT_ROWS, HOT_SHARE = 5_000, 500


@F.pandas_udf(LongType())
def _read(raw: pd.Series, zone: pd.Series) -> pd.Series:
    return pd.Series([read_instant(a, b) for a, b in zip(raw, zone)], dtype="Int64")


class InstantDictionary:
    """Persistent dictionary (raw, zone) -> utc_us in a folder of parts, one for each named extension.

    `extend` parses only pairs that no other part holds, so a daily run pays for new spellings
    only. Every part counts its rows for each pair, so the counts are those of all extensions.
    Unreadable pairs are kept with a null instant and aren't parsed again. Repeating an extension
    replaces its part and changes nothing.
    """

    SCHEMA = "raw string, zone string, utc_us long, n long"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "instants")
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        root = fs.Path(self.path)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.names = sorted(f.getPath().getName().removeprefix("part=") for f in files.listStatus(root) if f.getPath().getName().startswith("part=") and files.exists(fs.Path(f.getPath(), "_SUCCESS"))) if files.exists(root) else []

    @property
    def parts(self) -> int:
        return len(self.names)

    def _parts(self, names: list[str]) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/part={i}" for i in names])
        return rows if len(names) == 1 else rows.groupBy("raw", "zone").agg(F.max("utc_us").alias("utc_us"), F.sum("n").alias("n"))

    def read(self) -> DataFrame:
        return self._parts(self.names) if self.names else self.spark.createDataFrame([], self.SCHEMA)

    def extend(self, stamps: DataFrame, name: str | None = None) -> DataFrame:
        """Add the pairs of stamps (raw, zone) as the extension of that name, by default the next number; give the dictionary as it is now."""
        name = str(len(self.names)) if name is None else name
        others = [p for p in self.names if p != name]
        pairs = stamps.groupBy("raw", "zone").agg(F.count(F.lit(1)).alias("n"))
        if others:
            # Known pairs keep their instant; the parser sees the others only.
            known = self._parts(others).select("raw", "zone", F.col("utc_us").alias("_known"), F.lit(True).alias("_seen"))
            pairs = materialise(pairs.join(known, ["raw", "zone"], "left"), "pairs")
            told = pairs.where("_seen").select("raw", "zone", F.col("_known").alias("utc_us"), "n").unionByName(pairs.where("_seen is null").select("raw", "zone", _read("raw", "zone").alias("utc_us"), "n"))
        else:
            told = pairs.select("raw", "zone", _read("raw", "zone").alias("utc_us"), "n")
        told.write.mode("overwrite").parquet(f"{self.path}/part={name}")
        self.names = sorted({*self.names, name})
        return self.read()


def normalise_instants(rows: DataFrame, dictionary: InstantDictionary, salts: int = 64, parts: list[str] | None = None) -> DataFrame:
    """rows (tbl, row_key, raw, zone) -> (tbl, row_key, utc_us) of every readable stamp, whole-row copies once.

    Null and blank stamps, and unreadable ones, give no row; a null zone counts as UTC. A key with
    several different readable stamps gives a row for each. Extra columns are ignored. An empty
    table gives an empty result. With `parts`, the names of tables in tbl, the dictionary is
    extended by one after the other, as it grows from day to day.
    """
    rows = rows.select("tbl", "row_key", "raw", F.coalesce("zone", F.lit("UTC")).alias("zone")).where("raw is not null")
    for part in parts or [None]:
        dictionary.extend(rows if part is None else rows.where(F.col("tbl") == part), part)
    known = dictionary.read()
    if len(dictionary.names) > 1:
        known = materialise(known, "instants")
    # The total is read from the dictionary's own counts; at most HOT_SHARE pairs can pass.
    total = known.agg(F.sum("n")).first()[0] or 0
    hot = [(r.raw, r.zone) for r in known.where(F.col("n") > F.lit(max(HOT_ROWS, total // HOT_SHARE))).select("raw", "zone").collect()]
    right = replicate_hot(known.where("utc_us is not null").select("raw", "zone", "utc_us"), hot, ["raw", "zone"], salts)
    left = rows.withColumn("salt", hot_salt(hot, ["raw", "zone"], F.col("row_key"), salts))
    return left.join(right, ["raw", "zone", "salt"]).groupBy("raw", "zone", "salt", "tbl", "row_key", "utc_us").agg(F.lit(1).alias("_one")).select("tbl", "row_key", "utc_us")


def stamps(messages: DataFrame, requests: DataFrame, watches: DataFrame, sources: DataFrame) -> DataFrame:
    """The written stamps of the three tables with the zone they are local to."""
    zones = sources.groupBy("source_id").agg(F.min("tz_name").alias("zone"))
    told = messages.select("source_id", F.col("msg_id").cast("string").alias("row_key"), F.col("datetime_iso").alias("raw")).join(broadcast_if_small(zones), "source_id", "left")
    utc = F.lit("UTC").alias("zone")
    return (
        told.select(F.lit("messages").alias("tbl"), "row_key", "raw", F.coalesce("zone", F.lit("UTC")).alias("zone"))
        .unionByName(requests.select(F.lit("ingest_requests").alias("tbl"), F.col("entry_id").cast("string").alias("row_key"), F.col("received_at").alias("raw"), utc))
        .unionByName(watches.select(F.lit("drive_watch_state").alias("tbl"), F.col("channel_id").alias("row_key"), F.col("expiration").alias("raw"), utc))
    )
