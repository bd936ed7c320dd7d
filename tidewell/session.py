"""Session factory, scratch tables in the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes above which a table is never broadcast by hint.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 256 << 20


def session(app: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: AQE, UTC, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a session in one process (tests) gets a folder of its own; on a cluster it is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc.getCheckpointDir()
    if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="tidewell-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{scratch_root(spark)}/tidewell/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when df was counted and is within max_rows and BROADCAST_BYTES; else leave the join to Catalyst.

    Bytes are those of the rows as JSON, summed in the pass that counts.
    """
    wide = [f.name for f in df.schema if f.dataType.typeName() in ("string", "array", "struct", "map", "binary")]
    size = F.sum(F.octet_length(F.to_json(F.struct(*wide)))) if wide else F.lit(0)
    told = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), size.alias("b")).first()
    return F.broadcast(df) if told.n <= max_rows and (told.b or 0) <= BROADCAST_BYTES else df


def hot_salt(hot: list[tuple], keys: list[str], spread, salts: int = 64):
    """Column: 0 for ordinary keys; for the given hot keys a value in 0..salts-1 taken from `spread`."""
    if not hot:
        return F.lit(0)
    is_hot = F.struct(*keys).isin([F.struct(*[F.lit(v) for v in k]) for k in hot]) if len(keys) > 1 else F.col(keys[0]).isin([k[0] for k in hot])
    return F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))


def replicate_hot(df: DataFrame, hot: list[tuple], keys: list[str], salts: int = 64) -> DataFrame:
    """The small side of a salted join: one copy of each hot row per salt, one of every other row."""
    if not hot:
        return df.withColumn("salt", F.lit(0))
    is_hot = F.struct(*keys).isin([F.struct(*[F.lit(v) for v in k]) for k in hot]) if len(keys) > 1 else F.col(keys[0]).isin([k[0] for k in hot])
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("salt", F.explode(copies))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a small input comes in fewer parts than there are; a large one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(3 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of earlier jobs; call it only when no result that reads them is still to be computed."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = fs.Path(f"{scratch_root(spark)}/tidewell")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
