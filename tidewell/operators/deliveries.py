"""At-least-once deliveries: keep one entry of each message.

Storage is hash-bucketed by identifier and sorted in each bucket: every batch is a run of its own,
a bucketed table in a folder. Compaction merges sorted runs bucket by bucket, two by two and
without a shuffle, so that equal identifiers collapse to one row. What is kept of an identifier is
the same however often and in whatever order batches are merged. Messages are the connected groups
of these rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.components import connected_components
from tidewell.session import hot_salt, materialise, replicate_hot, scratch_path

HOT_ROWS, HOT_SHARE = 5_000, 500


def canonical_number(column) -> F.Column:
    """The digits of a whole number above 0 without leading zeros, outer white space aside; else null."""
    digits = F.regexp_extract(F.coalesce(column.cast("string"), F.lit("")), r"(?U)^\s*\+?0*([1-9][0-9]*)\s*$", 1)
    return F.when(digits != "", digits)


def identified(entries: DataFrame, tbl: str) -> DataFrame:
    """entries (entry_id, job_id, telegram_update_id, …) -> (tbl, entry_id, job, upd, ident); rows without a usable identifier fall away."""
    job, upd = canonical_number(F.col("job_id")), canonical_number(F.col("telegram_update_id").cast("decimal(38,0)"))
    return (
        entries.select(F.lit(tbl).alias("tbl"), "entry_id", job.alias("job"), upd.alias("upd"))
        .where("job is not null or upd is not null")
        .withColumn("ident", F.concat_ws("/", F.coalesce("job", F.lit("")), F.coalesce("upd", F.lit(""))))
    )


class DeliveryStore:
    """Bucketed, sorted runs of identifiers in a folder: (tbl, ident, job, upd, first_entry, last_entry, n).

    A manifest in the folder names the runs that count, so a store opened again at its path goes on
    where it was. first_entry and last_entry are the smallest and largest entry of the identifier,
    n its most entries in one run: minima and maxima, so upserting a batch again changes nothing,
    before compaction (its run is replaced) or after (it is merged into itself).
    """

    SCHEMA = "tbl string, ident string, job string, upd string, first_entry long, last_entry long, n long"
    KEYS = ("tbl", "ident")

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "deliveries")
        self.version, self.runs, kept = self._manifest()
        self.buckets = kept or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _manifest(self) -> tuple[int, list[str], int | None]:
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = fs.Path(f"{self.path}/manifest")
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = [int(f.getPath().getName()[2:]) for f in files.listStatus(root) if files.exists(fs.Path(f.getPath(), "_SUCCESS"))] if files.exists(root) else []
        if not done:
            return 0, [], None
        row = self.spark.read.schema("runs array<string>, buckets int").json(f"{self.path}/manifest/v={max(done)}").first()
        return max(done), list(row.runs), row.buckets

    def _commit(self, runs: list[str]) -> None:
        """The manifest is written last: readers see the old list or the new one."""
        self.version += 1
        self.spark.createDataFrame([(runs, self.buckets)], "runs array<string>, buckets int").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/v={self.version}")
        self.runs = runs

    def _table(self, run: str) -> str:
        return "tidewell_" + hashlib.md5(f"{self.path}/{run}".encode()).hexdigest()

    def _write(self, rows: DataFrame, run: str) -> None:
        self.spark.sql(f"drop table if exists {self._table(run)}")
        rows.write.format("parquet").mode("overwrite").bucketBy(self.buckets, *self.KEYS).sortBy(*self.KEYS).option("path", f"{self.path}/{run}").saveAsTable(self._table(run))

    def upsert(self, identified_rows: DataFrame, run: str) -> None:
        """Add a batch as one run. Partial aggregation comes before the one shuffle, whose partitions are the buckets."""
        merged = identified_rows.groupBy(*self.KEYS).agg(F.first("job").alias("job"), F.first("upd").alias("upd"), F.min("entry_id").alias("first_entry"), F.max("entry_id").alias("last_entry"), F.count(F.lit(1)).alias("n"))
        self._write(merged, f"run={run}")
        if f"run={run}" not in self.runs:
            self._commit([*self.runs, f"run={run}"])

    def _run(self, run: str) -> DataFrame:
        self.spark.sql(f"create table if not exists {self._table(run)} ({self.SCHEMA}) using parquet clustered by (tbl, ident) sorted by (tbl, ident) into {self.buckets} buckets location '{self.path}/{run}'")
        return self.spark.table(self._table(run))

    def _merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two sorted runs as one: both lie in the same buckets, so a merge join needs no shuffle."""
        x, y = a.alias("x"), b.alias("y")
        either = lambda c: (F.coalesce(F.col(f"x.{c}"), F.col(f"y.{c}")), F.coalesce(F.col(f"y.{c}"), F.col(f"x.{c}")))
        told = [either(c)[0].alias(c) for c in ("job", "upd")] + [F.least(*either("first_entry")).alias("first_entry")] + [F.greatest(*either(c)).alias(c) for c in ("last_entry", "n")]
        return x.hint("merge").join(y, list(self.KEYS), "full").select(*self.KEYS, *told)

    def read(self) -> DataFrame:
        """One row for each identifier, whether or not the runs were merged before."""
        return reduce(self._merge, [self._run(r) for r in self.runs]) if self.runs else self.spark.createDataFrame([], self.SCHEMA)

    def compact(self) -> DataFrame:
        """Merge the runs two by two into one base in which every identifier has one row; the merged runs are left to whoever still reads them."""
        runs, step = self.runs, 0
        while len(runs) > 1:
            merged = []
            for a, b in zip(runs[::2], runs[1::2]):
                step += 1
                self._write(self._merge(self._run(a), self._run(b)), f"base={self.version + 1}-{step}")
                merged.append(f"base={self.version + 1}-{step}")
            runs = merged + runs[len(merged) * 2 :]
        if runs != self.runs:
            self._commit(runs)
        return self.read()


def message_roots(keys: DataFrame) -> DataFrame:
    """keys (tbl, ident, job, upd, first_entry, last_entry, n) -> (tbl, ident, first_entry, last_entry, n, root): the smallest entry of each connected group.

    Only keys that share one of their identifiers with another key are linked, each to the smallest
    of those that have it; a key without the identifier takes no part. The groups are connected
    components of these links, whose number grows with the keys, not with their pairs.
    """
    node = F.struct("tbl", F.col("first_entry").alias("entry"))
    links = []
    for c in ("job", "upd"):
        held = keys.where(F.col(c).isNotNull()).select("tbl", c, "first_entry")
        low = held.groupBy("tbl", c).agg(F.min("first_entry").alias("low"), F.count(F.lit(1)).alias("k")).where("k > 1").select("tbl", c, "low")
        links.append(held.join(low, ["tbl", c]).select(node.alias("a"), F.struct("tbl", F.col("low").alias("entry")).alias("b")))
    roots = connected_components(reduce(DataFrame.union, links)).select("node.tbl", F.col("node.entry").alias("first_entry"), F.col("root.entry").alias("root"))
    return keys.join(roots, ["tbl", "first_entry"], "left").select("tbl", "ident", "first_entry", "last_entry", "n", F.coalesce("root", "first_entry").alias("root"))


def surplus_entries(streams: dict[str, DataFrame], store: DeliveryStore | None = None, salts: int = 64) -> DataFrame:
    """(tbl, entry_id) of all entries of a message but the one with the smallest entry_id in its stream.

    Entries of one stream are the same message if they share a job_id or telegram_update_id,
    directly or through others. An identifier counts only if it is a whole number above 0, outer
    white space aside, compared as a number; entries without one are messages of their own. Null
    entry_ids are ignored, entries repeated whole count once; empty streams give no rows.
    """
    rows = reduce(DataFrame.unionByName, [identified(df, name) for name, df in streams.items()]).where("entry_id is not null")
    spark = rows.sparkSession
    store = store or DeliveryStore(spark)
    for name, df in streams.items():
        store.upsert(identified(df, name).where("entry_id is not null"), name)
    repeated = materialise(message_roots(store.compact()).where("last_entry <> first_entry or root <> first_entry"), "roots")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    hot = [(r.tbl, r.ident) for r in repeated.where(F.col("n") > F.lit(max(HOT_ROWS, total // HOT_SHARE))).select("tbl", "ident").collect()]
    right = replicate_hot(repeated.select("tbl", "ident", "root"), hot, ["tbl", "ident"], salts)
    left = rows.withColumn("salt", hot_salt(hot, ["tbl", "ident"], F.col("entry_id"), salts))
    return left.join(right, ["tbl", "ident", "salt"]).where("entry_id <> root").select("tbl", "entry_id").distinct()
