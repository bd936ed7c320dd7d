"""Writers: keyed merges into versioned tables, JSON and CSV, appends that happen once, checked tables, reports, and a lock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """A table in a folder of versions; readers see the old or the new one whole.

    `merge` keeps, per key, the row with the highest (version column, batch); a batch merged twice
    changes nothing. The pointer is a one-row table written last.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str):
        self.spark, self.path, self.key, self.order = spark, path, key, order

    def version(self) -> int:
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = fs.Path(self.path)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return 0
        done = [int(f.getPath().getName()[2:]) for f in files.listStatus(root) if f.getPath().getName().startswith("v=") and files.exists(fs.Path(f.getPath(), "_SUCCESS"))]
        return max(done, default=0)

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.path}/v={v}") if v else None

    def merge(self, batch: DataFrame) -> DataFrame:
        """Last write wins by `order`; ties keep what is there. Null keys are refused."""
        v, old = self.version(), self.read()
        rows = batch.where(F.col(self.key).isNotNull()).withColumn("_new", F.lit(0))
        both = rows if old is None else rows.unionByName(old.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        rest = [c for c in both.columns if c not in (self.key, "_new")]
        best = both.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(F.col(self.order), F.col("_new"))).alias("_r")).select(self.key, "_r.*")
        best.write.mode("overwrite").parquet(f"{self.path}/v={v + 1}")
        return self.read()


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_once(df: DataFrame, path: str, batch_id: int, by: list[str] | None = None) -> None:
    """Append a batch under its number, in folders by the columns of `by`; a repeated batch replaces its own rows."""
    df.write.mode("overwrite").partitionBy(*(by or [])).parquet(f"{path}/batch_id={batch_id}")


def append_section(df: DataFrame, path: str, name: str) -> None:
    """Add a section that must not be there yet; a second one of the name is refused and changes nothing."""
    df.write.mode("errorifexists").json(f"{path}/section={name}")


def publish(df: DataFrame, path: str) -> None:
    """Rows as JSON messages with one column `data`, appended; readers take them as files of a stream."""
    df.select(F.to_json(F.struct(*df.columns)).alias("data")).write.mode("append").text(path)


def write_checked(df: DataFrame, path: str, key: str) -> int:
    """Write df with a checksum of its rows, which doesn't depend on their order; the checksum comes back."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    told = checksum(df.sparkSession.read.parquet(f"{path}/rows"), key)
    df.sparkSession.createDataFrame([(str(told),)], "checksum string").coalesce(1).write.mode("overwrite").json(f"{path}/checksum")
    return told


def read_checked(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows of write_checked; fails where they aren't the ones that were written."""
    df, want = spark.read.parquet(f"{path}/rows"), spark.read.schema("checksum string").json(f"{path}/checksum").first().checksum
    if str(checksum(df, key)) != want:
        raise ValueError(f"{path}: the rows aren't those that were written")
    return df


def checksum(df: DataFrame, key: str) -> int:
    """A sum over hashes of whole rows: any row changed, lost or doubled changes it."""
    part = F.conv(F.substring(F.sha2(F.to_json(F.struct(F.col(key), *[F.col(c) for c in sorted(df.columns) if c != key])), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return int(df.agg(F.sum(part).alias("s")).first().s or 0)


def resumed(spark: SparkSession, path: str, build) -> DataFrame:
    """The result of a stage: read where an earlier run has finished it, else built and written."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    done = fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class Lock:
    """One writer at a time: a file in the shared folder that only one can create."""

    def __init__(self, spark: SparkSession, path: str):
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = fs.Path(path)
        self._files = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def __enter__(self) -> Lock:
        if not self._files.createNewFile(self._path):
            raise RuntimeError(f"{self._path} is held by another writer")
        return self

    def __exit__(self, *_) -> None:
        self._files.delete(self._path, False)


def report(title: str, sections: dict[str, DataFrame], rows: int = 50) -> str:
    """A report in Markdown: each section the first rows of a small table, and how many more there are."""
    out = [f"# {title}"]
    for name, df in sections.items():
        found = df.limit(rows + 1).collect()
        cell = lambda v: "" if v is None else f"{v:g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
        out += [f"## {name}", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in found[:rows])]
        if len(found) > rows:
            out.append(f"({df.count() - rows} more rows)")
    return "\n\n".join(["\n".join(x) for x in _blocks(out)]) + "\n"


def _blocks(lines: list[str]) -> list[list[str]]:
    blocks: list[list[str]] = []
    for line in lines:
        if line.startswith("#") or not blocks or blocks[-1][-1].startswith("#") or not line.startswith("|"):
            blocks.append([line])
        else:
            blocks[-1].append(line)
    return blocks
