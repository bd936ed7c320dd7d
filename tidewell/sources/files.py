"""Readers: chat exports (plain or zipped), JSON and CSV with declared schemas, query sets and judgments."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES = T.StructType([T.StructField(c, T.StringType()) for c in ("query_id", "query_text", "intent", "origin", "split", "notes")])
QRELS = T.StructType([T.StructField(c, T.StringType()) for c in ("query_id", "candidate_id", "relevance", "answer_bearing")])


def export_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of chat exports as (source_id, line_no, line), source_id the file's name.

    A file is one text; its lines are numbered in order. Use for files of up to some hundred MB each.
    """
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_id"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    return whole.select("source_id", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).select("source_id", F.col("line_no").cast("long").alias("line_no"), "line")


def zipped_export_lines(spark: SparkSession, path: str) -> DataFrame:
    """As export_lines, from the first .txt member of each archive; broken archives give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        member = next((m for m in z.namelist() if m.lower().endswith(".txt")), None)
                        lines = re.split("\r\n?|\n", z.read(member).decode("utf-8", "replace")) if member else []
                except zipfile.BadZipFile:
                    lines = []
                if lines:
                    yield pd.DataFrame({"source_id": [name.rsplit("/", 1)[-1]] * len(lines), "line_no": [*range(len(lines))], "line": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "source_id string, line_no long, line string")


def json_list(spark: SparkSession, path: str, schema, strict: bool = False) -> DataFrame:
    """A file that holds a list of objects; strict fails on bad records, else they are dropped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """CSV of queries; rows without id are skipped, a query without text is an error."""
    rows = spark.read.schema(QUERIES).option("header", True).option("multiLine", True).option("escape", '"').csv(path).where("query_id is not null and trim(query_id) <> ''")
    return rows.withColumn("query_text", F.when(F.trim("query_text") != "", F.col("query_text")).otherwise(F.raise_error(F.concat(F.lit("empty query_text: "), "query_id"))))


def judgments(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """CSV of judgments; a blank grade is unjudged and dropped, anything but 0 to 3 or an unknown id is an error."""
    rows = spark.read.schema(QRELS).option("header", True).csv(path).where("relevance is not null and trim(relevance) <> ''")
    grade = F.expr("try_cast(trim(relevance) as int)")
    rows = rows.select("query_id", "candidate_id", F.when(grade.between(0, 3), grade).otherwise(F.raise_error(F.concat(F.lit("bad grade: "), "relevance")).cast("int")).alias("relevance"))
    if known is not None:
        stray = rows.join(known.select("candidate_id"), "candidate_id", "left_anti").limit(5).collect()
        if stray:
            raise ValueError(f"unknown candidates: {[r.candidate_id for r in stray]}")
    return rows
