"""Neighbours through shared names: adjacency, degrees, and expansion of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T

HUB, NEIGHBOURS = 16, 30


def connectors(edges: DataFrame) -> DataFrame:
    """edges (doc, node_type, name) -> (doc, node_type, norm), spellings folded, each once."""
    return edges.where("doc is not null and name is not null").select("doc", "node_type", T.name_norm(F.col("name")).alias("norm")).where("norm <> ''").distinct()


def degrees(folded: DataFrame) -> DataFrame:
    """Documents of each name; use says whether it links (2 to HUB), ends (1) or is a hub."""
    d = folded.groupBy("node_type", "norm").agg(F.count(F.lit(1)).alias("degree"))
    return d.withColumn("use", F.when(F.col("degree") > HUB, "hub").when(F.col("degree") == 1, "dead_end").otherwise("links"))


def adjacency(folded: DataFrame) -> DataFrame:
    """(doc, neighbour, path, connector, degree) through names that aren't hubs: a self-join whose groups hold HUB documents at most."""
    use = degrees(folded).where("use = 'links'").drop("use")
    few = folded.join(use, ["node_type", "norm"])
    a, b = few.withColumnRenamed("doc", "a"), few.select("node_type", "norm", F.col("doc").alias("b"))
    return a.join(b, ["node_type", "norm"]).where("a <> b").select(F.col("a").alias("doc"), F.col("b").alias("neighbour"), F.col("node_type").alias("path"), F.col("norm").alias("connector"), "degree")


def path_weight(path, degree):
    return F.when(path == "contains", F.lit(1.0)).otherwise(1 / F.log(1 + degree))


def expand(seeds: DataFrame, near: DataFrame, most: int = NEIGHBOURS) -> DataFrame:
    """seeds (query_id, doc, seed_rank), near (doc, neighbour, path, connector, degree) -> best neighbours that are no seeds.

    Score: sum over paths of weight / seed rank, nine decimals. The path told is that of the
    largest contribution; ties go to contains before entity before topic, then by name.
    """
    order = F.when(F.col("path") == "contains", 0).when(F.col("path") == "entity", 1).otherwise(2)
    paths = seeds.join(near, "doc").join(seeds.select("query_id", F.col("doc").alias("neighbour")), ["query_id", "neighbour"], "left_anti")
    told = paths.withColumn("c", path_weight(F.col("path"), F.col("degree")) / F.col("seed_rank"))
    summed = told.groupBy("query_id", "neighbour").agg(F.array_sort(F.collect_list("c")).alias("cs"), F.min_by(F.struct("path", "connector"), F.struct(-F.round("c", 9), order, F.coalesce("connector", F.lit("")))).alias("via"))
    scored = summed.select("query_id", "neighbour", F.round(F.aggregate("cs", F.lit(0.0), lambda x, y: x + y), 9).alias("score"), "via.path", "via.connector")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def note(path, connector, seed):
    """How a neighbour was reached, in words."""
    return F.when(path == "contains", F.concat(F.lit("shared in the message that holds "), seed)).when(path == "entity", F.concat(F.lit("also mentions "), connector, F.lit(", like "), seed)).otherwise(F.concat(F.lit("also about "), connector, F.lit(", like "), seed))
