"""Expansion systems: from results, from the query, from payloads; pools, glued texts, and the decision between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators.expansion import HUB, NEIGHBOURS
from tidewell.session import broadcast_if_small

SEEDS, NODES, BUDGET, RELEVANT, DELTA = 10, 5, 256, 2, 0.02
# Wins that beat, without a loss, by number of answerable queries.
SCOREBOARD = {8: 7, 7: 7, 6: 6, 5: 5}


def connector_nodes(edges: DataFrame) -> DataFrame:
    """edges (doc, node_type, name) -> (node_type, norm, raw_names, docs, degree): spellings of a name merged, its documents once each.

    docs is kept up to HUB documents, beyond which a name links nothing; degree counts all.
    """
    each = edges.where("doc is not null and name is not null").select("doc", "node_type", "name", T.name_norm(F.col("name")).alias("norm")).where("norm <> ''")
    names = each.select("node_type", "norm", "name").distinct().groupBy("node_type", "norm").agg(F.array_sort(F.collect_set("name")).alias("raw_names"))
    docs = each.select("node_type", "norm", "doc").distinct()
    degree = docs.groupBy("node_type", "norm").agg(F.count(F.lit(1)).alias("degree"))
    listed = docs.join(degree.where(F.col("degree") <= HUB), ["node_type", "norm"]).groupBy("node_type", "norm").agg(F.array_sort(F.collect_list("doc")).alias("docs"))
    return names.join(degree, ["node_type", "norm"]).join(listed, ["node_type", "norm"], "left").select("node_type", "norm", "raw_names", F.coalesce("docs", F.array().cast("array<bigint>")).alias("docs"), "degree")


def _best(contributions: DataFrame, by: str, order, most: int) -> DataFrame:
    """(query_id, doc, c, path, connector) -> the best documents of each query with the path of the largest contribution."""
    summed = contributions.groupBy("query_id", "doc").agg(F.array_sort(F.collect_list("c")).alias("cs"), F.min_by(F.struct("path", "connector"), F.struct(-F.round("c", 9), order, "connector")).alias("via"))
    scored = summed.select("query_id", "doc", F.round(F.aggregate("cs", F.lit(0.0), lambda x, y: x + y), 9).alias("score"), "via.path", "via.connector")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def start_nodes(nodes: DataFrame, node_vectors: DataFrame, query_vectors: DataFrame, k: int = NODES) -> DataFrame:
    """nodes (node_type, norm, degree, docs), vectors (key = node_type/norm) and (query_id, embedding) -> the k nodes nearest to each query, hubs left out first.

    All queries are compared with every usable node; each partition keeps the best of its own.
    """
    usable = nodes.where(F.col("degree") <= HUB).withColumn("key", F.concat_ws("/", "node_type", "norm")).join(node_vectors.where("embedding is not null"), "key")
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    asked = broadcast_if_small(query_vectors.where("embedding is not null").select("query_id", F.col("embedding").alias("q")), 10_000)
    near = usable.join(asked, F.lit(True)).select("query_id", "node_type", "norm", "degree", F.round(dot, 6).alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "node_type", "norm"))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def expand_from_query(starts: DataFrame, nodes: DataFrame, exclude: DataFrame, most: int = NEIGHBOURS) -> DataFrame:
    """Documents of the start nodes by cosine over ln(1 + degree), those of exclude (query_id, doc) left out; a node of one document is a direct hit."""
    held = starts.join(nodes.select("node_type", "norm", F.explode("docs").alias("doc")), ["node_type", "norm"])
    told = held.join(exclude, ["query_id", "doc"], "left_anti").select("query_id", "doc", (F.col("cosine") / F.log(1 + F.col("degree"))).alias("c"), F.concat(F.lit("query_"), "node_type").alias("path"), F.col("norm").alias("connector"))
    return _best(told, "c", F.when(F.col("path") == "query_entity", 1).otherwise(2), most)


def payload_expand(seeds: DataFrame, payload: DataFrame, exclude: DataFrame, most: int = NEIGHBOURS) -> DataFrame:
    """seeds (query_id, doc, seed_rank), payload (doc, node_type, name): neighbours that carry the same names, degrees counted in the payload alone."""
    folded = payload.where("doc is not null and name is not null").select("doc", "node_type", T.name_norm(F.col("name")).alias("norm")).distinct()
    degree = folded.groupBy("node_type", "norm").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") <= HUB)
    few = folded.join(degree, ["node_type", "norm"])
    paths = seeds.join(few, "doc").select("query_id", "seed_rank", "node_type", "norm", "degree").join(few.select("node_type", "norm", "doc"), ["node_type", "norm"])
    told = paths.join(exclude, ["query_id", "doc"], "left_anti").select("query_id", "doc", (1 / F.log(1 + F.col("degree")) / F.col("seed_rank")).alias("c"), F.concat(F.lit("payload_"), "node_type").alias("path"), F.col("norm").alias("connector"))
    return _best(told, "c", F.when(F.col("path") == "payload_entity", 1).otherwise(2), most)


def note(path, connector, seed):
    """How a neighbour was reached, by the five templates; null where there is no path."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return (
        F.when(path == "contains", F.concat(F.lit("shared in the same message as "), quoted(seed)))
        .when(path == "entity", F.concat(F.lit("both mention "), quoted(connector), F.lit(", like "), quoted(seed)))
        .when(path == "topic", F.concat(F.lit("both about "), quoted(connector), F.lit(", like "), quoted(seed)))
        .when(path == "query_entity", F.concat(F.lit("mentions "), quoted(connector)))
        .when(path == "query_topic", F.concat(F.lit("about "), quoted(connector)))
    )


def seed_label(kind, title, text):
    """A link goes by its title, a message by its first 80 characters."""
    return F.when(kind == "link", F.coalesce(title, F.lit(""))).otherwise(F.substring(F.coalesce(text, F.lit("")), 1, 80))


def with_note(text, told):
    return F.when(told.isNull(), text).otherwise(F.concat(F.lit("[connected: "), told, F.lit("] "), text))


def glued_texts(messages: DataFrame, held: DataFrame, budget: int = BUDGET) -> DataFrame:
    """messages (doc, text), held (doc, link, link_text) -> (doc, full_text, trimmed_text, links_trimmed, links_dropped).

    A message is followed by the texts of its links in order of link. The trimmed text, the one to
    embed, has at most `budget` words in all, one more being charged for each seam; a link that
    keeps a part is trimmed, one that keeps nothing is dropped. Sizes are counted in words.
    """
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    links = held.where("link is not null").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("link", F.coalesce("link_text", F.lit("")).alias("t")))).alias("ls"))
    rows = messages.join(links, "doc", "left").select("doc", F.coalesce("text", F.lit("")).alias("text"), F.transform(F.coalesce("ls", F.array().cast("array<struct<link:bigint,t:string>>")), lambda x: x["t"]).alias("ls"))
    start = F.struct(F.col("text").alias("out"), F.size(words(F.col("text"))).alias("used"), F.lit(0).alias("trimmed"), F.lit(0).alias("dropped"))

    def step(acc, t):
        room, w = F.lit(budget) - acc["used"] - 1, words(t)
        none, whole = room <= 0, F.size(w) <= room
        part = F.when(whole, t).otherwise(F.array_join(F.slice(w, 1, F.greatest(room, F.lit(1))), " "))
        return F.struct(F.when(none, acc["out"]).otherwise(F.concat(acc["out"], F.lit(" "), part)).alias("out"), F.when(none, acc["used"]).otherwise(acc["used"] + 1 + F.least(F.size(w), room)).alias("used"), (acc["trimmed"] + F.when(~none & ~whole, 1).otherwise(0)).alias("trimmed"), (acc["dropped"] + F.when(none, 1).otherwise(0)).alias("dropped"))

    folded = rows.select("doc", F.concat_ws(" ", F.array("text"), "ls").alias("full_text"), F.aggregate("ls", start, step).alias("a"))
    return folded.select("doc", "full_text", F.col("a.out").alias("trimmed_text"), F.col("a.trimmed").alias("links_trimmed"), F.col("a.dropped").alias("links_dropped"))


def pools(base: DataFrame, added: dict[str, DataFrame]) -> DataFrame:
    """(system, query_id, doc): the base results of each query and what each system adds to them."""
    b = base.select("query_id", "doc")
    return reduce(DataFrame.unionByName, [b.unionByName(rows.select("query_id", "doc")).distinct().select(F.lit(name).alias("system"), "query_id", "doc") for name, rows in added.items()])


def path_split(run: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """run (query_id, doc, rank, path), qrels (query_id, doc, relevance) -> (path, hits, share): by which paths the relevant ones among each query's first k came."""
    hits = run.where((F.col("rank") <= k) & F.col("path").isNotNull()).join(qrels.where(F.col("relevance") >= RELEVANT), ["query_id", "doc"], "left_semi")
    by = hits.groupBy("path").agg(F.count(F.lit(1)).alias("hits"))
    return by.join(F.broadcast(by.agg(F.sum("hits").alias("total"))), F.lit(True)).select("path", "hits", F.round(F.col("hits") / F.col("total"), 6).alias("share"))


def beats(n, wins, losses):
    """Whether a system beats another on few queries: no loss and the wins the board asks for; null where there are too few."""
    need = F.coalesce(*[F.when(n == k, F.lit(v)) for k, v in SCOREBOARD.items()])
    return F.when(n <= 4, F.lit(None).cast("boolean")).otherwise((losses == 0) & (wins >= need))


def improves(verdict, mean_delta):
    """Whether a system beats another on the large set: the interval lies above zero and the mean gains enough."""
    return (verdict == "improved") & (mean_delta >= DELTA)


def branch(over_pool, over_shortcuts):
    """What follows from beating the deeper pool and the shortcuts; null verdicts are too few queries."""
    return F.when(over_pool.isNull() | over_shortcuts.isNull(), "TOO FEW TO DECIDE").when(~over_pool, "GRAPH OUT").when(~over_shortcuts, "SHIP THE SHORTCUT(S)").otherwise("GRAPH STAYS")
