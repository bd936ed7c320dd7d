"""Queries on neighbours through shared names: links and the messages that hold them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import expansion as E
from tidewell.tables import table


def _edges(spark, sf_dir):
    s = table(spark, sf_dir, "scraped_links", "link_id", "entities", "topics")
    return s.select(F.col("link_id").alias("doc"), F.lit("entity").alias("node_type"), F.explode("entities").alias("name")).unionByName(s.select(F.col("link_id").alias("doc"), F.lit("topic").alias("node_type"), F.explode("topics").alias("name")))


def _near(spark, sf_dir):
    """Adjacency through names, and both ways between links of one message."""
    held = table(spark, sf_dir, "scraped_links", "link_id", "message_context").select("link_id", F.col("message_context.msg_id").alias("m")).where("m is not null").distinct()
    pairs = held.alias("a").join(held.alias("b"), F.col("a.m") == F.col("b.m")).where("a.link_id <> b.link_id")
    contains = pairs.select(F.col("a.link_id").alias("doc"), F.col("b.link_id").alias("neighbour"), F.lit("contains").alias("path"), F.lit("").alias("connector"), F.lit(2).cast("long").alias("degree"))
    return E.adjacency(E.connectors(_edges(spark, sf_dir))).unionByName(contains.distinct())


def _seeds(spark, sf_dir):
    """For every link whose id is divisible by 20: itself and the next link."""
    s = table(spark, sf_dir, "scraped_links", "link_id").distinct()
    q = s.where("link_id % 20 = 0").select(F.col("link_id").alias("query_id"))
    both = q.select("query_id", F.col("query_id").alias("doc"), F.lit(1).alias("seed_rank")).unionByName(q.select("query_id", (F.col("query_id") + 1).alias("doc"), F.lit(2).alias("seed_rank")))
    return both.join(s.withColumnRenamed("link_id", "doc"), "doc", "left_semi")


def connector_degree(spark, sf_dir):
    return E.degrees(E.connectors(_edges(spark, sf_dir)))


def degree_histogram(spark, sf_dir):
    return connector_degree(spark, sf_dir).groupBy("node_type", "degree").agg(F.count(F.lit(1)).alias("n"))


def adjacency(spark, sf_dir):
    return E.adjacency(E.connectors(_edges(spark, sf_dir)))


def expand_results(spark, sf_dir):
    return E.expand(_seeds(spark, sf_dir), _near(spark, sf_dir))


def dead_ends(spark, sf_dir):
    folded = E.connectors(_edges(spark, sf_dir))
    lone = E.degrees(folded).where("use = 'dead_end'").select("node_type", "norm")
    return folded.join(lone, ["node_type", "norm"]).groupBy("doc", "node_type").agg(F.count(F.lit(1)).alias("n"))


def expansion_notes(spark, sf_dir):
    found = E.expand(_seeds(spark, sf_dir), _near(spark, sf_dir), 5)
    return found.select("query_id", "neighbour", "rank", E.note(F.col("path"), F.col("connector"), F.concat(F.lit("link "), F.col("query_id").cast("string"))).alias("note"))


def denormalised_text(spark, sf_dir):
    """Messages with the titles of the links they hold, in order of link: the text an index would embed."""
    held = table(spark, sf_dir, "scraped_links", "link_id", "title", "message_context").select("link_id", "title", F.col("message_context.msg_id").alias("msg_id")).where("msg_id is not null and title is not null").distinct()
    titles = held.groupBy("msg_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("link_id", "title"))), lambda x: x["title"]), " / ").alias("titles"))
    m = table(spark, sf_dir, "messages", "msg_id", "text").where("text is not null").distinct()
    return m.join(titles, "msg_id").select("msg_id", F.concat(F.col("text"), F.lit('\n[shared link: "'), F.col("titles"), F.lit('"]')).alias("embedded_text"))


QUERIES = {f.__name__: f for f in (connector_degree, degree_histogram, adjacency, expand_results, dead_ends, expansion_notes, denormalised_text)}

_BASE = r"""e as (select distinct doc, node_type, regexp_replace(lower(regexp_replace(name, '^\s+|\s+$', '', 'g')), '[\s_-]+', ' ', 'g') as norm from (select link_id as doc, 'entity' as node_type, unnest(entities) as name from scraped_links union all select link_id, 'topic', unnest(topics) from scraped_links) where name is not null),
f as (select * from e where norm <> ''),
dg as (select node_type, norm, count(*) as degree from f group by all),
adj as (select a.doc, b.doc as neighbour, node_type as path, norm as connector, degree from f a join f b using (node_type, norm) join dg using (node_type, norm) where a.doc <> b.doc and degree between 2 and 16)"""
_EXPAND = """, h as (select distinct link_id, message_context.msg_id as m from scraped_links where message_context.msg_id is not null),
near as (select * from adj union all select distinct a.link_id, b.link_id, 'contains', '', 2 from h a join h b using (m) where a.link_id <> b.link_id),
sd as (select distinct q.link_id as query_id, s.link_id as doc, s.link_id - q.link_id + 1 as seed_rank from scraped_links q join scraped_links s on s.link_id in (q.link_id, q.link_id + 1) where q.link_id % 20 = 0),
pt as (select query_id, neighbour, path, connector, (case when path = 'contains' then 1.0::double else 1 / ln(1 + degree) end) / seed_rank as c from sd join near using (doc) where (query_id, neighbour) not in (select (query_id, doc) from sd)),
sc as (select query_id, neighbour, round(sum(c), 9) as score, arg_min({'p': path, 'c': connector}, (-round(c, 9), case path when 'contains' then 0 when 'entity' then 1 else 2 end, connector)) as via from pt group by all),
ex as (select query_id, neighbour, score, via.p as path, via.c as connector, row_number() over (partition by query_id order by score desc, neighbour) as rank from sc)"""

ORACLE_SQL = {
    "connector_degree": f"with {_BASE} select node_type, norm, degree, case when degree > 16 then 'hub' when degree = 1 then 'dead_end' else 'links' end as use from dg",
    "degree_histogram": f"with {_BASE} select node_type, degree, count(*) as n from dg group by all",
    "adjacency": f"with {_BASE} select * from adj",
    "expand_results": f"with {_BASE}{_EXPAND} select * from ex where rank <= 30",
    "dead_ends": f"with {_BASE} select doc, node_type, count(*) as n from f join dg using (node_type, norm) where degree = 1 group by all",
    "expansion_notes": f"with {_BASE}{_EXPAND} select query_id, neighbour, rank, case path when 'contains' then 'shared in the message that holds link ' || query_id when 'entity' then 'also mentions ' || connector || ', like link ' || query_id else 'also about ' || connector || ', like link ' || query_id end as note from ex where rank <= 5",
    "denormalised_text": "with h as (select distinct link_id, title, message_context.msg_id as msg_id from scraped_links where message_context.msg_id is not null and title is not null), t as (select msg_id, string_agg(title, ' / ' order by link_id) as titles from h group by 1) select distinct m.msg_id, text || chr(10) || '[shared link: \"' || titles || '\"]' as embedded_text from messages m join t using (msg_id) where text is not null",
}
