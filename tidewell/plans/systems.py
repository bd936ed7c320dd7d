"""Queries on search with payload filters and on the expansion systems.

Documents stand for what they are made of: a message for the message of that id, a link for the
scraped link of that id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import models as M
from tidewell.operators import retrieval as R
from tidewell.operators import systems as Y
from tidewell.plans.retrieval import _Q, _V, BOTH, _both, _docs, _queries, _tok, _vectors, bm25_cte, cosine_cte, rrf_cte
from tidewell.session import broadcast_if_small, materialise
from tidewell.tables import table

MIN_QUALITY, MIN_SCORE, GRAPH_SCALE = 3, 0.25, 0.5


def _names(spark, sf_dir) -> DataFrame:
    """(doc, node_type, name) of all documents."""
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), "candidate_type")
    g = table(spark, sf_dir, "grades", "msg_id", "topics").select(F.lit("message").alias("candidate_type"), F.col("msg_id").alias("doc"), F.lit("topic").alias("node_type"), F.explode("topics").alias("name"))
    s = table(spark, sf_dir, "scraped_links", "link_id", "topics", "entities")
    one = lambda c, kind: s.select(F.lit("link").alias("candidate_type"), F.col("link_id").alias("doc"), F.lit(kind).alias("node_type"), F.explode(c).alias("name"))
    return reduce(DataFrame.unionByName, [g, one("topics", "topic"), one("entities", "entity")]).distinct().join(d, ["doc", "candidate_type"], "left_semi").select("doc", "node_type", "name")


def _points(spark, sf_dir) -> DataFrame:
    """Documents with the payload a filter looks at."""
    quality = table(spark, sf_dir, "grades", "grade_id", "msg_id", "quality").groupBy(F.col("msg_id").alias("doc_id")).agg(F.max("quality").alias("quality"))
    return _docs(spark, sf_dir).select("doc_id", "text", "candidate_type").join(quality, "doc_id", "left").withColumn("quality", F.when(F.col("candidate_type") == "message", F.col("quality")))


def passes(kind, quality, least: int):
    """Quality holds for messages only, and one without counts as 0."""
    return (kind != "message") | (F.coalesce(quality, F.lit(0)) >= least)


def search_filtered(spark, sf_dir):
    """The standard search among documents that pass the filter: it comes before statistics and before the best are taken."""
    q, qv, v = _both(spark, sf_dir)
    kept = _points(spark, sf_dir).where(passes(F.col("candidate_type"), F.col("quality"), MIN_QUALITY)).select("doc_id", "text")
    return R.s2(kept, v.join(kept.select("doc_id"), "doc_id", "left_semi"), q, qv)


def search_terms(spark, sf_dir):
    """The words the older search looks for in each query."""
    return _queries(spark, sf_dir).select("query_id", F.array_join(T.search_terms(F.col("query_text")), " ").alias("terms"))


def _lexical(spark, sf_dir) -> DataFrame:
    """(query_id, doc_id) of documents whose text holds a word of the query anywhere."""
    q, _, _ = _both(spark, sf_dir)
    asked = q.select("query_id", T.search_terms(F.col("query_text")).alias("terms")).where("size(terms) > 0")
    docs = _points(spark, sf_dir).where(passes(F.col("candidate_type"), F.col("quality"), MIN_QUALITY)).select("doc_id", F.lower("text").alias("t"))
    return docs.join(broadcast_if_small(asked, 10_000), F.exists("terms", lambda w: F.col("t").contains(w))).select("query_id", "doc_id")


def lexical_run(spark, sf_dir):
    """Documents that hold query words, by how many different ones, then by id: a ranking of 30."""
    q, _, _ = _both(spark, sf_dir)
    words = q.select("query_id", F.array_distinct(T.search_terms(F.col("query_text"))).alias("terms"))
    hits = _lexical(spark, sf_dir).join(words, "query_id").join(_docs(spark, sf_dir).select("doc_id", F.lower("text").alias("t")), "doc_id")
    return R.top_ranked(hits.select("query_id", "doc_id", F.size(F.filter("terms", lambda w: F.col("t").contains(w))).cast("double").alias("score")))


def legacy_search(spark, sf_dir):
    """The older search: cosine results that pass the filter, ten at most, and lexical ones at half the best score; each url once, at least 0.25, ten in all."""
    q, qv, v = _both(spark, sf_dir)
    ok = _points(spark, sf_dir).where(passes(F.col("candidate_type"), F.col("quality"), MIN_QUALITY))
    near = R.cosine(v, qv, 20).join(ok.select("doc_id"), "doc_id", "left_semi")
    semantic = R.top_ranked(near.select("query_id", "doc_id", F.round("score", 4).alias("score")), 10).withColumn("source", F.lit(0))
    best = q.select("query_id").join(semantic.groupBy("query_id").agg(F.max("score").alias("best")), "query_id", "left")
    found = _lexical(spark, sf_dir).join(semantic.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").join(best, "query_id")
    graph = found.select("query_id", "doc_id", F.round(GRAPH_SCALE * F.coalesce("best", F.lit(1.0)), 4).alias("score"), F.lit(1).alias("source"))
    urls = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.links_in(F.coalesce("text", F.lit(""))).alias("urls"))
    both = semantic.select("query_id", "doc_id", "score", "source").unionByName(graph).join(urls, "doc_id")
    kept = R.url_deduplicated(both.select("query_id", "doc_id", "score", "source", "urls"), MIN_SCORE)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "doc_id"))
    return kept.withColumn("rank", rank.cast("long")).where("rank <= 10").select("query_id", "doc_id", "score", "rank")


def result_details(spark, sf_dir):
    """Results with what is looked up for them alone: the links of a message, the earliest message of a link; neither look-up drops a row."""
    q, qv, v = _both(spark, sf_dir)
    top = R.fuse([R.cosine(v, qv), R.bm25(_docs(spark, sf_dir), q)], 5).join(_docs(spark, sf_dir).select("doc_id", "candidate_type"), "doc_id")
    s = table(spark, sf_dir, "scraped_links", "link_id", "url", "message_context").select("link_id", "url", F.col("message_context.msg_id").alias("m"), F.col("message_context.sent_at").alias("at")).distinct()
    links = s.where("m is not null and url is not null").groupBy(F.col("m").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_set("url")), " ").alias("related")).withColumn("candidate_type", F.lit("message"))
    first = s.groupBy(F.col("link_id").alias("doc_id")).agg(F.min("at").alias("first_sent_at")).withColumn("candidate_type", F.lit("link"))
    return top.join(links, ["doc_id", "candidate_type"], "left").join(first, ["doc_id", "candidate_type"], "left").select("query_id", "rank", "doc_id", "candidate_type", F.coalesce("related", F.lit("")).alias("related"), F.coalesce("first_sent_at", F.lit("")).alias("first_sent_at"))


def whole_corpus_run(spark, sf_dir):
    """Every vector ranked for every query: rows and different documents, which must both be all there are."""
    _, qv, v = _both(spark, sf_dir)
    n = v.count()
    return R.cosine(v, qv, n).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"), F.max("rank").alias("last_rank")).withColumn("complete", F.col("docs") == F.lit(n))


def connector_nodes(spark, sf_dir):
    return Y.connector_nodes(_names(spark, sf_dir)).select("node_type", "norm", F.array_join("raw_names", "|").alias("raw_names"), F.array_join(F.transform("docs", lambda x: x.cast("string")), ",").alias("docs"), "degree")


def _sides(spark, sf_dir):
    """Base results, their first ten as seeds, and the nodes."""
    q, qv, v = _both(spark, sf_dir)
    base = materialise(R.s2(_docs(spark, sf_dir).select("doc_id", "text"), v, q, qv, R.DEPTH).select("query_id", F.col("doc_id").alias("doc"), "rank"), "base")
    return q, base, base.where(F.col("rank") <= Y.SEEDS).select("query_id", "doc", F.col("rank").alias("seed_rank")), materialise(Y.connector_nodes(_names(spark, sf_dir)), "nodes")


def _from_query(q, base, nodes):
    vectors = M.hashed_vectors(nodes.select(F.concat_ws("/", "node_type", "norm").alias("key"), F.col("norm").alias("text")))
    asked = M.hashed_vectors(q.select(F.col("query_id").alias("key"), F.col("query_text").alias("text"))).withColumnRenamed("key", "query_id")
    return Y.start_nodes(nodes, vectors, asked)


def query_start(spark, sf_dir):
    """The names nearest to each query by the offline vectors."""
    q, base, _, nodes = _sides(spark, sf_dir)
    return _from_query(q, base, nodes)


def query_expansion(spark, sf_dir):
    q, base, _, nodes = _sides(spark, sf_dir)
    return Y.expand_from_query(_from_query(q, base, nodes), nodes, base.select("query_id", "doc"))


def payload_expansion(spark, sf_dir):
    _, base, seeds, _ = _sides(spark, sf_dir)
    return Y.payload_expand(seeds, _names(spark, sf_dir), base.select("query_id", "doc"))


def system_pools(spark, sf_dir):
    """How many documents each system hands to the re-ranker for each query; the deeper pool is as large as the largest of the expanded ones."""
    q, base, seeds, nodes = _sides(spark, sf_dir)
    ex = base.select("query_id", "doc")
    r, k = Y.payload_expand(seeds, _names(spark, sf_dir), ex), Y.expand_from_query(_from_query(q, base, nodes), nodes, ex)
    sizes = Y.pools(base, {"s2": base.limit(0), "c2": r, "bq": k}).groupBy("system", "query_id").agg(F.count(F.lit(1)).alias("n"))
    deeper = sizes.groupBy("query_id").agg(F.max("n").alias("n")).select(F.lit("c0").alias("system"), "query_id", "n")
    return sizes.unionByName(deeper)


def expansion_path_split(spark, sf_dir):
    """Paths by which payload expansion reaches documents of the query's own source and kind."""
    _, base, seeds, _ = _sides(spark, sf_dir)
    run = Y.payload_expand(seeds, _names(spark, sf_dir), base.select("query_id", "doc"))
    d = _docs(spark, sf_dir).select("doc_id", "source", "candidate_type")
    rel = run.select("query_id", "doc").join(d.select(F.col("doc_id").alias("doc"), F.col("source").alias("s"), F.col("candidate_type").alias("t")), "doc").join(d.select(F.col("doc_id").alias("query_id"), "source", "candidate_type"), "query_id")
    qrels = rel.select("query_id", "doc", (2 * (F.col("s") == F.col("source")).cast("int") + (F.col("t") == F.col("candidate_type")).cast("int")).alias("relevance"))
    return Y.path_split(run, qrels)


_PATHS = [("contains", "", "A page"), ("entity", "ada", "A page"), ("topic", "vectors", "A page"), ("query_entity", "ada", ""), ("query_topic", "vectors", ""), (None, "", "A page")]


def note_templates(spark, sf_dir):
    """The five notes and a text without one."""
    rows = spark.createDataFrame(_PATHS, "path string, connector string, seed string")
    told = Y.note(F.col("path"), F.col("connector"), F.col("seed"))
    return rows.select(F.coalesce("path", F.lit("none")).alias("path"), Y.with_note(F.lit("body"), told).alias("text"))


def glued_texts(spark, sf_dir):
    """Messages with the summaries of the links they hold: whole, and cut to 256 words."""
    s = table(spark, sf_dir, "scraped_links", "link_id", "summary", "raw_text", "message_context").select("link_id", "summary", "raw_text", F.col("message_context.msg_id").alias("doc")).where("doc is not null").distinct()
    m = table(spark, sf_dir, "messages", "msg_id", "text").where("text is not null").distinct().select(F.col("msg_id").alias("doc"), "text").join(s.select("doc").distinct(), "doc", "left_semi")
    g = Y.glued_texts(m, s.select("doc", F.col("link_id").alias("link"), F.concat_ws(" ", "summary", "raw_text").alias("link_text")))
    return g.select("doc", F.sha2("full_text", 256).alias("full_hash"), F.size(F.filter(F.split("trimmed_text", r"\s+"), lambda w: w != "")).cast("long").alias("words"), "links_trimmed", "links_dropped")


_BOARD = [(8, 7, 0), (8, 6, 0), (8, 8, 1), (7, 7, 0), (6, 6, 0), (5, 5, 0), (5, 4, 0), (4, 4, 0)]


def decision_flow(spark, sf_dir):
    """What follows from every pair of verdicts on the board."""
    b = spark.createDataFrame(_BOARD, "n int, wins int, losses int").select("n", "wins", "losses", Y.beats(F.col("n"), F.col("wins"), F.col("losses")).alias("beats"))
    o = b.select(F.col("n").alias("n2"), F.col("wins").alias("wins2"), F.col("losses").alias("losses2"), F.col("beats").alias("beats2"))
    return b.join(o, F.col("n") == F.col("n2")).select("n", "wins", "losses", "wins2", "losses2", Y.branch(F.col("beats"), F.col("beats2")).alias("branch"))


QUERIES = {f.__name__: f for f in (search_filtered, search_terms, lexical_run, legacy_search, result_details, whole_corpus_run, connector_nodes, query_start, query_expansion, payload_expansion, system_pools, expansion_path_split, note_templates, glued_texts, decision_flow)}

_PTS = "ql as (select msg_id, max(quality) as quality from grades group by 1), ok as (select d.* from documents d left join ql on ql.msg_id = d.doc_id where candidate_type <> 'message' or coalesce(quality, 0) >= 3)"
_STOPSQL = ", ".join(f"'{w}'" for w in T.SEARCH_STOP)
_TERMSQL = f"list_filter(string_split_regex(lower(query_text), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 2 and t not in ({_STOPSQL}))"
_RR = "round(10 * len(list_intersect(list_distinct({q}), list_distinct({t}))) / greatest(1, len(list_distinct({q}))) - 2, 6)".format(q=_tok("qb.query_text"), t=_tok("d.text"))
_FILTERED = f"{BOTH}, {_PTS}, vok as (select * from vb where doc_id in (select doc_id from ok)), {cosine_cte('dense', 'vok', 'qb')}, {bm25_cte('lex', 'ok', 'qb')}, {rrf_cte('fused', ['dense', 'lex'])}"
_LEXICAL = f"tq as (select query_id, {_TERMSQL} as terms from qb), lx as (select query_id, doc_id, len(list_filter(list_distinct(terms), lambda t: contains(lower(text), t))) as matched from tq join ok on len(list_filter(terms, lambda t: contains(lower(text), t))) > 0)"
_NM = r"""nm as (select distinct doc, node_type, name, regexp_replace(lower(regexp_replace(name, '^\s+|\s+$', '', 'g')), '[\s_-]+', ' ', 'g') as norm from (select msg_id as doc, 'message' as ct, 'topic' as node_type, unnest(topics) as name from grades union all select link_id, 'link', 'topic', unnest(topics) from scraped_links union all select link_id, 'link', 'entity', unnest(entities) from scraped_links) x join documents d on d.doc_id = x.doc and d.candidate_type = ct where name is not null),
nf as (select distinct doc, node_type, norm from nm where norm <> ''), nd as (select node_type, norm, count(*) as degree from nf group by all)"""
_BASE = f"""{BOTH}, {cosine_cte('dense', 'vb', 'qb')}, {bm25_cte('lex', 'documents', 'qb')}, {rrf_cte('fused', ['dense', 'lex'])}, rr as (select f.query_id, f.doc_id, {_RR} as score from fused f join qb using (query_id) join documents d on d.doc_id = f.doc_id),
base as (select query_id, doc_id as doc, row_number() over (partition by query_id order by score desc, doc_id) as rank from rr)"""
_VEC = "list_transform(range(64), lambda i: len(list_filter({p}, lambda p: p = i))::double)"
_PLACES = "list_transform({t}, lambda t: ('0x' || md5(t)[1:8])::bigint % 64)"


def _unit(c: str) -> str:
    return f"list_transform({c}, lambda x: round(x / sqrt(list_sum(list_transform({c}, lambda y: y * y))), 6))"


_START = f"""nv as (select node_type, norm, degree, {_VEC.format(p='ps')} as c from (select *, {_PLACES.format(t=_tok('norm'))} as ps from nd where degree <= 16) where len(ps) > 0), nu as (select node_type, norm, degree, {_unit('c')} as e from nv),
qc as (select query_id, {_VEC.format(p='ps')} as c from (select query_id, {_PLACES.format(t=_tok('query_text'))} as ps from qb) where len(ps) > 0), qu as (select query_id, {_unit('c')} as e from qc),
st as (select * from (select query_id, node_type, norm, degree, cosine, row_number() over (partition by query_id order by cosine desc, node_type, norm) as rank from (select query_id, node_type, norm, degree, round(list_sum(list_transform(range(1, 65), lambda i: nu.e[i] * qu.e[i])), 6) as cosine from nu, qu)) where rank <= 5)"""
_VIA = """{n}s as (select query_id, doc, round(sum(c), 9) as score, arg_min({{'p': path, 'c': connector}}, (-round(c, 9), case when path like '%entity' then 1 else 2 end, connector)) as via from {n}c group by all),
{n} as (select * from (select query_id, doc, score, via.p as path, via.c as connector, row_number() over (partition by query_id order by score desc, doc) as rank from {n}s) where rank <= 30)"""
_BQ = f"bqc as (select query_id, doc, cosine / ln(1 + st.degree) as c, 'query_' || node_type as path, norm as connector from st join nf using (node_type, norm) where (query_id, doc) not in (select (query_id, doc) from base)), {_VIA.format(n='bq')}"
_C2 = f"c2c as (select b.query_id, f.doc, 1 / ln(1 + degree) / b.rank as c, 'payload_' || node_type as path, norm as connector from base b join nf g on g.doc = b.doc join nd using (node_type, norm) join nf f using (node_type, norm) where b.rank <= 10 and degree <= 16 and (b.query_id, f.doc) not in (select (query_id, doc) from base)), {_VIA.format(n='c2')}"

ORACLE_SQL = {
    "search_filtered": f"with {_FILTERED}, rr as (select f.query_id, f.doc_id, {_RR} as score from fused f join qb using (query_id) join documents d on d.doc_id = f.doc_id) select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from rr) where rank <= 5",
    "search_terms": f"with {_Q} select query_id, array_to_string({_TERMSQL}, ' ') as terms from q",
    "lexical_run": f"with {BOTH}, {_PTS}, {_LEXICAL} select * from (select query_id, doc_id, matched::double as score, row_number() over (partition by query_id order by matched desc, doc_id) as rank from lx) where rank <= 30",
    "legacy_search": f"""with {BOTH}, {_PTS}, {_LEXICAL}, {cosine_cte('dense', 'vb', 'qb', 20)}, sm as (select * from (select query_id, doc_id, round(score, 4) as score, 0 as source, row_number() over (partition by query_id order by round(score, 4) desc, doc_id) as r from dense where doc_id in (select doc_id from ok)) where r <= 10),
bs as (select query_id, max(score) as best from sm group by 1), al as (select query_id, doc_id, score, source from sm union all select query_id, doc_id, round(0.5 * coalesce(best, 1.0), 4), 1 from lx left join bs using (query_id) where (query_id, doc_id) not in (select (query_id, doc_id) from sm)),
u as (select doc_id, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), 'https?://[^\\s<>"'']+'), lambda u: regexp_replace(u, '[.,;:!?)\\]}}>*_]+$', ''))) as urls from documents), e as (select query_id, doc_id, score, unnest(urls) as url from al join u using (doc_id)),
b as (select query_id, url, arg_max(doc_id, (score, -doc_id)) as doc_id from e group by all), k as (select query_id, doc_id, score, source from al join u using (doc_id) where score >= 0.25 and (len(urls) = 0 or (query_id, doc_id) in (select (query_id, doc_id) from b)))
select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, source, doc_id) as rank from k) where rank <= 10""",
    "result_details": f"""with {BOTH}, {cosine_cte('dense', 'vb', 'qb')}, {bm25_cte('lex', 'documents', 'qb')}, {rrf_cte('fused', ['dense', 'lex'])}, s as (select distinct link_id, url, message_context.msg_id as m, message_context.sent_at as sa from scraped_links)
select query_id, rank, doc_id, candidate_type, case when candidate_type = 'message' then coalesce((select string_agg(distinct url, ' ' order by url) from s where m = doc_id and url is not null), '') else '' end as related, case when candidate_type = 'link' then coalesce((select min(sa) from s where link_id = doc_id), '') else '' end as first_sent_at from (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select query_id, doc_id, round(sum(1 / (60 + rank)), 6) as score from (select query_id, doc_id, l, min(rank) as rank from (select query_id, doc_id, 0 as l, rank from dense where rank <= 5 union all select query_id, doc_id, 1, rank from lex where rank <= 5) group by all) group by all)) join documents using (doc_id) where rank <= 5""",
    "whole_corpus_run": f"with {BOTH} select query_id, count(*) as n, count(distinct vb.doc_id) as docs, count(*) as last_rank, true as complete from qb, vb group by 1",
    "connector_nodes": f"with {_NM} select node_type, norm, (select string_agg(distinct name, '|' order by name) from nm where nm.node_type = nd.node_type and nm.norm = nd.norm) as raw_names, case when degree <= 16 then (select string_agg(doc::varchar, ',' order by doc) from nf where nf.node_type = nd.node_type and nf.norm = nd.norm) else '' end as docs, degree from nd",
    "query_start": f"with {BOTH}, {_NM}, {_START} select * from st",
    "query_expansion": f"with {_BASE}, {_NM}, {_START}, {_BQ} select * from bq",
    "payload_expansion": f"with {_BASE}, {_NM}, {_C2} select * from c2",
    "system_pools": f"with {_BASE}, {_NM}, {_START}, {_BQ}, {_C2}, z as (select 's2' as system, query_id, doc from base union select 'bq', query_id, doc from base union select 'c2', query_id, doc from base union select 'bq', query_id, doc from bq union select 'c2', query_id, doc from c2), n as (select system, query_id, count(*) as n from z group by all) select * from n union all select 'c0', query_id, max(n) from n group by all",
    "expansion_path_split": f"with {_BASE}, {_NM}, {_C2}, h as (select c2.path from c2 join documents d on d.doc_id = c2.doc join documents q on q.doc_id = c2.query_id where c2.rank <= 5 and d.source = q.source) select path, count(*) as hits, round(count(*) / sum(count(*)) over (), 6) as share from h group by 1",
    "note_templates": """select * from (values ('contains', '[connected: shared in the same message as "A page"] body'), ('entity', '[connected: both mention "ada", like "A page"] body'), ('topic', '[connected: both about "vectors", like "A page"] body'), ('query_entity', '[connected: mentions "ada"] body'), ('query_topic', '[connected: about "vectors"] body'), ('none', 'body')) t(path, text)""",
    "decision_flow": f"with b as (select n, wins, losses, case when n > 4 then losses = 0 and wins >= case n when 8 then 7 else n end end as b from (values {', '.join(map(str, _BOARD))}) t(n, wins, losses)) select x.n, x.wins, x.losses, y.wins as wins2, y.losses as losses2, case when x.b is null then 'TOO FEW TO DECIDE' when not x.b then 'GRAPH OUT' when not y.b then 'SHIP THE SHORTCUT(S)' else 'GRAPH STAYS' end as branch from b x join b y using (n)",
}
