"""Queries of the retrieval engine. Queries are the titled documents whose id is divisible by 20, against all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import links as L
from tidewell.operators import retrieval as R
from tidewell.plans.links import _ASKED, _items
from tidewell.tables import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text", "title", "candidate_type", "source", "lang")


def _queries(spark, sf_dir):
    return _docs(spark, sf_dir).where("doc_id % 20 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query_text"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _query_vectors(spark, sf_dir):
    return _vectors(spark, sf_dir).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


def bm25_topk(spark, sf_dir):
    return R.bm25(_docs(spark, sf_dir), _queries(spark, sf_dir))


def bm25_filtered(spark, sf_dir):
    """Statistics of the links alone: the filter comes before them."""
    return R.bm25(_docs(spark, sf_dir).where("candidate_type = 'link'"), _queries(spark, sf_dir))


def cosine_topk(spark, sf_dir):
    return R.cosine(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir))


def cosine_filtered(spark, sf_dir):
    return R.cosine(_vectors(spark, sf_dir).where("label in (0, 1, 2)"), _query_vectors(spark, sf_dir))


def _both(spark, sf_dir):
    """Queries that have a text and a vector, and the vectors of documents."""
    q = _queries(spark, sf_dir).join(_query_vectors(spark, sf_dir), "query_id")
    v = _vectors(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    return q.select("query_id", "query_text"), q.select("query_id", "embedding"), v


def rrf_fuse(spark, sf_dir):
    q, qv, v = _both(spark, sf_dir)
    return R.fuse([R.cosine(v, qv), R.bm25(_docs(spark, sf_dir), q)])


def s2_search(spark, sf_dir):
    q, qv, v = _both(spark, sf_dir)
    return R.s2(_docs(spark, sf_dir).select("doc_id", "text"), v, q, qv)


def s2_confidence(spark, sf_dir):
    return R.confidence(s2_search(spark, sf_dir))


def hybrid_search(spark, sf_dir):
    """The older search: cosine results, each url once, down to the least score."""
    urls = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.links_in(F.coalesce("text", F.lit(""))).alias("urls"))
    return R.url_deduplicated(R.cosine(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir), 20).join(urls, "doc_id").select("query_id", "doc_id", "score", "urls"))


def graph_lexical(spark, sf_dir):
    """Items under topics that contain a query word, by number of different words matched, then by item."""
    asked = spark.createDataFrame([(i, w) for i, x in enumerate(_ASKED) for w in x.lower().replace("-", " ").split() if len(w) > 2], "query_id long, term string")
    items = _items(spark, sf_dir)
    hit = R.names_with_terms(items, asked)
    return items.select("item", "key").distinct().join(hit, "key").groupBy("query_id", "item").agg(F.max("matched").alias("matched"), F.count(F.lit(1)).alias("n_topics"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_filtered, cosine_topk, cosine_filtered, rrf_fuse, s2_search, s2_confidence, hybrid_search, graph_lexical)}

_STOP = ", ".join(f"'{w}'" for w in T.BM25_STOP)


def _tok(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: w not in ({_STOP}))"


def bm25_cte(name: str, docs: str, queries: str) -> str:
    return f"""{name}_l as (select doc_id, {_tok('text')} as ts from {docs}),
{name}_p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(ts) as term from {name}_l) group by all),
{name}_s as (select count(*) as n, avg(len(ts)) as al from {name}_l),
{name}_d as (select term, count(*) as df from {name}_p group by 1),
{name}_q as (select query_id, term, count(*) as qtf from (select query_id, unnest({_tok('query_text')}) as term from {queries}) group by all),
{name}_h as (select query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / al))), 6) as score from {name}_q join {name}_p using (term) join {name}_d using (term) join {name}_l using (doc_id), {name}_s group by all),
{name} as (select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from {name}_h where score > 0) where rank <= 30)"""


def cosine_cte(name: str, vectors: str, queries: str, depth: int = 30) -> str:
    return f"""{name} as (select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select query_id, v.doc_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score from {queries} q, {vectors} v)) where rank <= {depth})"""


def rrf_cte(name: str, runs: list[str]) -> str:
    lists = " union all ".join(f"select query_id, doc_id, {i} as l, rank from {r}" for i, r in enumerate(runs))
    return f"""{name}_b as (select query_id, doc_id, l, min(rank) as rank from ({lists}) group by all),
{name} as (select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select query_id, doc_id, round(sum(1 / (60 + rank)), 6) as score from {name}_b group by all)) where rank <= 30)"""


_Q = "q as (select doc_id as query_id, title as query_text from documents where doc_id % 20 = 0 and title is not null)"
_V = "v as (select vec_id as doc_id, embedding, label from embeddings), qv as (select vec_id as query_id, embedding from embeddings where vec_id % 20 = 0)"
BOTH = f"{_Q}, {_V}, qb as (select query_id, query_text, embedding from q join qv using (query_id)), vb as (select * from v where doc_id in (select doc_id from documents))"
FUSED = f"{BOTH}, {cosine_cte('dense', 'vb', 'qb')}, {bm25_cte('lex', 'documents', 'qb')}, {rrf_cte('fused', ['dense', 'lex'])}"
S2 = f"""{FUSED}, rr as (select f.query_id, f.doc_id, round(10 * len(list_intersect(list_distinct({_tok('qb.query_text')}), list_distinct({_tok('d.text')}))) / greatest(1, len(list_distinct({_tok('qb.query_text')}))) - 2, 6) as score from fused f join qb using (query_id) join documents d on d.doc_id = f.doc_id),
s2 as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from rr) where rank <= 5)"""

from tidewell.plans.links import _ITEMS  # noqa: E402

ORACLE_SQL = {
    "bm25_topk": f"with {_Q}, {bm25_cte('lex', 'documents', 'q')} select * from lex",
    "bm25_filtered": f"with {_Q}, dl as (select * from documents where candidate_type = 'link'), {bm25_cte('lex', 'dl', 'q')} select * from lex",
    "cosine_topk": f"with {_V}, {cosine_cte('dense', 'v', 'qv')} select * from dense",
    "cosine_filtered": f"with {_V}, vf as (select * from v where label in (0, 1, 2)), {cosine_cte('dense', 'vf', 'qv')} select * from dense",
    "rrf_fuse": f"with {FUSED} select * from fused",
    "s2_search": f"with {S2} select * from s2",
    "s2_confidence": f"with {S2} select query_id, score as top_score, case when score >= 2.0 then 'strong' else 'weak' end as confidence from s2 where rank = 1",
    "hybrid_search": f"""with {_V}, {cosine_cte('dense', 'v', 'qv', 20)}, u as (select doc_id, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), 'https?://[^\\s<>"'']+'), lambda u: regexp_replace(u, '[.,;:!?)\\]}}>*_]+$', ''))) as urls from documents),
r as (select query_id, doc_id, score, urls from dense join u using (doc_id)), e as (select query_id, doc_id, score, unnest(urls) as url from r),
b as (select query_id, url, arg_max(doc_id, (score, -doc_id)) as doc_id from e group by all)
select query_id, doc_id, score from r where score >= 0.25 and (len(urls) = 0 or (query_id, doc_id) in (select (query_id, doc_id) from b))""",
    "graph_lexical": f"""with {_ITEMS}, q as (select * from (values {', '.join(f"({i}, '{w}')" for i, x in enumerate(_ASKED) for w in x.lower().replace('-', ' ').split() if len(w) > 2)}) t(query_id, term)),
m as (select query_id, key, count(distinct term) as matched from (select distinct key from ii) k join q on contains(key, term) group by all)
select query_id, item, max(matched) as matched, count(*) as n_topics from (select distinct item, key from ii) join m using (key) group by all""",
}
