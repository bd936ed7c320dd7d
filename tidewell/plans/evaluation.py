"""Queries that judge the runs. A pooled document's grade counts what it shares with the query: language, source, kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import evaluation as V
from tidewell.operators import retrieval as R
from tidewell.plans.retrieval import BOTH, FUSED, _both, _docs
from tidewell.session import materialise


def _runs(spark, sf_dir):
    q, qv, v = _both(spark, sf_dir)
    dense, lex = materialise(R.cosine(v, qv), "dense"), materialise(R.bm25(_docs(spark, sf_dir), q), "lex")
    return dense, lex, materialise(R.fuse([dense, lex]), "fused")


def _pool(dense, lex):
    return V.pooled({"bm25": (lex, 20), "cosine": (dense, 30)})


def _qrels(spark, sf_dir, pool):
    d = _docs(spark, sf_dir).select("doc_id", "lang", "source", "candidate_type")
    q = d.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("ql"), F.col("source").alias("qs"), F.col("candidate_type").alias("qt"))
    one = lambda a, b: F.coalesce((F.col(a) == F.col(b)).cast("int"), F.lit(0))
    return pool.select("query_id", "doc_id").join(d, "doc_id").join(q, "query_id").select("query_id", "doc_id", (one("lang", "ql") + one("source", "qs") + one("candidate_type", "qt")).alias("relevance"))


def _all(spark, sf_dir):
    dense, lex, fused = _runs(spark, sf_dir)
    return dense, lex, fused, materialise(_qrels(spark, sf_dir, _pool(dense, lex)), "qrels")


def pool_union(spark, sf_dir):
    dense, lex, _ = _runs(spark, sf_dir)
    return _pool(dense, lex)


def ranking_metrics(spark, sf_dir):
    _, _, fused, qrels = _all(spark, sf_dir)
    return V.ranking_metrics(fused, qrels)


def metrics_summary(spark, sf_dir):
    dense, lex, fused, qrels = _all(spark, sf_dir)
    out = None
    for name, run in (("cosine", dense), ("bm25", lex), ("fused", fused)):
        one = V.aggregate(V.ranking_metrics(run, qrels)).select(F.lit(name).alias("system"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def roc_auc(spark, sf_dir):
    dense, _, _, qrels = _all(spark, sf_dir)
    return V.roc_auc(dense, qrels)


def threshold_sweep(spark, sf_dir):
    dense, _, _, qrels = _all(spark, sf_dir)
    return V.threshold_sweep(dense, qrels)


def failure_class(spark, sf_dir):
    dense, _, _, qrels = _all(spark, sf_dir)
    cut = _docs(spark, sf_dir).where(T.estimated_tokens(F.col("text")) > 256)
    return V.failure_classes(dense, qrels, cut)


def win_tie_loss(spark, sf_dir):
    dense, _, fused, qrels = _all(spark, sf_dir)
    return V.win_tie_loss(V.ranking_metrics(dense, qrels), V.ranking_metrics(fused, qrels))


def paired_bootstrap(spark, sf_dir):
    dense, _, fused, qrels = _all(spark, sf_dir)
    return V.paired_bootstrap(V.ranking_metrics(dense, qrels), V.ranking_metrics(fused, qrels))


def unjudged_at_k(spark, sf_dir):
    _, _, fused, qrels = _all(spark, sf_dir)
    return V.unjudged(fused, qrels)


def headroom(spark, sf_dir):
    dense, _, _, qrels = _all(spark, sf_dir)
    return V.headroom(dense, qrels)


def abstention(spark, sf_dir):
    dense, _, _, qrels = _all(spark, sf_dir)
    return V.abstention(dense, qrels)


QUERIES = {f.__name__: f for f in (pool_union, ranking_metrics, metrics_summary, roc_auc, threshold_sweep, failure_class, win_tie_loss, paired_bootstrap, unjudged_at_k, headroom, abstention)}

_POOL = FUSED + ", pl as (select query_id, doc_id, min(rank) as best_rank, string_agg(distinct source, '+' order by source) as sources from (select query_id, doc_id, rank, 'bm25' as source from lex where rank <= 20 union all select query_id, doc_id, rank, 'cosine' from dense) group by all)"
_REL = _POOL + ", qrels as (select p.query_id, p.doc_id, coalesce((d.lang = q.lang)::int, 0) + coalesce((d.source = q.source)::int, 0) + coalesce((d.candidate_type = q.candidate_type)::int, 0) as relevance from pl p join documents d on d.doc_id = p.doc_id join documents q on q.doc_id = p.query_id)"


def _metrics(run: str, name: str) -> str:
    return f"""{name}_j as (select r.*, coalesce(relevance, 0) as grade, relevance is not null as is_judged from {run} r left join qrels using (query_id, doc_id)),
{name}_i as (select query_id, sum(case when p <= 5 then (pow(2, relevance) - 1) / log2(p + 1) else 0 end) as ideal, count(*) filter (relevance >= 2) as relevant from (select *, row_number() over (partition by query_id order by relevance desc, doc_id) as p from qrels) group by 1),
{name} as (select query_id, round(case when ideal > 0 then dcg / ideal end, 6) as ndcg, success, round(case when first_rank <= 5 then 1 / first_rank else 0 end, 6) as mrr, round(case when relevant > 0 then found / relevant end, 6) as recall, coalesce(first_rank, 0) as first_rank from
(select query_id, sum(case when rank <= 5 then (pow(2, grade) - 1) / log2(rank + 1) else 0 end) as dcg, max(case when rank <= 5 and grade >= 2 then 1 else 0 end)::double as success, min(case when grade >= 2 then rank end) as first_rank, count(*) filter (rank <= 5 and grade >= 2) as found from {name}_j group by 1) left join {name}_i using (query_id))"""


_MD, _MF = f"{_REL}, {_metrics('dense', 'md')}", f"{_REL}, {_metrics('fused', 'mf')}"
_MEANS = "count(*) as n, round(avg(ndcg), 6) as ndcg, round(avg(success), 6) as success, round(avg(mrr), 6) as mrr, round(avg(recall), 6) as recall"

ORACLE_SQL = {
    "pool_union": f"with {_POOL} select * from pl",
    "ranking_metrics": f"with {_MF} select * from mf",
    "metrics_summary": f"with {_MD}, {_metrics('lex', 'ml')}, {_metrics('fused', 'mf')} " + " union all ".join(f"select '{s}' as system, {_MEANS} from {m}" for s, m in (("cosine", "md"), ("bm25", "ml"), ("fused", "mf"))),
    "roc_auc": f"with {_MD}, b as (select score, count(*) filter (grade >= 2) as pos, count(*) filter (grade < 2) as neg from md_j group by 1), u as (select *, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as under from b) select sum(pos)::bigint as positives, sum(neg)::bigint as negatives, round(sum(pos * (under + neg / 2)) / (sum(pos) * sum(neg)), 6) as auc from u",
    "threshold_sweep": f"with {_MD}, t as (select unnest([{', '.join(map(str, V.THRESHOLDS))}])::double as threshold), s as (select threshold, query_id, grade, row_number() over (partition by threshold, query_id order by rank) as r from md_j, t where score >= threshold), p as (select threshold, query_id, count(*) as n, count(*) filter (grade >= 2) as h, max(case when grade >= 2 and r <= 5 then 1 else 0 end) as s from s group by all) select threshold, sum(n)::bigint as returned, round(sum(h) / sum(n), 6) as precision, round(sum(h) / (select count(*) filter (relevance >= 2) from qrels), 6) as recall, sum(s)::bigint as successes from p group by 1",
    "failure_class": f"with {_MD}, p as (select query_id, min(case when grade >= 2 then rank end) as f, max(case when grade >= 2 and rank <= 5 then score end) as b, bool_or(grade >= 2 and greatest(1, (length(coalesce(text, '')) + 3) // 4) > 256) as c from md_j join documents using (doc_id) group by 1) select query_id, case when f is null then 'no_corpus_answer' when b >= 0.25 then 'success' when b is not null then 'threshold_miss' when c then 'long_document_miss' when f > 30 then 'cosine_retrieval_miss' else 'ranking_miss' end as failure_class from p",
    "win_tie_loss": f"with {_MD}, {_metrics('fused', 'mf')}, d as (select round(coalesce(mf.ndcg, 0) - coalesce(md.ndcg, 0), 6) as d from md join mf using (query_id)) select count(*) filter (d > 0.01) as wins, count(*) filter (abs(d) <= 0.01) as ties, count(*) filter (d < -0.01) as losses, round(avg(d), 6) as mean_delta from d",
    "unjudged_at_k": f"with {_MF} select query_id, count(*) filter (not is_judged) as unjudged, round(count(*) filter (is_judged) / 5, 6) as judged_at_k from mf_j where rank <= 5 group by 1",
    "headroom": f"with {_REL} select count(*) as relevant, count(*) filter (coalesce(rank, 11) > 10) as beyond from qrels left join dense using (query_id, doc_id) where relevance >= 2",
    "abstention": f"with {_REL}, a as (select query_id, max(relevance) >= 2 as answerable from qrels group by 1) select coalesce(answerable, false) as answerable, count(*) as n, round(median(score), 6) as median_top from dense left join a using (query_id) where rank = 1 group by 1",
}
