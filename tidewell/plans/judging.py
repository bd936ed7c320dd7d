"""Queries on judgments, gates and comparisons; grades as in the evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import evaluation as V
from tidewell.operators import judging as J
from tidewell.operators import retrieval as R
from tidewell.plans.evaluation import _MD, _MF, _POOL, _REL, _all, _metrics, _runs
from tidewell.plans.ingest import _row
from tidewell.plans.retrieval import _both, _docs, _tok
from tidewell.session import materialise
from tidewell.tables import table


def distractors(spark, sf_dir):
    dense, _, _, qrels = _all(spark, sf_dir)
    return J.distractors(dense, qrels, _docs(spark, sf_dir))


def recall_of_pool(spark, sf_dir):
    _, lex, _, qrels = _all(spark, sf_dir)
    return J.recall_of_pool(lex, qrels)


def run_differences(spark, sf_dir):
    """The fused run against the cosine run."""
    dense, _, fused = _runs(spark, sf_dir)
    return J.run_differences(dense, fused)


def alias_resolution(spark, sf_dir):
    """Even documents are known; an odd one resolves to a known one of the same text."""
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text")
    known = d.where("id % 2 = 0")
    aliases = d.alias("a").join(known.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.text") == F.col("b.text"))).select(F.col("a.id").alias("id"), F.col("b.id").alias("alias_of"))
    return J.resolved(d, known, aliases).withColumn("resolved", F.coalesce("resolved", F.lit(-1)))


def grade_carry_over(spark, sf_dir):
    """Grades of the cosine pool carried to the pool of the fused run."""
    dense, _, fused, qrels = _all(spark, sf_dir)
    old = qrels.join(dense.where("rank <= 10").select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    return J.carried_grades(old, fused.where("rank <= 20")).withColumn("relevance", F.coalesce("relevance", F.lit(-1)))


def judgment_merge(spark, sf_dir):
    """Judgments of the cosine run and those the others add to them."""
    dense, _, _, qrels = _all(spark, sf_dir)
    first = qrels.join(dense.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    rest = qrels.join(dense.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return J.merged_judgments([first, rest]).groupBy("sheet", "relevance").agg(F.count(F.lit(1)).alias("n"))


def topup_pairs(spark, sf_dir):
    """Pairs to grade before two runs can be measured, where only the cosine pool is graded."""
    dense, lex, fused, qrels = _all(spark, sf_dir)
    return J.unjudged_pairs([fused, lex], qrels.join(dense.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi"))


def corpus_gates(spark, sf_dir):
    """The gates of the documents and of the lexical run, which is made twice."""
    q, _, _ = _both(spark, sf_dir)
    docs = _docs(spark, sf_dir)
    return J.gates(docs, materialise(R.bm25(docs, q), "run"), R.bm25(docs, q))


def vector_parity(spark, sf_dir):
    """Stored vectors against the same ones scaled, every tenth turned and every fiftieth missing."""
    v = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), "embedding")
    fresh = v.where("id % 50 <> 0").select("id", F.transform("embedding", lambda x, i: F.when((F.col("id") % 10 == 1) & (i == 0), x + 1.0).otherwise(x * 2.0)).alias("embedding"))
    return J.vector_parity(v, fresh)


def set_parity(spark, sf_dir):
    dense, _, fused = _runs(spark, sf_dir)
    return J.set_parity(dense, fused)


_PREDICTED = [("cosine->fused and bm25->fused", "improved"), ("cosine->bm25", "worse")]
_VERDICTS = [("cosine->fused", "improved at n=12"), ("bm25->fused", "no detectable difference"), ("cosine->bm25", "worse"), ("fused->s2", "improved")]


def held_predictions(spark, sf_dir):
    told = J.held_predictions(spark.createDataFrame(_VERDICTS, "name string, verdict string"), spark.createDataFrame(_PREDICTED, "name string, expected string"))
    return told.withColumn("held", F.coalesce(F.col("held").cast("string"), F.lit("no prediction")))


def usage_counters(spark, sf_dir):
    """The event table as a call log."""
    return J.usage(table(spark, sf_dir, "events", "event_type", "value"), "event_type", "value")


def ladder_scores(spark, sf_dir):
    """Means of three steps over answerable queries: cosine, fused, re-ranked."""
    q, _, _ = _both(spark, sf_dir)
    dense, _, fused, qrels = _all(spark, sf_dir)
    ranked = materialise(R.rerank(fused, _docs(spark, sf_dir).select("doc_id", "text"), q, R.DEPTH), "ranked")
    answerable = qrels.where(F.col("relevance") >= V.RELEVANT).select("query_id").distinct()
    out = None
    for name, run in (("s0", dense), ("s1", fused), ("s2", ranked)):
        m = V.ranking_metrics(run, qrels).join(answerable, "query_id", "left_semi")
        one = m.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias(c) for c in ("ndcg", "success", "mrr")], F.round(F.avg(F.col("first_rank").between(1, V.DEPTH).cast("double")), 6).alias("candidate_success")).select(F.lit(name).alias("step"), "*")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (distractors, recall_of_pool, run_differences, alias_resolution, grade_carry_over, judgment_merge, topup_pairs, corpus_gates, vector_parity, set_parity, held_predictions, usage_counters, ladder_scores)}

_HEAD = "lower(regexp_replace(coalesce(text, ''), '^[\\s\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+', '', 'g'))[1:200]"
_INTRO = f"(regexp_matches({_HEAD}, '{T.GREETING}') and regexp_matches({_HEAD}, '{T.FIRST_PERSON.replace(chr(39), chr(39) * 2)}') or contains({_HEAD}, 'introduce myself'))"
_RRSQL = f"rk0 as (select f.query_id, f.doc_id, round(10 * len(list_intersect(list_distinct({_tok('qb.query_text')}), list_distinct({_tok('d.text')}))) / greatest(1, len(list_distinct({_tok('qb.query_text')}))) - 2, 6) as score from fused f join qb using (query_id) join documents d on d.doc_id = f.doc_id), ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from rk0)"
_STEP = "select '{s}' as step, count(*) as n, round(avg(coalesce(ndcg, 0)), 6) as ndcg, round(avg(success), 6) as success, round(avg(mrr), 6) as mrr, round(avg((first_rank between 1 and 30)::int::double), 6) as candidate_success from {m} where query_id in (select query_id from qrels where relevance >= 2)"

ORACLE_SQL = {
    "distractors": f"with {_MD}, x as (select j.*, min(case when grade >= 2 then rank end) over (partition by query_id) as f, coalesce({_INTRO}, false) as intro from md_j j left join documents using (doc_id)) select query_id, max(score) as top_score, count(*) filter (rank < coalesce(f, 1000000)) as distractors, count(*) filter (rank < coalesce(f, 1000000) and intro) as intros from x group by 1",
    "recall_of_pool": f"with {_REL}, g as (select query_id, count(l.doc_id) as found, count(*) as relevant from qrels left join (select distinct query_id, doc_id from lex) l using (query_id, doc_id) where relevance >= 2 group by 1), s as (select l.query_id, count(relevance) filter (rank <= 5) as k from lex l left join qrels using (query_id, doc_id) group by 1) select query_id, round(coalesce(found / relevant, 0.0), 6) as recall_pool, round(k / 5, 6) as judged_at_k from s left join g using (query_id)",
    "run_differences": f"with {_POOL}, p as (select query_id, count(*) filter (b.rank is null) as only_frozen, count(*) filter (a.rank is null) as only_live, count(*) filter (abs(a.score - b.score) > 0.0001) as scores_apart from dense a full join fused b using (query_id, doc_id) group by 1), r as (select query_id, count(*) filter (a.doc_id is distinct from b.doc_id) as ranks_apart from dense a full join fused b using (query_id, rank) group by 1) select * from p join r using (query_id)",
    "alias_resolution": "with k as (select text, min(doc_id) as a from documents where doc_id % 2 = 0 and text is not null group by 1) select doc_id as id, case when doc_id % 2 = 0 then doc_id else coalesce(a, -1) end as resolved, case when doc_id % 2 = 0 then 'id' when a is not null then 'alias' else 'missing' end as how from documents left join k using (text)",
    "grade_carry_over": f"with {_REL}, o as (select q.* from qrels q join dense d using (query_id, doc_id) where d.rank <= 10), p as (select query_id, doc_id, 1 as p from fused where rank <= 20) select query_id, doc_id, coalesce(relevance, -1) as relevance, case when p is null then 'orphan' when relevance is null then 'open' else 'carried' end as state from p full join o using (query_id, doc_id)",
    "judgment_merge": f"with {_REL} select case when (query_id, doc_id) in (select (query_id, doc_id) from dense) then 0 else 1 end as sheet, relevance, count(*) as n from qrels group by all",
    "topup_pairs": f"with {_REL} select distinct query_id, doc_id from (select query_id, doc_id, rank from fused union all select query_id, doc_id, rank from lex) where rank <= 5 and (query_id, doc_id) not in (select (query_id, doc_id) from dense)",
    "corpus_gates": f"with t as (select *, regexp_replace(coalesce(text, ''), '^[\\s\\x{{A0}}\\x{{3000}}]+|[\\s\\x{{A0}}\\x{{3000}}]+$', '', 'g') as s from documents) select 'blank_text' as gate, count(*) filter (s = '') as violations from t union all select 'unknown_type', count(*) filter (coalesce(candidate_type not in ('message', 'link'), true)) from t union all select 'phone_like', count(*) filter (regexp_matches(regexp_replace(coalesce(text, ''), '{T.LINK_LIKE}', ' ', 'g'), '{T.PHONE_LIKE}')) from t union all select 'duplicate_id', count(*) from (select doc_id from documents group by 1 having count(*) > 1) union all select 'stray_id', 0 union all select 'not_repeatable', 0",
    "vector_parity": "with v as (select vec_id as id, embedding::double[] as a, list_transform(embedding, lambda x, i: case when vec_id % 10 = 1 and i = 1 then x::double + 1 else x::double * 2 end) as b, vec_id % 50 = 0 as gone from embeddings), c as (select *, case when not gone then round(list_cosine_similarity(a, b), 6) end as c from v) select count(c) as compared, count(*) filter (c < 0.9999) as apart, count(*) filter (gone) as missing, 0 as extra, min(c) as least_cosine from c",
    "set_parity": f"with {_POOL}, a as (select query_id, list(doc_id order by rank) as a from dense where rank <= 5 group by 1), b as (select query_id, list(doc_id order by rank) as b from fused where rank <= 5 group by 1) select query_id, a is not distinct from b as same from a full join b using (query_id)",
    "held_predictions": f"with p as (select unnest(string_split(n, ' and ')) as name, expected from (values {', '.join(map(_row, _PREDICTED))}) t(n, expected)), v as (select * from (values {', '.join(map(_row, _VERDICTS))}) t(name, verdict)) select name, verdict, expected, coalesce((verdict = expected or starts_with(verdict, expected || ' at n='))::varchar, 'no prediction') as held from v left join p using (name)",
    "usage_counters": "select event_type, count(*) as calls, round(sum(value), 6) as total, max(value) as longest, round(avg(value), 6) as mean from events group by 1",
    "ladder_scores": f"with {_MD}, {_metrics('fused', 'mf')}, {_RRSQL}, {_metrics('ranked', 'mr')} " + " union all ".join(_STEP.format(s=s, m=m) for s, m in (("s0", "md"), ("s1", "mf"), ("s2", "mr"))),
}
