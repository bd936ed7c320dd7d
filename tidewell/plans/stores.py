"""Queries on the stores of messages, links and points and on the ingestion steps around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import links as L
from tidewell.operators import stores as S
from tidewell.plans.ingest import _G, _row
from tidewell.plans.links import _CODE, _HOST, _LINKS, _ROUTE, _TRIM, _UT, _asked, _messages, _scraped, extract_links
from tidewell.tables import table

_REPOS = ["https://github.com/ada/tool", "https://github.com/ada/tool.git/", "https://www.github.com/ada/tool/tree/main/src/x.py", "https://github.com/ada/tool/BLOB/v1/README.md?x=1", "https://github.com/ada/tool/pull/12", "https://github.com/ada/tool/issues/3", "https://github.com/ada/tool/discussions", "https://github.com/ada/tool/wiki", "https://github.com/ada", "https://gist.github.com/ada/1f", "https://raw.githubusercontent.com/ada/tool/main/a/b.txt", "https://raw.githubusercontent.com/ada/tool", "https://docs.github.com/en/rest/x", "https://example.test/github.com/ada/tool"]


def repository_links(spark, sf_dir):
    """Addresses of repositories among all links, and one of every shape."""
    urls = _scraped(spark, sf_dir).select("url").union(_asked(spark, sf_dir).select("url")).union(spark.createDataFrame([(x,) for x in _REPOS], "url string")).where("url is not null").distinct()
    return urls.select("url", T.repository(F.col("url")).alias("r")).where("r is not null").select("url", "r.*")


def _stored(spark, sf_dir, odd: bool) -> DataFrame:
    """Messages with the grades of odd or even number: two imports of which the second comes later."""
    g = table(spark, sf_dir, "grades", "grade_id", "msg_id", "quality", "category").distinct().where(F.col("grade_id") % 2 == int(odd))
    m = table(spark, sf_dir, "messages", "msg_id", "datetime_iso", "text").distinct().where("text is not null")
    rows = g.join(m, "msg_id").select(F.struct(F.coalesce("datetime_iso", F.lit("")).alias("sent_at"), "text").alias("k"), "quality", F.when(F.col("grade_id") % 3 == 0, "").otherwise(F.coalesce("category", F.lit(""))).alias("category"), F.lit(False).alias("trusted"), "grade_id")
    return L.latest_by_key(rows, "k", [F.col("grade_id")]).select("k.sent_at", "k.text", "quality", "category", "trusted")


def message_upsert(spark, sf_dir):
    """Odd-numbered grades stored first, even-numbered ones merged in; a third of the categories come empty."""
    return S.upsert_messages(_stored(spark, sf_dir, True), _stored(spark, sf_dir, False)).select("sent_at", F.sha2("text", 256).alias("text_hash"), "quality", "category", "created")


def link_upsert(spark, sf_dir):
    """Links named by messages, then overwritten by what was scraped of them."""
    named = S.mention_links(spark.createDataFrame([], "url string, title string, status string, summary string"), extract_links(spark, sf_dir))
    scraped = L.latest_by_key(_scraped(spark, sf_dir).select("url", "title", F.lit("scraped").alias("status"), "summary", "link_id"), "url", [F.col("link_id")]).drop("link_id")
    return S.upsert_links(named, scraped).select("url", "title", "status", F.coalesce(F.length("summary"), F.lit(0)).cast("long").alias("summary_length"))


def _graph(spark, sf_dir) -> DataFrame:
    g = table(spark, sf_dir, "grades", "msg_id", "topics").where("msg_id is not null")
    s = _scraped(spark, sf_dir)
    held = s.select(F.col("msg_id").alias("src"), F.col("url").alias("dst")).union(extract_links(spark, sf_dir).select("msg_id", "url"))
    parts = [S.edges(g, "Message", "msg_id", "ABOUT", "Topic", "topics"), S.edges(s, "Link", "url", "MENTIONS", "Entity", "entities"), S.edges(s, "Link", "url", "ABOUT", "Topic", "topics"), S.edges_between(held, table(spark, sf_dir, "messages", "msg_id").select(F.col("msg_id").alias("src")), "Message", "CONTAINS", "Link")]
    return reduce(DataFrame.unionByName, parts)


def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)


def graph_counts(spark, sf_dir):
    return S.graph_counts(_graph(spark, sf_dir))


def node_deletion(spark, sf_dir):
    """Links that wait for a paste deleted with their edges: what is left, by type."""
    gone = _asked(spark, sf_dir).where("not resolved and url is not null").select(F.lit("Link").alias("type"), F.col("url").alias("id"))
    return S.without_nodes(_graph(spark, sf_dir), gone).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def _categories(spark, sf_dir, best) -> DataFrame:
    g = table(spark, sf_dir, "grades", "grade_id", "msg_id", "category").distinct().where("msg_id is not null and category is not null")
    return g.groupBy(F.col("msg_id").alias("id")).agg(best("category", "grade_id").alias("category"))


def payload_plan(spark, sf_dir):
    """Categories of the last grades against points that hold those of the first; every third point was never indexed."""
    return S.payload_plan(_categories(spark, sf_dir, F.min_by).where("id % 3 <> 0"), _categories(spark, sf_dir, F.max_by), "category")


def payload_update(spark, sf_dir):
    points = _categories(spark, sf_dir, F.min_by).where("id % 3 <> 0")
    return S.set_payload(points, payload_plan(spark, sf_dir), "category").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def point_lookup(spark, sf_dir):
    """Points by id; ids that aren't there are silently absent."""
    d = table(spark, sf_dir, "documents", "doc_id", "candidate_type", "n_chars")
    asked = d.where("doc_id % 20 = 0").select("doc_id").union(spark.createDataFrame([(-1,), (-2,)], "doc_id long"))
    return d.join(asked, "doc_id", "left_semi")


def store_fanout(spark, sf_dir):
    m = table(spark, sf_dir, "grades", "grade_id", "msg_id", "quality").distinct().where("msg_id is not null").groupBy("msg_id").agg(F.max("quality").alias("quality"))
    a = _asked(spark, sf_dir).withColumn("route", L.routed(F.col("block_reason")))
    return S.store_counts(m, _scraped(spark, sf_dir), a.where("route = 'blocked'"), a.where("route = 'ask_user'"))


def link_content(spark, sf_dir):
    """Links by whether the index, and a rebuild, would find something to embed."""
    s = _scraped(spark, sf_dir)
    fields = [F.col(c) for c in ("summary", "what_it_is", "problem_solved")]
    return s.select(T.has_content(*fields, F.col("raw_text")).alias("has_content"), T.has_content(*fields).alias("has_summary")).groupBy("has_content", "has_summary").agg(F.count(F.lit(1)).alias("n"))


def _raw(spark, sf_dir) -> DataFrame:
    return S.wrapped(table(spark, sf_dir, "ingest_requests", "entry_id", "text", "received_at", "skip_grading").distinct())


def ingest_messages(spark, sf_dir):
    """Bot records as messages: blank ones are refused."""
    return _raw(spark, sf_dir).select("entry_id", F.length("text").cast("long").alias("length"), "trusted", F.coalesce("error", F.lit("ok")).alias("outcome"))


def trusted_bypass(spark, sf_dir):
    """Trusted notes are stored without a grader; others are graded by the offline rubric."""
    from tidewell.operators.models import rubric_grades

    return S.graded_with_bypass(_raw(spark, sf_dir).where("error is null"), rubric_grades)


def _processed(spark, sf_dir) -> DataFrame:
    known = _scraped(spark, sf_dir).where("link_id % 4 = 0 and url is not null").select("url")
    s = _scraped(spark, sf_dir).where("url is not null").select("url", F.lit("scraped").alias("status"), F.lit(3).alias("rank"))
    a = _asked(spark, sf_dir).where("url is not null").select("url", L.routed(F.col("block_reason")).alias("status")).withColumn("rank", F.when(F.col("status") == "blocked", 2).otherwise(1))
    outcomes = s.unionByName(a).groupBy("url").agg(F.max_by("status", "rank").alias("status"))
    return S.processed_candidates(extract_links(spark, sf_dir), known, outcomes)


def process_candidates(spark, sf_dir):
    """Each link of each message once: what an import makes of it, where a quarter of the pages was scraped before."""
    return _processed(spark, sf_dir)


def candidate_counters(spark, sf_dir):
    return S.candidate_counts(_messages(spark, sf_dir), _processed(spark, sf_dir))


def paste_completion(spark, sf_dir):
    """Pending links answered by their partial texts, where the id is divisible by three; ids come in small letters."""
    p = _asked(spark, sf_dir).where("not resolved and url is not null").select("ask_id", "url", F.lit("").alias("title"), "partial_text")
    pasted = p.where("ask_id % 3 = 0").select(F.lower(T.paste_id(F.col("url"))).alias("link_id"), F.col("partial_text").alias("content"))
    return S.completed_pastes(p, pasted).select("url", "title", F.length("raw_text").cast("long").alias("raw_length"), "resolved")


def summary_gaps(spark, sf_dir):
    return S.summary_gaps(_scraped(spark, sf_dir))


def preview_refresh(spark, sf_dir):
    return S.messages_to_refresh(_messages(spark, sf_dir), _scraped(spark, sf_dir).where("summary is not null and summary <> ''"))


def scrape_tasks(spark, sf_dir):
    """Distinct links dealt to four workers in order."""
    return S.round_robin(extract_links(spark, sf_dir).select("url").distinct(), "url", 4)


def corpus_manifest(spark, sf_dir):
    """Links and messages as rows of the corpus: what is embedded, its size in estimated tokens, whether it is cut at 256, and its hash."""
    s = _scraped(spark, sf_dir).select(F.lit("link").alias("kind"), F.col("link_id").alias("id"), F.lit(None).cast("string").alias("text"), "summary", "what_it_is", "problem_solved")
    none = F.lit(None).cast("string")
    m = _messages(spark, sf_dir).select(F.lit("message").alias("kind"), F.col("msg_id").alias("id"), "text", none.alias("summary"), none.alias("what_it_is"), none.alias("problem_solved"))
    e = s.unionByName(m).select("kind", "id", T.embedded_text(*map(F.col, ("kind", "text", "summary", "what_it_is", "problem_solved"))).alias("e")).where("e <> ''")
    return e.select(F.concat_ws(":", "kind", F.col("id").cast("string")).alias("candidate_id"), T.estimated_tokens(F.col("e")).alias("token_count"), (T.estimated_tokens(F.col("e")) > 256).alias("truncated"), T.content_hash(F.col("e")).alias("content_hash")).distinct()


_KEYWORDS = ["vector", "c++", "latency", "open source", "v2.0", "prompt"]


def keyword_hits(spark, sf_dir):
    """Documents that hold a keyword whole, in any case."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    return d.select("doc_id", "text", F.explode(F.array(*map(F.lit, _KEYWORDS))).alias("keyword")).where(T.holds_word(F.col("text"), F.col("keyword"))).select("doc_id", "keyword")


def prompt_lists(spark, sf_dir):
    """Greedy batches of messages as the numbered lists a grader reads, and the tokens left beside them."""
    from tidewell.operators.ingest import packed_batches

    rows = table(spark, sf_dir, "messages", "msg_id", "source_id", "pos", "text").where("text is not null").distinct()
    b = packed_batches(rows).join(rows.select("msg_id", "pos", "text"), "msg_id")
    listed = b.groupBy("source_id", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("pos", "msg_id", "text"))).alias("items"))
    return listed.select("source_id", "batch_no", "n", T.token_budget(F.col("tokens")).alias("budget"), F.sha2(T.numbered(F.col("items.text")), 256).alias("prompt_hash"))


QUERIES = {f.__name__: f for f in (repository_links, message_upsert, link_upsert, graph_edges, graph_counts, node_deletion, payload_plan, payload_update, point_lookup, store_fanout, link_content, ingest_messages, trusted_bypass, process_candidates, candidate_counters, paste_completion, summary_gaps, preview_refresh, scrape_tasks, corpus_manifest, keyword_hits, prompt_lists)}

_SCR = "s as (select distinct link_id, url, title, status, raw_text, summary, what_it_is, problem_solved, how_useful, topics, entities, message_context.msg_id as msg_id from scraped_links)"
_ASK = "a as (select distinct ask_id, url, block_reason, partial_text, resolved from ask_links)"
_URLHOST = r"lower(regexp_extract(url, '^[a-zA-Z][\w+.-]*://([^/?#:]+)', 1))"
_STORE = """b{p} as (select sent_at, text, arg_max(quality, grade_id) filter (quality is not null) as q0, arg_max({{'q': quality, 'c': category}}, grade_id) as v from (select coalesce(datetime_iso, '') as sent_at, text, quality, case when grade_id % 3 = 0 then '' else coalesce(category, '') end as category, grade_id from (select distinct grade_id, msg_id, quality, category from grades) join (select distinct msg_id, datetime_iso, text from messages where text is not null) using (msg_id) where grade_id % 2 = {p}) group by 1, 2)"""
_GRAPH = f"""{_SCR}, {_LINKS}, h as (select msg_id::varchar as src, url as dst from s where msg_id is not null and url is not null union select msg_id::varchar, url from l),
gr as (select 'Message' as src_type, msg_id::varchar as src, 'ABOUT' as rel, 'Topic' as dst_type, t as dst from (select distinct msg_id, unnest(topics) as t from grades) where msg_id is not null and t <> ''
union select 'Link', url, 'MENTIONS', 'Entity', t from (select url, unnest(entities) as t from s) where url is not null and t <> '' union select 'Link', url, 'ABOUT', 'Topic', t from (select url, unnest(topics) as t from s) where url is not null and t <> ''
union select 'Message', src, 'CONTAINS', 'Link', dst from h where src in (select msg_id::varchar from messages))"""
_PLAN = "c as (select distinct grade_id, msg_id as id, category from grades where msg_id is not null and category is not null), w as (select id, arg_max(category, grade_id) as category from c group by 1), o as (select id, arg_min(category, grade_id) as category from c where id % 3 <> 0 group by 1), pl as (select id, w.category, case when o.id is null then 'not_in_index' when o.category = w.category then 'already_set' else 'to_update' end as state from w left join o using (id))"
_RAWSQL = f"r as (select distinct entry_id, {_TRIM.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} as text, coalesce(skip_grading, false) as trusted, received_at from ingest_requests)"
_PROC = f"""{_LINKS}, {_SCR}, {_ASK}, k as (select distinct url from s where link_id % 4 = 0 and url is not null), oc as (select url, arg_max(st, rank) as st from (select url, 'scraped' as st, 3 as rank from s where url is not null union all select url, {_ROUTE}, case when {_ROUTE} = 'blocked' then 2 else 1 end from a where url is not null) group by 1),
fi as (select url, min((msg_id, link_no)) as f from l group by 1),
pc as (select msg_id, link_no, url, case when k.url is not null or (msg_id, link_no) <> f then 'skipped_existing' else coalesce(st, 'not_scraped') end as result from l join fi using (url) left join k using (url) left join oc using (url))"""
_BLANK = lambda c: _TRIM.format(f"coalesce({c}, '')") + " = ''"
_WORDS = ", ".join(f"'{k}'" for k in _KEYWORDS)

ORACLE_SQL = {
    "repository_links": f"""with u as (select distinct url from (select url from scraped_links union all select url from ask_links union all select * from (values {", ".join(_row((x,)) for x in _REPOS)}) t(url)) where url is not null),
p as (select url, {_URLHOST} as host, list_filter(string_split(regexp_extract(url, '^[a-zA-Z][\\w+.-]*://[^/?#]+/?([^?#]*)', 1), '/'), lambda x: x <> '') as g from u),
q as (select *, len(g) as n, coalesce(g[1], '') as o, regexp_replace(coalesce(g[2], ''), '\\.git$', '') as rp, lower(coalesce(g[3], '')) as sub from p where host in ('github.com', 'www.github.com', 'gist.github.com') or host like '%.github.com' or contains(host, 'githubusercontent.com')),
k as (select *, case when contains(host, 'gist.github.com') then 'gist' when contains(host, 'raw.githubusercontent.com') then case when n < 4 then 'other' else 'raw' end when n < 2 then 'other' when n = 2 then 'repo' when sub in ('tree', 'blob', 'raw') then sub when sub in ('issues', 'discussions') then sub when sub in ('pull', 'pulls') then 'pulls' else 'other' end as kind, contains(host, 'raw.githubusercontent.com') as r from q)
select url, kind, case when kind in ('gist', 'other') then '' else o end as owner, case when kind in ('gist', 'other') then '' else rp end as repo, case when kind in ('tree', 'blob', 'raw') then case when r then g[3] else coalesce(g[4], '') end else '' end as ref, case when kind in ('tree', 'blob', 'raw') then array_to_string(list_slice(g, case when r then 4 else 5 end, n), '/') else '' end as path from k""",
    "message_upsert": f"with {_STORE.format(p=1)}, {_STORE.format(p=0)} select sent_at, sha256(text) as text_hash, case when b0.v is not null then b0.v.q else b1.v.q end as quality, coalesce(nullif(b0.v.c, ''), b1.v.c, '') as category, b1.v is null as created from b0 full join b1 using (sent_at, text)",
    "link_upsert": f"with {_LINKS}, {_SCR}, n as (select url, arg_max({{'t': title, 's': summary}}, link_id) as v from s where url is not null group by 1), o as (select distinct url from l) select url, case when v is not null then coalesce(v.t, '') else {_UT.format(u='url')} end as title, case when v is not null then 'scraped' end as status, length(coalesce(v.s, '')) as summary_length from n full join o using (url)",
    "graph_edges": f"with {_GRAPH} select * from gr",
    "graph_counts": f"with {_GRAPH}, nd as (select src_type as name, src as id from gr union select dst_type, dst from gr) select 'node' as what, name, count(*) as n from nd group by all union all select 'edge', rel, count(*) from gr group by all",
    "node_deletion": f"with {_GRAPH}, {_ASK}, x as (select url from a where not resolved and url is not null) select rel, count(*) as n from gr where not (src_type = 'Link' and src in (from x)) and not (dst_type = 'Link' and dst in (from x)) group by 1",
    "payload_plan": f"with {_PLAN} select * from pl",
    "payload_update": f"with {_PLAN}, u as (select o.id, coalesce(pl.category, o.category) as category from o left join (select * from pl where state = 'to_update') pl using (id)) select category, count(*) as n, sum(id)::bigint as ids from u group by 1",
    "point_lookup": "select doc_id, candidate_type, n_chars from documents where doc_id % 20 = 0",
    "store_fanout": f"with {_G}, {_SCR}, {_ASK}, m as (select msg_id, max(quality) as q from g where msg_id is not null group by 1) select 'messages' as counter, count(*) as n from m union all select 'vectored_messages', count(*) from m where q >= 4 union all select 'scraped_links', count(*) from s union all select 'vectored_links', count(*) from s where not ({_BLANK('summary')} and {_BLANK('what_it_is')} and {_BLANK('problem_solved')} and {_BLANK('raw_text')}) union all select 'blocked_links', count(*) from a where {_ROUTE} = 'blocked' union all select 'pending_links', count(*) from a where {_ROUTE} = 'ask_user'",
    "link_content": f"with {_SCR} select not ({_BLANK('summary')} and {_BLANK('what_it_is')} and {_BLANK('problem_solved')} and {_BLANK('raw_text')}) as has_content, not ({_BLANK('summary')} and {_BLANK('what_it_is')} and {_BLANK('problem_solved')}) as has_summary, count(*) as n from s group by all",
    "ingest_messages": f"with {_RAWSQL} select entry_id, length(text) as length, trusted, case when text = '' then 'blank text' else 'ok' end as outcome from r",
    "trusted_bypass": f"""with {_RAWSQL}, x as (select *, regexp_matches(text, '[0-9]')::int + contains(text, 'http')::int + (length(text) >= 120)::int + regexp_matches(lower(text), '(^|[^a-z])(because|so that|instead|turns out)([^a-z]|$)')::int as p from r where text <> '')
select entry_id, case when trusted then 5 else 1 + p end as quality, case when trusted then 1.0::double else round(0.6 + 0.1 * p, 6) end as confidence, case when trusted then 'resource' when p = 0 then 'noise' when contains(text, 'http') then 'resource' when contains(text, '?') then 'question' else 'insight' end as category from x""",
    "process_candidates": f"with {_PROC} select * from pc",
    "candidate_counters": f"with {_PROC} select result as counter, count(*) as n from pc group by 1 union all select 'no_links', count(*) from (select distinct msg_id from messages) where msg_id not in (select msg_id from pc)",
    "paste_completion": f"""with {_ASK}, p as (select * from a where not resolved and url is not null), d as (select 'LNK-' || upper(sha1(url)[1:6]) as link_id, max({_TRIM.format("coalesce(partial_text, '')")}) as c from p where ask_id % 3 = 0 and {_TRIM.format("coalesce(partial_text, '')")} <> '' group by 1),
h as (select url, count(*) as resolved, 'LNK-' || upper(sha1(url)[1:6]) as link_id from p group by 1) select url, coalesce(nullif(regexp_extract(c, '^([^\\n]*)', 1), ''), {_UT.format(u='url')})[1:120] as title, least(20000, length(c)) as raw_length, resolved from h join d using (link_id)""",
    "summary_gaps": "with " + _SCR + ", x as (select link_id, array_to_string(list_filter([" + ", ".join(f"case when {_BLANK(f)} then '{f}' end" for f in ("summary", "what_it_is", "problem_solved", "how_useful")) + f"], lambda v: v is not null), ',') as missing from s where not ({_BLANK('raw_text')})) select * from x where missing <> ''",
    "preview_refresh": f"with {_LINKS} select msg_id, count(*) as n_links from l where url in (select url from scraped_links where summary <> '') group by 1",
    "scrape_tasks": f"with {_LINKS} select url, (row_number() over (order by url) - 1) % 4 as worker from (select distinct url from l)",
    "corpus_manifest": f"""with {_SCR}, e as (select 'link:' || link_id as candidate_id, {_TRIM.format("concat_ws(' ', nullif(summary, ''), nullif(what_it_is, ''), nullif(problem_solved, ''))")} as e from s union all select 'message:' || msg_id, {_TRIM.format("coalesce(text, '')")} from (select distinct msg_id, datetime_iso, text from messages))
select distinct candidate_id, greatest(1, (length(e) + 3) // 4) as token_count, greatest(1, (length(e) + 3) // 4) > 256 as truncated, 'sha256:' || sha256(e) as content_hash from e where e <> ''""",
    "keyword_hits": f"select doc_id, k as keyword from documents, (select unnest([{_WORDS}]) as k) where regexp_matches(lower(text), '(?:^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(k) || '(?:[^\\p{{L}}\\p{{N}}_]|$)')",
}
