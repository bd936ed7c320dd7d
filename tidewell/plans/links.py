"""Queries on links, topics, commands and watch channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import links as L
from tidewell.operators.ingest import MIN_QUALITY
from tidewell.tables import table

#: The moment at which watch channels are looked at, in milliseconds.
NOW = 1_750_000_000_000


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "messages", "msg_id", "datetime_iso", "text").distinct()


def _scraped(spark, sf_dir):
    return table(spark, sf_dir, "scraped_links").select("link_id", "url", "status", "final_url", "title", "source", "raw_text", "summary", "what_it_is", "problem_solved", "how_useful", "link_intent", "topics", "entities", "scraped_at", "sent_at", F.col("message_context.msg_id").alias("msg_id")).distinct()


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "ask_links").select("ask_id", "url", "status", "block_reason", "partial_text", "created_at", "resolved", "sent_at", F.col("message_context.msg_id").alias("msg_id")).distinct()


def extract_links(spark, sf_dir):
    return _messages(spark, sf_dir).select("msg_id", F.posexplode(T.links_in(F.coalesce("text", F.lit("")))).alias("k", "url")).select("msg_id", F.col("k").cast("long").alias("link_no"), "url").distinct()


def url_classify(spark, sf_dir):
    u = F.col("url")
    kind = F.when(T.url_host(u).rlike(r"(^|\.)(youtube\.com|youtu\.be)$"), "youtube").when(T.url_host(u).rlike(r"(^|\.)github\.com$"), "github").when(T.url_host(u).rlike(r"(^|\.)(x|twitter)\.com$"), "x").otherwise("web")
    return _scraped(spark, sf_dir).select("link_id", T.url_host(u).alias("host"), T.url_title(u).alias("url_title"), T.paste_id(u).alias("paste_id"), kind.alias("kind"), T.link_point_id(u).alias("point_id"))


_FETCHED = [(-1, 401, "t", "x", "", 0), (-2, 404, "t", "x", "", 0), (-3, 503, "t", "x", "", 0), (-4, 200, "Just a moment...", "y" * 80, "https://a.test/", 0), (-5, 200, "t", "short", "https://a.test/", 60_000), (-6, 200, "t", "short", "https://a.test/", 100), (-7, 200, "t", "y" * 80, "https://a.test/signin?x", 0), (-8, 200, "Unlock the rest", "y" * 80, "https://a.test/", 0), (-9, 200, "t", "y" * 80, "https://a.test/", 0)]


def web_outcome(spark, sf_dir):
    """Pages of the table as fetched without an error, and one page for each rule."""
    rows = _scraped(spark, sf_dir).select("link_id", F.lit(200).alias("code"), "title", "raw_text", "final_url", F.lit(0).alias("html"))
    edge = spark.createDataFrame(_FETCHED, "link_id long, code int, title string, raw_text string, final_url string, html int")
    return rows.unionByName(edge).select("link_id", L.outcome_class(F.col("code"), F.col("title"), F.col("raw_text"), F.col("final_url"), F.col("html")).alias("outcome"))


def outcome_routing(spark, sf_dir):
    rows = _asked(spark, sf_dir).select(F.coalesce(L.reason_code(F.col("block_reason")), F.lit("unknown")).alias("code"), L.routed(F.col("block_reason")).alias("route"), "resolved")
    return rows.groupBy("code", "route").agg(F.count(F.lit(1)).alias("n"), F.count_if("resolved").alias("resolved"))


def pending_links(spark, sf_dir):
    """Unresolved pastes with their ready identifier."""
    return _asked(spark, sf_dir).where("not resolved and url is not null").select("ask_id", "url", T.paste_id(F.col("url")).alias("paste_id"), "sent_at")


def link_previews(spark, sf_dir):
    return L.previews(_messages(spark, sf_dir), _scraped(spark, sf_dir), _asked(spark, sf_dir))


def seen_url_first(spark, sf_dir):
    rows = extract_links(spark, sf_dir)
    known = _scraped(spark, sf_dir).select("url").distinct()
    return L.first_seen(rows.join(known, "url", "left_anti"), "url", [F.col("msg_id"), F.col("link_no")]).select("url", "msg_id", "link_no")


def replace_current(spark, sf_dir):
    old = L.latest_by_key(_asked(spark, sf_dir).select("url", "status", "ask_id"), "url", [F.col("ask_id")])
    new = L.latest_by_key(_scraped(spark, sf_dir).select("url", "status", F.col("link_id").alias("ask_id")), "url", [F.col("ask_id")])
    return L.replace_current(old.select("url", "status", "ask_id"), new.select("url", "status", "ask_id"), "url")


def link_merge(spark, sf_dir):
    old = L.latest_by_key(_asked(spark, sf_dir).select("url", "status", F.lit(None).cast("string").alias("title"), F.col("created_at").alias("seen_at"), "ask_id"), "url", [F.col("ask_id")]).drop("ask_id")
    new = L.latest_by_key(_scraped(spark, sf_dir).select("url", "status", "title", F.col("scraped_at").alias("seen_at"), "link_id"), "url", [F.col("link_id")]).drop("link_id")
    return L.merge_links(old, new)


def skip_transition(spark, sf_dir):
    links = L.latest_by_key(_asked(spark, sf_dir).select("url", "status", "ask_id"), "url", [F.col("ask_id")]).drop("ask_id")
    asked = _scraped(spark, sf_dir).select("url").union(_asked(spark, sf_dir).select("url")).where("url is not null").distinct()
    return L.skip_transition(links, asked)


def link_coverage(spark, sf_dir):
    fields = ("summary", "what_it_is", "problem_solved", "how_useful", "raw_text")
    said = [F.count_if(F.trim(F.coalesce(c, F.lit(""))) != "").alias(c) for c in fields]
    return _scraped(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), *said, F.max(F.length("raw_text")).cast("long").alias("longest"), F.round(F.avg(F.length("raw_text")), 6).alias("mean_length"))


def link_attribution(spark, sf_dir):
    return L.attribution(_scraped(spark, sf_dir).select("url", "sent_at", "msg_id").unionByName(_asked(spark, sf_dir).select("url", "sent_at", "msg_id")))


def restore_candidates(spark, sf_dir):
    """Good messages that aren't indexed: the half of `restore_all` that its SQL tells."""
    good = table(spark, sf_dir, "grades", "grade_id", "msg_id", "quality").distinct().where(F.col("quality") >= MIN_QUALITY).select("msg_id").distinct()
    indexed = table(spark, sf_dir, "documents", "doc_id", "candidate_type").where("candidate_type = 'message'").select(F.col("doc_id").alias("msg_id"))
    return good.join(indexed, "msg_id", "left_anti")


def restore_all(spark, sf_dir):
    """Good messages (by id) and links with content (by url) that are in neither index: what a rebuild has to bring back."""
    indexed = table(spark, sf_dir, "documents", "candidate_type", "url").where("candidate_type = 'link'")
    messages = restore_candidates(spark, sf_dir).select(F.lit("message").alias("kind"), F.col("msg_id").cast("string").alias("item"))
    return messages.unionByName(L.restorable_links(_scraped(spark, sf_dir), indexed).select(F.lit("link").alias("kind"), F.col("url").alias("item")))


def _items(spark, sf_dir):
    return L.topic_items(table(spark, sf_dir, "grades", "msg_id", "topics"), table(spark, sf_dir, "scraped_links", "link_id", "topics"))


def topic_groups(spark, sf_dir):
    return L.topic_groups(_items(spark, sf_dir))


def topic_neighbours(spark, sf_dir):
    return L.topic_neighbours(_items(spark, sf_dir))


_ASKED = ["Vector-Search", "graph stores", "prompt", "embedding", "nothing like it"]


def topic_browse(spark, sf_dir):
    return L.browse_topic(_items(spark, sf_dir), spark.createDataFrame([(x,) for x in _ASKED], "name string"))


def topic_suggest(spark, sf_dir):
    return L.suggest_topics(L.topic_groups(_items(spark, sf_dir)), spark.createDataFrame([(x,) for x in _ASKED], "name string"))


def messages_filtered(spark, sf_dir):
    """Messages since a stamp (compared as text) with a good grade on a topic, through the edge table."""
    best = table(spark, sf_dir, "grades", "grade_id", "msg_id", "quality").distinct().groupBy("msg_id").agg(F.max("quality").alias("quality")).where(F.col("quality") >= MIN_QUALITY)
    edge = _items(spark, sf_dir).where("key = 'vector search'").select(F.regexp_replace("item", "^m", "").alias("m")).where("m rlike '^[0-9]+$'").select(F.col("m").cast("long").alias("msg_id")).distinct()
    return _messages(spark, sf_dir).where("datetime_iso >= '2024-01-01'").join(best, "msg_id").join(edge, "msg_id", "left_semi").select("msg_id", F.col("datetime_iso").alias("sent_at"), "quality", T.snippet(F.col("text")).alias("snippet")).distinct()


def item_lookup(spark, sf_dir):
    """Messages with grade, topics and links: three independent look-ups, so none multiplies another."""
    m = table(spark, sf_dir, "messages", "msg_id").distinct()
    g = table(spark, sf_dir, "grades", "grade_id", "msg_id", "quality").distinct().groupBy("msg_id").agg(F.max("quality").alias("quality"))
    t = _items(spark, sf_dir).where("item like 'm%'").select(F.regexp_replace("item", "^m", "").cast("long").alias("msg_id"), "key").distinct().groupBy("msg_id").agg(F.count(F.lit(1)).alias("n_topics"))
    k = _scraped(spark, sf_dir).where("msg_id is not null").select("msg_id", "url").distinct().groupBy("msg_id").agg(F.count(F.lit(1)).alias("n_links"), F.min("url").alias("first_url"))
    return m.join(g, "msg_id", "left").join(t, "msg_id", "left").join(k, "msg_id", "left").select("msg_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("n_topics", F.lit(0)).alias("n_topics"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "first_url")


def category_backfill(spark, sf_dir):
    """The i-th grade of a text belongs to its i-th message, where both are equally many; else it stays unmatched."""
    from tidewell.operators.ordered import row_numbers

    m = _messages(spark, sf_dir).where("text is not null").select("msg_id", F.sha2("text", 256).alias("h"))
    g = table(spark, sf_dir, "grades", "grade_id", "category", "original_text").distinct().where("original_text is not null").select("grade_id", "category", F.sha2("original_text", 256).alias("h"))
    counts = m.groupBy("h").agg(F.count(F.lit(1)).alias("nm")).join(g.groupBy("h").agg(F.count(F.lit(1)).alias("ng")), "h").where("nm = ng").select("h")
    left = row_numbers(m.join(counts, "h", "left_semi"), ["h"], ["msg_id"])
    right = row_numbers(g.join(counts, "h", "left_semi"), ["h"], ["grade_id"])
    return left.join(right, ["h", "rn"]).select("msg_id", "grade_id", "category")


_COMMANDS = [(-1, "/start"), (-2, "/paste LNK-1 : body: more"), (-3, "/skip  LNK-2 "), (-4, "/blocked"), (-5, "see https://example.test/a"), (-6, "  "), (-7, "/ingest --trusted text"), (-8, "/via Ada: a note"), (-9, "/via Ada a note"), (-10, "/via note"), (-11, "/ask what now?"), (-12, "/ingest plain"), (-13, "/paste only"), (-14, "--trusted http://a.test"), (-15, "/Start")]


def _commands(spark, sf_dir):
    edge = spark.createDataFrame(_COMMANDS, "entry_id long, text string")
    return table(spark, sf_dir, "query_jobs", "entry_id", "text").unionByName(edge)


def command_routing(spark, sf_dir):
    return _commands(spark, sf_dir).select("entry_id", T.command(F.col("text")).alias("command"))


def command_parts(spark, sf_dir):
    return _commands(spark, sf_dir).select("entry_id", T.command_parts(F.col("text")).alias("p")).select("entry_id", "p.*")


def watch_renewal(spark, sf_dir):
    rows = table(spark, sf_dir, "drive_watch_state", "channel_id", "installation_id", "expiration", "status").distinct()
    at = F.expr("try_cast(case when trim(expiration) rlike '^[0-9]{13}$' then trim(expiration) end as bigint)")
    return rows.where("status = 'active'").select("channel_id", "installation_id", L.renewal_due(at, F.lit(NOW)).alias("due"), F.date_format(F.timestamp_millis(at), "yyyy-MM-dd HH:mm 'UTC'").alias("expires"))


QUERIES = {f.__name__: f for f in (extract_links, url_classify, web_outcome, outcome_routing, pending_links, link_previews, seen_url_first, replace_current, link_merge, skip_transition, link_coverage, link_attribution, restore_candidates, restore_all, topic_groups, topic_neighbours, topic_browse, topic_suggest, messages_filtered, item_lookup, category_backfill, command_routing, command_parts, watch_renewal)}

_S = "s as (select distinct link_id, url, status, final_url, title, source, raw_text, summary, what_it_is, problem_solved, how_useful, scraped_at, sent_at, message_context.msg_id as msg_id from scraped_links)"
_A = "a as (select distinct ask_id, url, status, block_reason, created_at, resolved, sent_at, message_context.msg_id as msg_id from ask_links)"
_LINKS = r"""e as (select msg_id, list_transform(regexp_extract_all(coalesce(text, ''), 'https?://[^\s<>"'']+'), lambda u: regexp_replace(u, '[.,;:!?)\]}>*_]+$', '')) as us from (select distinct msg_id, datetime_iso, text from messages)),
f as (select msg_id, u as url, min(k) as k0 from (select msg_id, unnest(us) as u, generate_subscripts(us, 1) as k from e) group by all),
l as (select msg_id, url, row_number() over (partition by msg_id order by k0) - 1 as link_no from f)"""
_HOST = r"regexp_replace(lower(regexp_extract({u}, '^[a-zA-Z][\w+.-]*://([^/?#:]+)', 1)), '^www\.', '')"
_SEGS = r"list_filter(string_split(regexp_extract({u}, '^[a-zA-Z][\w+.-]*://[^/?#]+/?([^?#]*)', 1), '/'), lambda p: p <> '' and lower(p) not in (" + ", ".join(f"'{x}'" for x in T.URL_NOISE) + r") and not regexp_full_match(p, '[0-9]+'))"
_UT = "array_to_string(list_concat([" + _HOST + "], list_slice(" + _SEGS + ", -2, -1)), ' / ')"
_KEY = r"""array_to_string(list_transform(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: case when length(w) > 3 and w like '%s' and w not like '%ss' then w[1:length(w) - 1] else w end), ' ')"""
_ITEMS = "i as (select distinct item, trim(name) as name, " + _KEY.format(c="trim(name)") + " as key from (select 'm' || msg_id as item, unnest(topics) as name from grades union all select 'l' || link_id, unnest(topics) from scraped_links) where trim(name) <> ''), ii as (select * from i where key <> '')"
_GROUPS = "bn as (select key, name, count(*) as n from ii group by all), gr as (select key, arg_max(name, n) as x, min(name) filter (n = top) as canonical, count(*) as variants from (select *, max(n) over (partition by key) as top from bn) group by key), groups as (select gr.key, canonical, variants, count(distinct item) as n_items from gr join ii using (key) group by all)"
_CODE = "nullif(regexp_extract(coalesce(block_reason, ''), '^([a-z_]+)', 1), '')"
_ROUTE = f"case when {_CODE} in ('truncated', 'paywall', 'auth_required') then 'ask_user' else 'blocked' end"
_BEST = "b as (select msg_id, max(quality) as quality from (select distinct grade_id, msg_id, quality from grades) group by 1)"
_ASKSQL = ", ".join(f"('{x}')" for x in _ASKED)

_TRIM = r"regexp_replace({}, '^[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+|[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+$', '', 'g')"
_CMD = f"""q as (select entry_id, text from query_jobs union all select * from (values {", ".join(repr(x) for x in _COMMANDS)}) t(entry_id, text)), r as (select entry_id, {_TRIM.format("coalesce(text, '')")} as t from q),
c as (select *, case when starts_with(t, '/start') then 'start' when starts_with(t, '/ask') then 'query' when starts_with(t, '/ingest') or starts_with(t, '/via') then 'ingest' when starts_with(t, '/paste') then 'paste' when starts_with(t, '/skip') then 'skip' when starts_with(t, '/blocked') then 'blocked' when contains(t, 'http://') or contains(t, 'https://') then 'ingest' else 'query' end as command from r)"""

ORACLE_SQL = {
    "extract_links": f"with {_LINKS} select msg_id, link_no, url from l",
    "url_classify": f"""with {_S}, h as (select *, {_HOST.format(u='url')} as host, sha1(unhex('{T.URL_NAMESPACE}') || encode('link-' || url)) as h from s)
select link_id, host, {_UT.format(u='url')} as url_title, 'LNK-' || upper(sha1(url)[1:6]) as paste_id, case when regexp_matches(host, '(^|\\.)(youtube\\.com|youtu\\.be)$') then 'youtube' when regexp_matches(host, '(^|\\.)github\\.com$') then 'github' when regexp_matches(host, '(^|\\.)(x|twitter)\\.com$') then 'x' else 'web' end as kind,
concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], printf('%02x', (('0x' || h[17:18])::int & 63) | 128) || h[19:20], h[21:32]) as point_id from h""",
    "web_outcome": f"""with {_S}, p as (select link_id, 200 as code, title, raw_text, final_url, 0 as html from s union all select * from (values {", ".join(repr(x) for x in _FETCHED)}) t(link_id, code, title, raw_text, final_url, html))
select link_id, case when code in (401, 403, 407) then 'auth_required' when code = 404 then 'not_found' when code >= 500 then 'failed'
when regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(raw_text, '')[1:6000]), '{T.PAYWALL}') then 'paywall' when regexp_matches(lower(coalesce(final_url, '')), '{T.LOGIN_PATH}') then 'auth_required'
when regexp_matches(lower(coalesce(title, '')), '{T.CHALLENGE}') then 'challenge_blocked' when length({_TRIM.format("coalesce(raw_text, '')")}) < 50 and html > 50000 then 'auth_required' when length({_TRIM.format("coalesce(raw_text, '')")}) < 50 then 'empty_content' end as outcome from p""",
    "outcome_routing": f"with {_A} select coalesce({_CODE}, 'unknown') as code, {_ROUTE} as route, count(*) as n, count(*) filter (resolved) as resolved from a group by 1, 2",
    "pending_links": f"with {_A} select distinct ask_id, url, 'LNK-' || upper(sha1(url)[1:6]) as paste_id, sent_at from a where not resolved and url is not null",
    "link_previews": f"""with {_LINKS}, {_S}, {_A}, p as (select url, arg_max(st, rank) as st from (select url, 3 as rank, 'scraped' as st from s union all select url, case when {_ROUTE} = 'blocked' then 2 else 1 end, {_ROUTE} from a) where url is not null group by 1)
select msg_id, link_no, l.url, coalesce(st, 'not_scraped') as preview_status from l left join p using (url)""",
    "seen_url_first": f"with {_LINKS} select url, (arg_min((msg_id, link_no), (msg_id, link_no))).msg_id as msg_id, (arg_min((msg_id, link_no), (msg_id, link_no))).link_no as link_no from (select url, msg_id, link_no from l where url not in (select url from scraped_links where url is not null)) group by 1".replace("(msg_id, link_no), (msg_id", "{'msg_id': msg_id, 'link_no': link_no}, (msg_id"),
    "replace_current": f"with {_A}, {_S}, o as (select url, arg_max(status, ask_id) as status, max(ask_id) as ask_id from a where url is not null group by 1), n as (select url, arg_max(status, link_id) as status, max(link_id) as ask_id from s where url is not null group by 1) select * from n union all select * from o where url not in (select url from n)",
    "link_merge": f"""with {_A}, {_S}, o as (select url, arg_max(status, ask_id) as status, arg_max(created_at, ask_id) as seen_at from a where url is not null group by 1), n as (select url, arg_max(status, link_id) as status, arg_max(title, link_id) as title, arg_max(scraped_at, link_id) as seen_at from s where url is not null group by 1)
select url, coalesce(nullif(n.status, ''), o.status) as status, coalesce(n.title, {_UT.format(u='url')}) as title, coalesce(nullif(n.seen_at, ''), o.seen_at) as seen_at from o full join n using (url)""",
    "skip_transition": f"with {_A}, {_S}, o as (select url, arg_max(status, ask_id) as status from a where url is not null group by 1), k as (select url from s where url is not null union select url from a where url is not null) select url, case when status is null then 'not_found' when status in ('blocked', 'pending_paste') then 'skipped' else 'conflict' end as outcome, case when status in ('blocked', 'pending_paste') then 'skipped' else status end as status from k left join o using (url)",
    "link_coverage": f"with {_S} select source, count(*) as n, " + ", ".join(f"count(*) filter (trim(coalesce({c}, '')) <> '') as {c}" for c in ("summary", "what_it_is", "problem_solved", "how_useful", "raw_text")) + ", max(length(s.raw_text)) as longest, round(avg(length(s.raw_text)), 6) as mean_length from s group by 1",
    "link_attribution": f"with {_S}, {_A} select url, min(sent_at) as first_sent_at, count(distinct msg_id) as n_messages from (select url, sent_at, msg_id from s union all select url, sent_at, msg_id from a) where url is not null group by 1",
    "restore_candidates": "select distinct msg_id from grades where quality >= 4 and msg_id is not null and msg_id not in (select doc_id from documents where candidate_type = 'message')",
    "restore_all": """select 'message' as kind, msg_id::varchar as item from (select distinct msg_id from grades where quality >= 4 and msg_id is not null and msg_id not in (select doc_id from documents where candidate_type = 'message'))
union all select 'link', url from (select distinct url from scraped_links where coalesce(nullif(status, ''), 'scraped') = 'scraped' and trim(coalesce(summary, '') || coalesce(what_it_is, '') || coalesce(problem_solved, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' and url not in (select url from documents where candidate_type = 'link' and url is not null))""",
    "topic_groups": f"with {_ITEMS}, {_GROUPS} select * from groups",
    "topic_neighbours": f"with {_ITEMS}, k as (select distinct item, key from ii), p as (select a.key, b.key as other, count(*) as shared from k a join k b on a.item = b.item and a.key <> b.key group by all), r as (select *, row_number() over (partition by key order by shared desc, other) as rank from p) select * from r where rank <= 5",
    "topic_browse": f"with {_ITEMS}, q as (select distinct {_KEY.format(c='name')} as key from (values {_ASKSQL}) t(name)) select distinct key, item from ii join q using (key)",
    "topic_suggest": f"with {_ITEMS}, {_GROUPS}, q as (select name as asked, {_KEY.format(c='name')} as akey from (values {_ASKSQL}) t(name)), r as (select asked, canonical, n_items, row_number() over (partition by asked order by abs(length(key) - length(akey)), canonical) as rank from q join groups on contains(key, akey) or contains(akey, key)) select asked, rank, canonical, n_items from r where rank <= 5",
    "messages_filtered": f"with {_ITEMS}, {_BEST} select distinct m.msg_id, datetime_iso as sent_at, quality, case when length(text) > 300 then regexp_replace(text[1:299], '\\s+$', '') || '…' else text end as snippet from messages m join b using (msg_id) where datetime_iso >= '2024-01-01' and quality >= 4 and 'm' || m.msg_id in (select item from ii where key = 'vector search')",
    "item_lookup": f"""with {_ITEMS}, {_BEST}, {_S}, t as (select item, count(distinct key) as n from ii group by 1), k as (select msg_id, count(distinct url) as n, min(url) as u from s where msg_id is not null group by 1)
select m.msg_id, coalesce(quality, 0) as quality, coalesce(t.n, 0) as n_topics, coalesce(k.n, 0) as n_links, k.u as first_url from (select distinct msg_id from messages) m left join b using (msg_id) left join t on t.item = 'm' || m.msg_id left join k on k.msg_id = m.msg_id""",
    "category_backfill": """with m as (select distinct msg_id, datetime_iso, text from messages where text is not null), g as (select distinct grade_id, category, original_text as text from grades where original_text is not null),
c as (select text from (select text, count(*) as n from m group by 1) join (select text, count(*) as n2 from g group by 1) using (text) where n = n2)
select msg_id, grade_id, category from (select *, row_number() over (partition by text order by msg_id) as rn from m where text in (select text from c)) join (select *, row_number() over (partition by text order by grade_id) as rn from g where text in (select text from c)) using (text, rn)""",
    "command_routing": f"with {_CMD} select entry_id, command from c",
    "command_parts": f"""with {_CMD}, d as (select *, case when starts_with(t, '/ingest') then {_TRIM.format("t[8:]")} else t end as i, {_TRIM.format("t[5:]")} as v, {_TRIM.format("t[7:]")} as p from c)
select entry_id, case when starts_with(t, '/ask') then {_TRIM.format("t[5:]")} when starts_with(t, '/via') then case when contains(v, ':') then {_TRIM.format("v[instr(v, ':') + 1:]")} when regexp_matches(v, '[ \t]') then {_TRIM.format("regexp_replace(v, '^[^ \t]*[ \t]', '')")} else v end
when command = 'ingest' then case when starts_with(i, '--trusted') then {_TRIM.format("i[10:]")} else i end when command = 'paste' then case when contains(p, ':') then {_TRIM.format("p[instr(p, ':') + 1:]")} else p end when command = 'skip' then '' else t end as content,
case when command = 'paste' then case when contains(p, ':') then {_TRIM.format("p[1:instr(p, ':') - 1]")} else '' end when command = 'skip' then {_TRIM.format("t[6:]")} else '' end as link_id,
command = 'ingest' and starts_with(i, '--trusted') and not starts_with(t, '/via') as trusted from d""",
    "watch_renewal": f"""with w as (select distinct channel_id, installation_id, status, case when regexp_full_match(trim(expiration), '[0-9]{{13}}') then trim(expiration)::bigint end as at_ms from drive_watch_state)
select channel_id, installation_id, at_ms is null or at_ms <= {NOW} + 86400000 as due, strftime(make_timestamp(at_ms * 1000), '%Y-%m-%d %H:%M UTC') as expires from w where status = 'active'""",
}
