"""Queries on notifications, change feeds, pages and the model surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import feeds as X
from tidewell.operators import models as M
from tidewell.plans.ingest import _row
from tidewell.plans.links import _TRIM
from tidewell.plans.retrieval import _tok
from tidewell.plans.systems import _PLACES, _VEC, _unit
from tidewell.tables import table

_TOKEN = "s3cret"


def notifications(spark, sf_dir):
    """Watch channels as the notifications they send: names of headers in varying case, a third with another token, a fifth without a state."""
    w = table(spark, sf_dir, "drive_watch_state", "channel_id", "resource_id", "status").distinct().where("channel_id is not null")
    h = F.pmod(F.conv(F.substring(F.md5("channel_id"), 1, 6), 16, 10).cast("int"), F.lit(15))
    headers = F.create_map(F.when(h % 2 == 0, "X-Goog-Channel-ID").otherwise("x-goog-channel-id"), F.col("channel_id"), F.lit("X-Goog-Channel-Token"), F.when(h % 3 == 0, "other").otherwise(_TOKEN), F.lit("X-Goog-Message-Number"), F.lit("1"), F.lit("X-Goog-Resource-ID"), F.col("resource_id"), F.lit("X-Goog-Resource-State"), F.when(h % 5 == 0, "  ").otherwise("change"))
    return X.notifications(w.select(F.col("channel_id").alias("id"), headers.alias("headers")), _TOKEN).distinct()


def event_validation(spark, sf_dir):
    """Watch channels as events: blank fields, other installations than the commonest in order, unknown states."""
    w = table(spark, sf_dir, "drive_watch_state", "channel_id", "installation_id", "resource_id", "status").distinct()
    e = w.withColumn("resource_state", F.when(F.col("status") == "active", "change").otherwise(F.col("status")))
    return e.select("channel_id", "installation_id", "resource_id", F.coalesce(X.event_error(["channel_id", "installation_id", "resource_id"], "inst_1"), F.lit("ok")).alias("outcome")).distinct()


def _changes(spark, sf_dir):
    """Parsed exports as changes of archives: sources are files, media messages deletions."""
    s = table(spark, sf_dir, "ingestion_sources", "source_id", "source_type", "file_name", "revision").distinct()
    n = F.conv(F.substring(F.md5("source_id"), 1, 6), 16, 10).cast("long")
    file = F.struct(F.when(n % 4 == 0, "text/plain").when(n % 2 == 0, "Application/ZIP").otherwise("application/x-zip-compressed").alias("mimeType"), F.when(n % 7 == 0, F.array(F.lit("other"))).otherwise(F.array(F.lit("other"), F.lit("inbox"))).alias("parents"), (n % 11 == 0).alias("trashed"), F.col("revision").alias("modifiedTime"))
    return s.select(n.alias("change_no"), F.col("source_id").alias("file_id"), (n % 13 == 0).alias("removed"), F.when(n % 9 == 0, "drive").otherwise("file").alias("type"), file.alias("file"))


def changed_files(spark, sf_dir):
    """Archives to import: relevant changes whose revision isn't the last one imported."""
    seen = table(spark, sf_dir, "ingestion_sources", "source_id", "revision").where("revision is not null and source_id like '%1'").select(F.col("source_id").alias("file_id"), "revision").distinct()
    return X.changed_files(_changes(spark, sf_dir), "inbox", seen)


def advanced_token(spark, sf_dir):
    """The feed's place after a batch that went through, and after one with a failure."""
    c, none = _changes(spark, sf_dir), spark.createDataFrame([], "file_id string, error string")
    good = X.advanced_token(c, none, 7).select(F.lit("good").alias("batch"), "*")
    return good.unionByName(X.advanced_token(c, spark.createDataFrame([("b", "broken archive"), ("a", None), ("c", "no text")], "file_id string, error string"), 7).select(F.lit("bad").alias("batch"), "*"))


def page_text(spark, sf_dir):
    """Documents written as pages with furniture around them, and read back."""
    d = table(spark, sf_dir, "documents", "doc_id", "title", "text").where("text is not null")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<html><head><title>"), esc(F.coalesce("title", F.lit(""))), F.lit("</title><style>p {x: y}</style></head><body><nav><a href='/'>Home</a></nav><!-- hidden --><script>var a = 1 < 2;</script><main><p>"), F.replace(esc(F.col("text")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></main><footer>all rights</footer></body></html>"))
    return X.page_text(d.select(F.col("doc_id").alias("page_id"), html.alias("html"))).select("page_id", F.coalesce("title", F.lit("")).alias("title"), F.sha2("text", 256).alias("text_hash"))


_REPO = [("ada/tool", " A tool ", "https://a.test", ["search", "", "text"], "Python", 12, "MIT", "Read me"), ("ada/bare", None, "", None, None, None, None, None), ("b/c", "x", None, [], "Go", 0, "", "r")]


def repository_pages(spark, sf_dir):
    return X.repository_pages(spark.createDataFrame(_REPO, "full_name string, description string, homepage string, topics array<string>, language string, stars int, licence string, readme string"))


def transcripts(spark, sf_dir):
    """Messages of a source as the snippets of a recording."""
    m = table(spark, sf_dir, "messages", "msg_id", "source_id", "pos", "text").distinct()
    return X.transcripts(m.select(F.col("source_id").alias("video_id"), F.struct("pos", "msg_id").alias("at"), "text")).select("video_id", F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("length"))


def text_embedding(spark, sf_dir):
    """Offline vectors of all documents."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("key"), "text")
    e = M.hashed_vectors(d)
    return e.select(F.col("key").alias("doc_id"), F.array_join(F.transform("embedding", lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("embedding"))


def message_enrichment(spark, sf_dir):
    m = table(spark, sf_dir, "messages", "msg_id", "text").distinct()
    return M.enriched(m).select("msg_id", "link_intent", F.array_join("entities", "|").alias("entities"), F.array_join("topics", "|").alias("topics"))


def two_pass_grades(spark, sf_dir):
    """Documents graded in pieces by the offline rubric, borderline ones again by one that asks for a reason or a link."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select(F.col("doc_id").alias("entry_id"), "text")
    second = lambda m: M.rubric_grades(m).withColumn("quality", F.when(F.col("category") == "resource", 4).otherwise(2))
    return M.two_pass_grades(d, M.rubric_grades, second)


def summary_merge(spark, sf_dir):
    """Grades as the partial summaries of their message: topics as entities and topics, reasons as points."""
    g = table(spark, sf_dir, "grades", "grade_id", "msg_id", "reason", "topics").distinct().where("msg_id is not null")
    topics = F.filter(F.coalesce("topics", F.array().cast("array<string>")), lambda x: x.isNotNull())
    return M.merged_summaries(g.select(F.col("msg_id").alias("key"), F.col("grade_id").alias("piece_no"), F.coalesce("reason", F.lit("")).alias("point"), topics.alias("entities"), topics.alias("topics"))).select("key", "points", F.array_join("entities", "|").alias("entities"), F.array_join("topics", "|").alias("topics"))


def graded_batches(spark, sf_dir):
    """Batches of messages as prompts, answered by a provider that grades the number of lines and once forgets one."""
    m = table(spark, sf_dir, "messages", "msg_id", "source_id", "pos", "text").where("text is not null").distinct()
    asked: set = set()

    def provider(prompts: list[str]) -> list[str]:
        import json
        import re

        out = []
        for p in prompts:
            n = max(int(x) for x in re.findall(r"(?m)^(\d+)\) ", p))
            n -= p not in asked and len(p) % 2
            asked.add(p)
            out.append("```json\n" + json.dumps([{"quality": 1 + len(p) % 5, "confidence": 0.5, "category": "insight"}] * n) + "\n```")
        return out

    # A line that looks like a list number would mislead this provider; texts are told by their hash.
    prompts = M.prompts_of(m.withColumn("text", F.sha2("text", 256)))
    return M.graded_batches(prompts, provider).select("key", F.size("grades").cast("long").alias("n"))


QUERIES = {f.__name__: f for f in (notifications, event_validation, changed_files, advanced_token, page_text, repository_pages, transcripts, text_embedding, message_enrichment, two_pass_grades, summary_merge, graded_batches)}

_H = "('0x' || md5({})[1:6])::bigint"
_CH = f"c as (select distinct source_id as file_id, revision, {_H.format('source_id')} as n from ingestion_sources)"

ORACLE_SQL = {
    "notifications": f"with w as (select distinct channel_id as id, resource_id, {_H.format('channel_id')} % 15 as h from drive_watch_state where channel_id is not null), e as (select *, case when trim(coalesce(resource_id, '')) = '' then 'missing x-goog-resource-id' when h % 5 = 0 then 'missing x-goog-resource-state' when h % 3 = 0 then 'bad token' end as error from w) select distinct id, error, case when error is null then id end as channel_id, case when error is null then resource_id end as resource_id, case when error is null then 'change' end as resource_state, case when error is null then '1' end as message_number from e",
    "event_validation": "select distinct channel_id, installation_id, resource_id, case when trim(coalesce(channel_id, '')) = '' then 'missing channel_id' when trim(coalesce(installation_id, '')) = '' then 'missing installation_id' when trim(coalesce(resource_id, '')) = '' then 'missing resource_id' when installation_id <> 'inst_1' then 'wrong installation' when case when status = 'active' then 'change' else status end not in ('" + "', '".join(X.STATES) + "') then 'unknown state' else 'ok' end as outcome from drive_watch_state",
    "changed_files": f"with {_CH}, r as (select file_id, arg_max(revision, n) as revision from c where n % 13 <> 0 and n % 9 <> 0 and n % 11 <> 0 and n % 4 <> 0 and n % 7 <> 0 group by 1) select * from r where (file_id, revision) not in (select (source_id, revision) from ingestion_sources where revision is not null and source_id like '%1') or revision is null",
    "advanced_token": f"with {_CH} select 'good' as batch, max(n) as token, null as error from c union all select 'bad', 7, 'b: broken archive'",
    "page_text": f"with d as (select doc_id as page_id, regexp_replace({_TRIM.format(chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')}, '\\s+', ' ', 'g') as title, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM.format(chr(114) + 'egexp_replace(x, ' + chr(39) + '[ \\t]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}), lambda x: x <> '') as ls from documents where text is not null) select page_id, title, sha256(array_to_string(ls, chr(10))) as text_hash from d",
    "repository_pages": "select * from (values ('ada/tool', '# ada/tool\nA tool\nHomepage: https://a.test | Topics: search, text | Language: Python | Stars: 12 | License: MIT\n---\n\nRead me'), ('ada/bare', '# ada/bare\n---\n\n'), ('b/c', '# b/c\nx\nLanguage: Go | Stars: 0\n---\n\nr')) t(full_name, text)",
    "transcripts": f"with m as (select distinct msg_id, source_id, pos, {_TRIM.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} as t from messages), g as (select source_id as video_id, coalesce(string_agg(t, ' ' order by pos nulls first, msg_id) filter (t <> ''), '') as text from m group by 1) select video_id, sha256(text) as text_hash, length(text) as length from g",
    "text_embedding": f"with p as (select doc_id, {_PLACES.format(t=_tok('text'))} as ps from documents), c as (select doc_id, ps, {_VEC.format(p='ps')} as c from p) select doc_id, case when len(ps) > 0 then array_to_string(list_transform({_unit('c')}, lambda x: round(x * 1000)::bigint::varchar), ',') end as embedding from c",
    "message_enrichment": r"""with m as (select distinct msg_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), 'https?://\S+|www\.\S+', ' ', 'g') as b from messages),
x as (select *, regexp_extract_all(b, '[A-Z][a-z]+(?: [A-Z][a-z]+)+') as es, regexp_extract_all(lower(b), '#([a-z][a-z0-9_-]+)', 1) as ts from m)
select msg_id, case when not regexp_matches(t, 'https?://[^\s<>"'']+') then '' when contains(t, '?') then 'ask' else 'share' end as link_intent, array_to_string(list_filter(es, lambda e, i: list_position(es, e) = i)[1:5], '|') as entities, array_to_string(list_filter(ts, lambda e, i: list_position(ts, e) = i)[1:3], '|') as topics from x""",
    "summary_merge": """with g as (select distinct grade_id, msg_id, coalesce(reason, '') as reason, list_filter(coalesce(topics, []), lambda x: x is not null) as topics from grades where msg_id is not null),
l as (select msg_id, string_agg(reason, ' ' order by grade_id) filter (reason <> '') as points, flatten(list(topics order by grade_id)) as ts from g group by 1)
select msg_id as key, coalesce(points, '') as points, array_to_string(list_filter(ts, lambda e, i: list_position(ts, e) = i)[1:5], '|') as entities, array_to_string(list_filter(ts, lambda e, i: list_position(ts, e) = i)[1:3], '|') as topics from l""",
}
