"""Queries from chat exports to graded messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import ingest as I
from tidewell.tables import table

_PLAIN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "messages", "msg_id", "source_id", "pos", "datetime_iso", "text", "is_media")


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "grades").distinct()


def chat_roundtrip(spark, sf_dir):
    """Messages with plain stamps written as export lines and parsed back: the part of `chat_roundtrip_all` that its SQL tells."""
    ts = F.try_to_timestamp(F.col("datetime_iso"), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    rows = _messages(spark, sf_dir).where(F.col("datetime_iso").rlike(_PLAIN)).select("source_id", "pos", ts.alias("ts"), "text").where("ts is not null and text is not null").distinct()
    parsed = I.parse_export(I.export_lines(rows))
    return parsed.select("source_id", F.expr(f"cast(line_no div {I.LINES} as bigint)").alias("pos"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("sent_at"), "text", "is_media")


def chat_roundtrip_all(spark, sf_dir):
    """Messages with text and a stamp in any readable form written as export lines, at their instant in UTC, and parsed back."""
    zones = table(spark, sf_dir, "ingestion_sources", "source_id", "tz_name").groupBy("source_id").agg(F.min("tz_name").alias("zone"))
    parsed = I.parse_export(I.export_lines(I.dated(_messages(spark, sf_dir), zones)))
    return parsed.select("source_id", F.expr(f"cast(line_no div {I.LINES} as bigint)").alias("pos"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("sent_at"), "text", "is_media")


def heuristic_filter(spark, sf_dir):
    return I.with_reasons(_messages(spark, sf_dir)).select("msg_id", "reason").distinct()


def heuristic_reason_counts(spark, sf_dir):
    rows = I.with_reasons(_messages(spark, sf_dir)).select("msg_id", F.coalesce("reason", F.lit("kept")).alias("reason")).distinct()
    counts = rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total"))), F.lit(True)).select("reason", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def message_identity(spark, sf_dir):
    return I.message_identities(_messages(spark, sf_dir))


def point_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "candidate_type", "text", "url", "sent_at")
    pid = F.when(F.col("candidate_type") == "link", T.link_point_id(F.coalesce("url", F.lit("")))).otherwise(T.message_point_id(F.coalesce("sent_at", F.lit("")), F.col("text")))
    return d.select("doc_id", pid.alias("point_id"), F.concat_ws(":", "candidate_type", pid).alias("candidate_id"), T.content_hash(F.col("text")).alias("content_hash"))


def unseen_messages(spark, sf_dir):
    return I.unseen_messages(_messages(spark, sf_dir), table(spark, sf_dir, "grades", "msg_id"))


def import_outcomes(spark, sf_dir):
    return I.import_outcomes(_messages(spark, sf_dir), _grades(spark, sf_dir).select("msg_id", "quality"))


def token_estimates(spark, sf_dir):
    rows = _messages(spark, sf_dir).select("msg_id", "source_id", T.estimated_tokens(F.col("text")).alias("tokens")).distinct()
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))


def batch_packing(spark, sf_dir):
    return I.packed_batches(_messages(spark, sf_dir))


def split_text(spark, sf_dir):
    return I.text_pieces(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", 1200)


def context_window(spark, sf_dir):
    return I.context_windows(_messages(spark, sf_dir), _grades(spark, sf_dir).select("msg_id", "quality"))


def pass2_merge(spark, sf_dir):
    """A second opinion that lifts a borderline grade where the first was sure of it."""
    g = _grades(spark, sf_dir).select("grade_id", "quality", "confidence")
    second = g.where("quality = 3").select("grade_id", F.when(F.col("confidence") >= 0.7, 4).otherwise(2).alias("quality"), "confidence")
    return I.merged_passes(g, second)


def chunk_grade_merge(spark, sf_dir):
    return I.merged_piece_grades(_grades(spark, sf_dir).select("msg_id", "grade_id", "quality", "confidence", "topics").where("quality is not null"))


def grade_normalise(spark, sf_dir):
    return I.normalised_grades(_grades(spark, sf_dir))


def grade_distribution(spark, sf_dir):
    """Counts of qualities 1 to 5, empty ones included."""
    counts = _grades(spark, sf_dir).groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    return spark.range(1, 6).select(F.col("id").cast("int").alias("quality")).join(counts, "quality", "left").select("quality", F.coalesce("n", F.lit(0)).alias("n"))


def category_stats(spark, sf_dir):
    g = _grades(spark, sf_dir)
    return g.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"), F.round(F.avg(F.size(F.coalesce("topics", F.array().cast("array<string>")))), 6).alias("mean_topics"))


def duplicates_reposts(spark, sf_dir):
    """Texts that several documents share: copies, and how many different stamps they carry."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "sent_at").select("doc_id", F.sha2("text", 256).alias("content_hash"), "sent_at")
    return d.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("sent_at").alias("stamps"), F.min("doc_id").alias("first_doc")).where("copies > 1")


def store_fingerprint(spark, sf_dir):
    """Counts by kind with an order-free checksum of the identifiers; nothing is gathered to compute it."""
    d = table(spark, sf_dir, "documents", "doc_id", "candidate_type")
    part = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return d.groupBy("candidate_type").agg(F.count(F.lit(1)).alias("n"), F.sum(part).cast("string").alias("checksum"))


_PHONES = [(-1, "ring 01632 960 001 or (555) 555-0142 today"), (-2, "see https://a.test/status/1234567890123 and www.b.test/0123456789"), (-3, "+44-7700-900-123"), (-4, None)]


def phone_gate(spark, sf_dir):
    """What looks like a phone number in messages once links are taken out, masked but for the last two digits."""
    edge = spark.createDataFrame(_PHONES, "msg_id long, text string")
    rows = table(spark, sf_dir, "messages", "msg_id", "text").unionByName(edge).distinct()
    return rows.select("msg_id", F.posexplode(T.phone_numbers(F.col("text"))).alias("k", "f")).select("msg_id", F.col("k").cast("long").alias("k"), T.masked_digits(F.col("f")).alias("masked"))


_INTROS = [(-1, "Hi all, my name is Ada"), (-2, "Hello, the queue is full"), (-3, "let me introduce myself"), (-4, None), (-5, "Namaste! I'm new"), (-6, "hey, anyone here?"), (-7, "history: I am"), (-8, "Good evening, i am late")]


def self_introduction(spark, sf_dir):
    """Messages that open with a greeting and speak in the first person, or say they introduce themselves."""
    edge = spark.createDataFrame(_INTROS, "msg_id long, text string")
    return table(spark, sf_dir, "messages", "msg_id", "text").unionByName(edge).distinct().select("msg_id", T.introduces(F.col("text")).alias("is_introduction"))


def enrichment_rollup(spark, sf_dir):
    """Links by intent: how many, and how many topics and entities they carry."""
    n = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    s = table(spark, sf_dir, "scraped_links", "link_id", "link_intent", "topics", "entities").distinct()
    return s.groupBy(F.coalesce("link_intent", F.lit("none")).alias("link_intent")).agg(F.count(F.lit(1)).alias("n"), F.sum(n("topics")).alias("topics"), F.sum(n("entities")).alias("entities"), F.round(F.avg(n("topics")), 6).alias("mean_topics"))


def revision_skip(spark, sf_dir):
    """Sources whose revision an earlier import has seen; the earlier state holds the even-numbered imports' revisions."""
    now = table(spark, sf_dir, "ingestion_sources", "source_id", "source_type", "revision").distinct()
    seen = table(spark, sf_dir, "ingestion_sources", "source_id", "revision", "imported_at").where("revision is not null and imported_at < '2026-09-15'").select("source_id", "revision").distinct()
    return now.join(seen.withColumn("unchanged", F.lit(True)), ["source_id", "revision"], "left").select("source_id", "source_type", F.coalesce("unchanged", F.lit(False)).alias("skipped"))


def latency_percentiles(spark, sf_dir):
    """Nearest-rank percentiles of a measured value per event type, and the interpolated median."""
    e = table(spark, sf_dir, "events", "event_type", "value").where("value is not null")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.round(F.expr("percentile(value, 0.5)"), 6).alias("median"))


def model_replies(spark, sf_dir):
    """Model answers as lists of grades: those the grades of the table would come in (fenced, alone, in a list, in a list of lists), and replies that are none."""
    g = _grades(spark, sf_dir).where("quality is not null and category is not null").select(F.col("grade_id").alias("reply_id"), F.concat(F.lit('{"quality": '), F.col("quality").cast("string"), F.lit(', "category": "'), "category", F.lit('"}')).alias("o"))
    kind = F.pmod("reply_id", F.lit(4))
    written = g.select("reply_id", F.when(kind == 0, F.concat(F.lit("```json\n["), "o", F.lit(", "), "o", F.lit("]\n```"))).when(kind == 1, F.col("o")).when(kind == 2, F.concat(F.lit("["), "o", F.lit("]"))).otherwise(F.concat(F.lit("[["), "o", F.lit("], ["), "o", F.lit("]]"))).alias("reply"))
    df = written.unionByName(spark.createDataFrame([(-1, "no json at all"), (-2, None), (-3, "[]"), (-4, '[{"quality": 9}]')], "reply_id long, reply string"))
    grades = T.json_objects(F.col("reply"), "struct<quality:int,category:string>")
    return df.select("reply_id", F.size(grades).cast("long").alias("n"), F.array_join(F.transform(grades, lambda g: F.greatest(F.lit(1), F.least(F.lit(5), g["quality"])).cast("string")), ",").alias("qualities"))


QUERIES = {f.__name__: f for f in (chat_roundtrip, chat_roundtrip_all, heuristic_filter, heuristic_reason_counts, message_identity, point_ids, unseen_messages, import_outcomes, token_estimates, batch_packing, split_text, context_window, pass2_merge, chunk_grade_merge, grade_normalise, grade_distribution, category_stats, duplicates_reposts, store_fingerprint, phone_gate, self_introduction, enrichment_rollup, revision_skip, latency_percentiles, model_replies)}

_WS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"


_ACKS = ", ".join(f"'{a}'" for a in T.SHORT_ACKS)


def _row(x: tuple) -> str:
    """A row of literals in SQL."""
    return "(" + ", ".join("null" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in x) + ")"


_REASON = f"""case when t = '' then 'empty'
  when coalesce(is_media, false) and {_strip("replace(t, '<Media omitted>', '')")} = '' then 'media_only_no_caption'
  when not regexp_matches(t, '[\\p{{L}}\\p{{N}}]') then 'no_alphanumeric'
  when len(regexp_split_to_array(t, '{_WS}')) <= 3 and not contains(t, '?') and not contains(lower(t), 'http') and lower(t) in ({_ACKS}) then 'short_acknowledgment' end"""
_REASONED = f"r as (select *, {_REASON} as reason from (select distinct msg_id, source_id, pos, datetime_iso, text, is_media, {_strip('coalesce(text, chr(32))')} as t from messages))"
_G = "g as (select distinct grade_id, msg_id, quality, confidence, category, reason, topics, original_text from grades)"
_IDS = r"""with m as (select distinct msg_id, source_id, datetime_iso, {norm} as norm, pos from messages where datetime_iso is not null and text is not null),
o as (select *, row_number() over (partition by source_id, datetime_iso, norm order by pos, msg_id) as occurrence from m)
select msg_id, occurrence, sha256('[' || {a} || ', ' || {b} || ', ' || {c} || ', ' || occurrence || ']') as message_id from o"""


def _js(x: str) -> str:
    out = f"replace(replace({x}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
    for code, letter in ((10, "n"), (13, "r"), (9, "t")):
        out = f"replace({out}, chr({code}), chr(92) || '{letter}')"
    return f"(chr(34) || {out} || chr(34))"


_UUID = """concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], printf('%02x', (('0x' || h[17:18])::int & 63) | 128) || h[19:20], h[21:32])"""

ORACLE_SQL = {
    "chat_roundtrip": f"""select distinct source_id, pos, replace(datetime_iso, 'T', ' ') as sent_at,
  array_to_string(list_filter(string_split(text, chr(10)), lambda x: {_strip('x')} <> ''), chr(10)) as text, contains(string_split(text, chr(10))[1], '<Media omitted>') as is_media
from messages where regexp_full_match(datetime_iso, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}') and try_strptime(datetime_iso, '%Y-%m-%dT%H:%M:%S') is not null and text is not null""",
    "heuristic_filter": f"with {_REASONED} select distinct msg_id, reason from r",
    "heuristic_reason_counts": f"with {_REASONED}, c as (select coalesce(reason, 'kept') as reason, count(*) as n from (select distinct msg_id, reason from r) group by 1) select reason, n, round(n / sum(n) over (), 6) as share from c",
    "message_identity": _IDS.format(norm=_strip("replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"), a=_js("source_id"), b=_js("datetime_iso"), c=_js("norm")),
    "point_ids": f"""with h as (select doc_id, candidate_type, text, sha1(unhex('{T.URL_NAMESPACE}') || encode(case when candidate_type = 'link' then 'link-' || coalesce(url, '') else 'msg-' || coalesce(sent_at, '') || '-' || text end)) as h from documents)
select doc_id, {_UUID} as point_id, candidate_type || ':' || {_UUID} as candidate_id, 'sha256:' || sha256(text) as content_hash from h""",
    "unseen_messages": "select distinct msg_id, source_id from messages where msg_id not in (select msg_id from grades where msg_id is not null)",
    "import_outcomes": f"""with {_REASONED}, {_G}, b as (select msg_id, max(quality) as quality from g group by 1)
select source_id, count(*) as total, count(*) filter (reason is not null) as dropped, count(*) filter (reason is null and quality is null) as ungraded, count(*) filter (reason is null and quality < 4) as low_quality, count(*) filter (reason is null and quality >= 4) as stored
from (select distinct msg_id, source_id, reason from r) left join b using (msg_id) group by 1""",
    "token_estimates": "select source_id, count(*) as n, sum(tokens)::bigint as tokens, max(tokens) as largest from (select distinct msg_id, source_id, greatest(1, (length(coalesce(text, '')) + 3) // 4) as tokens from messages) group by 1",
    "context_window": f"""with {_REASONED}, k as (select msg_id, source_id, row_number() over (partition by source_id order by pos, msg_id) as rn from (select distinct msg_id, source_id, pos from r where reason is null)), {_G},
q as (select msg_id from g where quality is not null group by 1 having max(quality) = 3)
select a.msg_id, coalesce(string_agg(b.msg_id::varchar, ',' order by b.rn) filter (b.rn < a.rn), '') as before_ids, coalesce(string_agg(b.msg_id::varchar, ',' order by b.rn) filter (b.rn > a.rn), '') as after_ids
from k a join q using (msg_id) left join k b on a.source_id = b.source_id and b.rn between a.rn - 3 and a.rn + 3 and b.rn <> a.rn group by 1""",
    "pass2_merge": f"with {_G}, f as (select grade_id, quality as first_quality, case when quality = 3 then case when confidence >= 0.7 then 4 else 2 end else quality end as quality from g) select grade_id, first_quality, quality, first_quality = 3 and quality >= 4 as promoted from f",
    "chunk_grade_merge": f"""with {_G}, s as (select * from g where quality is not null),
t as (select msg_id, topic, min((grade_id, k)) as first_at from (select msg_id, grade_id, unnest(topics) as topic, generate_subscripts(topics, 1) as k from s) group by all),
u as (select msg_id, topic, row_number() over (partition by msg_id order by first_at) as rn from t)
select msg_id, (arg_max(grade_id, (quality, -grade_id))) as best_grade_id, max(quality) as quality, round(avg(confidence), 6) as confidence, coalesce((select string_agg(topic, '|' order by rn) from u where u.msg_id = s.msg_id and rn <= 6), '') as topics from s group by msg_id""",
    "grade_normalise": f"with {_G} select grade_id, greatest(1, least(5, coalesce(quality, 1))) as quality, case when lower(category) in ({', '.join(repr(c) for c in T.CATEGORIES)}) then lower(category) else 'noise' end as category, len(list_filter(coalesce(topics, []), lambda x: trim(x) <> '')) as n_topics from g",
    "grade_distribution": f"with {_G} select q.quality::int as quality, count(g.grade_id) as n from range(1, 6) q(quality) left join g on g.quality = q.quality group by 1",
    "category_stats": f"with {_G} select category, count(*) as n, round(avg(confidence), 6) as mean_confidence, min(confidence) as min_confidence, max(confidence) as max_confidence, round(avg(len(coalesce(topics, []))), 6) as mean_topics from g group by 1",
    "duplicates_reposts": "select sha256(text) as content_hash, count(*) as copies, count(distinct sent_at) as stamps, min(doc_id) as first_doc from documents group by 1 having count(*) > 1",
    "store_fingerprint": "select candidate_type, count(*) as n, sum(('0x' || sha256(doc_id::varchar)[1:12])::hugeint)::varchar as checksum from documents group by 1",
    "self_introduction": f"""select distinct msg_id, regexp_matches(t, '{T.GREETING.replace("'", "''")}') and regexp_matches(t, '{T.FIRST_PERSON.replace("'", "''")}') or contains(t, 'introduce myself') as is_introduction
from (select msg_id, lower({_strip("coalesce(text, '')")})[1:200] as t from (select msg_id, text from messages union all select * from (values {", ".join(_row(x) for x in _INTROS)}) v(msg_id, text)))""",
    "enrichment_rollup": "select coalesce(link_intent, 'none') as link_intent, count(*) as n, sum(len(coalesce(topics, [])))::bigint as topics, sum(len(coalesce(entities, [])))::bigint as entities, round(avg(len(coalesce(topics, []))), 6) as mean_topics from (select distinct link_id, link_intent, topics, entities from scraped_links) group by 1",
    "revision_skip": "select distinct n.source_id, n.source_type, coalesce(n.revision is not null and n.imported_at < '2026-09-15', false) as skipped from ingestion_sources n",
    "latency_percentiles": "select event_type, count(*) as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, round(median(value), 6) as median from events where value is not null group by 1",
    "model_replies": f"with {_G}, r as (select grade_id as reply_id, case when grade_id % 4 in (1, 2) then 1::bigint else 2::bigint end as n, greatest(1, least(5, quality))::varchar as q from g where quality is not null and category is not null) select reply_id, n, case when n = 1 then q else q || ',' || q end as qualities from r union all select * from (values (-1, 0, ''), (-2, 0, ''), (-3, 0, ''), (-4, 1, '5')) t(reply_id, n, qualities)",
    "phone_gate": f"""with t as (select distinct msg_id, list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '{T.LINK_LIKE}', ' ', 'g'), '{T.PHONE_LIKE}'), lambda f: {_strip("f")}) as fs from (select msg_id, text from messages union all select * from (values {", ".join(_row(x) for x in _PHONES)}) v(msg_id, text))),
u as (select msg_id, unnest(fs) as f, generate_subscripts(fs, 1) - 1 as k from t)
select msg_id, k, regexp_replace(f[1:length(f) - length(e)], '\\d', '#', 'g') || e as masked from (select *, regexp_extract(f, '(\\d\\D*\\d\\D*)$', 1) as e from u)""",
}
