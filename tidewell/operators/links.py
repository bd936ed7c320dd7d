"""Links of messages: outcomes, previews, keyed merges, and the topics they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.session import broadcast_if_small

#: Reasons for which a person is asked to paste the page.
ASK_REASONS = ["truncated", "paywall", "auth_required"]


#: Characters of a text in which a paywall is looked for, shortest text that is content, and size of a page that has a text but shows none.
SEEN, SHORTEST, LARGE_PAGE = 6000, 50, 50_000


def outcome_class(status_code, title, text, final_url, html_size=None):
    """Why a fetched page is no use, by the first rule that holds; null if it is."""
    title, text, html_size = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")), F.lit(0) if html_size is None else F.coalesce(html_size, F.lit(0))
    return (
        F.when(status_code.isin(401, 403, 407), "auth_required")
        .when(status_code == 404, "not_found")
        .when(status_code >= 500, "failed")
        .when(F.lower(F.concat_ws(" ", title, F.substring(text, 1, SEEN))).rlike(T.PAYWALL), "paywall")
        .when(F.lower(F.coalesce(final_url, F.lit(""))).rlike(T.LOGIN_PATH), "auth_required")
        .when(F.lower(title).rlike(T.CHALLENGE), "challenge_blocked")
        .when((F.length(T.strip(text)) < SHORTEST) & (html_size > LARGE_PAGE), "auth_required")
        .when(F.length(T.strip(text)) < SHORTEST, "empty_content")
    )


def reason_code(c):
    """The code of a block reason, its detail off."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), "^([a-z_]+)", 1), F.lit(""))


def routed(c):
    return F.when(reason_code(c).isin(ASK_REASONS), "ask_user").otherwise("blocked")


def latest_by_key(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key, the last by `order`; combined map-side, so a hot key costs no more than another."""
    rest = [c for c in rows.columns if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def first_seen(rows: DataFrame, key: str, order: list) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def previews(messages: DataFrame, scraped: DataFrame, asked: DataFrame) -> DataFrame:
    """Links of messages with what is known of each: scraped before blocked before ask_user before not_scraped."""
    links = messages.select("msg_id", F.posexplode(T.links_in(F.coalesce("text", F.lit("")))).alias("k", "url")).distinct()
    s = scraped.select("url", F.lit(3).alias("rank"), F.lit("scraped").alias("preview_status"))
    a = asked.select("url", F.when(routed(F.col("block_reason")) == "blocked", 2).otherwise(1).alias("rank"), F.when(routed(F.col("block_reason")) == "blocked", "blocked").otherwise("ask_user").alias("preview_status"))
    best = s.unionByName(a).where("url is not null").groupBy("url").agg(F.max_by("preview_status", "rank").alias("preview_status"))
    return links.join(best, "url", "left").select("msg_id", F.col("k").cast("long").alias("link_no"), "url", F.coalesce("preview_status", F.lit("not_scraped")).alias("preview_status"))


def replace_current(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the batch give way to the batch; the others stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def merge_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keyed merge: status and times are overwritten, a title only fills a gap, and nothing is overwritten by an empty value."""
    o, n = old.alias("o"), new.alias("n")
    keep = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")).alias(c)
    return o.join(n, "url", "full").select("url", keep("status"), F.coalesce(F.nullif(F.col("o.title"), F.lit("")), F.col("n.title"), T.url_title(F.col("url"))).alias("title"), keep("seen_at"))


def skip_transition(links: DataFrame, asked: DataFrame) -> DataFrame:
    """Skip what is blocked or pending; others are refused (conflict), unknown keys aren't found."""
    known = asked.join(links, "url", "left")
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("status").isin("blocked", "pending_paste"), "skipped").otherwise("conflict")
    return known.select("url", outcome.alias("outcome"), F.when(outcome == "skipped", "skipped").otherwise(F.col("status")).alias("status"))


def restorable_links(scraped: DataFrame, indexed: DataFrame) -> DataFrame:
    """Each url of scraped (url, status, summary, what_it_is, problem_solved) once that has content and isn't among the indexed (url); no status counts as scraped."""
    content = F.concat(*[T.strip(F.coalesce(c, F.lit(""))) for c in ("summary", "what_it_is", "problem_solved")])
    rows = scraped.where((F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("scraped")) == "scraped") & (content != "")).select("url").distinct()
    return rows.join(indexed.select("url").distinct(), "url", "left_anti")


def attribution(edges: DataFrame) -> DataFrame:
    """url -> earliest stamp of the messages that carry it, compared as text."""
    return edges.where("url is not null").groupBy("url").agg(F.min("sent_at").alias("first_sent_at"), F.countDistinct("msg_id").alias("n_messages"))


def topic_items(grades: DataFrame, links: DataFrame) -> DataFrame:
    """(item, name, key): topics of messages and links, each item once per name."""
    g = grades.where("topics is not null").select(F.concat(F.lit("m"), F.col("msg_id").cast("string")).alias("item"), F.explode("topics").alias("name"))
    s = links.where("topics is not null").select(F.concat(F.lit("l"), F.col("link_id").cast("string")).alias("item"), F.explode("topics").alias("name"))
    return g.unionByName(s).where("name is not null and trim(name) <> ''").select("item", F.trim("name").alias("name")).withColumn("key", T.topic_key(F.col("name"))).where("key <> ''").distinct()


def topic_groups(items: DataFrame) -> DataFrame:
    """Spellings folded by key: items, variants, and the spelling with most items (then the first in order)."""
    by_name = items.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n"))
    head = by_name.groupBy("key").agg(F.max("n").alias("top"))
    named = by_name.join(head, "key").groupBy("key").agg(F.min(F.when(F.col("n") == F.col("top"), F.col("name"))).alias("canonical"), F.count(F.lit(1)).alias("variants"))
    total = items.select("key", "item").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_items"))
    return named.join(total, "key")


def topic_neighbours(items: DataFrame, most: int = 5) -> DataFrame:
    """Topics that share most items: the five best of each, ties by key.

    Pairs are made inside an item's own list of topics and combined map-side.
    """
    lists = items.groupBy("item").agg(F.array_sort(F.collect_set("key")).alias("keys")).where("size(keys) > 1")
    pairs = lists.select("keys", F.explode("keys").alias("key")).select("key", F.explode("keys").alias("other")).where("key <> other").groupBy("key", "other").agg(F.count(F.lit(1)).alias("shared"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("shared"), "other"))
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def browse_topic(items: DataFrame, asked: DataFrame) -> DataFrame:
    """Items of the asked topics, whatever the spelling."""
    return items.join(asked.select(T.topic_key(F.col("name")).alias("key")).distinct(), "key", "left_semi").select("key", "item").distinct()


def suggest_topics(groups: DataFrame, asked: DataFrame, most: int = 5) -> DataFrame:
    """For a topic that isn't there: those that contain it or lie in it, nearest in length, then by name."""
    a = asked.select(F.col("name").alias("asked"), T.topic_key(F.col("name")).alias("akey")).distinct()
    near = broadcast_if_small(a, 1000).join(groups, F.col("key").contains(F.col("akey")) | F.col("akey").contains(F.col("key")))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.abs(F.length("key") - F.length("akey")), "canonical"))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("asked", "rank", "canonical", "n_items")


def renewal_due(expiration, now_ms, window_ms: int = 86_400_000):
    """Whether a watch channel must be renewed: no number, past, or ending within a day."""
    at = F.expr("try_cast(_exp as bigint)") if isinstance(expiration, str) else expiration
    return at.isNull() | (at <= now_ms + window_ms)
