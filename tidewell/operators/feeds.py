"""Feeds and pages: notifications, change feeds, fetched pages and repositories, each a function of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T

# Headers a notification must carry, states it may tell, and types of an archive.
REQUIRED = ["x-goog-channel-id", "x-goog-channel-token", "x-goog-message-number", "x-goog-resource-id", "x-goog-resource-state"]
STATES = ["sync", "change"]
ARCHIVES = ["application/zip", "application/x-zip-compressed"]
PAGE_LIMIT = 2_000_000


def notifications(requests: DataFrame, token: str) -> DataFrame:
    """requests (id, headers map) -> (id, error, channel_id, resource_id, resource_state, message_number).

    Names of headers are compared in small letters; a missing or blank one, or another token, is an
    error. The token itself never comes out; hashes of it are compared, so how long that takes
    tells nothing.
    """
    h = F.transform_keys("headers", lambda k, v: F.lower(k))
    rows = requests.select("id", h.alias("h"))
    absent = F.filter(F.array(*map(F.lit, REQUIRED)), lambda k: T.strip(F.coalesce(F.element_at("h", k), F.lit(""))) == "")
    error = F.when(F.size(absent) > 0, F.concat(F.lit("missing "), absent[0])).when(F.sha2(F.col("h")["x-goog-channel-token"], 256) != F.sha2(F.lit(token), 256), "bad token")
    told = rows.withColumn("error", error)
    field = lambda k, n: F.when(F.col("error").isNull(), F.col("h")[k]).alias(n)
    return told.select("id", "error", field("x-goog-channel-id", "channel_id"), field("x-goog-resource-id", "resource_id"), field("x-goog-resource-state", "resource_state"), field("x-goog-message-number", "message_number"))


def event_error(fields: list[str], installation: str):
    """Why an event goes to the dead letters: a blank field, another installation, an unknown state; null if it is good."""
    blank = F.filter(F.array(*[F.when(T.strip(F.coalesce(F.col(f), F.lit(""))) == "", F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return F.when(F.size(blank) > 0, F.concat(F.lit("missing "), blank[0])).when(F.col("installation_id") != installation, "wrong installation").when(~F.col("resource_state").isin(STATES), "unknown state")


def relevant_changes(changes: DataFrame, folder: str) -> DataFrame:
    """changes (change_no, file_id, removed, type, file struct<mimeType, parents, trashed, modifiedTime>): archives of the folder that are neither removed nor in the bin."""
    f = F.col("file")
    return changes.where(~F.coalesce("removed", F.lit(False)) & (F.col("type") == "file") & ~F.coalesce(f["trashed"], F.lit(False)) & F.coalesce(F.lower(f["mimeType"]).isin(ARCHIVES), F.lit(False)) & F.coalesce(F.array_contains(f["parents"], folder), F.lit(False)))


def changed_files(changes: DataFrame, folder: str, revisions: DataFrame) -> DataFrame:
    """The latest relevant change of each file whose revision isn't the one imported last (file_id, revision)."""
    rows = relevant_changes(changes, folder).groupBy("file_id").agg(F.max_by(F.col("file.modifiedTime"), "change_no").alias("revision"))
    return rows.join(revisions, ["file_id", "revision"], "left_anti")


def advanced_token(changes: DataFrame, outcomes: DataFrame, token: int) -> DataFrame:
    """(token, error): the place of the feed after a batch, moved only if every file of it was imported; else the old place and the first error.

    outcomes (file_id, error), error null where the import went through.
    """
    worst = outcomes.where("error is not null").agg(F.min(F.concat_ws(": ", "file_id", "error")).alias("error"))
    last = changes.agg(F.max("change_no").alias("last"))
    return last.join(F.broadcast(worst), F.lit(True)).select(F.when(F.col("error").isNull(), F.coalesce("last", F.lit(token))).otherwise(F.lit(token)).cast("long").alias("token"), "error")


def page_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> (page_id, title, text): scripts, styles, comments, heads and furniture off, blocks as lines, entities read.

    Everything is done by expressions in generated code; a null page has a null title and no text.
    """
    html = F.coalesce("html", F.lit(""))
    title = T.strip(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    bare = html
    for pattern, by in ((r"(?s)<!--.*?-->", ""), (r"(?is)<(script|style|head|nav|header|footer|aside|noscript)\b[^>]*>.*?</\1\s*>", "\n"), (r"(?i)<br\s*/?>|</?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|main|pre|blockquote)\b[^>]*>", "\n"), (r"<[^>]+>", " ")):
        bare = F.regexp_replace(bare, pattern, by)
    for name, c in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        title, bare = F.replace(title, F.lit(f"&{name};"), F.lit(c)), F.replace(bare, F.lit(f"&{name};"), F.lit(c))
    lines = F.filter(F.transform(F.split(bare, "\n"), lambda x: T.strip(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != "")
    return pages.select("page_id", F.nullif(title, F.lit("")).alias("title"), F.array_join(lines, "\n").alias("text"))


def repository_pages(repos: DataFrame) -> DataFrame:
    """repos (full_name, description, homepage, topics, language, stars, licence, readme) -> (full_name, text): what is known in a head, a rule, then the readme; at most PAGE_LIMIT characters."""
    label = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    topics = F.array_join(F.filter(F.coalesce("topics", F.array().cast("array<string>")), lambda t: t != ""), ", ")
    bits = F.concat_ws(" | ", label("Homepage", F.col("homepage")), label("Topics", topics), label("Language", F.col("language")), label("Stars", F.col("stars").cast("string")), label("License", F.col("licence")))
    head = F.concat_ws("\n", T.strip(F.concat(F.lit("# "), F.coalesce("full_name", F.lit("")))), F.nullif(T.strip(F.coalesce("description", F.lit(""))), F.lit("")), F.nullif(bits, F.lit("")), F.lit("---"))
    return repos.select("full_name", F.substring(F.concat(head, F.lit("\n\n"), F.coalesce("readme", F.lit(""))), 1, PAGE_LIMIT).alias("text"))


def transcripts(snippets: DataFrame) -> DataFrame:
    """snippets (video_id, at, text) -> (video_id, text): what is said in order, blank snippets left out."""
    listed = snippets.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce(T.strip(F.col("text")), F.lit("")).alias("t")))).alias("s"))
    return listed.select("video_id", F.array_join(F.filter(F.transform("s", lambda x: x["t"]), lambda x: x != ""), " ").alias("text"))
