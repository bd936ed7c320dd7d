"""Stores of messages, links and points: keyed upserts, edges, payload updates and the ingestion steps around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators.ordered import row_numbers

RAW_LIMIT, TITLE_LIMIT, STORED_QUALITY = 20_000, 120, 4


def _given(new: str, old: str):
    """A new value unless it is empty."""
    return F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old))


def upsert_messages(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new (sent_at, text, quality, category, trusted) by (sent_at, text): everything is overwritten, a category only by one that isn't empty.

    Keys of each side are unique (`links.latest_by_key`). One shuffle join on the key.
    """
    n, o = new.withColumn("_n", F.lit(True)).alias("n"), old.withColumn("_o", F.lit(True)).alias("o")
    both = n.join(o, ["sent_at", "text"], "full")
    newer = lambda c: F.when(F.col("_n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select("sent_at", "text", newer("quality"), F.coalesce(_given("n.category", "o.category"), F.lit("")).alias("category"), newer("trusted"), F.col("_o").isNull().alias("created"))


def upsert_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new (url, title, status, summary) by url: a scraped link overwrites all of what is there."""
    n, o = new.withColumn("_n", F.lit(True)).alias("n"), old.alias("o")
    both = n.join(o, "url", "full")
    return both.select("url", *[F.when(F.col("_n"), F.coalesce(F.col(f"n.{c}"), F.lit(""))).otherwise(F.col(f"o.{c}")).alias(c) for c in ("title", "status", "summary")])


def mention_links(links: DataFrame, urls: DataFrame) -> DataFrame:
    """Links a message merely names (url) are created with a title from the address; those that exist stay as they are."""
    fresh = urls.select("url").where("url is not null").distinct().join(links.select("url"), "url", "left_anti")
    return links.unionByName(fresh.select("url", T.url_title(F.col("url")).alias("title")), allowMissingColumns=True)


def edges(rows: DataFrame, src_type: str, src: str, rel: str, dst_type: str, names: str) -> DataFrame:
    """(src_type, src, rel, dst_type, dst): one edge from each row to each name of its list, once; null and empty names make none."""
    each = rows.select(F.lit(src_type).alias("src_type"), F.col(src).cast("string").alias("src"), F.lit(rel).alias("rel"), F.lit(dst_type).alias("dst_type"), F.explode(names).alias("dst"))
    return each.where("src is not null and dst is not null and dst <> ''").distinct()


def edges_between(rows: DataFrame, sources: DataFrame, src_type: str, rel: str, dst_type: str) -> DataFrame:
    """Edges (src, dst) of rows whose source exists (src); others are dropped, as a match without a hit."""
    held = rows.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).where("src is not null and dst is not null").distinct().join(sources.select(F.col("src").cast("string").alias("src")).distinct(), "src", "left_semi")
    return held.select(F.lit(src_type).alias("src_type"), "src", F.lit(rel).alias("rel"), F.lit(dst_type).alias("dst_type"), "dst")


def graph_counts(graph: DataFrame) -> DataFrame:
    """(what, name, n): nodes by label and edges by type."""
    nodes = graph.select(F.col("src_type").alias("name"), F.col("src").alias("id")).union(graph.select("dst_type", "dst")).distinct()
    return nodes.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "name", "n").union(graph.groupBy("rel").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge"), "rel", "n"))


def without_nodes(graph: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges that are left once the nodes gone (type, id) are deleted with theirs."""
    src, dst = gone.select(F.col("type").alias("src_type"), F.col("id").alias("src")), gone.select(F.col("type").alias("dst_type"), F.col("id").alias("dst"))
    return graph.join(src.distinct(), ["src_type", "src"], "left_anti").join(dst.distinct(), ["dst_type", "dst"], "left_anti")


def payload_plan(points: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """points (id, column), wanted (id, column) -> (id, column, state): to_update, already_set or not_in_index."""
    p, w = points.select("id", F.col(column).alias("_now"), F.lit(True).alias("_in")), wanted.select("id", column)
    state = F.when(F.col("_in").isNull(), "not_in_index").when(F.col("_now").eqNullSafe(F.col(column)), "already_set").otherwise("to_update")
    return w.join(p, "id", "left").select("id", column, state.alias("state"))


def set_payload(points: DataFrame, plan: DataFrame, column: str) -> DataFrame:
    """points with the column of a plan's to_update rows; what else they hold, vectors too, isn't touched."""
    new = plan.where("state = 'to_update'").select("id", F.col(column).alias("_new"))
    return points.join(new, "id", "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def store_counts(messages: DataFrame, scraped: DataFrame, blocked: DataFrame, pending: DataFrame) -> DataFrame:
    """(counter, n): what one import writes to the graph and to the vectors.

    vectored_links counts every link with content, one that has raw text only too, although the
    vector writer has nothing to embed of that.
    """
    content = T.has_content(*map(F.col, ("summary", "what_it_is", "problem_solved", "raw_text")))
    one = lambda df, *named: df.agg(*[c.alias(n) for n, c in named])
    parts = [one(messages, ("messages", F.count(F.lit(1))), ("vectored_messages", F.count_if(F.coalesce("quality", F.lit(0)) >= STORED_QUALITY))), one(scraped, ("scraped_links", F.count(F.lit(1))), ("vectored_links", F.count_if(content))), one(blocked, ("blocked_links", F.count(F.lit(1)))), one(pending, ("pending_links", F.count(F.lit(1))))]
    return reduce(DataFrame.union, [p.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, p.columns)), F.array(*p.columns))).alias("counter", "n")) for p in parts])


def wrapped(raw: DataFrame) -> DataFrame:
    """Bot records (entry_id, text, received_at, skip_grading) as messages with `error`; they skip the heuristic filter."""
    text = T.strip(F.coalesce("text", F.lit("")))
    return raw.select("entry_id", text.alias("text"), "received_at", F.coalesce("skip_grading", F.lit(False)).alias("trusted"), F.when(text == "", "blank text").alias("error"))


def graded_with_bypass(messages: DataFrame, grader) -> DataFrame:
    """messages (entry_id, text, trusted) -> (entry_id, quality, confidence, category): trusted ones are resources of the best quality, others go to grader (entry_id, text)."""
    sure = messages.where("trusted").select("entry_id", F.lit(5).alias("quality"), F.lit(1.0).alias("confidence"), F.lit("resource").alias("category"))
    return sure.unionByName(grader(messages.where("not trusted").select("entry_id", "text")).select("entry_id", "quality", "confidence", "category"))


def processed_candidates(links: DataFrame, known: DataFrame, outcomes: DataFrame) -> DataFrame:
    """links (msg_id, link_no, url), known (url), outcomes (url, status) -> (msg_id, link_no, url, result).

    A url that an earlier run knows or an earlier message carries is skipped_existing; any other has
    the status of its fetch, or not_scraped.
    """
    first = links.where("url is not null").groupBy("url").agg(F.min(F.struct("msg_id", "link_no")).alias("_f"))
    told = links.where("url is not null").join(first, "url").join(known.select("url", F.lit(True).alias("_k")).distinct(), "url", "left").join(outcomes.select("url", "status"), "url", "left")
    again = F.col("_k").isNotNull() | (F.struct("msg_id", "link_no") != F.col("_f"))
    return told.select("msg_id", "link_no", "url", F.when(again, "skipped_existing").otherwise(F.coalesce("status", F.lit("not_scraped"))).alias("result"))


def candidate_counts(messages: DataFrame, processed: DataFrame) -> DataFrame:
    """(counter, n) of a run over the candidates, messages without links included."""
    some = processed.groupBy(F.col("result").alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    none = messages.select("msg_id").distinct().join(processed.select("msg_id").distinct(), "msg_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("no_links").alias("counter"), "n")
    return some.unionByName(none)


def completed_pastes(pending: DataFrame, pasted: DataFrame) -> DataFrame:
    """pending (ask_id, url, title), pasted (link_id, content) -> scraped links (url, title, raw_text, resolved).

    The id names the url. The title that is there stays, else the first line that says something,
    else one of the address, cut; `resolved` counts the requests the paste answers. Blank pastes
    and unknown ids give no row.
    """
    by_id = pasted.select(F.upper(T.strip(F.col("link_id"))).alias("link_id"), T.strip(F.coalesce("content", F.lit(""))).alias("content")).where("content <> ''").groupBy("link_id").agg(F.max("content").alias("content"))
    held = pending.where("url is not null").groupBy("url").agg(F.max(F.nullif(F.col("title"), F.lit(""))).alias("_t"), F.count(F.lit(1)).alias("resolved")).withColumn("link_id", T.paste_id(F.col("url")))
    title = F.coalesce("_t", F.nullif(F.regexp_extract("content", r"^([^\n]*)", 1), F.lit("")), T.url_title(F.col("url")))
    return held.join(by_id, "link_id").select("url", F.substring(title, 1, TITLE_LIMIT).alias("title"), F.substring("content", 1, RAW_LIMIT).alias("raw_text"), "resolved")


def summary_gaps(links: DataFrame, fields: tuple[str, ...] = ("summary", "what_it_is", "problem_solved", "how_useful")) -> DataFrame:
    """Links with raw text whose refreshed summaries lack a required field: (link_id, missing)."""
    missing = F.filter(F.array(*[F.when(T.strip(F.coalesce(f, F.lit(""))) == "", F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return links.where(T.strip(F.coalesce("raw_text", F.lit(""))) != "").select("link_id", F.array_join(missing, ",").alias("missing")).where("missing <> ''")


def messages_to_refresh(messages: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Messages (msg_id, text) that hold a refreshed url: theirs are the previews to renew."""
    held = messages.select("msg_id", F.explode(T.links_in(F.coalesce("text", F.lit("")))).alias("url"))
    return held.join(refreshed.select("url").distinct(), "url", "left_semi").groupBy("msg_id").agg(F.count(F.lit(1)).alias("n_links"))


def round_robin(tasks: DataFrame, order: str, workers: int) -> DataFrame:
    """tasks with the worker that gets each: task i of the given order goes to worker i modulo workers."""
    return row_numbers(tasks.withColumn("_all", F.lit(0)), ["_all"], [order], "_i").withColumn("worker", F.pmod(F.col("_i") - 1, F.lit(workers)).cast("long")).drop("_all", "_i")
