"""The model surface: providers are functions, calls run in batches on the executors, and offline stand-ins answer in tests.

A provider takes a list of prompts and gives a list of replies of the same length. The stand-ins
are expressions that tell what a text holds; they claim no judgement.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators.ingest import merged_piece_grades, packed_batches, text_pieces

Provider = Callable[[list[str]], list[str]]
ATTEMPTS, ENTITIES, TOPICS = 3, 5, 3
GRADE = "struct<quality:int,confidence:double,category:string>"
_REASONS = r"(^|[^a-z])(because|so that|instead|turns out)([^a-z]|$)"


def rubric_points(text):
    """How many of four signs of substance a text shows: a figure, a link, some length, a reason."""
    return text.rlike("[0-9]").cast("int") + text.contains("http").cast("int") + (F.length(text) >= 120).cast("int") + F.lower(text).rlike(_REASONS).cast("int")


def rubric_grades(messages: DataFrame) -> DataFrame:
    """messages (entry_id, text) -> (entry_id, quality, confidence, category) by the signs alone: the offline grader."""
    t, p = F.col("text"), rubric_points(F.col("text"))
    category = F.when(p == 0, "noise").when(t.contains("http"), "resource").when(t.contains("?"), "question").otherwise("insight")
    return messages.select("entry_id", (1 + p).cast("int").alias("quality"), F.round(0.6 + 0.1 * p, 6).alias("confidence"), category.alias("category"))


def completions(prompts: DataFrame, provider: Provider, key: str = "key", batch: int = 32) -> DataFrame:
    """prompts (key, prompt) -> (key, reply); a provider is called with at most `batch` prompts at once, blank prompts give a null reply."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                asked = [p for p in part["prompt"] if p and p.strip()]
                told = iter(provider(asked) if asked else [])
                yield pd.DataFrame({key: part[key], "reply": [next(told) if p and p.strip() else None for p in part["prompt"]]})

    kind = dict(prompts.dtypes)[key]
    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {kind}, reply string")


def graded_batches(prompts: DataFrame, provider: Provider, attempts: int = ATTEMPTS) -> DataFrame:
    """prompts (key, prompt, n) -> (key, grades): each must be answered by exactly n objects, else it is asked again; after the last attempt the task fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, prompt, n in zip(b["key"], b["prompt"], b["n"]):
                for _ in range(attempts):
                    found = parsed(provider([prompt])[0])
                    if len(found) == n:
                        break
                else:
                    raise ValueError(f"{key}: {len(found)} objects instead of {n} after {attempts} attempts")
                rows.append((key, [(int(x.get("quality") or 1), float(x.get("confidence") or 0.0), str(x.get("category") or "noise")) for x in found]))
            yield pd.DataFrame(rows, columns=["key", "grades"])

    return prompts.select(F.col("key").cast("string"), "prompt", "n").mapInPandas(run, f"key string, grades array<{GRADE}>")


def parsed(reply: str | None) -> list[dict]:
    """The objects of a reply, as functions.text.json_objects finds them."""
    bare = (reply or "").strip()
    if bare.startswith("```"):
        bare = bare.strip("`").removeprefix("json").strip()
    try:
        found = json.loads(bare)
    except ValueError:
        return []
    found = [found] if isinstance(found, dict) else found if isinstance(found, list) else []
    return [y for x in found for y in (x if isinstance(x, list) else [x]) if isinstance(y, dict)]


def cached(rows: DataFrame, cache: DataFrame, key: str, call) -> DataFrame:
    """rows whose key the cache (key, …) doesn't hold go to call; the cache's own rows for the others. Both have the same columns."""
    fresh = call(rows.join(cache.select(key), key, "left_anti"))
    return fresh.unionByName(cache.join(rows.select(key).distinct(), key, "left_semi"))


def two_pass_grades(messages: DataFrame, first, second, step: int = 4800) -> DataFrame:
    """messages (entry_id, text) -> (entry_id, first_quality, quality, n_pieces).

    Long texts are graded in pieces of at most `step` characters, whose best grade counts; borderline ones (3) get the
    second grader's opinion, others keep the first. first and second map (entry_id, text) to
    (entry_id, quality, confidence, category).
    """
    pieces = text_pieces(messages, "entry_id", "text", step)
    numbered = pieces.select(F.col("entry_id").alias("msg_id"), F.concat_ws("-", F.col("entry_id").cast("string"), F.col("piece_no").cast("string")).alias("entry_id"), "piece_no", F.col("piece").alias("text"))
    graded = first(numbered.select("entry_id", "text")).join(numbered.select("entry_id", "msg_id", F.col("piece_no").alias("grade_id")), "entry_id")
    merged = merged_piece_grades(graded.withColumn("topics", F.array().cast("array<string>"))).select(F.col("msg_id").alias("entry_id"), F.col("quality").alias("first_quality"))
    counts = pieces.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_pieces"))
    again = second(messages.join(merged.where("first_quality = 3").select("entry_id"), "entry_id", "left_semi")).select("entry_id", F.col("quality").alias("_second"))
    return merged.join(again, "entry_id", "left").join(counts, "entry_id").select("entry_id", "first_quality", F.coalesce("_second", "first_quality").alias("quality"), "n_pieces")


def enriched(messages: DataFrame) -> DataFrame:
    """messages (msg_id, text) -> (msg_id, link_intent, entities, topics): the offline enricher; words with capitals as entities, hashtags as topics, at most five and three."""
    t = F.coalesce("text", F.lit(""))
    bare = F.regexp_replace(t, T.LINK_LIKE, " ")
    entities = F.slice(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"([A-Z][a-z]+(?: [A-Z][a-z]+)+)"), F.lit(1))), 1, ENTITIES)
    topics = F.slice(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(bare), F.lit(r"#([a-z][a-z0-9_-]+)"), F.lit(1)), lambda x: x)), 1, TOPICS)
    intent = F.when(F.size(T.links_in(t)) == 0, "").when(t.contains("?"), "ask").otherwise("share")
    return messages.select("msg_id", intent.alias("link_intent"), entities.alias("entities"), topics.alias("topics"))


def merged_summaries(parts: DataFrame) -> DataFrame:
    """parts (key, piece_no, point, entities, topics) -> (key, points, entities, topics): points in order; entities and topics each once in order of appearance, at most five and three."""
    listed = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("piece_no", "point", "entities", "topics"))).alias("p"))
    first = lambda c, n: F.slice(F.array_distinct(F.flatten(F.col(f"p.{c}"))), 1, n)
    return listed.select("key", F.array_join(F.filter(F.col("p.point"), lambda x: x != ""), " ").alias("points"), first("entities", ENTITIES).alias("entities"), first("topics", TOPICS).alias("topics"))


def hashed_vectors(texts: DataFrame, size: int = 64) -> DataFrame:
    """texts (key, text) -> (key, embedding): hashed counts of words on the unit sphere, the offline embedder; a blank text keeps its row with a null vector."""
    tokens = T.bm25_tokens(F.coalesce("text", F.lit("")))
    place = F.transform(tokens, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(size)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(F.col("_p"), lambda p: p == i)).cast("double"))
    rows = texts.select("key", place.alias("_p")).select("key", counts.alias("_c"), F.size("_p").alias("_n"))
    norm = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("key", F.when(F.col("_n") > 0, F.transform("_c", lambda x: F.round(x / norm, 6))).alias("embedding"))


def prompts_of(messages: DataFrame) -> DataFrame:
    """messages (source_id, pos, msg_id, text) -> (key, prompt, n): the greedy batches of each source as numbered lists."""
    b = packed_batches(messages).join(messages.select("msg_id", "pos", "text").distinct(), "msg_id")
    listed = b.groupBy("source_id", "batch_no").agg(F.count(F.lit(1)).cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "msg_id", "text"))).alias("items"))
    return listed.select(F.concat_ws("/", "source_id", F.col("batch_no").cast("string")).alias("key"), T.numbered(F.col("items.text")).alias("prompt"), "n")
