"""Batched retrieval: every operator answers many queries at once, keyed by query_id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.session import broadcast_if_small, materialise

K1, B, RRF_K, DEPTH, TOP, STRONG = 1.5, 0.75, 60, 30, 5, 2.0
#: Query vectors multiplied at once, and different query words up to which a text is filtered where it is split.
BLOCK, TERMS = 16_384, 2000


def top_ranked(scores: DataFrame, depth: int = DEPTH, by: str = "query_id") -> DataFrame:
    """Rank by score, then by smaller doc_id; keep the first `depth`. Spark limits each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", rank.cast("long")).where(F.col("rank") <= depth)


def bm25(docs: DataFrame, queries: DataFrame, depth: int = DEPTH) -> DataFrame:
    """docs (doc_id, text), queries (query_id, query_text) -> (query_id, doc_id, score, rank).

    Statistics are those of the docs given, so a filter belongs before. Repeated query words count
    repeatedly. Documents without any query word have no score and no row; empty inputs give none.
    """
    asked = queries.select("query_id", F.explode(T.bm25_tokens(F.coalesce("query_text", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = materialise(asked, "asked")
    tokens = docs.select("doc_id", T.bm25_tokens(F.coalesce("text", F.lit(""))).alias("ts"))
    words = [r.term for r in asked.select("term").distinct().limit(TERMS + 1).collect()]
    if len(words) <= TERMS:
        # One pass: each text is split once, only asked words leave it, and a row without word tells its length.
        wanted = F.filter("ts", lambda t: t.isin(words)) if words else F.array().cast("array<string>")
        each = tokens.select("doc_id", F.size("ts").alias("len"), F.explode(F.concat(F.array(F.lit(None).cast("string")), wanted)).alias("term"))
        postings = materialise(each.groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
        stats, useful = postings.where("term is null"), postings.where("term is not null")
    else:
        stats = tokens.select(F.size("ts").alias("len"))
        each = tokens.select("doc_id", F.size("ts").alias("len"), F.explode("ts").alias("term")).join(broadcast_if_small(asked.select("term").distinct()), "term", "left_semi")
        useful = materialise(each.groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    stats = stats.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    df = useful.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = useful.join(broadcast_if_small(df), "term").join(F.broadcast(stats), F.lit(True))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    hits = weighed.select("term", "doc_id", weight.alias("w")).join(broadcast_if_small(asked), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * F.col("w")), 6).alias("score"))
    return top_ranked(hits.where("score > 0"), depth)


def cosine(vectors: DataFrame, queries: DataFrame, depth: int = DEPTH) -> DataFrame:
    """vectors (doc_id, embedding), queries (query_id, embedding) -> (query_id, doc_id, score, rank), exact.

    Queries go in blocks of BLOCK, as a broadcast matrix, to all rows; of every batch those leave
    that may be among the best, so what is shuffled is about depth rows per query and batch. Zero
    vectors score 0; null ones fall away; of a query id given twice one vector counts.
    """
    spark, out = vectors.sparkSession, None
    asked = queries.where("embedding is not null").select("query_id", "embedding")
    blocks = asked.count() // BLOCK + 1
    rows = vectors.where("embedding is not null").select("doc_id", "embedding")
    for at in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == at)
        told = block.dropDuplicates(["query_id"]).toArrow()
        if not told.num_rows:
            continue
        keys = told.column("query_id").to_numpy()
        q = _matrix(told.column("embedding").combine_chunks())
        sent = spark.sparkContext.broadcast((keys, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys, q = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                v = _matrix(b.column("embedding"))
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                s = np.round(q @ v.T, 6)
                docs = b.column("doc_id").to_numpy()
                least = np.partition(s, -depth, axis=1)[:, -depth, None] if depth < s.shape[1] else np.full((len(keys), 1), -np.inf)
                i, j = np.nonzero(s >= least)
                yield pa.RecordBatch.from_arrays([pa.array(keys[i], pa.int64()), pa.array(docs[j], pa.int64()), pa.array(s[i, j])], ["query_id", "doc_id", "score"])

        part = top_ranked(rows.mapInArrow(score, "query_id long, doc_id long, score double"), depth)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, doc_id long, score double, rank long")


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix, without a list for each."""
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def fuse(runs: list[DataFrame], depth: int = DEPTH) -> DataFrame:
    """Reciprocal-rank fusion of runs cut to depth: each list counts a document once, at its best rank."""
    rows = None
    for i, r in enumerate(runs):
        one = r.where(F.col("rank") <= depth).select("query_id", "doc_id", F.lit(i).alias("list"), "rank")
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy("query_id", "doc_id", "list").agg(F.min("rank").alias("rank"))
    return top_ranked(best.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 6).alias("score")), depth)


def lexical_scores(pool: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Stand-in for a cross-encoder: 10 x the share of query words in the document, less 2. Same contract: (query, text) -> score of six decimals."""
    q = queries.select("query_id", F.array_distinct(T.bm25_tokens(F.coalesce("query_text", F.lit("")))).alias("qt"))
    d = docs.join(pool.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.array_distinct(T.bm25_tokens(F.coalesce("text", F.lit("")))).alias("dt"))
    both = pool.select("query_id", "doc_id").join(q, "query_id").join(d, "doc_id")
    share = F.size(F.array_intersect("qt", "dt")) / F.greatest(F.lit(1), F.size("qt"))
    return both.select("query_id", "doc_id", F.round(10 * share - 2, 6).alias("score"))


def rerank(pool: DataFrame, docs: DataFrame, queries: DataFrame, top: int = TOP, scorer=lexical_scores) -> DataFrame:
    """Order the pool by the scorer, then by id; membership doesn't change."""
    return top_ranked(scorer(pool, docs, queries), top)


def confidence(ranked: DataFrame) -> DataFrame:
    """Per query the top score and its label: strong from STRONG on, else weak."""
    return ranked.where("rank = 1").select("query_id", F.col("score").alias("top_score"), F.when(F.col("score") >= STRONG, "strong").otherwise("weak").alias("confidence"))


def s2(docs: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, top: int = TOP) -> DataFrame:
    """The standard search: cosine and BM25 to DEPTH, fused, re-ranked, cut to top."""
    pool = materialise(fuse([cosine(vectors, query_vectors), bm25(docs, queries)]), "pool")
    return rerank(pool, docs, queries, top)


def url_deduplicated(results: DataFrame, min_score: float = 0.25) -> DataFrame:
    """results (query_id, doc_id, score, urls): for each url the best result stays; others go unless they are best for a url of theirs."""
    each = results.select("query_id", "doc_id", "score", F.explode("urls").alias("url"))
    best = each.groupBy("query_id", "url").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("doc_id")).select("query_id", "doc_id").distinct()
    plain = results.where(F.size("urls") == 0).select("query_id", "doc_id")
    return results.join(best.union(plain).distinct(), ["query_id", "doc_id"], "left_semi").where(F.col("score") >= min_score).drop("urls")


def names_with_terms(names: DataFrame, terms: DataFrame) -> DataFrame:
    """names (key), terms (query_id, term) -> (query_id, key, matched): names that contain a term, over distinct names only."""
    asked = terms.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    hit = broadcast_if_small(asked, 10_000)
    return names.select("key").distinct().join(hit, F.exists("terms", lambda t: F.col("key").contains(t))).select("query_id", "key", F.size(F.filter("terms", lambda t: F.col("key").contains(t))).cast("long").alias("matched"))
