"""Judging rankings: metrics, comparisons and statistics."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import broadcast_if_small

K, DEPTH, RELEVANT, THRESHOLD, BAND = 5, 30, 2, 0.25, 0.01
THRESHOLDS = [round(0.20 + 0.05 * i, 2) for i in range(9)]
RESAMPLES, SEED = 10_000, 42
#: Numbers a bootstrap draws at once.
DRAWN = 1 << 20


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """A run with grades; what nobody judged counts 0."""
    return run.join(qrels, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "score", "rank", F.coalesce("relevance", F.lit(0)).alias("grade"), F.col("relevance").isNotNull().alias("is_judged"))


def ranking_metrics(run: DataFrame, qrels: DataFrame, k: int = K) -> DataFrame:
    """Per query nDCG, success, reciprocal rank and recall at k, and the first relevant rank.

    The ideal is that of all judged documents, those the run never returned included; nDCG is null
    where that is 0.
    """
    j = judged(run, qrels)
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    top = F.col("rank") <= k
    hit = F.col("grade") >= RELEVANT
    got = j.groupBy("query_id").agg(
        F.sum(F.when(top, gain(F.col("grade")) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.max(F.when(top & hit, 1).otherwise(0)).cast("double").alias("success"),
        F.min(F.when(hit, F.col("rank"))).alias("first_rank"),
        F.count_if(top & hit).alias("found"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))
    ideal = qrels.withColumn("p", place).groupBy("query_id").agg(F.sum(F.when(F.col("p") <= k, gain(F.col("relevance")) / F.log2(F.col("p") + 1)).otherwise(0.0)).alias("ideal"), F.count_if(F.col("relevance") >= RELEVANT).alias("relevant"))
    both = got.join(ideal, "query_id", "left")
    return both.select("query_id", F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")), 6).alias("ndcg"), "success", F.round(F.when(F.col("first_rank") <= k, 1 / F.col("first_rank")).otherwise(0.0), 6).alias("mrr"), F.round(F.when(F.col("relevant") > 0, F.col("found") / F.col("relevant")), 6).alias("recall"), F.coalesce("first_rank", F.lit(0)).alias("first_rank"))


def roc_auc(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Pooled area under the ROC curve from average ranks, ties half; null if one class is empty.

    Scores are counted first; the ordered pass goes over distinct scores within thousandths, and over the thousandths.
    """
    by = judged(run, qrels).groupBy("score").agg(F.count_if(F.col("grade") >= RELEVANT).alias("pos"), F.count_if(F.col("grade") < RELEVANT).alias("neg"))
    # Running totals of ever coarser steps: those within a bucket, and those of the buckets below.
    step = F.floor(F.col("score") * F.lit(1000)).alias("bucket")
    within = Window.partitionBy("bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    sums = by.groupBy(step).agg(F.sum("neg").alias("all"))
    lower = sums.withColumn("before", F.coalesce(F.sum("all").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    told = by.withColumn("bucket", step).withColumn("own", F.coalesce(F.sum("neg").over(within), F.lit(0))).join(broadcast_if_small(lower.select("bucket", "before")), "bucket").withColumn("under", F.col("own") + F.col("before"))
    return told.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)).alias("u")).select(F.col("p").alias("positives"), F.col("n").alias("negatives"), F.round(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))), 6).alias("auc"))


def threshold_sweep(run: DataFrame, qrels: DataFrame, k: int = K) -> DataFrame:
    """For each threshold the results that survive, their precision and recall, and success among the first k survivors."""
    j = judged(run, qrels).select("query_id", "score", "rank", "grade", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("threshold")).where("score >= threshold")
    again = j.withColumn("r", F.row_number().over(Window.partitionBy("threshold", "query_id").orderBy("rank")))
    relevant = qrels.agg(F.count_if(F.col("relevance") >= RELEVANT).alias("relevant"))
    hit = F.col("grade") >= RELEVANT
    per = again.groupBy("threshold", "query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("h"), F.max(F.when(hit & (F.col("r") <= k), 1).otherwise(0)).alias("s"))
    return per.groupBy("threshold").agg(F.sum("n").alias("returned"), F.sum("h").alias("hits"), F.sum("s").alias("successes")).join(F.broadcast(relevant), F.lit(True)).select("threshold", "returned", F.round(F.col("hits") / F.col("returned"), 6).alias("precision"), F.round(F.col("hits") / F.col("relevant"), 6).alias("recall"), "successes")


def failure_classes(run: DataFrame, qrels: DataFrame, truncated: DataFrame | None = None, k: int = K, depth: int = DEPTH, threshold: float = THRESHOLD) -> DataFrame:
    """Per query, by the first that holds: no answer in the corpus, success, missed by the threshold, a relevant document that was cut (truncated: doc_id), a cosine miss beyond the depth, a miss of the ranking."""
    hit = F.col("grade") >= RELEVANT
    rows = judged(run, qrels)
    rows = rows.withColumn("_cut", F.lit(False)) if truncated is None else rows.join(truncated.select("doc_id", F.lit(True).alias("_cut")).distinct(), "doc_id", "left")
    per = rows.groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("first"), F.max(F.when(hit & (F.col("rank") <= k), F.col("score"))).alias("best"), F.max(hit & F.coalesce("_cut", F.lit(False))).alias("cut"))
    return per.select("query_id", F.when(F.col("first").isNull(), "no_corpus_answer").when(F.col("best") >= threshold, "success").when(F.col("best").isNotNull(), "threshold_miss").when(F.col("cut"), "long_document_miss").when(F.col("first") > depth, "cosine_retrieval_miss").otherwise("ranking_miss").alias("failure_class"))


def win_tie_loss(a: DataFrame, b: DataFrame, band: float = BAND) -> DataFrame:
    """Metrics of two systems -> (wins, ties, losses, mean_delta) of b against a; null nDCG counts 0."""
    d = a.select("query_id", F.coalesce("ndcg", F.lit(0.0)).alias("x")).join(b.select("query_id", F.coalesce("ndcg", F.lit(0.0)).alias("y")), "query_id").withColumn("d", F.round(F.col("y") - F.col("x"), 6))
    return d.agg(F.count_if(F.col("d") > band).alias("wins"), F.count_if(F.abs("d") <= band).alias("ties"), F.count_if(F.col("d") < -band).alias("losses"), F.round(F.avg("d"), 6).alias("mean_delta"))


def _resampled_means(values: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """The means of resamples, drawn one after another as random.Random(seed).randrange(len(values)) draws; DRAWN numbers lie in memory at once."""
    n, bits = len(values), np.random.MT19937()
    *key, pos = random.Random(seed).getstate()[1]
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, dtype=np.uint32), "pos": pos}}
    sums, at = np.zeros(resamples), 0
    while at < n * resamples:
        # randrange takes the upper bits of each number and passes over those that are too large.
        drawn = bits.random_raw(DRAWN) >> np.uint64(32 - n.bit_length())
        drawn = drawn[drawn < n][: n * resamples - at]
        owner = np.arange(at, at + len(drawn)) // n
        if len(drawn):
            sums[owner[0] : owner[-1] + 1] += np.bincount(owner - owner[0], weights=values[drawn])
        at += len(drawn)
    return sums / n


def paired_bootstrap(a: DataFrame, b: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(mean_delta, low, high, verdict): percentile interval over resampled queries, from the standard library's stream for the seed.

    The driver holds one number a query.
    """
    d = a.select("query_id", F.coalesce("ndcg", F.lit(0.0)).alias("x")).join(b.select("query_id", F.coalesce("ndcg", F.lit(0.0)).alias("y")), "query_id").orderBy("query_id")
    deltas = d.select((F.col("y") - F.col("x")).alias("d")).toPandas()["d"].to_numpy(dtype=float)
    if not len(deltas):
        return a.sparkSession.createDataFrame([], "mean_delta double, low double, high double, verdict string")
    means = np.sort(_resampled_means(deltas, resamples, seed))
    low, high = float(means[int(0.025 * resamples)]), float(means[int(0.975 * resamples) - 1])
    verdict = "improved" if low > 0 else "worse" if high < 0 else "no detectable difference"
    return a.sparkSession.createDataFrame([(round(float(deltas.mean()), 6), round(low, 6), round(high, 6), verdict)], "mean_delta double, low double, high double, verdict string")


def pooled(runs: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Union of the runs to their depths: (query_id, doc_id, best_rank, sources), sources in order of name."""
    rows = None
    for name, (run, depth) in sorted(runs.items()):
        one = run.where(F.col("rank") <= depth).select("query_id", "doc_id", "rank", F.lit(name).alias("source"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("query_id", "doc_id").agg(F.min("rank").alias("best_rank"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))


def unjudged(run: DataFrame, qrels: DataFrame, k: int = K) -> DataFrame:
    """Per query how many of the first k nobody judged, and the share of k that was."""
    j = judged(run, qrels).where(F.col("rank") <= k)
    return j.groupBy("query_id").agg(F.count_if(~F.col("is_judged")).alias("unjudged"), F.round(F.count_if(F.col("is_judged")) / F.lit(k), 6).alias("judged_at_k"))


def headroom(run: DataFrame, qrels: DataFrame, depth: int = 10) -> DataFrame:
    """Relevant documents a run ranks beyond the depth or not at all."""
    rel = qrels.where(F.col("relevance") >= RELEVANT).join(run.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    return rel.agg(F.count(F.lit(1)).alias("relevant"), F.count_if(F.coalesce("rank", F.lit(depth + 1)) > depth).alias("beyond"))


def abstention(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Median top score of queries with and without an answer."""
    answer = qrels.groupBy("query_id").agg((F.max("relevance") >= RELEVANT).alias("answerable"))
    top = run.where("rank = 1").select("query_id", "score").join(answer, "query_id", "left").withColumn("answerable", F.coalesce("answerable", F.lit(False)))
    return top.groupBy("answerable").agg(F.count(F.lit(1)).alias("n"), F.round(F.expr("percentile(score, 0.5)"), 6).alias("median_top"))


def aggregate(metrics: DataFrame) -> DataFrame:
    """Macro means; nulls don't count."""
    return metrics.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("ndcg", "success", "mrr", "recall")])
