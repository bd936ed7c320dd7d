import math
import re

import numpy as np

from tidewell.functions.text import BM25_STOP
from tidewell.operators import evaluation as V
from tidewell.operators import expansion as E
from tidewell.operators import retrieval as R


def tokens(t):
    return [w for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in BM25_STOP]


def test_bm25_against_the_formula(spark):
    texts = ["red fox jumps", "red red fish", None, "blue fish and the fox fox", "", "red fox jumps"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame([(1, "red fox red"), (2, "nothing here"), (3, None)], "query_id long, query_text string")
    tok = [tokens(t) for t in texts]
    avg = sum(map(len, tok)) / len(tok)
    want = {}
    for d, ts in enumerate(tok):
        s = sum(math.log(1 + (len(tok) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avg)) for w in tokens("red fox red") if (tf := ts.count(w)) and (df := sum(w in x for x in tok)))
        if s:
            want[d] = round(s, 6)
    got = R.bm25(docs, q).collect()
    assert {r.doc_id: r.score for r in got} == want and {r.query_id for r in got} == {1}
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == sorted(want, key=lambda d: (-want[d], d))


def test_cosine_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 2)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 8)).round(3)
    v[7] = v[3]
    v[9] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "doc_id long, embedding array<double>").repartition(5)
    q = df.where("doc_id < 5").withColumnRenamed("doc_id", "query_id")
    got = R.cosine(df, q, 6).collect()
    n = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for i in range(5):
        s = (n @ n[i]).round(6)
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == sorted(range(40), key=lambda d: (-s[d], d))[:6]


def test_fusion_counts_a_list_once(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 10, 3)], "query_id long, doc_id long, rank long")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 40)], "query_id long, doc_id long, rank long")
    got = {r.doc_id: r.score for r in R.fuse([a, b]).collect()}
    assert got == {10: round(1 / 61, 6), 11: round(1 / 62 + 1 / 61, 6)}


def test_metrics(spark):
    run = spark.createDataFrame([(1, 5, 0.9, 1), (1, 6, 0.8, 2), (1, 7, 0.1, 3), (2, 5, 0.5, 1)], "query_id long, doc_id long, score double, rank long")
    qrels = spark.createDataFrame([(1, 6, 3), (1, 8, 2), (1, 5, 0), (2, 5, 1)], "query_id long, doc_id long, relevance int")
    m = {r.query_id: r for r in V.ranking_metrics(run, qrels).collect()}
    assert m[1].ndcg == round((7 / math.log2(3)) / (7 + 3 / math.log2(3)), 6) and m[1].mrr == 0.5 and m[1].recall == 0.5 and m[1].first_rank == 2
    assert m[2].success == 0 and m[2].recall is None
    auc = V.roc_auc(run, qrels).first()
    assert (auc.positives, auc.negatives, auc.auc) == (1, 3, round(2 / 3, 6))
    assert {r.query_id: r.failure_class for r in V.failure_classes(run, qrels).collect()} == {1: "success", 2: "no_corpus_answer"}
    b = V.paired_bootstrap(V.ranking_metrics(run, qrels), V.ranking_metrics(run, qrels), 50).first()
    assert (b.mean_delta, b.verdict) == (0.0, "no detectable difference")


def test_expansion_skips_hubs_and_seeds(spark):
    edges = [(1, "entity", "A_b"), (2, "entity", "a  B"), (3, "entity", "a-b"), (4, "topic", "solo")] + [(i, "topic", "hub") for i in range(1, 20)] + [(5, "topic", None), (6, "topic", "  ")]
    folded = E.connectors(spark.createDataFrame(edges, "doc long, node_type string, name string"))
    assert {(r.node_type, r.norm, r.degree, r.use) for r in E.degrees(folded).collect()} == {("entity", "a b", 3, "links"), ("topic", "solo", 1, "dead_end"), ("topic", "hub", 19, "hub")}
    seeds = spark.createDataFrame([(9, 1, 1), (9, 2, 2)], "query_id long, doc long, seed_rank int")
    got = E.expand(seeds, E.adjacency(folded)).collect()
    assert [(r.neighbour, r.score, r.path, r.connector) for r in got] == [(3, round(1.5 / math.log(4), 9), "entity", "a b")]
