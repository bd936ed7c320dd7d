import random

import numpy as np
import pytest

from tidewell.llm import mixing as M
from tidewell.llm import packing as P
from tidewell.llm.tokens import VOCABULARY, encoder, token_counts


def test_every_document_once_and_split_only_if_it_must(spark):
    rng = random.Random(4)
    sizes = {i: rng.choice([rng.randrange(1, 60), rng.randrange(1, 300), 100, 200, 1000]) for i in range(3000)}
    rows = [(i, n, "c") for i, n in sizes.items()] + [(5, sizes[5], "c"), (None, 7, "c"), (9000, 0, "c")]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens long, container_kind string").repartition(40)
    kinds = spark.createDataFrame([("s", 100), ("m", 256), ("bad", 0), (None, 5)], "container_kind string, capacity_tokens int")
    got = P.pack(items, kinds).collect()
    for kind, cap in (("s", 100), ("m", 256)):
        mine = [r for r in got if r.container_kind == kind]
        pieces, used = {}, {}
        for r in mine:
            pieces.setdefault(r.doc_id, []).append((r.piece_no, r.first_token, r.n_tokens))
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        assert set(pieces) == set(sizes) and max(used.values()) <= cap
        for d, ps in pieces.items():
            ps.sort()
            assert sum(p[2] for p in ps) == sizes[d] and (len(ps) == 1 or sizes[d] > cap)
            assert [p[1] for p in ps] == [i * cap for i in range(len(ps))]
        # As good as first-fit decreasing with all items at hand, but for a few in a hundred.
        rooms = []
        for n in sorted((n % cap for n in sizes.values() if n % cap), reverse=True):
            k = next((k for k, room in enumerate(rooms) if room >= n), None)
            if k is None:
                rooms.append(cap - n)
            else:
                rooms[k] -= n
        assert len(used) <= 1.03 * (len(rooms) + sum(n // cap for n in sizes.values()))
    lists = P.container_lists(P.pack(items, kinds))
    assert lists.where("used_tokens > capacity_tokens").count() == 0
    assert P.pack(items.limit(0), kinds).count() == 0


def test_tokens_round_trip(spark):
    if not __import__("os").path.exists(VOCABULARY):
        pytest.skip("no vocabulary")
    texts = ["hello wörld 👍 <|endoftext|>", "", None, "数字 12"]
    got = {r.k: r.n_tokens for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k", []).collect()}
    enc = encoder(VOCABULARY)
    assert [enc.decode(enc.encode_ordinary(t)) for t in texts if t] == [t for t in texts if t]
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_rates_solve_the_least_squares():
    members, tokens, caps = [[(0, 1.0)], [(1, 1.0)], [(2, 1.0)]], np.array([100.0, 1000.0, 50.0]), np.array([1.0, 1.0, 4.0])
    want = np.array([50.0, 300.0, 150.0])
    assert np.allclose(M.projected_rates(members, tokens, caps, want) * tokens, want, rtol=1e-3)
    soft = [[(0, 0.5), (1, 0.5)], [(1, 1.0)], [(2, 1.0)]]
    rates = M.projected_rates(soft, tokens, caps, np.array([40.0, 300, 100]))
    dense = np.array([[0.5, 0.5, 0], [0, 1, 0], [0, 0, 1]])
    assert np.allclose((dense * (rates * tokens)[:, None]).sum(axis=0), [40, 300, 100], rtol=1e-2)


def test_shares_and_caps(spark):
    rng = random.Random(6)
    docs = [(i, s, f"text of {s} {i % 13}", rng.randrange(5, 60)) for s, k in (("a", 900), ("b", 300), ("c", 60)) for i in range({"a": 0, "b": 1000, "c": 2000}[s], {"a": 0, "b": 1000, "c": 2000}[s] + k)]
    docs += [docs[0], (None, "a", "x", 9), (5000, None, "text of b 3", 20), (5001, "zzz", "text of c 4", 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)], "source string, target_share double, max_repeats int")
    chosen = M.mixture(df, targets)
    assert chosen.count() == chosen.select("doc_id").distinct().count()
    got = {r.source: r for r in M.mixture_shares(chosen, targets).collect() if r.source}
    caps = {"a": 1, "b": 2, "c": 3}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(got[s].actual_share - share) < 0.02 and got[s].max_repeats_used <= caps[s]
    assert M.mixture(df.limit(0), targets).count() == 0 and M.mixture(df, targets.limit(0)).count() == 0


def test_classifier_on_held_out_texts():
    rng = random.Random(7)
    words = {"a": ["apple", "pear", "plum"], "b": ["bolt", "nut", "gear"]}
    rows = [(s, " ".join(rng.choices(words[s] + ["the", "of"], k=12))) for s in words for _ in range(100)]
    m = M.SourceModel(["a", "b"], rows[:80] + rows[100:180])
    held = rows[80:100] + rows[180:]
    assert np.mean([m.names[int(m.posterior(t).argmax())] == s for s, t in held]) >= 0.95
    assert all(sum(w for _, w in M.members_of(m.memberships(t))) == 1 for _, t in held)


def test_no_source_is_left_out_and_posteriors_meet_the_targets(spark):
    rng = random.Random(8)
    docs = [(10_000 * k + i, s, " ".join(rng.choices(["the", "of", f"{s}ly", f"{s}ing", f"{s}er"], k=12)), rng.randrange(80, 200)) for k, s in enumerate("abcd") for i in range({"a": 4000, "b": 4000, "c": 60, "d": 1200}[s])]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 1), ("c", 0.1, 1), ("d", 0.1, 1), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in M.mixture_shares(M.mixture(df, targets), targets).collect()}
    assert all(got[s].n_docs > 0 for s in "abcd") and got["none"].n_docs == 0
    soft = {r.source: r for r in M.posterior_shares(df, targets, df).collect()}
    assert all(abs(soft[s].expected_share - w) < 0.06 and abs(soft[s].actual_share - w) < 0.08 for s, w in (("a", 0.44), ("b", 0.33), ("c", 0.11), ("d", 0.11)))
    assert M.posterior_shares(df.limit(0), targets, df).count() == 0


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_tables_keep_caps_and_shares(spark, sf):
    from tidewell.llm import queries as Q

    sf_dir = f"/root/testdata/sf{sf}"
    if not __import__("os").path.isdir(sf_dir):
        pytest.skip("no test tables")
    shares = Q.p9_shares(spark, sf_dir).collect()
    caps = {r.source: r.max_repeats for r in spark.read.parquet(f"{sf_dir}/mixture_targets.parquet").collect()}
    held = {r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct().collect()}
    assert all(r.max_repeats_used <= caps[r.source] for r in shares) and all(r.n_docs > 0 for r in shares if r.source in held)
    assert max(abs(r.actual_share - r.target_share) for r in shares) < {"0.01": 0.08, "0.1": 0.02}[sf]


def test_tables_are_packed_whole(spark):
    """Every token of every document once in each kind, no container over its capacity, nothing split that fits."""
    from tidewell.llm import queries as Q

    sf_dir = "/root/testdata/sf0.01"
    if not __import__("os").path.isdir(sf_dir):
        pytest.skip("no test tables")
    import duckdb

    sizes = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", []).where("n_tokens > 0").toPandas()
    packed = Q._packed(spark, sf_dir).toPandas()
    con = duckdb.connect()
    con.register("sizes", sizes), con.register("packed", packed)
    assert con.execute("select count(*) from (select container_kind, doc_id, sum(n_tokens) as n, count(*) as k, any_value(capacity_tokens) as c from packed group by all) p full join (select container_kind, s.* from sizes s, (select distinct container_kind from packed)) s using (container_kind, doc_id) where n is distinct from n_tokens or k > 1 and n <= c").fetchone()[0] == 0
    assert con.execute("select count(*) from (select container_id, container_kind, sum(n_tokens) as n, any_value(capacity_tokens) as c from packed group by all) where n > c").fetchone()[0] == 0
    assert con.execute("select min(f) from (select sum(n_tokens) / (count(distinct container_id) * any_value(capacity_tokens)) as f from packed group by container_kind)").fetchone()[0] > 0.93
