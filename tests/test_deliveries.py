import random

from tidewell.operators.components import connected_components
from tidewell.operators.deliveries import DeliveryStore, identified, surplus_entries

SCHEMA = "entry_id long, job_id string, telegram_update_id long, tbl string"


def brute(entries):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for e, j, u in entries:
        j = (j or "").strip()
        ids = [("j", int(j))] if j.isdigit() and int(j) > 0 else []
        ids += [("u", u)] if u and u > 0 else []
        for i in ids:
            parent[find(("e", e))] = find(i)
    low = {}
    for e, *_ in entries:
        low[find(("e", e))] = min(e, low.get(find(("e", e)), e))
    return sorted(e for e, *_ in entries if low[find(("e", e))] != e)


def test_random_entries_against_union_find(spark):
    rng = random.Random(3)
    entries = [(i, rng.choice([None, "", "null", "0", "-", f" 00{rng.randrange(1, 60)} ", str(rng.randrange(1, 60)), str(rng.randrange(1, 900))]), rng.choice([None, 0, rng.randrange(1, 200), rng.randrange(1, 900)])) for i in range(600)]
    df = spark.createDataFrame([(*e, "x") for e in entries], SCHEMA)
    got = sorted(r.entry_id for r in surplus_entries({"s": df}).collect())
    assert got == brute(entries)


def test_long_chain_and_hot_identifier(spark):
    chain = [(i, str(i // 2 + 1), (i + 1) // 2 + 1) for i in range(300)]
    hot = [(1000 + i, "777777", None) for i in range(6000)]
    df = spark.createDataFrame([(*e, "x") for e in chain + hot], SCHEMA)
    got = sorted(r.entry_id for r in surplus_entries({"s": df}).collect())
    assert got == list(range(1, 300)) + list(range(1001, 7000))


def test_streams_are_apart_and_empty_ones_do(spark):
    a = spark.createDataFrame([(5, "7", None, "x"), (6, "7", None, "x")], SCHEMA)
    b = spark.createDataFrame([(5, "7", None, "x")], SCHEMA)
    assert [tuple(r) for r in surplus_entries({"a": a, "b": b}).collect()] == [("a", 6)]
    assert surplus_entries({"a": a.limit(0)}).count() == 0


def test_upserting_a_batch_twice_changes_nothing(spark):
    a = identified(spark.createDataFrame([(1, "7", 3, "x"), (2, " 07", 3, "x"), (3, "8", None, "x")], SCHEMA), "t")
    s = DeliveryStore(spark, buckets=4)
    s.upsert(a, "b0")
    s.upsert(a, "b0")
    s.upsert(a.where("entry_id > 1"), "b1")
    assert sorted((r.ident, r.first_entry) for r in s.compact().collect()) == [("7/3", 1), ("8/", 3)]
    assert len(s.runs) == 1


def test_a_batch_upserted_after_compaction_and_a_store_opened_again(spark, tmp_path):
    rows = lambda *entries: identified(spark.createDataFrame([(e, j, u, "x") for e, j, u in entries], SCHEMA), "t")
    path = str(tmp_path / "store")
    s = DeliveryStore(spark, path, 4)
    b0, b1 = rows((1, "7", 3), (2, "7", 3), (4, "9", None)), rows((3, "8", None), (5, "7", 3))
    s.upsert(b0, "b0")
    s.upsert(b1, "b1")
    want = sorted(map(tuple, s.compact().collect()))
    assert [(r[1], r[4], r[5], r[6]) for r in want] == [("7/3", 1, 5, 2), ("8/", 3, 3, 1), ("9/", 4, 4, 1)]
    again = DeliveryStore(spark, path)
    assert again.buckets == 4 and sorted(map(tuple, again.read().collect())) == want
    again.upsert(b0, "b0")
    assert sorted(map(tuple, again.read().collect())) == want and sorted(map(tuple, again.compact().collect())) == want
    again.upsert(rows((6, "10", None)), "b2")
    assert DeliveryStore(spark, path).read().count() == 4


def test_merging_runs_shuffles_nothing(spark):
    s = DeliveryStore(spark, buckets=4)
    for i in range(3):
        s.upsert(identified(spark.createDataFrame([(k, str(k % 50 + 1), k, "x") for k in range(i * 40, i * 40 + 90)], SCHEMA), "t"), f"b{i}")
    assert "Exchange" not in s._merge(*[s._run(r) for r in s.runs[:2]])._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.ident, r.first_entry) for r in s.compact().collect()) == sorted((f"{k % 50 + 1}/{k or ''}", k) for k in range(170))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 500), (7, 7), (None, 3), (900, 300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 300: 300, 900: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
