import itertools
import random
from collections import Counter

from tidewell.llm.cooccurrence import baskets, frequent_pairs


def test_against_brute_force(spark):
    rng = random.Random(5)
    items = [f"i{n}" for n in range(30)]
    data = []
    for k in range(600):
        picked = [rng.choice(items[: rng.choice([4, 30])]) for _ in range(rng.randrange(6))]
        if k % 3 == 0:
            picked += ["Hot", " hot "]
        if k % 10 == 0:
            picked += ["Left", "right "]
        data.append((k, picked + ["", "  ", None], "clash"))
    data += [(601, None, ""), (602, [], ""), (None, ["x", "y"], "")] + data[:50]
    sets = {k: {x.strip().lower() for x in v or [] if x and x.strip()} for k, v, _ in data if k is not None}
    one, two = Counter(), Counter()
    for s in sets.values():
        one.update(s)
        two.update(itertools.combinations(sorted(s), 2))
    want = {(a, b, n) for (a, b), n in two.items() if n >= 5 and n * len(sets) >= 4 * one[a] * one[b]}
    df = spark.createDataFrame(data, "key long, items array<string>, n string")
    got = frequent_pairs([baskets(df, "key", "items", "f")]).collect()
    assert {(r.item_a, r.item_b, r.n_ab) for r in got} == want and ("left", "right", 60) in want
    assert all(r.n == len(sets) for r in got)
    assert frequent_pairs([baskets(df.limit(0), "key", "items", "f")]).count() == 0
