import random

import pytest

from tidewell.operators import evaluation as V
from tidewell.plans import evaluation as E


def metrics(spark, values):
    return spark.createDataFrame([*enumerate(values)], "query_id long, ndcg double")


@pytest.mark.parametrize("n, resamples", [(1, 40), (7, 10_000), (64, 500), (20_001, 40)])
def test_bootstrap_draws_the_stream_of_the_standard_library(spark, monkeypatch, n, resamples):
    monkeypatch.setattr(V, "DRAWN", 1 << 14)
    rng = random.Random(3)
    a, b = ([rng.random() for _ in range(n)] for _ in range(2))
    deltas, rng = [y - x for x, y in zip(a, b)], random.Random(42)
    means = sorted(sum(deltas[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))
    got = V.paired_bootstrap(metrics(spark, a), metrics(spark, b), resamples).first()
    assert (got.low, got.high) == pytest.approx((means[int(0.025 * resamples)], means[int(0.975 * resamples) - 1]), abs=2e-6)


def test_the_query_takes_ten_thousand_resamples(spark, monkeypatch):
    rng = random.Random(5)
    a, b = ([rng.random() for _ in range(9)] for _ in range(2))
    monkeypatch.setattr(E, "_all", lambda *_: (metrics(spark, a), None, metrics(spark, b), None))
    monkeypatch.setattr(V, "ranking_metrics", lambda run, _: run)
    deltas, rng = [y - x for x, y in zip(a, b)], random.Random(42)
    means = sorted(sum(deltas[rng.randrange(9)] for _ in range(9)) / 9 for _ in range(10_000))
    got = E.paired_bootstrap(spark, None).first()
    assert (got.low, got.high) == pytest.approx((means[250], means[9749]), abs=2e-6)
