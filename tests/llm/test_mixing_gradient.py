import numpy as np
import pytest

from tidewell.llm import mixing as M


def solved(adds, cap, want):
    """Plain projected gradient, run long."""
    x, step = cap / 2, 1 / np.linalg.norm(adds, 2) ** 2
    for _ in range(30_000):
        x = np.clip(x - step * (adds @ (x @ adds - want)), 0, cap)
    return x


def test_squares_are_those_of_the_totals():
    assert np.allclose(M.projected_rates([[(0, 0.5), (1, 0.5)]], np.array([100.0]), np.array([1.0]), np.array([10.0, 40.0])), [0.5], atol=1e-3)


@pytest.mark.parametrize("rows", [0, 50_000])
def test_each_document_has_a_rate_by_its_whole_posterior(spark, monkeypatch, rows):
    """The same by executors and at hand, and as a dense solver finds it."""
    rng = np.random.default_rng(5)
    p, size, cap = rng.dirichlet(np.ones(4) * 0.6, 80).astype(np.float32), rng.integers(20, 90, 80), rng.integers(1, 4, 80)
    want = size.sum() * np.array([0.3, 0.1, 0.2, 0.1])
    monkeypatch.setattr(M, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(M, "WRITTEN", 5)
    soft = spark.createDataFrame([(i, "x", int(n), int(c), v.tobytes()) for i, (n, c, v) in enumerate(zip(size, cap, p))], "doc_id long, source string, n_tokens long, cap int, p binary").repartition(2)
    others = M.Others(soft, 4)
    label = M.projected_rates([[(0, 1.0)]], np.array([90.0]), np.array([2.0]), want, others)
    x = np.array([r.x for r in others.rated().orderBy("doc_id").collect()])
    adds = np.vstack([[90.0, 0, 0, 0], p * size[:, None]])
    best = solved(adds, np.array([2.0, *cap]), want)
    off = lambda r: np.linalg.norm(r @ adds - want) / want.sum()
    assert (x >= 0).all() and (x <= cap).all() and off(np.array([*label, *x])) < off(best) + 2e-3
    # Two likeliest sources in eighths miss more than that.
    told = np.zeros((81, 4))
    told[0, 0] = 90
    for d, v in enumerate(p):
        for s, w in M.members_of(M.likeliest(v)):
            told[d + 1, s] = w * size[d]
    cut = solved(told, np.array([2.0, *cap]), want)
    assert off(cut) > off(best) + 1e-2


def test_whole_repeats_keep_the_totals_of_the_rates(spark):
    rng = np.random.default_rng(6)
    p, size, x = rng.dirichlet(np.ones(5), 400).astype(np.float32), rng.integers(20, 90, 400), rng.uniform(0, 3, 400)
    rated = spark.createDataFrame([(i, "x", int(n), v.tobytes(), float(r)) for i, (n, v, r) in enumerate(zip(size, p, x))], "doc_id long, source string, n_tokens long, p binary, x double")
    got = np.array([r.repeats for r in M._whole(rated, 5).orderBy("doc_id").collect()])
    assert (np.abs(got - x) < 1).all() and np.abs((got - x) @ (p * size[:, None])).max() < 150
