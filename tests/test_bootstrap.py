import math

import numpy as np
import pytest

from faultline.operators.bootstrap import WIDE, binomial_at, gate_statistics, grading_statistics, intervals, multinomial, resampled, tree_nodes


def gate_cells(spark, tp, fp, fn, tn):
    rows = [("run", True, True, tp), ("run", False, True, fp), ("run", True, False, fn), ("run", False, False, tn)]
    return spark.createDataFrame([r for r in rows if r[3]], "run_id string, truth boolean, routed boolean, n bigint")


def brute(tp, fp, fn, tn, resamples=4000):
    rng = np.random.default_rng(1)
    draws = rng.multinomial(tp + fp + fn + tn, np.array([tp, fp, fn, tn]) / (tp + fp + fn + tn), resamples)
    return np.percentile(draws[:, 0] / (draws[:, 0] + draws[:, 2]), [2.5, 97.5])


def test_draws_match_the_distribution(spark):
    """A published run: 78.9 percent recall, 95 percent interval 65.9 to 90.5 with another generator."""
    got = intervals(gate_cells(spark, 30, 7, 8, 5), ["run_id"], ["truth", "routed"], gate_statistics()).first()
    low, high = brute(30, 7, 8, 5)
    assert got.n_rows == 50 and got.recall == pytest.approx(30 / 38) and got.f1 == pytest.approx(0.8)
    assert got.recall_low == pytest.approx(low, abs=0.02) and got.recall_high == pytest.approx(high, abs=0.02)
    assert got.recall_low == pytest.approx(0.6586, abs=0.04) and got.recall_high == pytest.approx(0.9049, abs=0.04)


@pytest.mark.parametrize("n, p", [(1, 0.5), (7, 0.2), (50, 0.76), (999, 0.999), (10**6, 0.3), (10**7, 0.5), (10**10, 0.01)])
def test_counts_have_mean_and_variance_of_the_law(n, p):
    counts = binomial_at(np.full(20_000, n), p, np.random.default_rng(5).random(20_000)).astype(float)
    assert counts.mean() == pytest.approx(n * p, abs=0.05 * np.sqrt(n * p * (1 - p)))
    assert counts.var() == pytest.approx(n * p * (1 - p), rel=0.05)
    assert counts.min() >= 0 and counts.max() <= n


def test_counts_invert_the_distribution_function():
    steps = np.cumsum([math.comb(12, k) * 0.3**k * 0.7 ** (12 - k) for k in range(13)])
    uniforms = np.linspace(0.001, 0.999, 500)
    assert binomial_at(np.full(500, 12), 0.3, uniforms).tolist() == [int(np.argmax(steps >= u)) for u in uniforms]


def test_wide_quantiles_agree_with_the_sum(monkeypatch):
    n, p = np.full(3000, 4 * int(WIDE) ** 2 + 10), 0.4
    uniforms = np.random.default_rng(2).random(3000)
    by_sum = binomial_at(n - n // 10, p, uniforms)  # below the border
    monkeypatch.setattr("faultline.operators.bootstrap.WIDE", 100.0)
    apart = np.abs(binomial_at(n - n // 10, p, uniforms) - by_sum)
    assert apart.max() <= 1 and apart.mean() < 0.01


@pytest.mark.parametrize("cells", [[50], [3, 47], [5, 0, 9], [1, 2, 3, 4, 5, 6, 7], [0, 0, 4, 0, 0, 0, 0, 0, 6]])
def test_resamples_are_multinomial(cells):
    rng, n = np.random.default_rng(3), sum(cells)
    nodes = tree_nodes(16)
    assert len(nodes) == 15
    drawn = multinomial(np.array(cells), nodes, rng.random((8000, len(nodes))))
    brute = rng.multinomial(n, np.array(cells) / n, 8000)
    assert (drawn.sum(axis=1) == n).all()
    assert drawn.mean(axis=0) == pytest.approx(np.array(cells), abs=0.15)
    assert np.cov(drawn.T) == pytest.approx(np.cov(brute.T), abs=0.08 * n)


def test_every_resample_holds_all_rows(spark):
    draws = resampled(gate_cells(spark, 30, 7, 8, 5), ["run_id"], ["truth", "routed"], 50)
    sizes = draws.groupBy("b").agg({"n": "sum", "*": "count"}).collect()
    assert len(sizes) == 50 and {r["count(1)"] for r in sizes} == {4} and {r["sum(n)"] for r in sizes} == {50}


def test_groups_of_several_sizes(spark):
    rows = [(f"g{g}", c, 1 + (g * c) % 5) for g in range(1, 8) for c in range(g)]
    draws = resampled(spark.createDataFrame(rows, "g string, c int, n long"), ["g"], ["c"], 20)
    totals = draws.groupBy("g", "b").agg({"n": "sum", "*": "count"}).collect()
    assert len(totals) == 7 * 20
    assert all(r["sum(n)"] == sum(n for g, _, n in rows if g == r.g) and r["count(1)"] == int(r.g[1:]) for r in totals)


def test_one_row(spark):
    got = intervals(gate_cells(spark, 1, 0, 0, 0), ["run_id"], ["truth", "routed"], gate_statistics()).first()
    assert (got.recall, got.recall_low, got.recall_high) == (1.0, 1.0, 1.0)


def test_large_counts_cost_no_rows(spark):
    big = 10**9
    got = intervals(gate_cells(spark, 30 * big, 7 * big, 8 * big, 5 * big), ["run_id"], ["truth", "routed"], gate_statistics()).first()
    assert got.recall_high - got.recall_low < 1e-4 and got.recall == pytest.approx(30 / 38)


def test_grading_intervals(spark):
    cells = spark.createDataFrame([("a", 0, 0, 6), ("a", 1, 2, 3), ("a", 0, 3, 1)], "asset_class string, truth int, pred int, n bigint")
    got = intervals(cells, ["asset_class"], ["truth", "pred"], grading_statistics()).first()
    assert (got.exact_match, got.within_one_grade) == (0.6, 0.9)
    assert 0.2 <= got.exact_match_low < 0.6 < got.exact_match_high <= 0.95
