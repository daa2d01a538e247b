"""Fitted smoothing against the grid it starts from, a fine search and the recursion by expressions."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from replen.operators import forecasting, smoothing


def some_series(count, least, seed):
    r = np.random.RandomState(seed)
    wave = lambda k: 15 * r.rand() * np.sin(np.arange(k) * 2 * np.pi / 12)
    made = [np.maximum(0, 40 + wave(k) + r.randn(k) * r.choice([1, 8, 25]) + np.arange(k) * r.randn()).round() for k in r.randint(least, 50, count)]
    return [*made, np.zeros(least), np.full(least + 5, 7.0), np.arange(least) * 1000.0]


@pytest.mark.parametrize("seasonal", [False, True])
def test_error_against_the_grid_and_a_fine_search(seasonal):
    series = some_series(25, 24 if seasonal else 3, 4)
    found = smoothing.fit(series, seasonal)
    if seasonal:
        coarse = list(product(smoothing.ALPHAS, smoothing.BETAS, smoothing.GAMMAS, smoothing.DAMPINGS))
        fine = list(product(np.linspace(0.0001, 0.9999, 12), np.linspace(0, 1, 10), np.linspace(0, 1, 10), (0.8, 0.87, 0.94, 0.98, 0.995)))
    else:
        coarse, fine = list(product(smoothing.ALPHAS, smoothing.BETAS)), list(product(np.linspace(0.0001, 0.9999, 80), np.linspace(0, 1, 80)))
    for i, s in enumerate(series):
        y, n = s[None], np.array([len(s)])
        least = lambda grid: smoothing.run(y, n, np.array(grid)[None])[0].min()
        assert found["sse"][i] <= least(coarse) + 1e-9 and found["sse"][i] <= 1.01 * least(fine) + 1e-6
    again = smoothing.fit(series[::-1], seasonal)  # each series by itself, whatever shares its batch
    assert all(np.allclose(found[k], again[k][::-1], rtol=1e-12) for k in found)


def test_fits_equal_the_recursion_by_expressions(spark):
    series = some_series(6, 24, 9)
    rows = [(f"e{i}", [float(x) for x in s], len(s), "x") for i, s in enumerate(series)] + [("short", [1.0, 2.0, 3.0], 3, None), ("one", [5.0], 1, "y")]
    arrays = spark.createDataFrame(rows, "entity string, y array<double>, n int, other string").repartition(3)
    out = {r.entity: r for r in smoothing.fitted(arrays, es=F.col("n") >= 3, hw=F.col("n") >= 24).collect()}
    assert out["one"].es is None and out["one"].hw is None and out["short"].hw is None and out["short"].es is not None and out["one"].other == "y" and out["short"].other is None
    for i, s in enumerate(series):
        e, h = out[f"e{i}"].es, out[f"e{i}"].hw
        one = arrays.where(F.col("entity") == f"e{i}").select(
            forecasting.smoothing_fit(F.col("y"), e.alpha, e.beta).alias("e"), forecasting.holt_winters_fit(F.col("y"), h.alpha, h.beta, h.gamma, h.damping).alias("h")
        ).first()
        near = lambda x: pytest.approx(x, rel=1e-6, abs=1e-6)
        assert (e.level, e.trend, e.sse) == near((one.e.level, one.e.trend, one.e.sse))
        assert (h.level, h.trend, h.sse) == near((one.h.level, one.h.trend, one.h.sse)) and h.season == near(one.h.season)
    assert smoothing.fitted(arrays.where("false"), es=F.lit(True), hw=F.lit(True)).count() == 0
    assert smoothing.fitted(arrays, es=F.lit(None).cast("boolean")).where("es is not null").count() == 0
