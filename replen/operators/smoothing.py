"""Fitted smoothing: the parameters of every series by the least squared one-step error, all series of an Arrow batch moving together.

A search starts from the best points of a grid and tries a step up and down in each parameter; a step that helps is taken, else halved.
So the error is never above the grid's.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

SEASON = 12
#: Least and greatest alpha, beta, gamma and damping, and the grids that the search starts from.
BOUNDS = np.array([(0.0001, 0.9999), (0.0, 1.0), (0.0, 1.0), (0.8, 0.995)])
ALPHAS, BETAS, GAMMAS, DAMPINGS = (0.1, 0.3, 0.5, 0.7, 0.9), (0.1, 0.3, 0.5), (0.05, 0.3, 0.6), (0.85, 0.98)
STARTS, FIRST_STEP, LAST_STEP, ROUNDS = 3, 0.1, 0.0005, 150
#: Series worked on at a time (bounds memory).
CHUNK = 1000

ES = T.StructType([T.StructField(c, T.DoubleType()) for c in ("level", "trend", "sse", "alpha", "beta")])
HW = T.StructType([T.StructField("level", T.DoubleType()), T.StructField("trend", T.DoubleType()), T.StructField("season", T.ArrayType(T.DoubleType()))]
                  + [T.StructField(c, T.DoubleType()) for c in ("sse", "alpha", "beta", "gamma", "damping")])


def run(y: np.ndarray, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Squared error, level, trend and seasons (next month's first) after each series, for parameters p of shape (series, sets, 2 or 4).

    y: (series, months), padded after n months. Two parameters give an additive trend, four a damped one with additive seasons.
    """
    seasonal, alpha, beta = p.shape[2] == 4, p[..., 0], p[..., 1]
    shape = alpha.shape
    if seasonal:
        gamma, damping = p[..., 2], p[..., 3]
        first, second = y[:, :SEASON].mean(1), y[:, SEASON : 2 * SEASON].mean(1)
        level, trend, start = first, (second - first) / SEASON, SEASON
        season = np.repeat((y[:, :SEASON] - first[:, None])[:, :, None], shape[1], 2)
    else:
        level, trend, start, damping, season = y[:, 0], y[:, 1] - y[:, 0], 1, 1.0, None
    level, trend = (np.repeat(x[:, None], shape[1], 1) for x in (level, trend))
    sse = np.zeros(shape)
    for t in range(start, y.shape[1]):
        on, x = (t < n)[:, None], y[:, t][:, None]
        moved = damping * trend
        s = season[:, t % SEASON] if seasonal else 0.0
        error = np.where(on, x - (level + moved + s), 0.0)
        sse += error * error
        new = level + moved + alpha * error
        trend = np.where(on, beta * (new - level) + (1 - beta) * moved, trend)
        level = np.where(on, new, level)
        if seasonal:
            season[:, t % SEASON] = np.where(on, gamma * (x - new) + (1 - gamma) * s, s)
    if seasonal:
        turned = (np.arange(SEASON)[None] + n[:, None]) % SEASON
        season = np.take_along_axis(season, turned[:, :, None], 1)
    return sse, level, trend, season


def search(y: np.ndarray, n: np.ndarray, seasonal: bool) -> np.ndarray:
    """The parameters of each series."""
    grid = np.array(list(product(ALPHAS, BETAS, GAMMAS, DAMPINGS) if seasonal else product(ALPHAS, BETAS)))
    d, m = grid.shape[1], len(y)
    low, high = BOUNDS[:d].T
    sse = run(y, n, np.broadcast_to(grid, (m, *grid.shape)))[0]
    order = np.argsort(sse, axis=1, kind="stable")[:, :STARTS]
    at, best = grid[order], np.take_along_axis(sse, order, 1)
    step = np.full(best.shape, FIRST_STEP)
    moves = np.concatenate([np.eye(d), -np.eye(d)])
    for _ in range(ROUNDS):
        live = (step >= LAST_STEP).any(1)
        if not live.any():
            break
        a, b, w = at[live], best[live], step[live]
        tried = np.clip(a[:, :, None] + w[..., None, None] * moves, low, high)
        found = run(y[live], n[live], tried.reshape(len(a), -1, d))[0].reshape(*b.shape, -1)
        k = found.argmin(2)
        least = np.take_along_axis(found, k[..., None], 2)[..., 0]
        better = (least < b) & (w >= LAST_STEP)
        at[live] = np.where(better[..., None], np.take_along_axis(tried, k[..., None, None], 2)[:, :, 0], a)
        best[live], step[live] = np.where(better, least, b), np.where(better, w, w / 2)
    return at[np.arange(m), best.argmin(1)]


def fit(series: list[np.ndarray], seasonal: bool) -> dict[str, np.ndarray]:
    """level, trend, sse and parameters (and seasons) of series of two values (two years) or more."""
    out: list[tuple] = []
    for i in range(0, len(series), CHUNK):
        part = series[i : i + CHUNK]
        n = np.array([len(s) for s in part])
        y = np.zeros((len(part), n.max()))
        for row, s in zip(y, part):
            row[: len(s)] = s
        p = search(y, n, seasonal)
        sse, level, trend, season = run(y, n, p[:, None])
        out.append((level[:, 0], trend[:, 0], sse[:, 0], p, season[:, :, 0] if seasonal else p))
    level, trend, sse, p, season = (np.concatenate(x) for x in zip(*out))
    found = {"level": level, "trend": trend, "sse": sse} | dict(zip(("alpha", "beta", "gamma", "damping"), p.T))
    return found | ({"season": season} if seasonal else {})


def _structs(series: list[np.ndarray], on: np.ndarray, kind: T.StructType) -> pa.Array:
    """The fits of the series that are on, null for the others."""
    names, n = kind.fieldNames(), len(series)
    fits = fit([s for s, o in zip(series, on) if o], "season" in names) if on.any() else {}
    columns = []
    for c in names:
        whole = np.zeros((n, SEASON) if c == "season" else n)
        if fits:
            whole[on] = fits[c]
        flat = pa.array(whole.ravel())
        columns.append(pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * SEASON, flat) if c == "season" else flat)
    return pa.StructArray.from_arrays(columns, names=names, mask=pa.array(~on))


def fitted(arrays: DataFrame, es: Column | None = None, hw: Column | None = None) -> DataFrame:
    """arrays (with y, see forecasting.as_arrays()) with the fits es and hw where the conditions hold, null elsewhere."""
    rows = arrays.withColumns({f"_{k}": c for k, c in (("es", es), ("hw", hw)) if c is not None})
    asked = {k: kind for k, c, kind in (("es", es, ES), ("hw", hw, HW)) if c is not None}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("y"))
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            series = np.split(lists.flatten().to_numpy(zero_copy_only=False), ends[:-1])
            kept = [(c, batch.column(i)) for i, c in enumerate(batch.schema.names) if c[1:] not in asked or c[0] != "_"]
            for k, kind in asked.items():
                on = batch.column(batch.schema.get_field_index(f"_{k}")).fill_null(False).to_numpy(zero_copy_only=False)
                kept.append((k, _structs(series, on, kind)))
            yield pa.RecordBatch.from_arrays([x for _, x in kept], names=[c for c, _ in kept])

    schema = T.StructType([*arrays.schema.fields, *[T.StructField(k, kind) for k, kind in asked.items()]])
    return rows.mapInArrow(of, schema)
