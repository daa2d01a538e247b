"""Intervals of equal stock hold the whole history, however its snapshots come, and give the same streaks and grids."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from replen.operators import accuracy, inventory, stock_intervals

HISTORY = "sku string, snapshot_date date, available_stock double"
DAY = date(2001, 1, 1)


def random_history(seed, n_days=12, n_skus=9):
    rng = random.Random(seed)
    days = sorted(rng.sample(range(40), n_days))
    rows = []
    for k in range(n_skus):
        stock = 0.1
        for d in days:
            stock = rng.choice([stock, stock, stock, 0.0, 0.3, 5.0, None])
            if rng.random() < 0.8:
                rows.append((f"AB00{k % 3}0{k}{'0' * 2}", DAY + timedelta(d), stock))
    return rows


def runs_by_hand(rows):
    """(sku, first, last, stock) by a walk over each SKU's days."""
    days = sorted({d for _, d, _ in rows})
    held = {(s, d): v for s, d, v in rows}
    out = []
    for sku in {s for s, _, _ in rows}:
        open_ = None
        for d in days:
            if (sku, d) not in held:
                open_ = None
            elif open_ is not None and open_[3] == held[sku, d]:
                open_[2] = d
            else:
                open_ = [sku, d, d, held[sku, d]]
                out.append(open_)
    return sorted(((a, b, c, None if v is None else Decimal(str(v))) for a, b, c, v in out), key=repr)


def rows_of(df):
    return sorted(((r.sku, r.first, r.last, None if r.stock is None else r.stock.normalize()) for r in df.select("sku", F.col("first"), F.col("last"), "stock").collect()), key=repr)


def plain(rows):
    return sorted(((a, b, c, None if v is None else v.normalize()) for a, b, c, v in rows), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_snapshots_in_any_order(spark, tmp_path, seed):
    rows = random_history(seed)
    whole = spark.createDataFrame(rows, HISTORY)
    want = plain([(r[0], r[1], r[2], r[3]) for r in runs_by_hand(rows)])
    assert [tuple(r) for r in rows_of(stock_intervals.intervals(whole))] == want
    days = sorted({d for _, d, _ in rows})
    random.Random(seed).shuffle(days)
    root = str(tmp_path / "history")
    for i in range(0, len(days), 3):  # late days come between old ones
        part = [r for r in rows if r[1] in days[i : i + 3]]
        stock_intervals.ingest(spark.createDataFrame(part, HISTORY), root, i + 1)
    found, stored = stock_intervals.read(spark, root)
    assert rows_of(found) == want and {r.snapshot_date for r in stored.collect()} == set(days)
    back = stock_intervals.history(found, stored).select("sku", "snapshot_date", F.col("available_stock").cast("double"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    stock_intervals.ingest(spark.createDataFrame(rows[:20], HISTORY), root, 99)  # known days change nothing
    assert rows_of(stock_intervals.read(spark, root)[0]) == want


@pytest.mark.parametrize("seed", [3, 4])
def test_same_streaks_and_grids(spark, seed):
    rows = random_history(seed)
    df = spark.createDataFrame(rows, HISTORY).withColumn("model", F.substring("sku", 1, 5))
    days, found = stock_intervals.snapshot_days(df), stock_intervals.intervals(df)
    rng = random.Random(seed)
    plan = [(f"AB00{k % 3}0{k}00", DAY + timedelta(d), 2.0) for k in range(10) for d in range(45) if rng.random() < 0.7]
    forecast = spark.createDataFrame(plan, "sku string, forecast_date date, forecast double").withColumn("model", F.substring("sku", 1, 5))
    sales = spark.createDataFrame([(r[0], r[1], 3) for r in plan[::4]], "sku string, sale_date date, quantity int").withColumn("model", F.substring("sku", 1, 5))
    exact = df.withColumn("available_stock", F.col("available_stock").cast("decimal(28,6)"))
    for entity in ("sku", "model"):
        runs = stock_intervals.entity_runs(found, days, F.col("sku") if entity == "sku" else F.substring("sku", 1, 5))
        got = stock_intervals.out_of_stock_streaks(runs, days)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, inventory.out_of_stock_streaks(exact, entity).collect()), key=repr)
        span = (DAY + timedelta(6), DAY + timedelta(35))
        got = stock_intervals.daily_grid(sales, forecast, runs, days, *span, entity).collect()
        want = accuracy.daily_grid(sales, forecast, exact, *span, entity).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == set(map(tuple, want))


def test_odd_histories(spark):
    odd = [(None, DAY, 1.0), (None, DAY + timedelta(1), 1.0), ("a", None, 3.0), ("a", DAY, None), ("a", DAY + timedelta(1), None), ("b", DAY, 1.0), ("b", DAY, 4.0)]
    df = spark.createDataFrame(odd, HISTORY)
    want = [("a", DAY, DAY + timedelta(1), None), ("b", DAY, DAY, Decimal(4)), (None, DAY, DAY + timedelta(1), Decimal(1))]
    assert rows_of(stock_intervals.intervals(df)) == sorted(want, key=repr)
    none = df.where("false")
    days, found = stock_intervals.snapshot_days(none), stock_intervals.intervals(none)
    assert found.count() == 0 and stock_intervals.out_of_stock_streaks(stock_intervals.entity_runs(found, days, F.col("sku")), days).count() == 0
    again, all_days = stock_intervals.extend(stock_intervals.intervals(df), stock_intervals.snapshot_days(df), none)
    assert rows_of(again) == sorted(want, key=repr) and all_days.count() == 2
