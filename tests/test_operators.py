"""Golden values and edge cases on literal rows."""

import datetime as dt
import itertools
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from replen import queries
from replen.functions.calendar import last_whole_week, week_start, year_to_last_month
from replen.functions.change import percent_change
from replen.functions.sku import aliased, with_sku_parts
from replen.operators import accuracy, allocation, forecasting, inventory, maintenance, materials, orders, priority, reports, selection, series, stats, store
from replen.operators import least_excess, smoothing
from replen.operators.adhoc import QuerySpec, query
from replen.plans.settings import Settings
from replen.sources import files

D = dt.date
AS_OF = D(2001, 8, 15)
SALES = "order_id string, sale_date date, sku string, quantity int, unit_price double, total_amount double"


def sales_of(spark, rows):
    return with_sku_parts(spark.createDataFrame([(f"o{i}", d, sku, q, 2.0, 2.0 * q) for i, (d, sku, q) in enumerate(rows)], SALES))


def test_reorder_point_golden(spark):
    rows = spark.createDataFrame([("a", 200.0, 50.0, "regular"), ("b", 10.0, None, "basic")], "entity string, average double, sd double, type string")
    none = spark.createDataFrame([], "entity string, calendar_month int, in_season boolean")
    found = {r.entity: r for r in stats.safety_stock(rows, none, AS_OF).collect()}
    assert round(found["a"].safety_stock, 2) == 95.92 and round(found["a"].rop, 1) == 367.9
    assert found["b"].safety_stock is None and found["b"].rop is None


def test_types(spark):
    old, new = D(1999, 1, 1), D(2001, 1, 1)
    rows = [("n", new, 2.0), ("b", old, 0.5), ("s", old, 1.1), ("r", old, 0.6), ("e", old, 1.0)]
    found = stats.classify(spark.createDataFrame(rows, "entity string, first_sale date, cv double"), AS_OF).collect()
    assert {r.entity: r.type for r in found} == {"n": "new", "b": "basic", "s": "seasonal", "r": "regular", "e": "regular"}


def test_entity_stats_of_one_month(spark):
    months = stats.monthly(sales_of(spark, [(D(2001, 1, 3), "CH0010101", 5), (D(2001, 1, 30), "CH0010101", 7)]), "sku", AS_OF)
    r = stats.entity_stats(months).first()
    assert (r.n_months, r.quantity, r.sd, r.cv) == (1, 12, None, 0.0)
    assert stats.entity_stats(months.where("false")).count() == 0


def test_seasonal_index_golden(spark):
    rows = [(D(2001, m, 1), "CH0010101", q) for m, q in ((1, 180), (2, 20), (3, 100))]
    index = {r.calendar_month: r for r in stats.seasonal_index(stats.monthly(sales_of(spark, rows), "sku", AS_OF)).collect()}
    assert index[1]["index"] == pytest.approx(1.8) and index[1].in_season and not index[3].in_season


def test_priority_golden(spark):
    rows = [("CH0010101", "seasonal", 0, 25.0, 100.0, 100.0, 80), ("CH0010102", "regular", 30, 100.0, 100.0, 70.0, 100), ("CH0010103", "odd", 500, 0.0, None, 0.0, None)]
    df = spark.createDataFrame(rows, "entity string, type string, stock int, price double, rop double, deficit double, forecast int")
    found = {r.entity: r for r in priority.prioritise(df).collect()}
    assert found["CH0010101"].score == pytest.approx((100 * 0.5 + 20 * 0.3 + 80 * 0.2) * 1.3) and found["CH0010101"].urgent
    assert found["CH0010102"].risk == pytest.approx(56) and not found["CH0010102"].urgent
    assert found["CH0010103"].score == 0
    with pytest.raises(ValueError):
        priority.prioritise(df.drop("rop"))


def test_changes_and_weeks(spark):
    rows = spark.createDataFrame([(5, 0), (0, 5), (0, 0), (3, 2)], "a int, b int")
    assert [r[0] for r in rows.select(percent_change(F.col("a"), F.col("b"))).collect()] == [999, -100, 0, 50]
    assert last_whole_week(AS_OF) == (D(2001, 8, 6), D(2001, 8, 12))
    assert year_to_last_month(D(2001, 1, 5)) == ((D(2000, 1, 1), D(2000, 12, 31)), (D(1999, 1, 1), D(1999, 12, 31)))
    days = spark.createDataFrame([(D(2001, 8, d),) for d in range(6, 20)], "d date")
    for r in days.select("d", week_start(F.col("d"), 2).alias("w")).collect():
        assert r.w.weekday() == 2 and 0 <= (r.d - r.w).days < 7


def test_streaks(spark):
    rows = [("a", D(2001, 1, 1), 5), ("a", D(2001, 1, 8), 0), ("b", D(2001, 1, 1), 3), ("c", D(2001, 1, 1), 0), ("c", D(2001, 1, 8), 0), ("d", D(2001, 1, 8), 1)]
    found = inventory.out_of_stock_streaks(spark.createDataFrame(rows, "sku string, snapshot_date date, available_stock int"), "sku").collect()
    assert {r.entity: r.days_out for r in found} == {"a": 7, "b": 7, "c": 7}


def test_projection_falls(spark):
    starts = spark.createDataFrame([("a", 10, 6.0)], "entity string, stock int, rop double")
    plan = spark.createDataFrame([("a", D(2001, m, 1), 4) for m in (9, 10, 11)], "entity string, forecast_date date, forecast int")
    rows = inventory.projection(starts, plan, AS_OF).orderBy("date", "step").collect()
    assert [r.projected for r in rows] == [10, 6, 2, -2]
    c = inventory.crossings(inventory.projection(starts, plan, AS_OF), AS_OF).first()
    assert (c.rop_date, c.zero_date, c.critical) == (D(2001, 9, 1), D(2001, 11, 1), False)  # stock at the reorder point has reached it


def test_projection_ends_on_the_same_day_of_the_month(spark):
    starts = spark.createDataFrame([("a", 10, 6.0)], "entity string, stock int, rop double")
    days = [D(2001, 1, 31), D(2001, 2, 27), D(2001, 2, 28), D(2001, 3, 1), D(2001, 3, 29), D(2001, 3, 31), D(2001, 4, 1)]
    plan = spark.createDataFrame([("a", d, 1) for d in days], "entity string, forecast_date date, forecast int")
    until = lambda n: sorted(r.date for r in inventory.projection(starts, plan, D(2001, 1, 31), n).where("step = 1").collect())
    assert until(1) == days[:3] and until(2) == days[:6]


def test_impact_without_prices(spark):
    rows = [("a", "regular", 0, 0.0, 9.0, 9.0, 10), ("b", "regular", 0, 0.0, 9.0, 9.0, 40)]
    df = spark.createDataFrame(rows, "entity string, type string, stock int, price double, rop double, deficit double, forecast int")
    assert {r.impact for r in priority.prioritise(df).collect()} == {0}
    assert {r.entity: r.impact for r in priority.prioritise(df.drop("price")).collect()} == {"a": 25, "b": 100}


def test_method_of_an_entity(spark):
    rows = [("new", 0.1, 40, "moving_avg"), ("basic", None, 11, "moving_avg"), ("basic", None, 40, "exp_smoothing"), ("regular", None, 40, "holt_winters"), ("seasonal", None, 40, "holt_winters"),
            (None, None, 40, "exp_smoothing"), ("regular", None, 20, "exp_smoothing"), ("basic", 0.6, 24, "holt_winters"), ("regular", 0.59, 40, "exp_smoothing")]
    df = spark.createDataFrame(rows, "type string, cv double, n int, want string").withColumn("got", forecasting.choose_method(F.col("type"), F.col("cv"), F.col("n")))
    assert df.where("got <> want or got is null").count() == 0


def test_detail_adds_up_to_summary(spark):
    rows = [(D(2001, 3, i + 1), f"CH00{i % 3}0{i % 2}01", i + 1) for i in range(12)] + [(D(2000, 3, 1), "CH0010101", 4)]
    category = spark.createDataFrame([("CH001", "P1", "K1"), ("CH002", "P1", "K2")], "model string, podgrupa string, kategoria string")
    out = reports.yoy_by_category(sales_of(spark, rows), category, AS_OF).collect()
    assert sum(r.current for r in out if r.level == 0) == sum(range(1, 13))
    assert sum(r.current for r in out if r.level == 0 and r.podgrupa) == sum(r.current for r in out if r.level == 1)


def test_features_do_not_leak(spark):
    months = spark.createDataFrame([("a", D(2000 + i // 12, i % 12 + 1, 1), i * i) for i in range(20)], "entity string, month date, quantity int")
    before = series.features(months).where("month = date '2001-06-01'").first()
    changed = months.withColumn("quantity", F.when(F.col("month") >= "2001-06-01", 10_000).otherwise(F.col("quantity")))
    after = series.features(changed).where("month = date '2001-06-01'").first()
    drop = ("quantity",)
    assert {k: v for k, v in before.asDict().items() if k not in drop} == {k: v for k, v in after.asDict().items() if k not in drop}
    assert series.filled(months.where("quantity not in (4, 9)")).count() == 20


def brute_smoothing(y, a, b):
    level, trend, sse = y[0], y[1] - y[0], 0.0
    for x in y[1:]:
        guess = level + trend
        sse += (x - guess) ** 2
        new = a * x + (1 - a) * guess
        level, trend = new, b * (new - level) + (1 - b) * trend
    return level, trend, sse


def test_smoothing_by_brute_force(spark):
    y = [float((7 * i * i + 3 * i) % 31) for i in range(30)]
    months = spark.createDataFrame([("a", D(1999 + i // 12, i % 12 + 1, 1), v) for i, v in enumerate(y)], "entity string, month date, quantity double")
    arrays = forecasting.as_arrays(months)
    (r,) = smoothing.fitted(arrays, es=F.lit(True)).select("es.*").collect()
    best = brute_smoothing(y, r.alpha, r.beta)
    assert (r.level, r.trend, r.sse) == pytest.approx(best) and r.sse <= min(brute_smoothing(y, a / 100, b / 100)[2] for a in range(1, 100, 2) for b in range(0, 101, 2)) * 1.01
    stated = arrays.select(forecasting.smoothing_fit(F.col("y"), 0.3, 0.1).alias("f")).select("f.*").first()
    assert tuple(stated) == pytest.approx(brute_smoothing(y, 0.3, 0.1))
    rows = forecasting.exponential_smoothing(arrays, 3).orderBy("month").collect()
    assert [r.forecast for r in rows] == pytest.approx([max(0, best[0] + k * best[1]) for k in (1, 2, 3)])
    season = [50 + 10 * (i % 12) for i in range(36)]
    seasonal = spark.createDataFrame([("s", D(1999 + i // 12, i % 12 + 1, 1), v) for i, v in enumerate(season)], "entity string, month date, quantity int")
    rows = forecasting.holt_winters(forecasting.as_arrays(seasonal), 12).orderBy("month").collect()
    assert [r.forecast for r in rows] == pytest.approx(season[:12], abs=1.0)


def test_pooled_model(spark):
    months = spark.createDataFrame([(e, D(1998 + i // 12, i % 12 + 1, 1), 20 + 5 * (i % 12) + k) for k, e in enumerate("ab") for i in range(40)], "entity string, month date, quantity int")
    types = spark.createDataFrame([("a", "basic", 0.2)], "entity string, type string, cv double")
    name, model, scores = forecasting.train_pooled(series.training_matrix(months, types), D(2001, 1, 1), ["ridge", "random_forest"])
    assert name in scores and len(forecasting.importance(model)) == 15
    out = forecasting.predict_pooled(model, series.future_matrix(months, types, 3), 1.0).collect()
    assert len(out) == 6 and all(r.forecast >= 0 for r in out)


def test_pooled_model_is_whole(spark):
    noise = [0, 7, -4, 9, -8, 3, -6]
    rows = [(e, D(1998 + i // 12, i % 12 + 1, 1), 50 + 5 * (i % 12) + (3 * noise[i % 7] if e == "b" else 0)) for e in "ab" for i in range(40)]
    months = spark.createDataFrame(rows, "entity string, month date, quantity int")
    types = spark.createDataFrame([("a", "basic", 0.2)], "entity string, type string, cv double")
    matrix, cut = series.training_matrix(months, types), D(2001, 1, 1)
    assert forecasting.fit_pooled(matrix, cut)[2].keys() == {"gbt", "random_forest", "ridge", "lasso"}
    _, model, _, residuals = forecasting.fit_pooled(matrix, cut, ["ridge"])
    every = forecasting.assembled(matrix)
    want = forecasting.candidates(every.count())["ridge"].fit(every)
    assert model.coefficients.toArray() == pytest.approx(want.coefficients.toArray(), rel=1e-4, abs=1e-4)
    kept = forecasting.candidates(every.where(F.col("month") < cut).count())["ridge"].fit(every.where(F.col("month") < cut))
    off = {}
    for r in kept.transform(every.where(F.col("month") >= cut)).collect():
        off.setdefault(r.entity, []).append(r.quantity - max(0.0, r.prediction))
    rms = lambda x: (sum(v * v for v in x) / len(x)) ** 0.5
    sds = {r.entity: r.residual_sd for r in forecasting.residual_sds(residuals).collect()}
    assert sds == pytest.approx({"a": rms(off["a"]), "b": rms(off["b"]), None: rms(off["a"] + off["b"])}, rel=1e-3)
    few = forecasting.residual_sds(residuals.where("entity = 'a'"))
    out = forecasting.predict_pooled(model, series.future_matrix(months, types, 3), few).collect()
    assert len(out) == 6 and all(r.upper - r.forecast == pytest.approx(1.96 * sds["a"], rel=1e-3) for r in out)


def test_pooled_query_has_intervals_of_its_errors(spark):
    rows = queries.QUERIES["pooled_ml_forecast"](spark, "/root/testdata/sf0.001").collect()
    assert len({round(r.upper - r.forecast, 3) for r in rows}) > 1


def test_version_as_of(spark):
    rows = spark.createDataFrame([(D(2001, 1, d), d) for d in (1, 5, 9)], "generated_date date, forecast int")
    assert {r.forecast for r in inventory.version_as_of(rows, D(2001, 1, 7)).collect()} == {5}
    assert inventory.version_as_of(rows, D(2001, 3, 1)).count() == 0


def test_upserts_are_idempotent(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    once = maintenance.upsert(target, rows, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, maintenance.upsert(once, rows, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    twice = rows.union(rows)
    assert [tuple(r) for r in maintenance.insert_ignore(target, twice, ["k"]).collect()] == [(3, "c")]
    with pytest.raises(ValueError):
        maintenance.assert_unique(twice, ["k"])


def test_materials(spark):
    orders = spark.createDataFrame([(" ch001", 10), ("CH001", 5), ("", 3), ("CH002", 0)], "model string, total_quantity int")
    bom = spark.createDataFrame([("CH001", "wool", 1.5, 0.0, "2x1", 0.1, 0.0)], "model string, main_material_name string, main_m double, main_kg double, ribbing_type string, ribbing_m double, lining_m double")
    need = {r.material: r for r in materials.requirements(materials.explode_bom(materials.production_quantities(orders), bom)).collect()}
    assert need["wool"].meters == 22.5 and need["ribbing 2x1"].meters == pytest.approx(1.5) and len(need) == 2
    text = spark.createDataFrame([("min 10 i maks 60, parzyste",), ("n/d",), (None,)], "t string").select(materials.parse_constraint(F.col("t")).alias("c")).collect()
    assert tuple(text[0].c) == (10, 60, True) and text[1].c is None and text[2].c is None


def test_allocation_covers_demand(spark):
    demand = spark.createDataFrame([("CH001", c, f"0{s}", q) for c in ("01", "02") for s, q in ((1, 7), (2, 12), (3, 0), (4, 9))], "model string, color string, size string, quantity int")
    patterns = spark.createDataFrame([(i, f"0{s}", 1) for i in (1, 2, 3) for s in (i, i + 1)], "pattern_id int, size string, count int")
    uses = allocation.allocate(demand, patterns, 5)
    made = allocation.produced(uses, patterns, demand)
    assert made.where("not covered").count() == 0 and allocation.violations(uses, 5).count() == 0
    assert allocation.parity(uses).where("uses % 2 = 1").count() == 0
    bounded = allocation.material_bounds(uses, 30, 40).groupBy("model", "pattern_id").agg(F.sum("uses").alias("n")).where("n > 0").collect()
    assert all(30 <= r.n <= 40 for r in bounded)


def test_color_cap_keeps_total(spark):
    rows = [("m", "01", 50, 60, 40), ("m", "02", 10, 80, 10), ("m", "03", 5, 5, 9), ("m", "04", 0, 30, 0)]
    found = {r.color: r for r in allocation.cap_colors(spark.createDataFrame(rows, "model string, color string, quantity int, sales_12m int, stock int")).collect()}
    assert "03" not in found and all(r.capped <= r.cap for r in found.values())
    assert sum(r.capped for r in found.values()) == 65


def test_aliases(spark):
    rows = spark.createDataFrame([("01",), ("06",)], "size string")
    dim = spark.createDataFrame([("01", "XS")], "code string, alias string")
    assert {tuple(r) for r in aliased(rows, dim, "size", "name").collect()} == {("01", "XS"), ("06", "06")}


def test_query_spec(spark):
    sales = sales_of(spark, [(D(2001, 7, 1), "CH0010101", 5), (D(1999, 7, 1), "CH0020101", 50)])
    out = query(QuerySpec("sales", group_by="model", last=(6, "months"), as_of=AS_OF), {"sales": sales}).collect()
    assert [tuple(r) for r in out] == [("CH001", 5)]
    assert query(QuerySpec("sales", where=(("quantity", ">", 10.0),), as_of=AS_OF), {"sales": sales}).count() == 1


def test_settings_digest():
    assert Settings().digest() == Settings().digest() != Settings(lead_time=2.0).digest()


def test_comparison_with_nothing_sold(spark):
    own = spark.createDataFrame([("a", D(2001, 1, 1), 5.0, "x"), ("b", D(2001, 1, 1), 5.0, "x")], "entity string, month date, forecast double, method string")
    real = spark.createDataFrame([("a", D(2001, 1, 1), 4)], "entity string, month date, quantity int")
    out = accuracy.compare(accuracy.align(own, own.withColumn("forecast", F.lit(8)), real)).collect()
    assert [(r.entity, r.winner, r.improvement) for r in out] == [("a", "internal", 75.0)]


def test_files(spark, tmp_path):
    for name, order in (("20200101-20201231.csv", "o1"), ("20200101-20200630.csv", "o2"), ("20210101_20210401.csv", "o3")):
        (tmp_path / name).write_text(f"order_id,sale_date,sku,quantity,unit_price,total_amount\n{order},2020-02-03,CH0010101,2,1.5,3.0\n,,,,,\n")
    rows = files.sales(spark, str(tmp_path))
    assert {r.order_id for r in files.best_file_per_year(rows).collect()} == {"o1", "o3"}
    assert {r.order_id for r in files.current_year_file(rows, D(2021, 5, 1)).collect()} == {"o3"}
    raw = spark.createDataFrame([("ch001 ", "1,5", "Tak", "-"), ("CH001", "x", "no", "wool")], "model string, m string, out string, name string")
    bom = files.normalised_bom(raw, ["m"], ["name"], ["out"]).collect()
    assert len(bom) == 1 and bom[0].model == "CH001"


def test_pattern_sets(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"id": 1, "name": "n", "size_names": ["S"], "min_order_per_pattern": 5, "patterns": [{"id": 2, "name": "p", "sizes": {"S": 1, "M": 2}}]}]')
    assert {(r.set_id, r.pattern_id, r["size"], r["count"]) for r in files.pattern_sizes(spark, str(tmp_path)).collect()} == {(1, 2, "S", 1), (1, 2, "M", 2)}


def test_selection(spark):
    rows = spark.createDataFrame([("CH0010101",), ("CH0010201",), ("DO0010101",), (None,)], "sku string")
    out = spark.createDataFrame([("CH0010199",), (None,)], "sku string")
    left = lambda level: {r.sku for r in selection.without(rows, out, level).collect()}
    assert left("model_color") == {"CH0010201", "DO0010101", None} and left("model") == {"DO0010101", None} and len(left("sku")) == 4
    stock = spark.createDataFrame([("CH0010101", "n", True), ("DO0010101", None, False)], "sku string, product_name string, is_active boolean")
    assert selection.active_only(rows, stock).count() == 1
    view = [tuple(r) for r in selection.exclusion_view(stock, out.where("sku is not null")).collect()]
    assert view[0] == ("CH0010199", None, True) and len(view) == 3
    assert [r.sku for r in selection.exclusion_list(rows.union(rows)).collect()] == ["CH0010101", "CH0010201", "DO0010101"]
    assert selection.with_defaults(rows, stock=0, sku="x").columns == ["sku", "stock"]


def test_orders(spark):
    t = dt.datetime
    rows = spark.createDataFrame([("1", D(2001, 1, 1), "active", t(2001, 1, 1), None), ("2", D(2001, 1, 2), "active", t(2001, 1, 1), None)], "order_id string, order_date date, status string, updated_at timestamp, archived_at timestamp")
    assert [r.order_id for r in orders.active_orders(rows).collect()] == ["2", "1"]
    done = orders.archive(rows, rows.where("order_id = '2'"), t(2001, 2, 1))
    assert [r.order_id for r in orders.archived_orders(done).collect()] == ["2"] and orders.active_orders(done).count() == 1
    times = spark.createDataFrame([(t(2001, 1, 1), t(2001, 1, 3, 5)), (t(2001, 1, 1), t(2001, 1, 1, 5)), (t(2001, 1, 1), t(2001, 1, 1, 0, 5)), (t(2001, 1, 2), t(2001, 1, 1)), (None, None)], "a timestamp, b timestamp")
    assert [r[0] for r in times.select(orders.processing_time(F.col("a"), F.col("b"))).collect()] == ["2d", "5h", "<1h", "", ""]
    uses = spark.createDataFrame([("m", 2, 3), ("m", 1, 4), ("m", 3, 0)], "model string, p int, n int")
    assert orders.pairs_text(uses, ["model"], "p", "n", "t").first().t == "1:4, 2:3"
    made = spark.createDataFrame([("m", "01", 3, 4), ("m", "02", 5, 5)], "model string, size string, required int, produced int")
    assert {(r["size"], r.excess) for r in orders.required_and_produced(made, ["02"]).collect()} == {("01", 1), ("02", 0), ("TOTAL", 1)}


def test_order_table(spark):
    scored = spark.createDataFrame([("CH0010101", 5.0, 2.5, 4), ("CH0010102", 7.0, 0.0, 1)], "entity string, score double, deficit double, forecast int")
    items = orders.color_items(scored)
    assert items.first().sizes == {"01": 4, "02": 1}
    months = spark.createDataFrame([("CH0010101", D(2001, 7, 1), 9)], "entity string, month date, quantity int")
    row = orders.order_table(items.drop("sizes"), months, [D(2001, 6, 1), D(2001, 7, 1)]).first().asDict()
    assert (row["06-2001"], row["07-2001"]) == (0, 9)


def test_store(spark, tmp_path):
    root = str(tmp_path)
    made = spark.createDataFrame([("a", D(2001, 9, 1), 5.0, "x")], "entity string, month date, forecast double, method string")
    for name, day in (("b1", D(2001, 8, 1)), ("b2", D(2001, 9, 1))):
        store.save_batch(made, root, name, day, "model", 3)
    assert [r.batch_id for r in store.list_batches(spark, root).collect()] == ["b2", "b1"]
    assert store.load_batch(spark, root, "b1").count() == 1 and store.covered_months(D(2001, 8, 15), 3) == (D(2001, 8, 1), D(2001, 10, 1))
    real = spark.createDataFrame([("a", D(2001, 9, 1), 4)], "entity string, month date, quantity int")
    assert store.rescore(store.load_batch(spark, root, "b1"), made.drop("method"), real, D(2001, 10, 1)).first().winner == "tie"


def test_constraints_in_order(spark):
    demand = spark.createDataFrame([("CH001", c, f"0{s}", 10) for c in ("01", "02") for s in (1, 2)], "model string, color string, size string, quantity int")
    patterns = spark.createDataFrame([(1, "01", 1), (1, "02", 1)], "pattern_id int, size string, count int")
    colors = spark.createDataFrame([("CH001", "01", 20, 30, 0), ("CH001", "02", 20, 5, 9)], "model string, color string, quantity int, sales_12m int, stock int")
    uses = {r.color: r.uses for r in allocation.constrain(demand, patterns, colors=colors, even=True).collect()}
    assert uses == {"01": 16}
    totals = spark.createDataFrame([("CH001", 40)], "model string, total int")
    sold = spark.createDataFrame([("CH001", "01", 3), ("CH001", "02", 1)], "model string, color string, quantity int")
    sizes = spark.createDataFrame([("CH001", "01", 1), ("CH001", "02", 1)], "model string, size string, quantity int")
    uses = {r.color: r.uses for r in allocation.constrain(demand, patterns, children=(totals, sold, sizes)).collect()}
    assert uses == {"01": 15, "02": 5}


def test_cover_modes_by_brute_force():
    r = np.random.RandomState(7)
    for _ in range(60):
        sizes = [str(s) for s in range(4)]
        patterns = {p: {s: int(r.randint(1, 3)) for s in r.choice(sizes, r.randint(1, 3), replace=False)} for p in range(3)}
        demand = {s: int(r.randint(0, 7)) for s in sizes}
        least = int(r.randint(1, 4))
        met = {s for n in patterns.values() for s in n}

        def excess(uses):
            made = {s: sum(n.get(s, 0) * uses[p] for p, n in patterns.items()) for s in sizes}
            return None if any(made[s] < demand[s] for s in met) else sum(max(0, made[s] - demand[s]) for s in met)

        allowed = [0, *range(least, 10)]
        best = min(e for u in itertools.product(allowed, repeat=3) if (e := excess(dict(enumerate(u)))) is not None)
        found = {m: allocation.cover(demand, patterns, least, m) for m in ("classic", "overshoot", "search", "least")}
        got = {m: excess(u) for m, u in found.items()}
        assert all(e is not None and e >= best for e in got.values()) and got["search"] <= min(got["classic"], got["overshoot"]) and got["least"] == best
        assert all(n == 0 or n >= least for u in found.values() for n in u.values())
    for mode, excess in (("search", 3), ("least", 0)):
        big = allocation.cover({"0": 100_000, "1": 7}, {0: {"0": 1, "1": 1}, 1: {"0": 3}}, 5, mode)
        assert big[0] >= 7 and 0 <= big[0] + 3 * big[1] - 100_000 <= excess


def test_least_excess_in_all_forms(spark, monkeypatch):
    r = np.random.RandomState(3)
    sets = [{p: {str(s): int(r.randint(1, 4)) for s in r.choice(5, r.randint(1, 5), replace=False)} for p in range(5)} for _ in range(4)]
    demands = [{str(s): int(r.randint(0, 90)) for s in range(6)} for _ in range(6)]
    solve = lambda: [[least_excess.Cover(p, 5).least_excess(d) for d in demands] for p in sets]
    whole = solve()
    monkeypatch.setattr(least_excess, "MOST_SYSTEMS", 0)  # greedy corners
    monkeypatch.setattr(least_excess, "MOST_STATES", 3)
    assert solve() == whole
    for p, found in zip(sets, whole):
        for d, u in zip(demands, found):
            assert allocation._excess(u, d, p) <= allocation._excess(allocation.cover(d, p, 5, "search"), d, p)
    # equal demands of many model-colors, sizes and quantities that are missing, a size that no pattern has
    rows = [(f"m{i}", c, s, q) for i in range(40) for c in ("01", "02") for s, q in demands[i % 2].items()]
    rows += [("none", "01", "9", 4), ("none", "01", None, 4), ("none", "01", "0", None), (None, None, "0", 7)]
    table = spark.createDataFrame([(p, s, n) for p, sizes in sets[0].items() for s, n in sizes.items()], "pattern_id int, size string, count int")
    demand = spark.createDataFrame(rows, "model string, color string, size string, quantity int")
    for mode in ("least", "search"):
        got = {}
        for x in allocation.allocate(demand, table, 5, mode).collect():
            got.setdefault((x.model, x.color), {})[x.pattern_id] = x.uses
        want = [allocation.cover(d, sets[0], 5, mode) for d in demands[:2]]
        assert len(got) == 82 and all(got[f"m{i}", c] == want[i % 2] for i in range(40) for c in ("01", "02"))
        assert got["none", "01"] == dict.fromkeys(sets[0], 0) and got[None, None] == allocation.cover({"0": 7}, sets[0], 5, mode)
    assert allocation.allocate(demand.where("false"), table).count() == 0 and allocation.allocate(demand, table.where("false")).count() == 0


def test_stores_delete(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("a", date(2001, 1, 1), 1.0)], "entity string, month date, forecast double")
    for b in ("x", "y"):
        store.save_batch(rows, root, b, date(2001, 1, 1), "model", 3)
    assert store.delete_batch(spark, root, "x") and not store.delete_batch(spark, root, "x")
    assert [r.batch_id for r in store.list_batches(spark, root).collect()] == ["y"] and store.load_batch(spark, root, "y").count() == 1


def test_one_entity_type_is_rebuilt(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = lambda k, n: spark.range(n).select(F.lit(k).alias("entity_type"), F.col("id").alias("entity_id"))
    maintenance.rebuild_entity_type(rows("sku", 3).unionByName(rows("model", 2)), path)
    maintenance.rebuild_entity_type(rows("model", 5), path)
    assert {r.entity_type: r["count"] for r in spark.read.parquet(path).groupBy("entity_type").count().collect()} == {"sku": 3, "model": 5}


def test_upsert_of_repeated_keys(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, v int")
    out = maintenance.upsert(spark.createDataFrame([("a", 9), ("c", 4)], "k string, v int"), rows, ["k"])
    assert sorted((r.k, r.v) for r in out.collect()) == [("a", 1), ("b", 3), ("c", 4)]
    with pytest.raises(ValueError):
        maintenance.refresh({}, {}, "stock")


def test_details(spark):
    rows = spark.createDataFrame([("ab", 2.0), ("ac", None), ("b", 1.0)], "entity string, mape double")
    assert [r.entity for r in accuracy.details(rows, by="mape").collect()] == ["b", "ab", "ac"]
    assert [r.entity for r in accuracy.details(rows, search="A", by="mape", descending=True).collect()] == ["ab", "ac"]
    assert [r.entity for r in accuracy.details(rows, entity="b").collect()] == ["b"]


def test_exclusions_and_orders_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "sku string")
    files.save_exclusions(rows, str(tmp_path / "x"))
    assert [r.sku for r in files.load_exclusions(spark, str(tmp_path / "x")).collect()] == ["a", "b"]
    files.write_orders(spark.createDataFrame([("1", date(2001, 1, 2), 5), ("2", date(2001, 1, 3), 6)], "order_id string, order_date date, n int"), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).where("order_date = '2001-01-03'").first().n == 6
