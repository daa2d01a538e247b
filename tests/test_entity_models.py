"""Models of each entity against direct fits, on folds that leak nothing, and the coverage of their bands."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from replen.operators import entity_models as em
from replen.operators import forecasting
from replen.operators.forecasting import FEATURES
from replen.operators.series import filled, training_matrix


def month(i):
    return date(1990 + i // 12, i % 12 + 1, 1)


@pytest.fixture(scope="module")
def months(spark):
    r = np.random.RandomState(1)
    rows = []
    for e in range(50):
        n, level, season = int(r.choice([14, 26, 30, 48, 60])), r.uniform(2, 400), r.uniform(0, 0.8)
        for i in range(n):
            q = max(0, int(level * (1 + season * np.sin(i * np.pi / 6)) * (1 + 0.3 * r.randn()) + 0.1 * i))
            if r.rand() > 0.05 or i in (0, n - 1):
                rows.append((f"m{e}", month(60 - n + i), q))
    rows += [("gone", month(i), 0) for i in range(40)]
    return spark.createDataFrame(rows, "entity string, month date, quantity long").cache()


@pytest.fixture(scope="module")
def types(months):
    return months.select("entity").distinct().select("entity", F.lit("regular").alias("type"), F.lit(0.5).alias("cv"))


def ridge(x, y, alpha=1.0):
    centred = x - x.mean(0)
    beta = np.linalg.lstsq(np.r_[centred, np.sqrt(alpha) * np.eye(x.shape[1])], np.r_[y - y.mean(), np.zeros(x.shape[1])], rcond=None)[0]
    return np.r_[y.mean() - x.mean(0) @ beta, beta]


def lasso(x, y, alpha=0.1, sweeps=1000):
    """Coordinate descent on the residuals of one entity, as many sweeps as the candidate is allowed."""
    centred, rest, beta = x - x.mean(0), y - y.mean(), np.zeros(x.shape[1])
    square = (centred**2).sum(0)
    for _ in range(sweeps):
        for j in np.flatnonzero(square > 1e-9):
            rest = rest + centred[:, j] * beta[j]
            at = centred[:, j] @ rest
            beta[j] = np.sign(at) * max(0, abs(at) - alpha * len(y)) / square[j]
            rest = rest - centred[:, j] * beta[j]
    return np.r_[y.mean() - x.mean(0) @ beta, beta]


def test_linear_candidates_equal_direct_fits(months, types):
    rows = em.with_folds(training_matrix(months, types))
    found = {(c.entity, c.fold, c.method): np.array(c.coefficients) for c in em.coefficients(em.gram_sums(rows)).collect()}
    data = rows.select("entity", "fold", *FEATURES, F.col("quantity").cast("double").alias("quantity")).toPandas()
    checked = lassos = 0
    for entity, own in data.groupby("entity"):
        for fold in [*own["fold"].dropna().unique(), None]:
            train = own if fold is None else own[~(own["fold"] >= fold)]
            x, y = train[FEATURES].astype(float).to_numpy(), train["quantity"].to_numpy()
            fold = None if fold is None else int(fold)
            assert x @ found[entity, fold, "ridge"][1:] + found[entity, fold, "ridge"][0] == pytest.approx(x @ ridge(x, y)[1:] + ridge(x, y)[0], rel=1e-5, abs=1e-3)
            if fold is None and checked % 4 == 0:
                want = lasso(x, y)
                assert x @ found[entity, fold, "lasso"][1:] + found[entity, fold, "lasso"][0] == pytest.approx(x @ want[1:] + want[0], abs=2e-3 * (1 + y.std()))
                lassos += 1
            checked += 1
    assert checked > 110 and lassos > 5


@pytest.mark.parametrize("times", [1, 10**4, 10**6])
def test_ridge_is_solved_whatever_the_scale_of_quantities(months, types, times):
    """mean_3 depends on three lags, and the last digits of large sums exceed the penalty; entities of a year of rows have fewer of them than features."""
    large = months.where("entity < 'm3'").withColumn("quantity", F.col("quantity") * times)
    rows = em.with_folds(training_matrix(large, types))
    found = {(c.entity, c.fold): np.array(c.coefficients) for c in em.coefficients(em.gram_sums(rows)).where("method = 'ridge'").collect()}
    data = rows.select("entity", "fold", *FEATURES, F.col("quantity").cast("double").alias("quantity")).toPandas()
    least = len(data)
    for (entity, fold), coefs in found.items():
        own = data[data["entity"] == entity]
        train, tested = (own, own) if fold is None else (own[~(own["fold"] >= fold)], own[own["fold"] == fold])
        want, x = ridge(train[FEATURES].astype(float).to_numpy(), train["quantity"].to_numpy()), tested[FEATURES].astype(float).to_numpy()
        assert np.abs(x @ coefs[1:] + coefs[0] - x @ want[1:] - want[0]).max() <= 1e-5 * (train["quantity"].mean() + np.abs(x @ want[1:] + want[0]).max())
        least = min(least, len(train))
    assert len(found) > 40 and least < len(FEATURES)


def test_lasso_settles_beside_constant_features(months, types):
    """The square of a constant feature (an entity's cv) is noise of either sign around its mean; a root of it must not pass for settled."""
    few = months.where("entity < 'm2'")
    rows = em.with_folds(training_matrix(few, types.withColumn("cv", 0.3 + F.pmod(F.hash("entity"), F.lit(97)) / 7)))
    found = {(c.entity, c.fold): np.array(c.coefficients) for c in em.coefficients(em.gram_sums(rows)).where("method = 'lasso'").collect()}
    data = rows.select("entity", "fold", *FEATURES, F.col("quantity").cast("double").alias("quantity")).toPandas()
    for (entity, fold), coefs in found.items():
        own = data[data["entity"] == entity]
        train = own if fold is None else own[~(own["fold"] >= fold)]
        x, y = train[FEATURES].astype(float).to_numpy(), train["quantity"].to_numpy()
        want = lasso(x, y)
        assert x @ coefs[1:] + coefs[0] == pytest.approx(x @ want[1:] + want[0], abs=2e-3 * (1 + y.std()))
    assert len(found) > 20


def test_sums_of_disjoint_rows_are_added(months, types):
    rows = em.with_folds(training_matrix(months, types))
    late = F.col("month") >= F.lit(month(50))
    whole = {(g.entity, g.fold): np.array(g.gram) for g in em.gram_sums(rows).collect()}
    parts = {(g.entity, g.fold): np.array(g.gram) for g in em.merged(em.gram_sums(rows.where(~late)), em.gram_sums(rows.where(late))).collect()}
    assert whole.keys() == parts.keys() and all(np.allclose(whole[k], parts[k], rtol=1e-12) for k in whole)


def test_all_candidates_in_one_table_without_leaks(spark, months, types):
    """What is said about a month does not depend on its quantity, nor on any later one; folds are the entity's last months."""
    last = months.groupBy("entity").agg(F.max("month").alias("last"))
    poisoned = months.join(last, "entity").withColumn("quantity", F.when((F.col("month") == F.col("last")) & (F.col("entity") != "gone"), 10**6).otherwise(F.col("quantity"))).drop("last")
    one, other = em.out_of_fold(months, types).collect(), em.out_of_fold(poisoned, types, candidates=(*em.LINEAR, *em.METHODS)).collect()
    said = {(r.entity, r.fold, r.month, r.method): r.forecast for r in one}
    assert len(said) == len(one) and {k[3] for k in said} == {*em.LINEAR, *em.TREES, *em.METHODS}
    assert len(other) > 1000
    for r in other:  # trees depend on how rows lie in partitions, so it is the rows they see that are compared below
        assert r.forecast == pytest.approx(said[r.entity, r.fold, r.month, r.method], rel=1e-6, abs=1e-6)
    for fold in range(3):
        seen = [em.rows_before(em.with_folds(training_matrix(m, types)), fold).where("n >= 15").drop("n") for m in (months, poisoned)]
        assert not seen[0].exceptAll(seen[1]).count() and not seen[1].exceptAll(seen[0]).count()
        tested = {(r.entity, r.month) for r in one if r.fold == fold and r.method == "ridge"}
        assert tested and not tested & {(r.entity, r.month) for r in seen[0].select("entity", "month").collect()}
    steps = {(r.entity, r.fold, r.method): set() for r in one}
    for r in one:
        steps[r.entity, r.fold, r.method].add(r.step)
        assert r.month == month(59 - 3 * (2 - r.fold) - (3 - r.step)) or r.entity == "gone"
    assert set(map(frozenset, steps.values())) == {frozenset({1, 2, 3})}


def test_choice_and_forecasts(months, types):
    forecasts, summary, scores = em.train_and_forecast(months, types, 5, metric="mae")
    by = {}
    for s in scores.collect():
        by.setdefault(s.entity, []).append((s.score, s.method))
        assert 1 <= s.n_folds <= 3 and s.deviation >= 0
    rows = forecasts.collect()
    assert {(r.entity, r.method, r.score) for r in rows} == {(e, min(x)[1], min(x)[0]) for e, x in by.items()}
    assert len(rows) == 5 * len(by) and all(r.forecast >= 0 and 0 <= r.lower <= r.upper for r in rows)
    assert {r.month for r in rows if r.entity != "gone"} == {month(60 + i) for i in range(5)}
    counts = {r.method: r.n_entities for r in summary.collect()}
    assert sum(counts.values()) == 51 and len([m for m in counts if m != "failed"]) > 1
    mape = em.model_scores(em.out_of_fold(months, types, candidates=("moving_avg",)))
    assert mape.where("entity = 'gone' and score = double('infinity')").count() == 1
    best = em.best_models(mape)
    assert best.where("entity = 'gone'").count() == 0 and "failed" in {r.method for r in em.training_summary(months, best).collect()}


def test_bands_cover_held_out_months(spark):
    r = np.random.RandomState(7)
    level = np.exp(r.uniform(1, 6, 400))
    rows = [(f"e{e}", month(i), float(max(0, level[e] * (1 + 0.4 * r.standard_gamma(1) - 0.4)))) for e in range(400) for i in range(39)]
    months = spark.createDataFrame(rows, "entity string, month date, quantity double").cache()
    past = months.where(F.col("month") < F.lit(month(36)))
    known = forecasting.fold_forecasts(filled(past, 12), methods=("moving_avg", "exp_smoothing"))
    scale = em.levels(past)
    banded = em.bands(em.residual_sketches(known, scale), 0.9)
    made = forecasting.moving_average(forecasting.as_arrays(filled(past, 12)), 3)
    made = made.select("entity", "month", (F.months_between("month", F.lit(month(35)))).cast("int").alias("step"), "method", "forecast")
    out = em.with_bands(made, scale, banded).join(months, ["entity", "month"])
    inside = out.agg(F.avg(F.col("quantity").between(F.col("lower"), F.col("upper")).cast("int"))).first()[0]
    assert out.count() == 1200 and abs(inside - 0.9) <= 0.03
    few = em.bands(em.residual_sketches(known.where("entity in ('e1', 'e2', 'e3')"), scale), 0.9)
    assert few.groupBy("method", "step").agg(F.count_distinct("low").alias("n")).where("n > 1").count() == 0  # too few of a class: all take the step's
    unseen = em.with_bands(made.limit(1).withColumn("step", F.lit(9)), scale.withColumn("class", F.lit(99)), banded)
    assert unseen.where("lower is not null and upper > forecast").count() == 1


def test_months_and_types_are_computed_once(spark, months, types):
    """Whatever months and types come from is read once, by the folds as by the forecasts."""
    seen = {}

    def counting(df, name):
        rows = df.coalesce(2)
        seen[name] = (spark.sparkContext.accumulator(0), df.count())

        def run(batches):
            for pdf in batches:
                seen[name][0].add(len(pdf))
                yield pdf

        return rows.mapInPandas(run, df.schema)

    named = ("ridge", "moving_avg")
    assert em.model_scores(em.out_of_fold(counting(months, "m"), counting(types, "t"), candidates=named)).count() > 50
    assert em.train_and_forecast(counting(months, "m2"), counting(types, "t2"), 2, metric="mae", candidates=named)[0].count() > 50
    assert {k: n.value for k, (n, _) in seen.items()} == {k: rows for k, (_, rows) in seen.items()}


def test_trees_are_fitted_alike_whatever_the_shuffle_partitions(spark):
    """Each pass of a fit costs a task a partition, so partitions follow the rows; forests draw their samples by partition."""
    values = [(f"e{k % 5}", date(2019 + k // 60, 1 + k // 5 % 12, 1), float(k * 37 % 101), *[float((k * (3 + i)) % 17) for i in range(len(em.FEATURES))]) for k in range(300)]
    rows = spark.createDataFrame(values, ["entity", "month", "quantity", *em.FEATURES])
    found = []
    for n in (3, 40):
        made = forecasting.dealt(forecasting.assembled(rows.repartition(n, "month")))
        assert made.rdd.getNumPartitions() == 1 and made.count() == 300
        models = em.fitted_trees(rows.repartition(n, "month"), ("random_forest",))
        found.append(models["random_forest"].featureImportances.toArray().tolist())
    assert found[0] == found[1]


def test_kept_tables_follow_their_rows_and_bring_no_plan(spark, months):
    """Caches over caches are described whole after every stage, and have a task for each shuffle partition."""
    rows = months.repartition(40, "entity").groupBy("entity").agg(F.sum("quantity").alias("quantity"))
    out = em.kept(rows)
    assert em.kept(out) is out and out.rdd.getNumPartitions() == 1
    twice = em.kept(out.join(months.repartition(40, "month"), "entity").groupBy("month").count())
    assert twice.rdd.getNumPartitions() == 1 and "Exchange" not in twice._jdf.queryExecution().toString()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.collect()))
