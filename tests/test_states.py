from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from replen.operators import states, stats
from replen.streaming import ingest

SALES = "order_id string, sku string, sale_time timestamp, quantity double"

def entities():
    return {"sku": F.col("sku"), "model": F.substring("sku", 1, 3)}


def of(rows, by=()):
    return states.month_states(rows, entities(), F.col("sale_time"), F.col("quantity"), by)


def table(df):
    return {tuple(r[k] for k in states.KEYS): tuple(r[c] for c in ("n_rows", "n", "total", "m2", "low", "high", "first", "last")) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:2] == want[k][:2] and got[k][4:] == want[k][4:] and got[k][2:4] == pytest.approx(want[k][2:4], rel=1e-9, abs=1e-6)


def events(spark, sf="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/events.parquet").select(
        F.col("event_id").cast("string").alias("order_id"), F.concat_ws("-", F.lit("usr"), "event_type", F.col("user_id") % 7).alias("sku"), F.col("ts").alias("sale_time"), F.col("value").alias("quantity")
    )


def test_states_merge_in_any_order(spark):
    r = np.random.RandomState(2)
    rows = [(str(i), f"abc{r.randint(3)}", datetime(2001, int(r.randint(1, 5)), int(r.randint(1, 28))), float(1e9 + r.randint(100))) for i in range(400)]
    rows += [("n1", "abc0", datetime(2001, 1, 1), None), ("n2", "abc9", datetime(2001, 1, 1), None), ("n3", "abc0", None, 3.0), ("n4", None, datetime(2001, 1, 1), 3.0)]
    df = spark.createDataFrame(rows, SALES)
    whole = table(of(df))
    assert len(whole) == len({(t, e, m) for _, s, x, _ in rows for t, e in (("sku", s), ("model", s and s[:3])) for m in [x and (x.year, x.month)]})
    for k, v in whole.items():
        if k[2] and k[1] and v[1]:
            values = [q for _, s, x, q in rows if x and q is not None and s and (x.year, x.month) == (k[2].year, k[2].month) and (s if k[0] == "sku" else s[:3]) == k[1]]
            assert v[1] == len(values) and v[3] == pytest.approx(np.var(values) * len(values), rel=1e-6, abs=1e-6)
    parts = of(df.withColumn("part", F.hash("order_id") % 5), ("part",)).drop("part")
    got = table(states.merged(parts))
    for k in whole:  # values near 1e9: the squares about the mean keep their digits
        assert got[k][:3] == pytest.approx(whole[k][:3]) and got[k][3] == pytest.approx(whole[k][3], rel=1e-6, abs=1e-6) and got[k][4:] == whole[k][4:]
    assert states.merged(of(df.where("false"))).count() == 0


def test_ten_batches_equal_one_recomputation(spark, tmp_path):
    root, df = str(tmp_path), events(spark).withColumn("part", F.pmod(F.hash("order_id"), F.lit(10)))
    old = None
    assert states.stored(spark, root).count() == 0
    for i in range(10):
        batch = of(df.where(F.col("part") == i))
        states.append(batch, root, i)
        if i in (3, 7):
            states.append(batch, root, i)  # run again
            states.compact(spark, root, i + 1)
            states.append(batch, root, i)  # and again, after it was compacted
        if i == 8:
            old = states.entity_table(states.stored(spark, root))
    assert {p.name for p in (tmp_path / "monthly_states").iterdir() if p.is_dir()} == {"generation=4", "generation=8"}
    now = states.stored(spark, root)
    same(table(now), table(of(df)))
    with pytest.raises(ValueError):
        states.stored(spark, root, 5)
    # derived statistics: the touched entities only, and equal to those of all sales
    sold = df.select("*", F.col("sale_time").cast("date").alias("sale_date"))
    want = {r.entity: r for r in stats.entity_stats(stats.monthly(sold, "sku")).collect()}
    seen = states.stored(spark, root, 9)
    got = states.refreshed_table(states.entity_table(seen), now, of(df.where("part = 9"))).where("entity_type = 'sku'").collect()
    assert old.count() and len(got) == len(want)
    for r in got:
        w = want[r.entity_id]
        assert (r.n_months, r.first_sale) == (w.n_months, w.first_sale) and (r.quantity, r.sd or 0, r.cv) == pytest.approx((w.quantity, w.sd or 0, w.cv))
    months = {(r.entity, r.month): r.quantity for r in states.as_months(now, "model").collect()}
    assert sum(months.values()) == pytest.approx(df.agg(F.sum("quantity")).first()[0]) and all(m.day == 1 for _, m in months)


def test_stream_of_events_keeps_states(spark, tmp_path, monkeypatch):
    source, target, root, ck = (str(tmp_path / n) for n in ("in", "out", "states", "ck"))
    df = events(spark).dropDuplicates(ingest.KEYS)
    cut = df.approxQuantile("quantity", [0.5], 0.0)[0]
    files = [df.where(F.col("quantity") > cut), df.where(F.pmod(F.hash("order_id"), F.lit(3)) == 0), df, df.where("false")]  # overlapping, late, repeated, none
    run = lambda: ingest.start(spark, source, StructType.fromDDL(SALES), target, ck, root, entities()).awaitTermination()
    append = states.append
    for i, rows in enumerate(files):
        rows.coalesce(1).write.mode("append").parquet(source)
        if i == 1:  # stopped between the rows and their states
            def stop(*args):
                raise RuntimeError("stopped")

            monkeypatch.setattr(states, "append", stop)
            with pytest.raises(Exception, match="stopped"):
                run()
            monkeypatch.setattr(states, "append", append)
        run()
    assert spark.read.parquet(target).count() == df.count()
    same(table(states.stored(spark, root)), table(of(df)))
    states.compact(spark, root, 2)
    same(table(states.stored(spark, root)), table(of(df)))
    assert date(2024, 1, 1) in {k[2] for k in table(states.stored(spark, root))}
