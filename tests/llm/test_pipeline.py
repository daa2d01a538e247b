"""The pipeline's stages against the operators' own decisions, each on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from replen.llm import exact, minhash, mixing

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, before, SF).write.parquet(path)
        after = spark.read.parquet(path)
        if name != names[-1]:
            assert after.columns == columns
            assert not after.select(columns).exceptAll(docs.crossJoin(F.broadcast(spark.range(2))).select(columns)).count()
        if name == "exact dedup":
            assert after.count() == before.select(F.lower("text")).distinct().count()
            assert exact.deduplicate(after, exact.dealt_load()).where("group_size > 1").count() == 0
        if name == "near dedup":
            assert minhash.near_duplicates(after).where("not kept").count() == 0
        if name == "mixing":
            want = mixing.mix(before).agg(F.sum("copies")).first()[0]
            assert after.count() == want
        if name == names[-1]:
            assert after.count() == before.count()
        before = after


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_stage_links_from_four_fifths(spark):
    rows = []
    for i in range(120):
        words = [f"w{i}x{k}" for k in range(404)]
        copy = [*words[: 404 - (39, 44, 45)[i % 3]], *(f"c{i}x{k}" for k in range((39, 44, 45)[i % 3]))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    alike = [similarity(rows[2 * i][1], rows[2 * i + 1][1]) for i in range(120)]
    assert {round(s, 3) for s in alike} == {0.822, 0.802, 0.798}
    kept = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    want = {2 * i for i in range(120)} | {2 * i + 1 for i, s in enumerate(alike) if s < 0.8}
    assert {r.doc_id for r in kept.collect()} == want


def test_stages_handle_odd_rows(spark):
    """Null and empty texts, missing and repeated ids, equal rows, extra columns with clashing names, an empty table."""
    text = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, text(1)), (1, text(1)), (2, text(1).upper()), (3, text(3)), (3, text(4)), (None, text(5)), (None, text(5)), (None, text(3)), (7, None), (8, ""), (9, text(5) + " more")]
    docs = spark.createDataFrame([(i, t, "en", "a", 5, "x", "y") for i, t in rows], "doc_id long, text string, lang string, source string, copies int, kept string, n string")
    once = corpus_pipeline.one_of_each_text(spark, docs, SF)
    got = sorted((r.doc_id or 0, (r.text or "")[:4].lower()) for r in once.collect())
    assert once.columns == docs.columns and got == [(0, "w5x0"), (2, "w1x0"), (3, "w3x0"), (3, "w4x0"), (8, ""), (9, "w5x0")]
    group = corpus_pipeline.one_of_each_group(spark, docs.where("doc_id is null or doc_id > 3"), SF)
    got = sorted((r.doc_id or 0, (r.text or "")[:4]) for r in group.collect())
    assert got == [(0, "w3x0"), (0, "w5x0"), (0, "w5x0"), (7, ""), (8, "")]
    mix = corpus_pipeline.mixed(spark, docs, SF)
    wanted = mixing.mix(docs).agg(F.sum("copies"), F.sum("taken")).first()
    assert mix.columns == docs.columns and abs(mix.where("text <> ''").count() * 60 - wanted[1]) <= 62
    assert mix.where("copies = 5 and kept = 'x'").count() == mix.count()
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.of_quality(spark, docs.where("doc_id > 6 or doc_id is null"), SF).where("text is null or text = ''").count() == 0
    ids = corpus_pipeline.encoded(spark, docs, SF).collect()
    assert len(ids) == len(rows) and {r.n_tokens for r in ids if r.doc_id in (7, 8)} == {1}


def test_run_and_rerun_agree(spark):
    first = corpus_pipeline.run(spark, SF).groupBy("doc_id", "ids_sha256").count()
    second = corpus_pipeline.run(spark, SF).groupBy("doc_id", "ids_sha256").count()
    assert first.exceptAll(second).count() == 0 and first.count() > 0


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    """Rows of one id and text (up to case) that differ in other columns: the same ones stay, however the rows come."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words if k % 2 else words.upper(), "en", "ab"[k % 2], None if k % 3 == 0 else f"x{k}") for k in range(24)]
    rows += [(2, f"{words} {k}", "en", "a", "y") for k in range(6)]
    for stage in (corpus_pipeline.one_of_each_text, corpus_pipeline.mixed):
        found = []
        for order in (rows, rows[::-1], rows[12:] + rows[:12]):
            docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, extra string").repartition(1 + len(found))
            found.append(sorted(map(repr, stage(spark, docs, SF).collect())))
        assert found[0] == found[1] == found[2] and found[0]


def test_mixing_shuffles_texts_once_and_places_all_copies(spark):
    rows = [(k % 7, f"w{k % 7} " * (3 + k % 7), "en", "ab"[k % 2], f"x{k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, extra string")
    made = corpus_pipeline.mixed(spark, docs, SF)
    plan = made._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanges = [x for x in plan.split("\n\n") if x.lstrip().startswith("(") and "Exchange\n" in x and "text#" in x.split("Arguments")[0]]
    assert len(exchanges) == 1
    want = mixing.mix(corpus_pipeline.keyed(docs), id_col="_key").groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0")
    got = corpus_pipeline.keyed(made).groupBy("_key").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert made.groupBy("extra").count().agg(F.max("count")).first()[0] <= 2


def test_stages_hold_arrow_batches_small(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        corpus_pipeline.encoded(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), SF)
        assert spark.conf.get(key) == str(corpus_pipeline.BATCH_BYTES)
        spark.conf.set(key, "1024")
        corpus_pipeline.small_batches(spark)
        assert spark.conf.get(key) == "1024"
    finally:
        spark.conf.set(key, before)
