"""Scoring around fitted models against brute force, and streams in several batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scarpline import vocab
from scarpline.operators import matrix, models
from scarpline.plans import grid
from scarpline.session import scratch_path
from scarpline.streaming import slots, state


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(240):
        steep = (i * 37) % 60
        rows.append((i, int(steep > 30), 27.0 + i / 300, float(steep), 1 + i % 6, float((i * 13) % 40)))
    df = spark.createDataFrame(rows, "id int, target int, latitude double, slope double, land_cover_class int, rain_1d double")
    other = [f for f in vocab.MODEL_FEATURES if f not in df.columns]
    return matrix.cast_features(df.withColumns({f: F.col("slope") * 0 + 1.0 for f in other})).cache()


@pytest.fixture(scope="module")
def forest(labelled):
    return models.fit("Random Forest", labelled, vocab.MODEL_FEATURES, trees=5)


def cells_of(labelled):
    status = F.when(F.col("id") % 5 == 0, "UNAVAILABLE").otherwise("OK")
    return labelled.withColumns({
        "status": status, "reasons": F.when(status == "OK", F.array().cast("array<string>")).otherwise(F.array(F.lit("nodata"))),
        "state": F.when(F.col("id") % 3 == 0, "Sikkim").when(F.col("id") % 3 == 1, "Assam").otherwise("Tripura"),
    })


def test_every_baseline_learns_the_obvious(spark, labelled):
    split = labelled.withColumn("split", F.when(F.col("id") % 3 == 0, "test").otherwise("train"))
    rows = models.train_baselines(split, {"s": split}, trees=30, feature_sets={"all": vocab.MODEL_FEATURES}).collect()
    assert sorted(r.model for r in rows) == sorted(models.MODELS)
    assert min(r.roc_auc for r in rows) > 0.9, [(r.model, r.roc_auc) for r in rows]


def test_only_the_boosted_model_sees_a_category(labelled):
    boosted = models.fit(models.PRIMARY, labelled, vocab.MODEL_FEATURES, trees=2)
    assert models.CATEGORY in boosted.stages[0].getInputCols()
    assert vocab.LAND_COVER_FEATURE in models.build("Random Forest", vocab.MODEL_FEATURES).getStages()[0].getInputCols()


def test_unusable_cells_stay_without_a_number(labelled, forest):
    cells = cells_of(labelled)
    rows = {r.id: r for r in grid.with_classes(models.grid_score(forest, cells)).collect()}
    direct = {r.id: r.probability for r in models.score(forest, labelled).collect()}
    assert len(rows) == 240
    for i, r in rows.items():
        if i % 5 == 0:
            assert r.probability is None and r.risk_class is None and r.reasons == ["nodata"]
        else:
            assert r.probability == direct[i] and r.exceeds_decision_threshold == (direct[i] >= 0.5)


def test_points_use_their_own_states_model(labelled, forest):
    other = models.fit("Random Forest", labelled.withColumn("target", 1 - F.col("target")), vocab.MODEL_FEATURES, trees=5)
    rows = models.point_score({"Sikkim": forest, "Assam": other}, cells_of(labelled)).collect()
    a = {r.id: r.probability for r in models.score(forest, labelled).collect()}
    b = {r.id: r.probability for r in models.score(other, labelled).collect()}
    for r in rows:
        want = None if r.id % 5 == 0 or r.state == "Tripura" else (a if r.state == "Sikkim" else b)[r.id]
        assert r.probability == want
        if want is None:
            assert r.status == "UNAVAILABLE" and r.reasons


def test_linear_contributions_are_exact(labelled):
    linear = models.fit("Logistic Regression", labelled, ["slope", "rain_1d"])
    w = linear.stages[-1].coefficients
    rows = labelled.select("slope", "rain_1d").collect()
    mean = [sum(r[i] for r in rows) / len(rows) for i in (0, 1)]
    want = {n: sum(abs(w[i] * (r[i] - mean[i])) for r in rows) / len(rows) for i, n in enumerate(("slope", "rain_1d"))}
    got = models.feature_attribution(labelled.sparkSession, linear, labelled, ["slope", "rain_1d"]).collect()
    assert [r.feature for r in got] == sorted(want, key=want.get, reverse=True)
    assert all(r.importance == pytest.approx(want[r.feature], abs=2e-6) for r in got)


def test_nothing_to_explain_is_said(spark, labelled):
    r = models.feature_attribution(spark, None, None, ["slope"]).first()
    assert r.status == "UNAVAILABLE" and r.importance is None and "no model" in r.reason


def test_scenarios_move_only_rain(labelled):
    both = models.scenario_cells(labelled)
    low, high = (both.where(F.col("scenario") == n) for n in ("low", "high"))
    static = ["id", *vocab.STATIC_FEATURES]
    assert low.select(static).exceptAll(high.select(static)).isEmpty()
    assert high.agg(F.min("antecedent_rain_14d")).first()[0] == 90.0 * 14


# --- streams ---------------------------------------------------------------------------------------

T0 = dt.datetime(2025, 9, 18, 0, 0)


def feed(spark, batches, schema):
    """One file per batch, in order of their modification times."""
    import os

    path = scratch_path(spark, "feed")
    os.makedirs(path)
    for i, rows in enumerate(batches):
        part = scratch_path(spark, "part")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        name = next(n for n in os.listdir(part) if n.endswith(".parquet"))
        os.link(f"{part}/{name}", f"{path}/{i:03d}.parquet")
        os.utime(f"{path}/{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def at(slot):
    return T0 + dt.timedelta(minutes=30 * slot)


def test_better_runs_replace_worse_ones_only(spark):
    schema = "aoi int, slot timestamp, source_kind string, mm double"
    batches = [
        [(1, at(0), "OPEN_METEO_FALLBACK", 3.0), (1, at(1), "IMERG_HHR_EARLY", 1.0)],
        [(1, at(0), "IMERG_HHR_LATE", 2.0), (1, at(1), "IMERG_HHR_LATE", 9.0)],
        [(1, at(0), "IMERG_HHR_EARLY", 1.5), (1, at(0), "IMERG_HHR_LATE", 0.1)],
    ]
    out = slots.run_available(state.run_upgrade(feed(spark, batches, schema), slots.LATE_DELAY), "upgrade", settings=state.SETTINGS)
    got = sorted((r.slot, r.source_rank, r.mm, r.previous_rank) for r in out.collect())
    assert got == [(at(0), 1, 1.5, 2), (at(0), 2, 2.0, 3), (at(0), 3, 3.0, None), (at(1), 1, 1.0, None)]


def test_late_rows_are_dropped(spark):
    schema = "aoi int, slot timestamp, source_kind string, mm double"
    batches = [[(1, at(100), "IMERG_HHR_EARLY", 1.0)], [(1, at(101), "IMERG_HHR_EARLY", 1.0)], [(1, at(0), "IMERG_HHR_EARLY", 5.0)]]
    out, dropped = slots.run_counted(state.run_upgrade(feed(spark, batches, schema), slots.LATE_DELAY), "late", settings=state.SETTINGS)
    assert dropped == 1
    assert sorted(r.slot for r in out.collect()) == [at(100), at(101)]


def test_silence_is_reported_stale(spark):
    schema = "aoi int, slot timestamp, mm double"
    batches = [[(1, at(0), 1.0), (2, at(0), 4.0)], [(2, at(1), 5.0)], [(2, at(40), 6.0)]]
    out = slots.run_available(state.latest(feed(spark, batches, schema), "0 minutes"), "latest", settings=state.SETTINGS).collect()
    one = sorted((r.observed_at, r.freshness) for r in out if r.aoi == 1)
    assert one == [(at(0), "NEAR_REAL_TIME"), (at(0), "STALE")]
    assert max((r.observed_at, r.latest_mm) for r in out if r.aoi == 2) == (at(40), 6.0)


def test_a_stopped_stream_resumes(spark):
    """A second run in the same folder reads only what is new, and remembers its state."""
    schema = "aoi int, slot timestamp, source_kind string, mm double"
    folder, path = scratch_path(spark, "resume"), scratch_path(spark, "landing")
    before = spark.conf.get(slots.PARTITIONS), spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)

    def go(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        out, _ = slots.run_counted(state.run_upgrade(stream, slots.LATE_DELAY), "resume", folder=folder, state_partitions=3, settings=state.SETTINGS)
        return sorted((r.slot, r.source_rank, r.previous_rank) for r in out.collect())

    assert go([(1, at(0), "OPEN_METEO_FALLBACK", 3.0), (1, at(1), "IMERG_HHR_EARLY", 1.0)]) == [(at(0), 3, None), (at(1), 1, None)]
    again = go([(1, at(0), "IMERG_HHR_LATE", 2.0), (1, at(1), "IMERG_HHR_LATE", 9.0)])
    assert again == [(at(0), 2, 3), (at(0), 3, None), (at(1), 1, None)]
    assert before == (spark.conf.get(slots.PARTITIONS), spark.conf.get("spark.sql.streaming.stateStore.providerClass", None))


def test_a_gap_leaves_the_total_null(spark):
    schema = "aoi int, ts timestamp, rate double"
    rows = [(1, at(i), 2.0) for i in range(24) if i != 5] + [(1, at(200), 0.0)]
    stream = feed(spark, [rows[:10], rows[10:20], rows[20:]], schema)
    out = slots.run_available(slots.accumulations(slots.slot_rain(stream)), "gap")
    got = {r.window_end: r for r in out.collect()}
    full = got[at(18)]
    assert (full.accum_3h_mm, full.accum_6h_mm) == (6.0, 12.0)
    holed = got[at(12)]
    assert holed.accum_3h_mm == 6.0 and holed.accum_6h_mm is None and "11 of 12" in holed.accum_6h_reason
    assert got[at(10)].accum_3h_mm is None


def test_alerts_need_the_threshold(spark):
    df = spark.createDataFrame([(1, 100.0, None), (2, 5.0, 200.0)], "aoi int, accum_3h_mm double, accum_6h_mm double")
    got = sorted((r.aoi, r.duration_h) for r in slots.trigger_alerts(df).collect())
    assert got == [(1, 3.0), (2, 6.0)]


def test_the_newest_run_stops_at_the_first_gap(spark):
    schema = "aoi int, slot timestamp, mm double"
    hour = lambda h: T0 + dt.timedelta(hours=h)
    batches = [
        [(1, hour(h), 1.0) for h in (0, 1, 2, 5, 6)] + [(2, hour(3), None)],
        [(1, hour(4), 2.0), (1, hour(6), 0.5)],
        [(1, hour(3), 0.25)],
        [(1, hour(3), 0.25)],
        [(1, hour(30), 9.0)],
    ]
    out = slots.run_available(state.newest_run(feed(spark, batches, schema), "9 days"), "run", settings=state.SETTINGS).collect()
    got = sorted((r.anchor, r.run_hours, r.accum_3h_mm, r.accum_6h_mm) for r in out)
    assert got == [(hour(6), 2, None, None), (hour(6), 3, 4.0, None), (hour(6), 7, 4.0, 6.25), (hour(30), 1, None, None)]
    assert all(("contiguous" in (r.accum_6h_reason or "")) == (r.accum_6h_mm is None) for r in out)


def test_a_repeated_batch_counts_once(spark):
    """foreachBatch may see a batch twice: the table is as after one call, and the newest row stays."""
    table = scratch_path(spark, "upsert")
    write = state.upsert_latest(table)
    row = lambda aoi, slot, mm, age=0.0: (aoi, at(slot), mm, age, "NEAR_REAL_TIME", False)
    first = spark.createDataFrame([row(1, 0, 1.0), row(1, 2, 3.0), row(2, 5, 4.0)], state.LATEST_SCHEMA)
    second = spark.createDataFrame([row(1, 3, 7.0), row(1, 3, 7.0, 200.0)], state.LATEST_SCHEMA)
    for batch, number in ((first, 0), (second, 1), (first, 0), (second, 1)):
        write(batch, number)
    got = sorted((r.aoi, r.observed_at, r.latest_mm, r.age_minutes) for r in state.read_latest(spark, table).collect())
    assert got == [(1, at(3), 7.0, 200.0), (2, at(5), 4.0, 0.0)]


def test_dropped_rows_are_counted_over_many_batches(spark):
    """The count does not rest on the last few progress reports."""
    schema = "aoi int, slot timestamp, source_kind string, mm double"
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", None)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    try:
        batches = [[(1, at(100), "IMERG_HHR_EARLY", 1.0)], [(1, at(101), "IMERG_HHR_EARLY", 1.0)], *([(1, at(i), "IMERG_HHR_EARLY", 5.0)] for i in range(3)), [(1, at(102), "IMERG_HHR_EARLY", 1.0)]]
        _, dropped = slots.run_counted(state.run_upgrade(feed(spark, batches, schema), slots.LATE_DELAY), "many", settings=state.SETTINGS)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates") if before is None else spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    assert dropped == 3
