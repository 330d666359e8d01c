"""Stored models as tables against the models themselves; many rasters against brute force."""

import math

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from scarpline import vocab
from scarpline.operators import ensembles, matrix, models, raster, rasters
from scarpline.plans import model_runs
from scarpline.session import scratch_path, through_table
from scarpline.sources import documents

FEATURES = vocab.MODEL_FEATURES


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(480):
        steep = (i * 37) % 60
        rows.append((i, "Sikkim" if i % 2 else "Assam", int((steep > 30) != (i % 6 == 3)), 27.0 + i / 300, float(steep), 1 + i % 6, float((i * 13) % 40), f"{1990 + i % 10}-03-0{1 + i % 9}"))
    df = spark.createDataFrame(rows, "id int, state string, target int, latitude double, slope double, land_cover_class int, rain_1d double, event_date string")
    other = [f for f in FEATURES if f not in df.columns]
    return matrix.cast_features(df.withColumns({f: (F.col("id") * (7 + n)) % 23 for n, f in enumerate(other)})).cache()


@pytest.fixture(scope="module")
def saved(spark, labelled):
    """state -> (model, folder), per kind of model; the boosted ones split on the category."""
    out = {}
    for name in (models.PRIMARY, "Random Forest", "Logistic Regression"):
        for state in ("Sikkim", "Assam"):
            model, path = models.fit(name, labelled.where(F.col("state") == state), FEATURES, trees=7), scratch_path(spark, "model")
            ensembles.save(model, path)
            out.setdefault(name, {})[state] = (model, path)
    return out


def cells(labelled):
    odd = F.col("id") % 11 == 0
    return labelled.withColumns({
        "state": F.when(F.col("id") % 13 == 0, "Tripura").otherwise(F.col("state")),
        "status": F.when(odd, "UNAVAILABLE").otherwise("OK"),
        "reasons": F.when(odd, F.array(F.lit("nodata"))).otherwise(F.array().cast("array<string>")),
        "slope": F.when(odd, F.lit(None)).otherwise(F.col("slope")),
    })


@pytest.mark.parametrize("name", [models.PRIMARY, "Random Forest"])
def test_every_states_model_in_one_pass(spark, labelled, saved, name):
    nodes = ensembles.node_table(spark, {s: path for s, (_, path) in saved[name].items()}, FEATURES)
    rows = {r.id: r for r in ensembles.score(cells(labelled), nodes, FEATURES).collect()}
    assert len(rows) == 480
    direct = {}
    for state, (model, _) in saved[name].items():
        direct |= {(state, r.id): r.probability for r in models.score(model, labelled).collect()}
    for i, r in rows.items():
        if i % 11 == 0:
            assert r.status == "UNAVAILABLE" and r.probability is None and r.reasons == ["nodata"]
        elif r.state == "Tripura":
            assert r.status == "UNAVAILABLE" and r.probability is None and r.reasons == ["no model for this area"]
        else:
            assert r.status == "OK" and abs(r.probability - direct[r.state, i]) < 1e-12
    if name == models.PRIMARY:
        assert nodes.where("mask is not null").count() > 0


def test_path_contributions_add_up(spark, labelled, saved):
    nodes = ensembles.node_table(spark, {s: path for s, (_, path) in saved[models.PRIMARY].items()}, FEATURES)
    both = labelled.withColumns({"x": ensembles.path_contributions(spark, nodes, "state", FEATURES), "p": ensembles.probability(spark, nodes, "state", FEATURES)})
    for r in both.collect():
        margin = r.x.start + sum(r.x.contributions)
        assert abs(1 / (1 + math.exp(-2 * margin)) - r.p) < 1e-12
    used = {r.feature for r in nodes.where("feature is not null").select("feature").distinct().collect()}
    ranked = ensembles.attribution(labelled, nodes, FEATURES).collect()
    assert len(ranked) == 2 * len(FEATURES) and all((r.importance == 0) for r in ranked if r.feature not in used)


def test_linear_terms(spark, labelled, saved):
    terms = ensembles.linear_table(spark, {s: path for s, (_, path) in saved["Logistic Regression"].items()}, FEATURES)
    rows = ensembles.score_linear(cells(labelled), terms, FEATURES).where("status = 'OK'").collect()
    direct = {(s, r.id): r.probability for s, (m, _) in saved["Logistic Regression"].items() for r in models.score(m, labelled).collect()}
    assert len(rows) > 300 and all(abs(r.probability - direct[r.state, r.id]) < 1e-9 for r in rows)
    w = saved["Logistic Regression"]["Assam"][0].stages[-1].coefficients[FEATURES.index("slope")]
    slopes = [r.slope for r in labelled.where("state = 'Assam'").collect()]
    mean = sum(slopes) / len(slopes)
    want = sum(abs(w * (s - mean)) for s in slopes) / len(slopes)
    got = ensembles.attribution(labelled, terms, FEATURES).where("state = 'Assam' and feature = 'slope'").first()
    assert got.importance == pytest.approx(want, rel=1e-9)
    with pytest.raises(ValueError, match="not a tree"):
        ensembles.node_table(spark, {"Assam": saved["Logistic Regression"]["Assam"][1]}, FEATURES)


def test_scenarios_score_the_same_row(spark, labelled, saved):
    nodes = ensembles.node_table(spark, {s: path for s, (_, path) in saved[models.PRIMARY].items()}, FEATURES)
    scored = ensembles.score_scenarios(cells(labelled), nodes, FEATURES).collect()
    wet = matrix.cast_features(models.scenario_cells(cells(labelled).where("status = 'OK' and state <> 'Tripura'"))).withColumn("p", ensembles.probability(spark, nodes, "state", FEATURES))
    want = {(r.id, r.scenario): r.p for r in wet.collect()}
    for r in scored:
        for s in r.scenarios:
            assert s.probability == want.get((r.id, s.scenario))


def test_models_ask_for_known_features_and_bounded_nodes(spark, labelled, saved, monkeypatch):
    nodes = ensembles.node_table(spark, {"Assam": saved["Random Forest"]["Assam"][1]}, FEATURES)
    with pytest.raises(ValueError, match="not given"):
        ensembles.pack(nodes, ["slope"])
    monkeypatch.setattr(ensembles, "MOST_NODES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        ensembles.pack(nodes, FEATURES)


def test_train_decide_refit_record(spark, labelled):
    positives = labelled.where("target = 1").select("state", "event_date", (F.col("id") % 4 == 0).alias("low_accuracy"))
    dated = labelled.withColumn("event_date", F.to_timestamp("event_date"))
    path = scratch_path(spark, "records")
    metrics, saved, records = model_runs.train_decide_record(dated, positives, path, cutoff_year=1995, trees=3, sets={model_runs.PRIMARY_SET: FEATURES})
    assert metrics.count() == 2 * 2 * 3 and sorted(saved) == ["Assam", "Sikkim"]
    primary = {r.state: r for r in metrics.where(f"split = 'temporal' and model = '{models.PRIMARY}'").collect()}
    for r in records.collect():
        assert (r.pr_auc, r.roc_auc, r.false_alarm_rate) == (primary[r.state].pr_auc, primary[r.state].roc_auc, primary[r.state].false_alarm_rate)
        assert r.samples == 240 and r.n_features == 11 and r.independent_events == positives.where(F.col("state") == r.state).select("event_date").distinct().count()
        assert r.final_recommendation == vocab.OPTION_C and r.justification_reasons  # fewer than 100 dates


def test_a_refit_that_differs_is_refused(spark, labelled):
    splits = {("Assam", "temporal"): matrix.temporal_holdout(labelled.where("state = 'Assam'").withColumn("event_date", F.to_timestamp("event_date")), cutoff_year=1995)}
    key = ("Assam", "temporal", model_runs.PRIMARY_SET, models.PRIMARY)
    found = model_runs.baselines(splits, trees=3, names=(models.PRIMARY,), sets={model_runs.PRIMARY_SET: FEATURES})
    folder = scratch_path(spark, "models")
    assert list(model_runs.refit_and_save(splits, found, folder, trees=3)) == ["Assam"]
    found[key] = found[key] | {"roc_auc": 0.123}
    with pytest.raises(model_runs.MetricsDiffer, match="Assam"):
        model_runs.refit_and_save(splits, found, folder, trees=3)


def test_one_class_is_not_trained(spark, labelled):
    data = labelled.where("state = 'Assam'").withColumns({"target": F.lit(1), "event_date": F.to_timestamp("event_date")})
    metrics, saved, records = model_runs.train_decide_record(data, data.select("state", F.col("event_date").cast("string").alias("event_date"), F.lit(False).alias("low_accuracy")), scratch_path(spark, "records"), cutoff_year=1995, trees=2)
    assert metrics.count() == 0 and saved == {} and records.count() == 0


# --- many rasters ----------------------------------------------------------------------------------

GEOREF = [(0, "Sikkim", 88.0, 28.0, 0.1, 1), (1, None, 87.5, 28.5, 0.25, 2), (2, "Assam", 91.0, 26.0, 0.05, 1)]


@pytest.fixture(scope="module")
def georef(spark):
    return spark.createDataFrame(GEOREF, "raster_id int, state string, west double, north double, res double, priority int")


def grid_cells(shape):
    return [(r, i, j, None if (i, j) == (2, 3) else float(100 * r + 7 * i + (j * j) % 11)) for r, (rows, cols) in enumerate(shape) for i in range(rows) for j in range(cols)]


def test_stencil_of_many_rasters_equals_each_alone(spark, georef):
    cells = spark.createDataFrame(grid_cells([(7, 9), (5, 4), (11, 6)]), "raster_id int, row_idx int, col_idx int, elevation double")
    together = raster.neighbourhood(cells, block=4, by=("raster_id",))
    for i in range(3):
        alone = raster.neighbourhood(cells.where(F.col("raster_id") == i), block=4)
        mine = together.where(F.col("raster_id") == i).drop("raster_id")
        assert mine.count() == alone.count() and mine.select(alone.columns).exceptAll(alone).isEmpty()
    sized = rasters.terrain(cells, georef).where("raster_id = 2 and slope is not null").count()
    assert sized > 0


def test_first_usable_raster_wins(spark, georef):
    values = grid_cells([(10, 10), (8, 8), (10, 20)])
    wide = spark.createDataFrame(values, "raster_id int, row_idx int, col_idx int, elevation double")
    points = [(i, ("Sikkim", "Assam", None, "Tripura")[i % 4], 25.4 + (i * 37 % 60) / 18, 87.4 + (i * 53 % 97) / 21) for i in range(400)]
    points += [(1000, "Sikkim", None, 88.0), (1001, "Sikkim", float("nan"), 88.0)]
    got = {r.k: r for r in rasters.sample(spark.createDataFrame(points, "k int, state string, latitude double, longitude double"), "k", wide, georef, names=("elevation",)).collect()}
    assert len(got) == len(points)
    table = {(r, i, j): v for r, i, j, v in values}
    for k, state, lat, lon in points:
        over = []
        for r, own, west, north, res, priority in GEOREF:
            if lat is not None and lat == lat and (own is None or own == state):
                at = (r, math.floor((north - lat) / res), math.floor((lon - west) / res))
                if at in table:
                    over.append((table[at] is None, priority, r, table[at]))
        best = min(over, default=None, key=lambda x: x[:3])
        row = got[k]
        if best is None:
            assert (row.status, row.reasons, row.elevation) == ("UNAVAILABLE", ["point is outside every raster"], None)
        elif best[0]:
            assert (row.status, row.reasons, row.elevation) == ("UNAVAILABLE", ["elevation is nodata or not finite"], None)
        else:
            assert (row.status, row.elevation, row.raster_id) == ("REAL", best[3], best[2])
    assert {r.raster_id for r in got.values()} == {None, 0, 1, 2}


def test_land_cover_of_the_first_known_raster(spark, georef):
    codes = [(0, 0, 0, 0), (1, 2, 2, 10), (0, 0, 1, 50)]
    cells = spark.createDataFrame(codes, "raster_id int, row_idx int, col_idx int, code int")
    points = spark.createDataFrame([(1, "Sikkim", 27.95, 88.05), (2, "Sikkim", 27.95, 88.15), (3, "Assam", 27.95, 88.15), (4, "Assam", 20.0, 88.0)], "k int, state string, latitude double, longitude double")
    got = {r.k: (r.land_cover_class, r.land_cover_unavailable) for r in rasters.landcover(points, "k", cells, georef).collect()}
    assert got == {1: (1, False), 2: (4, False), 3: (1, False), 4: (-1, True)}


def test_cells_whose_file_is_small_are_not_broadcast(spark, georef):
    """A raster of equal cells is a tiny file of many rows, and exploded points look like few."""
    rows = spark.range(200_000).selectExpr("CAST(0 AS INT) AS raster_id", "CAST(id DIV 400 AS INT) AS row_idx", "CAST(id % 400 AS INT) AS col_idx", "7.0D AS elevation", "10 AS code")
    wide = through_table(rows, "flat")
    points = spark.range(1).selectExpr("explode(sequence(1, 1000)) AS k", "'Sikkim' AS state").withColumns({"latitude": 27.9 - F.col("k") / 1e4, "longitude": F.lit(88.5)})
    meta = raster.RasterMeta(west=88.0, north=28.0, res=0.1)
    for sampled in (
        rasters.sample(points, "k", wide, georef, names=("elevation",)), rasters.landcover(points, "k", wide, georef),
        raster.raster_sample(points, wide, meta, ["elevation"]), raster.landcover_sample(points, wide, meta),
    ):
        plan = sampled._jdf.queryExecution().executedPlan().toString()
        joined = [x for x in plan.splitlines() if "Join" in x and ("row_idx" in x or "_ti" in x or "_r#" in x)]
        assert joined and all("SortMergeJoin" in x for x in joined)
        assert sampled.count() == 1000


def test_trees_and_rows_are_dealt_into_blocks(spark, labelled, saved, monkeypatch):
    """An ensemble that may not come to the driver is scored, compared and ranked like any other."""
    nodes = ensembles.node_table(spark, {s: path for s, (_, path) in saved[models.PRIMARY].items()}, FEATURES)
    p, x = (f(spark, nodes, "state", FEATURES) for f in (ensembles.probability, ensembles.path_contributions))
    direct = {r.id: r for r in cells(labelled).select("id", p.alias("p"), x.alias("x")).collect()}
    whole = {(r.state, r.feature): r.importance for r in ensembles.tree_ranking(labelled, nodes, FEATURES).collect()}
    low, high = ({r.id: r.scenarios[i].probability for r in ensembles.score_scenarios(cells(labelled), nodes, FEATURES).collect()} for i in (0, 1))
    for name, value in (("MOST_NODES", 3), ("BLOCK_NODES", 8), ("CHUNK_ROWS", 50)):
        monkeypatch.setattr(ensembles, name, value)
    got = ensembles.score(cells(labelled), nodes, FEATURES).collect()
    assert len(got) == 480 and sum(r.probability is not None for r in got) > 300
    for r in got:
        assert (r.probability is None) == (r.status != "OK") and (r.probability is None or abs(r.probability - direct[r.id].p) < 1e-12)
    ranked = {(r.state, r.feature): r.importance for r in ensembles.tree_ranking(labelled, nodes, FEATURES).collect()}
    assert ranked.keys() == whole.keys() and all(abs(ranked[k] - whole[k]) < 1e-9 for k in whole)
    for r in ensembles.score_scenarios(cells(labelled), nodes, FEATURES).collect():
        for s, want in zip(r.scenarios, (low, high), strict=True):
            assert s.probability == pytest.approx(want[r.id], abs=1e-12)
    with pytest.raises(ValueError, match="not given"):
        ensembles.score(cells(labelled), nodes, ["slope"])


def test_written_by_value_without_a_sort(spark, monkeypatch):
    """Snapshots and run records keep a file open per state instead of sorting a task's rows."""
    key, open_files, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (open_files.append(int(spark.conf.get(key))), write(self, path))[1])
    before, path = spark.conf.get(key), scratch_path(spark, "by-state")
    rows = spark.range(0, 1000, 1, 4).selectExpr("id", "concat('s', id % 4) AS state")
    for part in (0, 1):
        documents.append_run_records(rows.where(f"id % 2 = {part}"), path)
    assert len(open_files) == 2 and min(open_files) >= 4 and spark.conf.get(key) == before
    back = spark.read.parquet(path)
    assert back.select("id", "state").exceptAll(rows).isEmpty() and back.count() == 1000


# --- the training rows -----------------------------------------------------------------------------


def test_samples_are_made_once(spark, small):
    """The negatives of the training matrix are written; its plan only reads them."""
    from checks import q_areas, q_matrix, q_models
    from checks.fixtures import Inputs
    from scarpline.plans import training

    fx = Inputs(spark, small)
    rows = training.area_matrix(q_matrix.positives(fx), fx.pilots, q_areas.terrain_table(fx), fx.covers, fx.georef, fx.rain_daily, q_models.rain_key)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "sample_id" in plan and "attempt" not in plan


def test_copies_of_places_are_measured_before_they_may_be_broadcast(spark):
    """Places of a tiny file are copied ninefold; the copies are shuffled, hence measured, first."""
    places = through_table(spark.range(50_000).selectExpr("27.0D + id / 1e5 AS latitude", "88.0D + (id % 300) / 1e3 AS longitude"), "places")
    candidates = spark.range(2000).selectExpr("id", "27.0D + id / 1800 AS latitude", "88.5D AS longitude")
    far = matrix.far_from(candidates, places, 0.05)
    assert far.count() == far.select("id").distinct().count()
    lines = matrix.far_from(candidates, places, 0.05)._jdf.queryExecution().executedPlan().toString().splitlines()
    last = max(i for i, x in enumerate(lines) if "Generate explode" in x and "longitude" in x)
    assert any("Exchange hashpartitioning" in x and "_bc" in x for x in lines[:last])


def test_a_fit_done_again_sees_the_same_rows_in_the_same_order(spark, labelled, monkeypatch):
    monkeypatch.setattr(model_runs, "ROWS_PER_PART", 40)
    dated = labelled.withColumn("event_date", F.to_timestamp("event_date")).repartition(7)
    orders = []
    for frames in (model_runs.holdouts(dated, 1995), model_runs.holdouts(dated.repartition(3, "slope"), 1995)):
        rows = frames["Assam", "temporal"].withColumn("part", F.spark_partition_id()).collect()
        parts = {}
        for r in rows:
            parts.setdefault(r.part, []).append(r.id)
        orders.append(sorted(parts.values()))
    assert len(orders[0]) > 2 and orders[0] == orders[1]


def test_fits_do_not_crowd_the_driver(spark, monkeypatch):
    """Unless asked to, no fit begins before the one before has ended."""
    import threading
    import time

    lock, running, most = threading.Lock(), [0], [0]

    def fit(*_):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.02)
        with lock:
            running[0] -= 1

    monkeypatch.setattr(model_runs, "parts_of", lambda frame: (None, None, True))
    monkeypatch.setattr(model_runs, "measure", lambda model, test: {})
    monkeypatch.setattr(models, "fit", fit)
    splits = {(state, split): None for state in ("a", "b") for split in ("spatial", "temporal")}
    assert len(model_runs.baselines(splits)) == 24 and most == [1]
    assert len(model_runs.baselines(splits, at_once=4)) == 24
