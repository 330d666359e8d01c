"""A third of all rows under one key: same results as brute force, no rows lost."""

import datetime as dt
import math

from pyspark.sql import functions as F

from scarpline import vocab
from scarpline.functions import geo
from scarpline.operators import aoi, catalog, evaluate, exposure, matrix, rainfall, raster

N = 3000


def hot(i):
    return i % 3 == 0


def test_one_event_repeated(spark):
    rows = [(i, 27.5 if hot(i) else 27.0 + (i % 500) / 500, 88.5, "2015-06-01") for i in range(N)]
    df = spark.createDataFrame(rows, "event_id long, latitude double, longitude double, event_date string")
    first = {}
    for i, la, lo, d in rows:
        first.setdefault((la, lo, d), i)
    got = catalog.event_dedup(df.repartition(16), "event_id").collect()
    assert sorted(r.event_id for r in got) == sorted(first.values())


def test_one_box_holds_a_third(spark):
    rows = [(i, 27.5 if hot(i) else 20.0 + i % 9, 88.5 if hot(i) else 90.0 + i % 6) for i in range(N)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    boxes = aoi.pilot_boxes(aoi.aoi_dimension(spark))
    want = sum(a <= la <= b and c <= lo <= d for _, la, lo in rows for _, a, b, c, d in vocab.PILOT_BOXES)
    assert aoi.match_boxes(df, boxes, "inner").count() == want
    assert aoi.with_candidates(df, boxes).count() == N


def test_one_cell_sampled_by_a_third(spark):
    meta = raster.RasterMeta(88.0, 28.0, 0.1)
    wide = spark.createDataFrame([(r, c, float(r * 10 + c)) for r in range(10) for c in range(10)], "row_idx int, col_idx int, elevation double")
    rows = [(i, 27.95 if hot(i) else 27.05 + (i % 19) / 20, 88.05 + (0 if hot(i) else (i % 9) / 10)) for i in range(N)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    got = {r.id: r.elevation for r in raster.raster_sample(df, wide, meta, ["elevation"]).collect()}
    assert len(got) == N
    for i, la, lo in rows:
        assert got[i] == math.floor((28.0 - la) / 0.1) * 10 + math.floor((lo - 88.0) / 0.1)


def test_one_score_holds_a_third(spark):
    pairs = [(0.5 if hot(i) else (i * 7919 % 1009) / 1009, int(i % 5 == 0 or i % 7 == 1)) for i in range(N)]
    df = spark.createDataFrame(pairs, "score double, target int")
    p, n = [s for s, t in pairs if t], [s for s, t in pairs if not t]
    auc = sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))
    assert abs(evaluate.roc_auc(df).first().roc_auc - auc) <= 5e-5


def test_crowded_scores_stay_exact(spark):
    """A third of the distinct scores within a millionth: ranges follow the data."""
    pairs = [(0.5 + i * 1e-10 if hot(i) else i / N, i % 2) for i in range(N)]
    df = spark.createDataFrame(pairs, "score double, target int")
    ordered = sorted(pairs, reverse=True)
    hits, total = 0, 0.0
    for k, (_, t) in enumerate(ordered, 1):
        hits += t
        total += t * hits / k
    assert len({s for s, _ in pairs}) == N
    assert abs(evaluate.average_precision(df).first().pr_auc - total / hits) <= 5e-5


def test_one_place_holds_a_third_of_the_positives(spark):
    box = dict(zip(geo.EDGES, vocab.PILOT_BOXES[0][1:]))
    rows = [(i, 27.5 if hot(i) else 27.0 + (i * 37 % 110) / 100, 88.4 if hot(i) else 88.0 + (i * 53 % 90) / 100, "d") for i in range(150)]
    df = spark.createDataFrame(rows, "event_id long, latitude double, longitude double, event_date string")
    got = matrix.buffered_negatives(df, box).collect()
    places = {(la, lo) for _, la, lo, _ in rows}
    accepted = {}
    for i, *_ in rows:
        for k in range(150):
            at = {}
            for axis, (prime, by_seed, by_attempt, again) in matrix.AXES.items():
                mixed = (i % prime * by_seed + k * by_attempt + 12345) % prime
                at[axis] = float((mixed * again + 6789) % prime) / float(prime)
            la = box["min_lat"] + at["lat"] * (box["max_lat"] - box["min_lat"])
            lo = box["min_lon"] + at["lon"] * (box["max_lon"] - box["min_lon"])
            if all(math.sqrt((a - la) ** 2 + (b - lo) ** 2) >= 0.05 for a, b in places):
                accepted.setdefault(i, []).append(k)
    want = sorted((i, k) for i, ks in accepted.items() for k in ks[:3])
    assert sorted((r.positive_id, r.attempt) for r in got) == want


def test_one_rain_cell_and_day_asked_by_a_third(spark):
    day = dt.date(2024, 2, 1)
    daily = spark.createDataFrame([(c, day - dt.timedelta(days=k), float(c + k)) for c in range(5) for k in range(1, 20)], "cell_id int, day date, mm double")
    rows = [(i, 0 if hot(i) else i % 5, day if hot(i) else day - dt.timedelta(days=i % 8)) for i in range(N)]
    asked = spark.createDataFrame(rows, "id long, cell_id int, target_day date")
    got = {r.id: r for r in rainfall.event_rainfall_join(asked, daily).collect()}
    assert len(got) == N
    for i, c, d in rows:
        shift = (day - d).days
        want = [float(c + k) for k in range(1 + shift, 15 + shift)]
        if shift <= 5:
            assert got[i].antecedent_rain_14d == sum(want) and got[i].rain_1d == want[0]
        else:
            assert got[i].rain_status == "UNAVAILABLE" and got[i].rain_1d is None


def test_one_area_holds_a_third_of_the_grid(spark):
    cells = [(1170 if hot(i) else 1171 + i % 9, 2680 if hot(i) else 2680 + i % 9, float(i % 50), "d") for i in range(N)]
    grid = spark.createDataFrame(cells, "lat_idx int, lon_idx int, precip double, day string")
    box = aoi.pilot_boxes(aoi.aoi_dimension(spark)).where("state = 'Sikkim'")
    r = rainfall.aoi_mean_precip(grid, box, ["day"]).first()
    low = [round((v + o) * 10) for v, o in ((27.0, 89.95), (28.1, 89.95), (88.0, 179.95), (88.9, 179.95))]
    inside = [p for a, o, p, _ in cells if low[0] <= a <= low[1] and low[2] <= o <= low[3]]
    assert r.cells == len(inside) and r.mean_mm == sum(inside) / len(inside)


def test_preference_keeps_every_row(spark):
    rows = [("Sikkim" if hot(i) else "Assam", i) for i in range(N)]
    df = spark.createDataFrame(rows, "state string, event_id long")
    states = aoi.pilot_boxes(aoi.aoi_dimension(spark))
    got = catalog.source_preference(df.where("state = 'Sikkim'"), df, states).groupBy("state", "source").agg(F.count("event_id").alias("n"))
    assert {(r.state, r.source, r.n) for r in got.collect()} == {
        ("Sikkim", "validated_snapshot", 1000), ("Assam", "raw_glc_catalog", 2000),
        ("Arunachal Pradesh", "NONE", 0), ("Meghalaya", "NONE", 0),
    }


def test_a_city_is_many_buckets(spark):
    """Nine tenths of the segments lie in a thousandth of the map: leaves stay near the crowd, pairs as they were."""
    import random

    rng = random.Random(3)
    city = [(i, 27.05 + rng.random() / 300, 88.05 + rng.random() / 300) for i in range(9000)]
    land = [(10_000 + i, 27.0 + rng.random(), 88.0 + rng.random()) for i in range(1000)]
    rows = [(i, str(i), "road", lon, lat, lon + rng.uniform(-2e-4, 2e-4), lat + rng.uniform(-2e-4, 2e-4)) for i, lat, lon in city + land]
    rows += [(20_000 + i, "long", "road", 88.0, 27.0 + i / 50, 89.0, 27.9 - i / 50) for i in range(20)]
    parts = spark.createDataFrame(rows, "osm_id int, asset_name string, asset_type string, lon1 double, lat1 double, lon2 double, lat2 double").cache()
    cells = spark.createDataFrame(
        [("S", f"{i}/{j}", (i * 7 + j + 2) % 10 / 10, 27 + i / 40, 27 + (i + 1) / 40, 88 + j / 40, 88 + (j + 1) / 40) for i in range(40) for j in range(40)],
        "state string, cell_id string, hazard double, min_lat double, max_lat double, min_lon double, max_lon double",
    ).cache()
    plain = exposure.exposure_join(cells, parts)
    tree = exposure.exposure_join_adaptive(cells, parts, crowd=200)
    assert plain.count() == tree.count() > 5000 and plain.exceptAll(tree).isEmpty()
    crowded = exposure.crowded_buckets(parts, 0.1, 200, exposure.DEPTH)
    keyed = exposure._segment_buckets(parts, 0.1)
    assert keyed.groupBy("_by", "_bx").count().agg(F.max("count")).first()[0] > 9000
    leaves = exposure._to_leaves(keyed, crowded, 0.1, exposure.DEPTH, exposure._segment_meets)
    sizes = sorted(r["count"] for r in leaves.groupBy("level", "_by", "_bx").count().collect())
    assert sizes[-1] <= 2 * 200


def test_places_that_coincide_stop_at_the_last_cut(spark):
    parts = spark.createDataFrame([(i, "x", "road", 88.05, 27.05, 88.05, 27.05) for i in range(500)], "osm_id int, asset_name string, asset_type string, lon1 double, lat1 double, lon2 double, lat2 double")
    cells = spark.createDataFrame([("S", "a", 0.9, 27.0, 27.1, 88.0, 88.1)], "state string, cell_id string, hazard double, min_lat double, max_lat double, min_lon double, max_lon double")
    assert exposure.exposure_join_adaptive(cells, parts, crowd=10, depth=4).count() == 500


def test_one_group_of_most_rows_keeps_its_first(spark):
    rows = [(i, "hot" if i % 10 else f"g{i}", float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "at int, g string, v double").repartition(8)
    first = {r.g: r.at for r in catalog.first_rows(df, ["g"], "at").collect()}
    last = {r.g: (r.at, r.v) for r in catalog.first_rows(df, ["g"], "at", last=True).collect()}
    assert first["hot"] == 1 and last["hot"] == (1999, 1999.0) and len(first) == len(last) == 201
    plan = catalog.first_rows(df, ["g"], "at")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_leaves_are_dealt_out_by_key_not_by_the_file_they_come_from(spark):
    """Few hot cells: the join must not run in the few tasks that read the segments."""
    parts = spark.createDataFrame([(i, "x", "road", 88.05, 27.0 + i / 600, 88.06, 27.001 + i / 600) for i in range(600)], "osm_id int, asset_name string, asset_type string, lon1 double, lat1 double, lon2 double, lat2 double").coalesce(1)
    cells = spark.createDataFrame([("S", "a", 0.9, 27.0, 28.0, 88.0, 88.1)], "state string, cell_id string, hazard double, min_lat double, max_lat double, min_lon double, max_lon double")
    found = exposure.exposure_join_adaptive(cells, parts, crowd=20)
    assert found.count() == 600
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert "SortMergeJoin" in next(x for x in plan if "Join [level" in x)  # the one of segments and cells stands first
