"""Known facts and refusals of single operators, on literal inputs."""

import math

import pytest
from pyspark.sql import functions as F

from scarpline import vocab
from scarpline.functions import clock, geo, landcover, provenance as prov, risk
from scarpline.operators import aoi, catalog, evaluate, exposure, matrix, prefix, rainfall, raster, status
from scarpline.sources import catalog_files, documents, osm, rain_documents

NAN, INF = float("nan"), float("inf")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(v):
    return F.lit(v).cast("double")


# --- thresholds and fusion ---------------------------------------------------------------

def test_threshold_curve(spark):
    row = one(
        spark, risk.critical_intensity(1.0).alias("a"), risk.critical_intensity(0.25).alias("b"),
        risk.critical_accumulation(24.0).alias("c"), risk.critical_accumulation(0.5).alias("d"),
    )
    assert row.a == 14.2 and row.b == 14.2
    assert row.c == pytest.approx(round(14.2 * 24**-0.62, 4) * 24, abs=1e-4)
    assert row.d == 7.1


@pytest.mark.parametrize("mm, exceeded, word", [(100.0, True, "valid"), (5.0, False, "valid"), (0.0, False, "valid"), (None, False, "missing_data"), (-1.0, False, "missing_data"), (NAN, False, "missing_data")])
def test_trigger(spark, mm, exceeded, word):
    t = one(spark, risk.rainfall_trigger(lit(mm), 24.0).alias("t")).t
    assert (t.exceeded, t.status) == (exceeded, word)
    if word == "missing_data":
        assert t.ratio is None and t.score == 0.0


def test_levels_at_their_edges(spark):
    df = spark.createDataFrame([(0.85,), (0.65,), (0.4,), (0.3999,), (None,)], "s double")
    assert [r[0] for r in df.select(risk.warning_level("s")).collect()] == ["EXTREME", "HIGH", "MEDIUM", "LOW", None]


def fused(spark, s, now, ahead, slope, dem=True, rain=True, exposure=None):
    df = spark.createDataFrame([(s, now, ahead, slope, exposure, dem, rain)], "susceptibility double, mm_now double, mm_forecast double, slope double, e double, has_real_dem boolean, has_real_rainfall boolean")
    return risk.with_fused_risk(df, exposure="e").first()


def test_fusion(spark):
    strong = fused(spark, 0.70, 60.0, 120.0, 38.0)
    assert strong.warning_level in ("HIGH", "EXTREME") and strong.confidence == "HIGH"
    assert strong.final_risk_score <= 1.0
    assert fused(spark, 0.7, 60.0, 120.0, 38.0, dem=False, rain=False).confidence == "LOW"
    # Rain that is not a live observation degrades the confidence, not the score.
    proxy = fused(spark, 0.7, 60.0, 120.0, 38.0, rain=False)
    assert proxy.confidence == "MEDIUM" and proxy.final_risk_score == strong.final_risk_score


def test_missing_forecast_is_not_zero(spark):
    absent, dry = fused(spark, 0.7, 60.0, None, 38.0), fused(spark, 0.7, 60.0, 0.0, 38.0)
    assert absent.final_risk_score == dry.final_risk_score
    assert absent.forecast_trigger_score is None and not absent.forecast_evaluated
    assert dry.forecast_trigger_score == 0.0 and dry.forecast_evaluated


def test_exposure_never_enters_the_score(spark):
    a, b = fused(spark, 0.5, 60.0, None, 10.0), fused(spark, 0.5, 60.0, None, 10.0, exposure=1.0)
    assert a.final_risk_score == b.final_risk_score
    assert a.exposure_status == "UNAVAILABLE" and a.exposure_score is None


def test_unknown_status_stops(spark):
    with pytest.raises(Exception, match="unknown input status"):
        one(spark, prov.input_record("x", F.lit("GUESS"), lit(1.0)).alias("r"))
    r = one(spark, prov.input_record("x", F.lit("UNAVAILABLE"), lit(1.0)).alias("r")).r
    assert r.value is None


# --- catalogue -----------------------------------------------------------------------------

def test_inventory_counts_duplicates_once(spark):
    rows = [(27.5, 88.5, "2015-06-01", "exact"), (27.5, 88.5, "2015-06-01", "exact"), (27.6, 88.5, "2015-06-02", "1km"), (27.7, 88.5, "2015-06-03", "50km")]
    df = spark.createDataFrame(rows, "latitude double, longitude double, event_date string, location_accuracy string")
    boxes = aoi.admin_boxes(aoi.aoi_dimension(spark)).drop("is_pilot")
    got = {r.state: r for r in catalog.inventory_quality(df, boxes).collect()}
    assert (got["Sikkim"].inventory_events, got["Sikkim"].usable_events, got["Sikkim"].spatial_quality) == (4, 3, "Good")
    assert (got["Tripura"].inventory_events, got["Tripura"].temporal_quality) == (0, "Poor")


def test_catalog_csv(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text("latitude,longitude,event_date,event_title,location_accuracy,fatality_count\n27.5,88.5,2015-06-01,\"a, b\",exact,2.0\nx,88,2015-06-01,,,\n27.6,88.6,,  ,1km,many\n")
    rows = catalog_files.read_catalog(spark, str(path)).orderBy("latitude").collect()
    assert [(r.event_title, r.fatality_count, r.event_date) for r in rows] == [("a, b", 2, "2015-06-01"), (None, None, None)]


def test_catalog_csv_with_line_breaks(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text('latitude,longitude,event_date,event_title\n27.5,88.5,2015-06-01,"said ""slide""\nthen rain"\n')
    row = catalog_files.read_catalog(spark, str(path), multi_line=True).first()
    assert row.event_title == 'said "slide"\nthen rain'


def test_snapshot_label_is_recomputed(spark, tmp_path):
    (tmp_path / "s.json").write_text("""{"state": "Sikkim", "count": 9, "events": [
      {"latitude": 27.5, "longitude": 88.5, "event_date": "2015-06-01", "location_accuracy": "25km", "spatial_uncertainty": "precise_lt_5km"},
      {"latitude": 10.0, "longitude": 88.5, "event_date": "2015-06-01"}, {"latitude": null, "longitude": 88.5}]}""")
    rows = catalog_files.read_snapshot(spark, str(tmp_path / "s.json"), aoi.pilot_boxes(aoi.aoi_dimension(spark))).collect()
    assert [r.spatial_uncertainty for r in rows] == ["approximate_ge_5km"]


def test_uncertainty_of_nothing(spark):
    df = spark.createDataFrame([], "location_accuracy string")
    r = catalog.uncertainty_summary(df).first()
    assert (r.precise_lt_5km, r.approximate_ge_5km, r.pct_approximate_ge_5km) == (0, 0, 0.0)


def test_published_share(spark):
    df = spark.createDataFrame([("exact",)] * 18 + [("25km",)] * 64, "location_accuracy string")
    assert catalog.uncertainty_summary(df).first().pct_approximate_ge_5km == 78.0


# --- places -----------------------------------------------------------------------------------

def test_pilot_tiles(spark):
    boxes = aoi.pilot_boxes(aoi.aoi_dimension(spark))
    n = {r.state: r.n for r in aoi.tile_cover(boxes).groupBy("state").agg(F.count("*").alias("n")).collect()}
    assert n == {"Sikkim": 2, "Assam": 6, "Arunachal Pradesh": 6, "Meghalaya": 2}


def test_pilots_lie_in_their_states(spark):
    dim = aoi.aoi_dimension(spark)
    rows = {r.state: r for r in aoi.aoi_consistency(aoi.admin_boxes(dim), aoi.pilot_boxes(dim)).collect()}
    assert len(rows) == 4 and all(r.within for r in rows.values())
    assert rows["Sikkim"].differing_keys == ["max_lat", "max_lon"]


def test_overlap_is_ambiguous(spark):
    pts = spark.createDataFrame([(1, 25.8, 92.0), (2, 27.3, 88.6), (3, 10.0, 10.0), (4, 27.0, 88.0), (5, 28.1, 88.9)], "id int, latitude double, longitude double")
    dim = aoi.aoi_dimension(spark)
    aliases = aoi.values_frame(spark, "alias, resolved", vocab.STATE_ALIASES)
    rows = {r.id: r for r in aoi.point_in_aoi(pts, aoi.pilot_boxes(dim), aliases, "id").collect()}
    assert rows[1].status == "AMBIGUOUS" and rows[1].candidates == ["Assam", "Meghalaya"] and rows[1].state is None
    assert [rows[i].state for i in (2, 4, 5)] == ["Sikkim"] * 3 and rows[3].status == "OUTSIDE"


def test_grid_limits(spark):
    boxes = aoi.pilot_boxes(aoi.aoi_dimension(spark)).where("state = 'Sikkim'")
    assert aoi.grid_build(boxes).count() == 22 * 18
    with pytest.raises(ValueError):
        aoi.grid_build(boxes, 0.5)
    with pytest.raises(Exception, match="exceeds"):
        aoi.grid_build(boxes, 0.02, max_cells=1500).collect()


def test_segment_clipping(spark):
    rows = [(0.0, 0.0, 3.0, 3.0, True), (0.0, 3.0, 0.9, 3.0, False), (1.5, 1.5, 1.5, 1.5, True), (0.0, 1.9, 1.9, 4.0, False), (2.0, 0.0, 2.0, 5.0, True), (2.1, 0.0, 2.1, 5.0, False)]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, want boolean").withColumns({"min_lon": lit(1.0), "max_lon": lit(2.0), "min_lat": lit(1.0), "max_lat": lit(2.0)})
    assert all(r.want == r.got for r in df.withColumn("got", geo.segment_meets_box("x1", "y1", "x2", "y2")).collect())


def test_random_segments(spark):
    """Against the separating-axis test: box overlap, and corners on both sides of the line."""
    import random

    rng = random.Random(7)
    rows = [tuple(rng.randrange(0, 9) / 2 for _ in range(4)) for _ in range(1500)]

    def want(x1, y1, x2, y2, lo=1.0, hi=2.0):
        if max(x1, x2) < lo or min(x1, x2) > hi or max(y1, y2) < lo or min(y1, y2) > hi:
            return False
        side = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (lo, hi) for y in (lo, hi)]
        return not (min(side) > 0 or max(side) < 0)

    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double").withColumns({"min_lon": lit(1.0), "max_lon": lit(2.0), "min_lat": lit(1.0), "max_lat": lit(2.0)})
    got = df.withColumn("got", geo.segment_meets_box("x1", "y1", "x2", "y2")).collect()
    assert all(r.got == want(r.x1, r.y1, r.x2, r.y2) for r in got)


def test_long_line_is_found_once_per_cell(spark):
    line = spark.createDataFrame([(1, "a", "road", [(88.0, 27.0), (88.45, 27.0), (88.45, 27.4)])], "osm_id long, asset_name string, asset_type string, coords array<struct<lon:double,lat:double>>")
    cells = spark.createDataFrame([("S", "hit", 0.9, 26.9, 27.1, 88.2, 88.6), ("S", "edge", 0.6, 26.9, 27.1, 88.2, 88.6), ("S", "off", 0.9, 27.5, 27.6, 88.0, 88.6)], "state string, cell_id string, hazard double, min_lat double, max_lat double, min_lon double, max_lon double")
    assert [r.cell_id for r in exposure.exposure_join(cells, exposure.segments(line)).collect()] == ["hit"]


# --- rasters -------------------------------------------------------------------------------------

def dem(spark, rows):
    return spark.createDataFrame([(i, j, z) for i, r in enumerate(rows) for j, z in enumerate(r)], "row_idx int, col_idx int, elevation double")


def test_plane_has_its_slope(spark):
    t = raster.terrain(dem(spark, [[0.0, 10.0, 20.0]] * 3), 10.0).where("row_idx = 1 AND col_idx = 1").first()
    assert t.slope == pytest.approx(45.0) and t.roughness == 20.0 and t.tpi == pytest.approx(0.0)
    assert t.aspect == pytest.approx(270.0)


def test_cell_size_follows_the_latitude(spark):
    cells = dem(spark, [[0.0, 10.0, 20.0]] * 4)
    meta = raster.RasterMeta(88.0, 60.2, 0.1)
    metres = 0.1 * 111000.0 * math.cos(math.radians(60.0))
    got = raster.terrain_of(cells, meta).where("row_idx = 1 AND col_idx = 1").first()
    assert got.slope == pytest.approx(math.degrees(math.atan(10.0 / metres)))


def test_flat_cell_and_border(spark):
    rows = raster.terrain(dem(spark, [[5.0] * 4] * 4), 30.0).collect()
    assert len(rows) == 16 and all(r.aspect == 270.0 and r.slope == 0.0 and r.roughness == 0.0 for r in rows)


@pytest.mark.parametrize("size", [0, -1.0, NAN, INF, "30", None, True])
def test_cell_size_must_be_given(size):
    with pytest.raises(ValueError):
        raster.require_cell_size(size)


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_blocks_do_not_show(spark, block):
    cells = dem(spark, [[float((i * 7 + j * j * 3) % 11) for j in range(7)] for i in range(6)])
    want = {(r.row_idx, r.col_idx): r for r in raster.terrain(cells, 30.0, block=256).collect()}
    got = {(r.row_idx, r.col_idx): r for r in raster.terrain(cells.repartition(5), 30.0, block=block).collect()}
    assert got == want


def test_nodata_spoils_only_its_neighbours(spark):
    z = [[1.0] * 5 for _ in range(5)]
    z[2][2] = vocab.NODATA
    rows = raster.terrain(dem(spark, z), 30.0).collect()
    assert sum(r.slope is None for r in rows) == 9


def test_off_raster_point_keeps_its_row(spark):
    meta = raster.RasterMeta(88.0, 28.0, 0.5)
    wide = raster.terrain(dem(spark, [[1.0, 2.0], [3.0, 4.0]]), 30.0)
    pts = spark.createDataFrame([(1, 27.9, 88.1), (2, 10.0, 88.1)], "id int, latitude double, longitude double")
    rows = {r.id: r for r in raster.raster_sample(pts, wide, meta).collect()}
    assert rows[1].status == "REAL" and rows[1].elevation == 1.0
    assert rows[2].status == "UNAVAILABLE" and rows[2].elevation is None and rows[2].reasons == ["point is outside the raster"]


def test_land_cover_codes(spark):
    codes = [*vocab.LAND_COVER_GROUPS, 0, 77, NAN, INF, None, 10.4]
    df = spark.createDataFrame([(None if c is None else float(c),) for c in codes], "code double")
    got = [r[0] for r in df.select(landcover.group_of("code")).collect()]
    assert got == [*vocab.LAND_COVER_GROUPS.values(), -1, -1, -1, -1, -1, 1]
    proxy = spark.createDataFrame([(2999.9,), (3000.0,), (4200.0,), (NAN,), (None,)], "z double").select(landcover.proxy_class("z"))
    assert [r[0] for r in proxy.collect()] == [1, 2, 3, None, None]


# --- rainfall -----------------------------------------------------------------------------------------

def daily(spark, values, end="2024-02-01", cell=1):
    """values[k] is the rain k+1 days before end."""
    base = spark.createDataFrame([(cell, k + 1, v) for k, v in enumerate(values)], "cell_id int, k int, mm double")
    return base.select("cell_id", F.date_sub(F.lit(end).cast("date"), F.col("k")).alias("day"), "mm")


def ask(spark, end="2024-02-01", cell=1):
    return spark.createDataFrame([(cell, end)], "cell_id int, d string").select("cell_id", F.to_date("d").alias("target_day"))


def test_antecedent_window(spark):
    r = rainfall.antecedent_for(ask(spark), daily(spark, [float(i) for i in range(1, 15)])).first()
    assert (r.rain_1d, r.rain_3d, r.rain_7d, r.antecedent_rain_14d, r.rain_intensity_max_3d) == (1.0, 6.0, 28.0, 105.0, 3.0)


@pytest.mark.parametrize("values", [[1.0] * 13, [1.0] * 6 + [None] + [1.0] * 7, [1.0] * 6 + [NAN] + [1.0] * 7, [1.0] * 6 + [-0.5] + [1.0] * 7])
def test_incomplete_window_refuses(spark, values):
    r = rainfall.antecedent_for(ask(spark), daily(spark, values)).first()
    assert r.rain_status == "UNAVAILABLE" and r.rain_1d is None and r.antecedent_rain_14d is None
    assert r.rain_reasons == ["13 of 14 antecedent days observed"]


def test_event_day_never_counts(spark):
    same_day = daily(spark, [99.0], end="2024-02-02")
    r = rainfall.antecedent_for(ask(spark), daily(spark, [1.0] * 14).unionByName(same_day)).first()
    assert r.antecedent_rain_14d == 14.0


def test_chunks_do_not_show(spark):
    long = daily(spark, [float(i % 9) for i in range(150)])
    key = lambda df: sorted(map(tuple, df.drop("rain_reasons").collect()))
    assert key(rainfall.antecedent_features(long, chunk=14)) == key(rainfall.antecedent_features(long.repartition(7), chunk=1000))
    assert key(rainfall.inclusive_accumulations(long, chunk=7)) == key(rainfall.inclusive_accumulations(long, chunk=999))


@pytest.mark.parametrize("cells, mean, status", [([1.0, 3.0, -9999.9, NAN], 2.0, "REAL"), ([0.0, 0.0], 0.0, "REAL"), ([-9999.9, NAN], None, "UNAVAILABLE"), ([-0.01, 0.0], 0.0, "REAL")])
def test_area_mean(spark, cells, mean, status):
    box = spark.createDataFrame([("A", 27.0, 27.3, 88.0, 88.3)], "state string, min_lat double, max_lat double, min_lon double, max_lon double")
    grid = spark.createDataFrame([(1170, 2680 + i, v) for i, v in enumerate(cells)], "lat_idx int, lon_idx int, precip double").withColumn("day", F.lit("2024-01-01"))
    r = rainfall.aoi_mean_precip(grid, box, ["day"]).first()
    assert (r.mean_mm, r.status) == (mean, status)


def test_forecast_gaps(spark):
    rows = [("a", h, 1.0 if h != 2 else None) for h in range(1, 5)] + [("b", h, None) for h in range(1, 4)] + [("a", -1, 50.0)]
    df = spark.createDataFrame(rows, "p string, h int, mm double").withColumn("time", F.expr("timestampadd(HOUR, h, TIMESTAMP_NTZ '2024-01-01 00:00:00')"))
    got = {r.p: r for r in rainfall.forecast_accumulation(df, "p", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"), 3).collect()}
    assert got["a"].forecast_mm == 2.0 and got["b"].forecast_mm is None and got["b"].status == "UNAVAILABLE"


def slots(spark, offsets):
    df = spark.createDataFrame([("x", o, 2.0) for o in offsets], "aoi string, o int, rate double")
    return df.select("aoi", F.expr("timestampadd(MINUTE, -30 * o, TIMESTAMP_NTZ '2025-09-18 09:00:00')").alias("slot"), (F.col("rate") * 0.5).alias("mm"))




def accumulate(spark, offsets):
    run = rainfall.contiguous_run(slots(spark, offsets), ["aoi"], F.expr("TIMESTAMP_NTZ '2025-09-18 13:12:45'"))
    return rainfall.complete_accumulation(run, ["aoi"]).first()


def test_accumulations(spark):
    full = accumulate(spark, range(12))
    assert (full.accum_3h_mm, full.accum_6h_mm, full.accum_6h_reason) == (6.0, 12.0, None)
    half = accumulate(spark, range(6))
    assert half.accum_3h_mm == 6.0 and half.accum_6h_mm is None and "6 of 12" in half.accum_6h_reason
    gap = accumulate(spark, [0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11])
    assert gap.intervals == 3 and gap.accum_3h_mm is None
    future = accumulate(spark, [-20, *range(12)])
    assert future.accum_6h_mm == 12.0


def test_final_product_cannot_be_probed(spark):
    req = spark.sql("SELECT 1 AS cell_id, DATE '2024-02-01' AS target_day, 'Final' AS run_type, DATE '2024-02-02' AS now_day")
    r = rainfall.probe_window_asof(req, daily(spark, [1.0] * 20)).first()
    assert r.status == "FAILED" and r.last_offset < r.first_offset and r.antecedent_rain_14d is None


def test_freshness_and_ages(spark):
    df = spark.createDataFrame([(90.0,), (90.1,), (360.0,), (360.1,), (None,)], "m double")
    assert [r[0] for r in df.select(clock.freshness("m")).collect()] == ["NEAR_REAL_TIME", "RECENT", "RECENT", "STALE", None]
    ages = spark.createDataFrame([(89.0,), (90.0,), (7200.0,), (200000.0,), (None,)], "s double")
    assert [r[0] for r in ages.select(clock.age_label("s")).collect()] == ["89s ago", "2 min ago", "2.0 h ago", "2.3 d ago", None]


def test_granule_names(spark):
    name = one(spark, clock.granule_name(F.lit("Early"), F.expr("TIMESTAMP_NTZ '2025-09-18 09:00:00'")).alias("n")).n
    assert name == "3B-HHR-E.MS.MRG.3IMERG.20250918-S090000-E092959.0540.V07B.HDF5"
    parse = lambda t: one(spark, rain_documents.granule_parse(F.lit(t)).alias("g")).g
    good = "3B-HHR-L.MS.MRG.3IMERG.20250918-S093000-E095959.9999.V07B.RT-H5"
    assert parse(good).run == "Late" and parse(good).slot.minute == 30
    assert parse(good.replace("S093000", "S093100")) is None and parse("readme.txt") is None


def test_unknown_run_type_stops(spark):
    with pytest.raises(Exception, match="unknown run type"):
        one(spark, clock.run_type_strict(F.lit("weekly")).alias("r"))


# --- matrix and metrics ------------------------------------------------------------------------------

def test_missing_features_drop(spark):
    rows = [(1.0, 2.0, 1), (NAN, 2.0, 1), (1.0, 2.0, -1), (INF, 2.0, 3), (4.0, 5.0, 6)]
    df = spark.createDataFrame(rows, "elevation double, slope double, land_cover_class int")
    names = ["elevation", "slope", "land_cover_class"]
    kept = matrix.drop_missing_features(df, names).collect()
    r = matrix.drop_report(df, names).first()
    assert [k.elevation for k in kept] == [1.0, 4.0]
    assert (r.rows_in, r.rows_dropped, r.dropped_nonfinite_numeric, r.dropped_landcover_unavailable) == (5, 3, 2, 1)


def test_unknown_category_stops(spark):
    df = spark.createDataFrame([(1,), (9,)], "c int")
    with pytest.raises(Exception, match="outside its vocabulary"):
        matrix.category_guard(df, "c", [1, 2]).collect()


def test_negatives_keep_their_distance(spark):
    box = dict(zip(geo.EDGES, vocab.PILOT_BOXES[0][1:]))
    pos = spark.createDataFrame([(i, 27.0 + (i * 37 % 100) / 100, 88.0 + (i * 53 % 90) / 100, "2015-01-01") for i in range(40)] , "event_id long, latitude double, longitude double, event_date string")
    rows = matrix.buffered_negatives(pos, box).collect()
    again = matrix.buffered_negatives(pos.repartition(7), box, first_round=150).collect()
    assert sorted(rows) == sorted(again) and len(rows) == 120
    places = [(r.latitude, r.longitude) for r in pos.collect()]
    assert min(math.dist((r.latitude, r.longitude), p) for r in rows for p in places) >= 0.05


def test_incomplete_rainfall_aborts(spark):
    df = spark.createDataFrame([("REAL",), ("UNAVAILABLE",)], "rain_status string")
    with pytest.raises(Exception, match="no complete rainfall"):
        matrix.complete_rainfall_only(df).collect()


def test_median_is_exact(spark):
    for values in ([1.0, 2.0, 3.0, 4.0], [5.0], [1.0, 1.0, 9.0], [float(i * i % 101) for i in range(500)]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        s = sorted(values)
        n = len(s)
        assert prefix.exact_median(df, "v").first()[0] == (s[(n - 1) // 2] + s[n // 2]) / 2


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_match_a_plain_loop(spark, descending):
    keys = [(float((i * 7919) % 1009), i % 5) for i in range(700)]
    df = spark.createDataFrame(keys, "k double, v int").groupBy("k").agg(F.sum("v").alias("v"))
    got = {r.k: r.before_v for r in prefix.running_totals(df, "k", ["v"], descending, ranges=16).collect()}
    total, want = 0, {}
    for k, v in sorted(((r.k, r.v) for r in df.collect()), reverse=descending):
        want[k], total = total, total + v
    assert got == want


def brute_auc(pairs):
    p = [s for s, t in pairs if t]
    n = [s for s, t in pairs if not t]
    return sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))


def test_metrics_by_hand(spark):
    pairs = [((i * 37 % 50) / 50, int(i % 3 == 0 or i % 7 == 0)) for i in range(120)]
    df = spark.createDataFrame(pairs, "score double, target int")
    got = evaluate.all_metrics(df).first()
    assert got.roc_auc == pytest.approx(brute_auc(pairs), abs=5e-5)
    assert got.roc_auc == evaluate.roc_auc(df).first().roc_auc
    assert got.pr_auc == evaluate.average_precision(df).first().pr_auc
    b = evaluate.binary_metrics(df).first()
    assert (got.precision, got.recall, got.f1, got.false_alarm_rate) == (b.precision, b.recall, b.f1, b.false_alarm_rate)


def test_one_class_gives_zeros(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 1)], "score double, target int")
    assert tuple(evaluate.all_metrics(df).first()) == (0.0,) * 6


def test_refit_must_agree(spark):
    a = spark.createDataFrame([(1, 0.5)], "id int, m double")
    b = spark.createDataFrame([(1, 0.6)], "id int, m double")
    assert evaluate.refit_consistency(a, a, ["id"], ["m"]).count() == 1
    with pytest.raises(Exception, match="differ"):
        evaluate.refit_consistency(b, a, ["id"], ["m"]).collect()


def test_misaligned_contributions_rank_nothing(spark):
    df = spark.createDataFrame([([1.0, -2.0],)], "contributions array<double>")
    assert evaluate.feature_ranking(df, ["a", "b", "c"]).count() == 0
    assert [r.feature for r in evaluate.feature_ranking(df, ["a", "b"]).collect()] == ["b", "a"]


# --- evidence and documents ------------------------------------------------------------------------------

@pytest.mark.parametrize("text, ok", [
    ('{"validation_metrics": {"PR-AUC": 0.6, "ROC-AUC": 0.8}, "metrics_source": "computed_from_validation_run"}', True),
    ('{"validation_metrics": {"PR-AUC": true, "ROC-AUC": 0.8}, "metrics_source": "computed_from_validation_run"}', False),
    ('{"validation_metrics": {"PR-AUC": "0.6", "ROC-AUC": 0.8}, "metrics_source": "computed_from_validation_run"}', False),
    ('{"validation_metrics": {"PR-AUC": 0.6}, "metrics_source": "computed_from_validation_run"}', False),
    ('{"validation_metrics": {"PR-AUC": 0.6, "ROC-AUC": 0.8}, "metrics_source": "remembered"}', False),
    ('{"validation_metrics": {"PR-AUC": 0.7762, "ROC-AUC": 0.919}, "metrics_source": "computed_from_validation_run"}', False),
    ("not json", False), ("{}", False),
])
def test_evidence(spark, text, ok):
    df = spark.createDataFrame([(text, True, True)], "metrics_json string, has_model boolean, has_schema boolean")
    r = status.evidence_gate(df).first()
    assert r.complete is ok and (r.pr_auc is not None) is ok


def test_assets(spark, tmp_path):
    (tmp_path / "e.json").write_text("""{"elements": [{"type": "node", "id": 111, "lat": 27.3, "lon": 88.6, "tags": {"amenity": "hospital", "name": "H"}},
      {"type": "way", "id": 222, "geometry": [{"lat": 27.3, "lon": 88.6}, {"lat": 27.4, "lon": 88.7}], "tags": {"highway": "primary"}},
      {"type": "way", "id": 333, "geometry": [{"lat": 27.3, "lon": 88.6}]}, {"type": "node", "id": 444}]}""")
    (tmp_path / "none.json").write_text('{"elements": []}')
    rows = osm.read_osm(spark, str(tmp_path)).orderBy("osm_id").collect()
    assert [(r.osm_id, r.asset_type, r.asset_name) for r in rows] == [(111, "hospital", "H"), (222, "road", "OSM Way 222")]


def test_map_needs_coordinates(spark):
    cell = "cell_id string, latitude double, longitude double, status string, probability double, risk_class string, exceeds_decision_threshold boolean"
    ok = spark.createDataFrame([("a", 27.0, 88.0, "UNAVAILABLE", None, None, None)], cell)
    text = documents.geojson_lines(ok).first().value
    assert '"coordinates":[88.0,27.0]' in text and '"probability":null' in text
    with pytest.raises(Exception, match="no coordinate"):
        documents.geojson_lines(spark.createDataFrame([("a", None, 88.0, "OK", 0.1, "LOW", False)], cell)).collect()


def test_map_header_names_the_series_really_used(spark):
    from scarpline.plans import grid

    cells = spark.createDataFrame([("Sikkim", "OK", 0.9), ("Sikkim", "UNAVAILABLE", None), ("Assam", "UNAVAILABLE", None)], "state string, status string, probability double")
    rain = spark.createDataFrame([("Sikkim", vocab.FALLBACK_LABEL, vocab.SOURCE_FALLBACK, True, "FALLBACK")], "state string, source string, source_kind string, is_fallback boolean, data_quality_status string")
    rows = {r.state: r for r in documents.map_header(grid.grid_summary(cells, ["state"]), rain, "2024-01-20", 0.05).collect()}
    assert rows["Sikkim"].generated_from.startswith("susceptibility model + earlier rain: stand-in series " + vocab.FALLBACK_LABEL)
    assert rows["Sikkim"].summary.risk_class_counts == {"EXTREME": 1, "HIGH": 0, "MEDIUM": 0, "LOW": 0}
    assert "origin not stated" in rows["Assam"].generated_from and rows["Assam"].summary.mean_probability is None


def test_crop_window():
    box = dict(zip(geo.EDGES, vocab.PILOT_BOXES[0][1:]))
    assert raster.RasterMeta(88.0, 28.1, 0.02).window(box) == (0, 54, 0, 44)
    assert raster.RasterMeta(87.0, 29.0, 0.5).window(box) == (1, 3, 2, 3)


def test_manifest_entries_need_both(spark):
    df = spark.sql("SELECT map('a', named_struct('bytes', 5L, 'sha256', repeat('a', 64)), 'b', named_struct('bytes', 0L, 'sha256', repeat('a', 64)), 'c', named_struct('bytes', 5L, 'sha256', 'zz')) AS artifacts")
    assert [r.name for r in documents.manifest_entries(df).collect()] == ["a"]


def test_bucket_size_does_not_show(spark):
    import random

    rng = random.Random(3)
    point = lambda: (88.0 + rng.randrange(0, 90) / 100, 27.0 + rng.randrange(0, 110) / 100)
    rows = [(i, "a", "road", [point() for _ in range(1 + i % 4)]) for i in range(120)]
    lines = exposure.segments(spark.createDataFrame(rows, "osm_id long, asset_name string, asset_type string, coords array<struct<lon:double,lat:double>>"))
    boxes = aoi.pilot_boxes(aoi.aoi_dimension(spark)).where("state = 'Sikkim'")
    cells = aoi.grid_build(boxes).select("state", "cell_id", lit(0.9).alias("hazard"), "bbox.*")
    found = lambda size: sorted((r.osm_id, r.cell_id) for r in exposure.exposure_join(cells, lines, size).collect())
    whole = found(50.0)
    assert whole and found(0.1) == whole and found(0.03) == whole


def test_status_tone_tests_the_negative_first(spark):
    df = spark.createDataFrame([("Unavailable",), ("Available",), ("Not Trained",), (None,)], "s string")
    assert [r[0] for r in df.select(prov.status_tone("s")).collect()] == ["bad", "good", "bad", "neutral"]


def test_nothing_defaults_to_real(spark):
    n = F.lit(None)
    r = one(spark, prov.rain_tone(n.cast("boolean"), n.cast("string"), n.cast("string")).alias("a"), prov.rain_tone(F.lit(True), F.lit("REAL"), F.lit("IMERG")).alias("b"), prov.live_tone(F.lit("REAL"), n.cast("string")).alias("c"))
    assert (r.a, r.b, r.c) == ("unreported", "fallback", "unreported")
