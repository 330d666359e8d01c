"""Gaps stay gaps: absent cells, repeated days, crowded positives."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from scarpline.operators import matrix, rainfall, raster
from scarpline.operators.rainfall import REPEATED

SIDE = 16


def cells_with_gaps():
    """A raster with absent cells at a corner, at borders, at block borders and inside."""
    rng = random.Random(6)
    gone = {(0, 0), (0, 7), (5, 8), (7, 7), (8, 8), (10, 4), (10, 5), (15, 3), (12, 15)}
    return {(r, c): float(rng.randint(0, 900)) for r in range(SIDE) for c in range(SIDE) if (r, c) not in gone}


def plain_nine(cells):
    top, left = min(r for r, _ in cells), min(c for _, c in cells)
    bottom, right = max(r for r, _ in cells), max(c for _, c in cells)
    for r, c in cells:
        around = [(min(max(r + i, top), bottom), min(max(c + j, left), right)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        yield (r, c), [cells.get(at) for at in around]


@pytest.mark.parametrize("block", [1, 5, 8, 16, 256])
@pytest.mark.parametrize("shift", [0, 1003])
def test_stencil_does_not_depend_on_its_block(spark, block, shift):
    cells = {(r + shift, c + shift): z for (r, c), z in cells_with_gaps().items()}
    df = spark.createDataFrame([(r, c, z) for (r, c), z in cells.items()], "row_idx int, col_idx int, elevation double")
    nine = raster.neighbourhood(df, block=block).withColumn("tpi", raster.tpi()).withColumn("rough", raster.roughness())
    got = {(r.row_idx, r.col_idx): r for r in nine.collect()}
    for at, values in plain_nine(cells):
        whole = None not in values
        assert got[at].complete == whole
        assert got[at].rough == (max(values) - min(values) if whole else None)
        assert not whole or math.isclose(got[at].tpi, values[4] - sum(values) / 9, abs_tol=1e-9)
    assert sum(r.complete for r in got.values()) == sum(None not in v for _, v in plain_nine(cells))


def test_terrain_of_a_cropped_raster_uses_its_own_latitude(spark):
    meta = raster.RasterMeta(west=0.0, north=60.0, res=0.02)
    rows = [(r, c, float(r * 7 + c * c)) for r in range(1000, 1011) for c in range(11)]
    df = spark.createDataFrame(rows, "row_idx int, col_idx int, elevation double")
    mean_lat = 60.0 - (1000 + 1010 + 1) / 2 * 0.02
    from scarpline.functions import geo

    metres = spark.range(1).select(geo.mean_cell_metres(meta.res, F.lit(mean_lat)).alias("m")).first().m
    got = {(r.row_idx, r.col_idx): r.slope for r in raster.terrain_of(df, meta).collect()}
    want = {(r.row_idx, r.col_idx): r.slope for r in raster.terrain(df, metres).collect()}
    assert got == want


@pytest.fixture(scope="module")
def daily(spark):
    """Cell 1 complete; cell 2 with one day twice and one missing."""
    first = dt.date(2024, 1, 1)
    rows = [(1, first + dt.timedelta(days=i), 1.0) for i in range(20)]
    rows += [(2, first + dt.timedelta(days=i), 1.0) for i in range(20) if i != 9]
    rows += [(2, first + dt.timedelta(days=10), 5.0)]
    return spark.createDataFrame(rows, "cell_id int, day date, mm double")


def test_repeated_days_refuse(spark, daily):
    day = dt.date(2024, 1, 17)
    row = lambda df, cell: df.where((F.col("cell_id") == cell) & (F.col("day") == F.lit(day))).first()
    antecedent = rainfall.antecedent_features(daily)
    assert row(antecedent, 1).rain_status == "REAL" and row(antecedent, 1).antecedent_rain_14d == 14.0
    two = row(antecedent, 2)
    assert (two.days_present, two.rain_status, two.antecedent_rain_14d) == (12, "UNAVAILABLE", None) and REPEATED in two.rain_reasons
    asked = spark.createDataFrame([(1, day), (2, day)], "cell_id int, target_day date")
    found = {r.cell_id: r for r in rainfall.antecedent_for(asked, daily).collect()}
    assert found[1].rain_status == "REAL" and found[2].days_present == 12 and REPEATED in found[2].rain_reasons
    sums = {(r.cell_id, r.day): r for r in rainfall.inclusive_accumulations(daily).collect()}
    assert sums[2, dt.date(2024, 1, 12)].accumulation_3d_mm is None and sums[1, dt.date(2024, 1, 12)].accumulation_3d_mm == 3.0
    window = daily.where("day BETWEEN DATE '2024-01-03' AND DATE '2024-01-16'")
    valid = {r.cell_id: r for r in rainfall.series_validate(window, ["cell_id"]).collect()}
    assert valid[1].status == "VALID" and valid[2].status == "REFUSED" and valid[2].days == 13 and REPEATED in valid[2].reasons
    asks = spark.createDataFrame([(c, dt.date(2024, 1, 18), "Early", dt.date(2024, 6, 1)) for c in (1, 2)], "cell_id int, target_day date, run_type string, now_day date")
    probed = {r.cell_id: r for r in rainfall.probe_window_asof(asks, daily).collect()}
    assert probed[1].status == "OK" and probed[2].status == "FAILED" and REPEATED in probed[2].reasons


def test_candidate_points_stay_distinct(spark):
    """Ids that agree modulo any small number have positions of their own."""
    box = {"min_lat": 0.0, "max_lat": 1.0, "min_lon": 0.0, "max_lon": 1.0}
    ids = spark.range(100_000).select((F.col("id") * 1_000_003 + F.col("id") % 7).alias("seed"), *[F.lit(v).alias(k) for k, v in box.items()])
    ids = ids.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(29))))
    lat, lon = matrix.candidate_point(F.col("seed"), F.col("k"))
    r = ids.select(lat.alias("a"), lon.alias("b")).agg(F.count_distinct("a", "b").alias("n"), F.avg("a").alias("a"), F.avg("b").alias("b"), F.corr("a", "b").alias("c")).first()
    assert r.n == 3_000_000 and abs(r.a - 0.5) < 0.01 and abs(r.b - 0.5) < 0.01 and abs(r.c) < 0.01


def test_report_counts_a_crowded_positive(spark):
    """One state is full of positives: its points fall short, and the report says so."""
    boxes = spark.createDataFrame([("full", 0.0, 0.1, 0.0, 0.1), ("open", 0.0, 5.0, 0.0, 5.0)], "state string, min_lat double, max_lat double, min_lon double, max_lon double")
    rows = [("full", i, 0.02 * (i % 6), 0.02 * (i // 6), "d") for i in range(36)] + [("open", 100 + i, 1.0 + i, 1.0, "d") for i in range(3)]
    pos = spark.createDataFrame(rows, "state string, event_id long, latitude double, longitude double, event_date string")
    got = {r.state: r for r in matrix.negatives_report(pos, matrix.buffered_negatives(pos, boxes)).collect()}
    assert tuple(got["full"]) == ("full", 36, 108, 0, 36 * 150, 36)
    assert got["open"].accepted == got["open"].wanted == 9 and got["open"].positives_short == 0 and got["open"].attempted < 3 * 150


def test_large_files_are_hashed_in_pieces(spark, monkeypatch):
    """Above the limit a file is streamed: the same digest, and a verdict where it cannot be opened."""
    import hashlib
    import os

    from scarpline.session import scratch_path
    from scarpline.sources import documents

    folder = scratch_path(spark, "digests")
    os.makedirs(folder)
    contents = {"small": b"a" * 10, "large": bytes(range(256)) * 4000, "edge": b"b" * 100}  # empty files are not in Spark's listing
    for name, data in contents.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    want = {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}
    for limit in (0, 100, documents.WHOLE_BYTES):
        got = {r.name: (r.length, r.sha256) for r in documents.file_inventory(spark, folder, whole_bytes=limit).collect()}
        assert got == want
    assert documents._digest("nowhere://x/y") is None and documents._digest(f"file://{folder}/gone") is None
    files = spark.createDataFrame([("a", 5, None), ("b", 5, "x")], "name string, length bigint, sha256 string")
    entries = spark.createDataFrame([("a", 5, "x"), ("b", 5, "x")], "name string, length bigint, sha256 string")
    assert {r.name: r.verdict for r in documents.file_integrity(files, entries).collect()} == {"a": "not readable", "b": "ok"}


def test_a_budget_that_runs_out(spark):
    """Where nearly the whole box is taken, a state gets what its attempts find and no more."""
    from scarpline.operators import matrix

    crowd = [("A", i, 27.0 + (i // 20) * 0.05, 88.0 + (i % 20) * 0.05, "2001-01-0%d" % (1 + i % 9)) for i in range(400)]
    free = [("B", 1000 + i, 10.0, 10.0, None if i else "2002-02-02") for i in range(5)]
    pos = spark.createDataFrame(crowd + free, "state string, event_id bigint, latitude double, longitude double, event_date string")
    boxes = spark.createDataFrame([("A", 27.0, 28.0, 88.0, 89.0), ("B", 0.0, 20.0, 0.0, 20.0)], "state string, min_lat double, max_lat double, min_lon double, max_lon double")
    got = matrix.budgeted_negatives(pos, boxes, attempts_per_negative=10).collect()
    by = {s: [r for r in got if r.state == s] for s in "AB"}
    assert len(by["B"]) == 15 and {r.event_date for r in by["B"]} == {"2002-02-02"}
    assert 0 < len(by["A"]) < 1200 and max(r.attempt for r in by["A"]) < 400 * 30
    for r in by["A"]:
        assert min((r.latitude - y) ** 2 + (r.longitude - x) ** 2 for _, _, y, x, _ in crowd) ** 0.5 >= 0.05
    for s in "AB":
        order = sorted(by[s], key=lambda r: r.attempt)
        assert [r.number for r in order] == list(range(len(order)))
    assert len({r.event_date for r in by["A"]}) > 3
