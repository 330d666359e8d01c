"""Many rasters, and stored models of all areas: grid, points, attribution and scenarios."""

from pyspark.sql import functions as F

from scarpline import vocab
from scarpline.operators import aoi, catalog, ensembles, matrix, models, raster, rasters
from scarpline.plans import grid, model_runs, training
from scarpline.session import scratch_path, through_table

from . import q_matrix, q_models, q_rain
from .fixtures import oracle, rnd
from .q_raster import FULL, GROUP, NINE_NAMES, TPI, ROUGH, SLOPE, ASPECT, r6
from .registry import query

STEP = 0.05  # degrees of a grid cell
REFIT_TREES = 20  # rounds of the models that are fitted twice only to be compared


# --- terrain, places and samples over many rasters ---------------------------------------------

def terrain_table(fx):
    """The terrain of all rasters, written once."""
    wide = rasters.terrain(fx.cells, fx.georef)
    return through_table(wide.withColumns({n: r6(F.col(n)) for n in ("slope", "aspect", "tpi")}), "terrains")


def _nine():
    picks, joins = [], []
    for dr, r in ((-1, "n"), (0, "c"), (1, "s")):
        for dc, c in ((-1, "w"), (0, "c"), (1, "e")):
            t = f"{r}{c}"
            joins.append(f"LEFT JOIN z {t} ON {t}.raster_id = z.raster_id AND {t}.row_idx = least(greatest(z.row_idx + {dr}, 0), m.r1) AND {t}.col_idx = least(greatest(z.col_idx + {dc}, 0), m.c1)")
            picks.append(f"{t}.elevation AS {t}")
    return f"SELECT z.raster_id, z.row_idx, z.col_idx, z.elevation, m.metres, {', '.join(picks)} FROM z JOIN ext m ON m.raster_id = z.raster_id " + " ".join(joins)


RRC = "raster_id, row_idx, col_idx"
EXT = """
SELECT *, abs(res) * 111000e0 * cos(radians(north - (r0 + r1 + 1) * (res / 2))) AS metres FROM (
 SELECT raster_id, min(row_idx) AS r0, max(row_idx) AS r1, min(col_idx) AS c0, max(col_idx) AS c1 FROM fx_cells GROUP BY raster_id) JOIN fx_georef USING (raster_id)"""
GRAD = f"""
SELECT *, CASE WHEN {FULL} THEN ((ne + 2 * ce + se) - (nw + 2 * cw + sw)) / (8 * metres) END AS dz_dx, CASE WHEN {FULL} THEN ((sw + 2 * sc + se) - (nw + 2 * nc + ne)) / (8 * metres) END AS dz_dy FROM nine"""
TERRAINS = dict(
    ext=EXT, z=f"SELECT {RRC}, CASE WHEN elevation = -9999 THEN NULL ELSE elevation END AS elevation FROM fx_cells", nine=_nine(), g=GRAD,
    t=f"SELECT {RRC}, elevation, {SLOPE} AS slope, {ASPECT} AS aspect, {ROUGH} AS roughness, {TPI} AS tpi, elevation IS NOT NULL AND {FULL} AS ok FROM g",
)
NAMES = vocab.TERRAIN_FEATURES


def sampled_ctes(points):
    """Best terrain `bt` and land cover `bl` per key of a CTE with key, state, latitude, longitude."""
    place = f"""
SELECT * FROM (SELECT p.key, e.raster_id, e.priority, CAST(floor((e.north - p.latitude) / e.res) AS INT) AS row_idx, CAST(floor((p.longitude - e.west) / e.res) AS INT) AS col_idx, r0, r1, c0, c1
 FROM {points} p JOIN ext e ON e.state IS NULL OR e.state = p.state) WHERE row_idx BETWEEN r0 AND r1 AND col_idx BETWEEN c0 AND c1"""
    best = """
SELECT * FROM (SELECT pl.key, pl.raster_id, %s, t.raster_id IS NOT NULL AS hit, coalesce(t.ok, false) AS ok,
  row_number() OVER (PARTITION BY pl.key ORDER BY CASE WHEN t.ok THEN 0 ELSE 1 END, pl.priority, pl.raster_id) AS rn
 FROM pl LEFT JOIN t ON t.raster_id = pl.raster_id AND t.row_idx = pl.row_idx AND t.col_idx = pl.col_idx) WHERE rn = 1""" % ", ".join(f"t.{n}" for n in NAMES)
    cover = f"""
SELECT * FROM (SELECT key, grp, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN grp = -1 THEN 1 ELSE 0 END, priority, raster_id) AS rn
 FROM (SELECT pl.key, pl.priority, pl.raster_id, {GROUP} AS grp FROM pl JOIN fx_covers l ON l.raster_id = pl.raster_id AND l.row_idx = pl.row_idx AND l.col_idx = pl.col_idx)) WHERE rn = 1"""
    return dict(pl=place, bt=best, bl=cover)


WHY = "CASE WHEN b.key IS NULL THEN 'point is outside every raster' WHEN NOT b.hit THEN 'no raster has a cell here' ELSE concat_ws('; ', " + ", ".join(
    f"CASE WHEN b.{n} IS NULL THEN '{n} is nodata or not finite' END" for n in NAMES) + ") END"
EVENT_POINTS = "SELECT state || '-' || CAST(event_id AS STRING) AS key, state, latitude, longitude FROM pos"
POSITIVE_CTES = {k: q_matrix.NEGATIVE_CTES[k] for k in ("first", "pos")}
AREA_VIEWS = ("fx_events", "fx_cells", "fx_covers", "fx_georef")


def event_points(fx):
    return q_matrix.positives(fx).select(F.concat_ws("-", "state", F.col("event_id").cast("string")).alias("key"), "state", "latitude", "longitude")


@query("raster_sample_many", oracle(f"""
SELECT p.key, {', '.join(f'CASE WHEN b.ok THEN b.{n} END AS {n}' for n in NAMES)}, CASE WHEN b.ok THEN b.raster_id END AS raster_id, CASE WHEN b.ok THEN 'REAL' ELSE 'UNAVAILABLE' END AS status, {WHY} AS reasons
FROM pts p LEFT JOIN bt b ON b.key = p.key""", *AREA_VIEWS, **POSITIVE_CTES, **TERRAINS, pts=EVENT_POINTS, **sampled_ctes("pts")))
def raster_sample_many(fx):
    """Terrain at every event from five rasters of different origin and resolution."""
    return rasters.sample(event_points(fx), "key", terrain_table(fx), fx.georef).drop("state", "latitude", "longitude")


@query("landcover_sample_many", oracle("""
SELECT p.key, coalesce(b.grp, -1) AS land_cover_class, coalesce(b.grp, -1) = -1 AS land_cover_unavailable FROM pts p LEFT JOIN bl b ON b.key = p.key""", *AREA_VIEWS, **POSITIVE_CTES, **TERRAINS, pts=EVENT_POINTS, **sampled_ctes("pts")))
def landcover_sample_many(fx):
    return rasters.landcover(event_points(fx), "key", fx.covers, fx.georef).drop("state", "latitude", "longitude")


TILED = """
SELECT raster_id, row_idx, col_idx, elevation, 2 AS tile_order FROM {c} WHERE col_idx <= 24
UNION ALL SELECT raster_id, row_idx, col_idx, elevation + 1e0, 1 + 2 * (raster_id % 2) FROM {c} WHERE col_idx >= 16"""


@query("dem_mosaic_many", oracle("""
SELECT raster_id, row_idx, col_idx, elevation FROM (SELECT *, row_number() OVER (PARTITION BY raster_id, row_idx, col_idx ORDER BY tile_order) AS rn FROM tiles) WHERE rn = 1""",
    "fx_cells", tiles=TILED.format(c="fx_cells")))
def dem_mosaic_many(fx):
    """Overlapping tiles of several rasters, each raster with its own order of tiles."""
    return raster.dem_mosaic(fx.sql(TILED, c=fx.cells), by=(rasters.ID,))


# --- stored models over the grid of every area ---------------------------------------------------

def area_boxes(fx):
    """The extent of each area's own raster, so the grid grows with the rasters."""
    return rasters.bounds(fx.georef, fx.cells).where("state IS NOT NULL").select("state", *matrix.BOX)


def area_cells(fx, wide=None):
    rain = q_models.state_rain(fx)
    cells = grid.area_features(area_boxes(fx), terrain_table(fx) if wide is None else wide, fx.covers, fx.georef, rain, STEP)
    return matrix.cast_features(cells)


F32 = lambda e: f"CAST(CAST({e} AS FLOAT) AS DOUBLE)"
RAIN_CTES = dict(
    sd=q_models.STATE_DAILY.format(d="fx_rain_daily"), sr="SELECT state AS cell_id, day, mm FROM sd",
    sq=f"SELECT DISTINCT state AS cell_id, DATE '{q_models.TARGET_DAY}' AS target_day FROM fx_georef WHERE state IS NOT NULL",
    w=q_rain.window_sql("sq", source="sr"),
)
GRID = f"""
SELECT state || '/' || cell_id AS key, * FROM (SELECT state, printf('r%02dc%02d', r, c) AS cell_id, {rnd('lo_a + h * 0.5e0', 6)} AS latitude, {rnd('lo_o + wd * 0.5e0', 6)} AS longitude FROM (
 SELECT state, h, wd, r.v AS r, c.v AS c, min_lat + r.v * h AS lo_a, min_lon + c.v * wd AS lo_o FROM (
  SELECT *, (max_lat - min_lat) / n_lat AS h, (max_lon - min_lon) / n_lon AS wd FROM (
   SELECT *, greatest(round_even((max_lat - min_lat) / {STEP}e0, 0), 1) AS n_lat, greatest(round_even((max_lon - min_lon) / {STEP}e0, 0), 1) AS n_lon FROM (
    SELECT state, north - (r1 + 1) * res AS min_lat, north - r0 * res AS max_lat, west + c0 * res AS min_lon, west + (c1 + 1) * res AS max_lon FROM ext WHERE state IS NOT NULL))) b,
  (SELECT unnest(range(0, 3000)) AS v) r, (SELECT unnest(range(0, 100)) AS v) c WHERE r.v < n_lat AND c.v < n_lon))"""
PROXY = "CASE WHEN b.elevation < 3000 THEN 1 WHEN b.elevation < 4200 THEN 2 ELSE 3 END"
RAIN_WHY = "CASE WHEN w.cell_id IS NULL THEN 'no rainfall for this area' WHEN w.rain_status <> 'REAL' THEN w.rain_reasons END"


def feature_sql(cover, why):
    return f"""
SELECT *, CASE WHEN reasons = '' THEN 'OK' ELSE 'UNAVAILABLE' END AS status FROM (SELECT p.*, {', '.join(f"{F32(f'CASE WHEN b.ok THEN b.{n} END')} AS {n}" for n in NAMES)}, {cover} AS land_cover_class,
 {', '.join(f"{F32('w.' + n)} AS {n}" for n in vocab.RAIN_FEATURES)}, {why} AS reasons
FROM pts p LEFT JOIN bt b ON b.key = p.key LEFT JOIN bl l ON l.key = p.key LEFT JOIN w ON w.cell_id = p.state)"""


GRID_COVER = f"CASE WHEN p.state = 'Sikkim' THEN CASE WHEN b.ok THEN {PROXY} END ELSE nullif(l.grp, -1) END"
GRID_WHY = f"concat_ws('; ', nullif({WHY}, ''), CASE WHEN p.state <> 'Sikkim' AND coalesce(l.grp, -1) = -1 THEN 'land cover unavailable' END, {RAIN_WHY})"
GRID_CTES = dict(**TERRAINS, pts=GRID, **sampled_ctes("pts"), **RAIN_CTES, ft=feature_sql(GRID_COVER, GRID_WHY))
GRID_VIEWS = ("fx_cells", "fx_covers", "fx_georef", "fx_rain_daily")
LEFT = "CASE n.feature " + " ".join(
    f"WHEN '{f}' THEN " + (f"(n.mask >> f.{f}) & 1 = 1" if f == vocab.LAND_COVER_FEATURE else f"f.{f} <= n.cut") for f in vocab.MODEL_FEATURES) + " END"


def walk_ctes(rows="ft"):
    """Three splits down every tree of each OK row's own area: `steps` and the probability `pb`."""
    at0 = f"SELECT f.*, n.tree, n.weight, n.feature AS split, n.value AS v, CASE WHEN {LEFT} THEN n.left ELSE n.right END AS nxt FROM (SELECT * FROM {rows} WHERE status = 'OK') f JOIN fx_trees n ON n.key = f.state AND n.node = 0"
    level = lambda i: f"""SELECT f.* EXCLUDE (tree, weight, split, v, nxt), n.tree, n.weight, f.split AS came, (n.value - f.v) * n.weight AS moved, n.value AS v, n.feature AS split, CASE WHEN n.left IS NOT NULL THEN CASE WHEN {LEFT} THEN n.left ELSE n.right END END AS nxt
FROM {'at0' if i == 1 else f'(SELECT * EXCLUDE (came, moved) FROM at{i - 1})'} f JOIN fx_trees n ON n.key = f.state AND n.tree = f.tree AND n.node = f.nxt"""
    return dict(at0=at0, at1=level(1), at2=level(2), at3=level(3), pb="SELECT key, 1 / (1 + exp(-2 * sum(v * weight))) AS p FROM at3 GROUP BY key")


CLASS = "CASE WHEN p >= 0.85 THEN 'EXTREME' WHEN p >= 0.65 THEN 'HIGH' WHEN p >= 0.4 THEN 'MEDIUM' WHEN p IS NOT NULL THEN 'LOW' END"


@query("grid_score", oracle(f"""
SELECT state, cell_id, latitude, longitude, status, {rnd('p', 6)} AS susceptibility_probability, {CLASS} AS risk_class, p >= 0.5 AS exceeds_decision_threshold, reasons FROM ft LEFT JOIN pb USING (key)""",
    *GRID_VIEWS, "fx_trees", **GRID_CTES, **walk_ctes()))
def grid_score(fx):
    """The cells of every state, each by its own state's stored model, in one scan."""
    scored = ensembles.score(area_cells(fx), fx.trees, vocab.MODEL_FEATURES)
    return grid.with_classes(scored).select(
        "state", "cell_id", "latitude", "longitude", "status", "susceptibility_probability", "risk_class", "exceeds_decision_threshold", "reasons"
    )


POINTS = """
SELECT *, CAST(event_id AS STRING) AS key, CASE WHEN len(c) = 1 THEN c[1] END AS state, CASE len(c) WHEN 0 THEN 'OUTSIDE' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS state_status,
 CASE len(c) WHEN 0 THEN 'no box contains the point' WHEN 1 THEN NULL ELSE 'several boxes contain the point; name a state' END AS state_reasons
FROM (SELECT event_id, latitude, longitude, coalesce((SELECT list(state ORDER BY state) FROM fx_aoi WHERE kind = 'pilot' AND e.latitude BETWEEN min_lat AND max_lat AND e.longitude BETWEEN min_lon AND max_lon), []) AS c FROM fx_events e)"""
POINT_WHY = f"concat_ws('; ', p.state_reasons, nullif({WHY}, ''), CASE WHEN coalesce(l.grp, -1) = -1 THEN 'land cover unavailable' END, {RAIN_WHY})"


@query("point_score", oracle(f"""
SELECT event_id, state, state_status, status, {rnd('p', 6)} AS susceptibility_probability, {CLASS} AS risk_class, reasons FROM ft LEFT JOIN pb USING (key)""",
    *AREA_VIEWS, "fx_rain_daily", "fx_trees", **TERRAINS, pts=POINTS, **sampled_ctes("pts"), **RAIN_CTES, ft=feature_sql("nullif(l.grp, -1)", POINT_WHY), **walk_ctes()))
def point_score(fx):
    """Every event as a point: its state resolved, its state's stored model applied, one scan."""
    resolved = aoi.point_in_aoi(
        fx.events.select("event_id", "latitude", "longitude"), fx.pilots.select("state", "min_lat", "max_lat", "min_lon", "max_lon"), fx.state_aliases, "event_id"
    ).withColumnsRenamed({"status": "state_status", "reasons": "state_reasons"})
    ready = grid.point_features(resolved, "event_id", terrain_table(fx), fx.covers, fx.georef, q_models.state_rain(fx))
    scored = ensembles.score(matrix.cast_features(ready), fx.trees, vocab.MODEL_FEATURES)
    return grid.with_classes(scored).select("event_id", "state", "state_status", "status", "susceptibility_probability", "risk_class", "reasons")


@query("grid_score_linear", oracle(f"""
SELECT state, cell_id, status, {rnd('p', 6)} AS susceptibility_probability FROM (SELECT f.*, CASE WHEN status = 'OK' THEN 1 / (1 + exp(-(b.w + {' + '.join(f'f.{n} * w{i}' for i, n in enumerate(vocab.MODEL_FEATURES))}))) END AS p FROM ft f
 JOIN (SELECT key AS state, {', '.join(f"sum(weight) FILTER (WHERE feature = '{n}') AS w{i}" for i, n in enumerate(vocab.MODEL_FEATURES))}, sum(weight) FILTER (WHERE feature IS NULL) AS w FROM fx_terms GROUP BY key) b USING (state))""",
    *GRID_VIEWS, "fx_terms", **GRID_CTES))
def grid_score_linear(fx):
    """The same cells by stored logistic models, one join on the state."""
    scored = ensembles.score_linear(area_cells(fx), fx.terms, vocab.MODEL_FEATURES)
    return grid.with_classes(scored).select("state", "cell_id", "status", "susceptibility_probability")


MOVED = "SELECT key, state, came AS feature, sum(moved) AS c FROM (SELECT key, state, came, moved FROM at1 UNION ALL SELECT key, state, came, moved FROM at2 UNION ALL SELECT key, state, came, moved FROM at3) GROUP BY ALL"
NAMED = "SELECT unnest([" + ", ".join(f"'{f}'" for f in vocab.MODEL_FEATURES) + "]) AS feature"
LINEAR = "\nUNION ALL ".join(
    f"SELECT state, '{n}' AS feature, avg(abs((f.{n} - m) * w)) AS importance FROM (SELECT state, {n}, avg(CAST({n} AS DOUBLE)) OVER (PARTITION BY state) AS m FROM ft WHERE status = 'OK') f JOIN (SELECT key AS state, weight AS w FROM fx_terms WHERE feature = '{n}') USING (state) GROUP BY state"
    for n in vocab.MODEL_FEATURES)


@query("feature_attribution", oracle(f"""
SELECT 'trees' AS kind, 'REAL' AS status, s.state, n.feature, {rnd('coalesce(sum(abs(m.c)), 0) / any_value(s.n)', 5)} AS importance, CAST(NULL AS STRING) AS reason
FROM (SELECT state, count(*) AS n FROM ft WHERE status = 'OK' GROUP BY state) s CROSS JOIN nm n LEFT JOIN mv m ON m.state = s.state AND m.feature = n.feature GROUP BY s.state, n.feature
UNION ALL SELECT 'linear', 'REAL', state, feature, {rnd('importance', 5)}, NULL FROM ln
UNION ALL SELECT 'none', 'UNAVAILABLE', NULL, NULL, NULL, 'no model was supplied'""", *GRID_VIEWS, "fx_trees", "fx_terms", **GRID_CTES, **walk_ctes(), mv=MOVED, nm=NAMED, ln=LINEAR))
def feature_attribution(fx):
    """Mean absolute contribution per state: path differences for trees, the exact formula for linear models."""
    cells = through_table(area_cells(fx).where("status = 'OK'").select("state", *vocab.MODEL_FEATURES), "attributed")
    ranked = ensembles.attribution(cells, fx.trees, vocab.MODEL_FEATURES).withColumn("kind", F.lit("trees")).unionByName(
        ensembles.attribution(cells, fx.terms, vocab.MODEL_FEATURES).withColumn("kind", F.lit("linear"))
    ).unionByName(ensembles.attribution(cells, None, vocab.MODEL_FEATURES).withColumn("kind", F.lit("none")))
    return ranked.select("kind", "status", "state", "feature", (F.rint(F.col("importance") * 1e5) / 1e5).alias("importance"), "reason")


SCENARIO_ROWS = "SELECT f.* EXCLUDE (key, " + ", ".join(vocab.RAIN_FEATURES) + "), key || '#' || s.scenario AS key, s.scenario, " + ", ".join(
    f"{F32(f's.mm * {k}')} AS {n}" for n, k in (("rain_1d", 1), ("rain_3d", 3), ("rain_7d", 7), ("antecedent_rain_14d", 14), ("rain_intensity_max_3d", 1))
) + " FROM ft f, (VALUES ('low', 1e0), ('high', 90e0)) AS s(scenario, mm)"
OKP = "p IS NOT NULL"


@query("scenario_compare", oracle(f"""
SELECT *, 0 AS static_rows_that_differ, count(*) OVER () > 1 AND (min(max_probability) OVER () <> max(max_probability) OVER () OR min(mean_probability) OVER () <> max(mean_probability) OVER ()) AS output_moved FROM (
 SELECT scenario, count(*) AS cells_total, count(*) FILTER (WHERE {OKP}) AS cells_scored, count(*) FILTER (WHERE status <> 'OK') AS cells_unavailable, count(*) FILTER (WHERE p >= 0.85) AS n_extreme, count(*) FILTER (WHERE p >= 0.65 AND p < 0.85) AS n_high,
 count(*) FILTER (WHERE p >= 0.4 AND p < 0.65) AS n_medium, count(*) FILTER (WHERE p < 0.4) AS n_low, count(*) FILTER (WHERE p >= 0.5) AS cells_exceeding_threshold, {rnd('max(p)', 6)} AS max_probability,
 {rnd('CAST(sum(CAST(round_even(p * 1e6, 0) AS BIGINT)) AS DOUBLE) / 1e6 / nullif(count(p), 0)', 6)} AS mean_probability FROM sc LEFT JOIN pb USING (key) GROUP BY scenario)""",
    *GRID_VIEWS, "fx_trees", **GRID_CTES, sc=SCENARIO_ROWS, **walk_ctes("sc")))
def scenario_compare(fx):
    """Low and high rain over the same cells, each cell read and placed once.

    A scenario is a second score of the same row, so no other column can differ.
    """
    scored = ensembles.score_scenarios(area_cells(fx), fx.trees, vocab.MODEL_FEATURES)
    each = scored.select("status", F.inline("scenarios"))
    summary = through_table(grid.grid_summary(each, ["scenario"]), "scenarios")
    moved = summary.agg(F.count_distinct("mean_probability", "max_probability")).scalar()
    return summary.withColumns({"static_rows_that_differ": F.lit(0), "output_moved": moved > 1})


# --- training over all areas ----------------------------------------------------------------------

CUTOFF = 1995  # the last training year of the temporal holdout


def labelled(fx):
    """The complete rows of the training matrix of every state, written once."""
    rows = training.area_matrix(q_matrix.positives(fx), fx.pilots, terrain_table(fx), fx.covers, fx.georef, fx.rain_daily, q_models.rain_key)
    ready = models.clean_for_training(rows).withColumn("event_date", catalog.parse_date("event_date"))
    return through_table(ready.select("sample_id", "state", "target", "latitude", "event_date", *vocab.MODEL_FEATURES), "labelled")


KEYED = "SELECT *, sample_id AS key, CAST(seed % 30 AS INT) AS cell_id, DATE '2024-01-15' + CAST(seed % 14 AS INT) AS target_day FROM samples"
LABELLED = f"""
SELECT p.sample_id, p.state, p.target, p.latitude, p.event_date, {', '.join(f"CASE WHEN b.ok THEN b.{n} END AS {n}" for n in NAMES)}, coalesce(l.grp, -1) AS land_cover_class, w.rain_1d
FROM pts p JOIN bt b ON b.key = p.key JOIN bl l ON l.key = p.key JOIN w ON w.cell_id = p.cell_id AND w.target_day = p.target_day WHERE b.ok AND l.grp <> -1 AND w.rain_status = 'REAL'"""
LABELLED_CTES = dict(**q_matrix.NEGATIVE_CTES, **TERRAINS, samples=q_models.SAMPLES, pts=KEYED, **sampled_ctes("pts"), w=q_rain.window_sql("pts"), m=LABELLED)


@query("labelled_areas", oracle("""
SELECT sample_id, state, CAST(target AS BIGINT) AS target, latitude, CAST(elevation AS FLOAT) AS elevation, CAST(slope AS FLOAT) AS slope, CAST(roughness AS FLOAT) AS roughness, CAST(land_cover_class AS INT) AS land_cover_class, CAST(rain_1d AS FLOAT) AS rain_1d FROM m""", *AREA_VIEWS, "fx_rain_daily", **LABELLED_CTES))
def labelled_areas(fx):
    """What the models of all states learn from: complete rows, terrain from many rasters."""
    return labelled(fx).select("sample_id", "state", "target", "latitude", "elevation", "slope", "roughness", "land_cover_class", "rain_1d")


@query("train_baselines")
def train_baselines(fx):
    """Metrics of three models on two feature sets and two holdouts, for every state."""
    splits = model_runs.holdouts(labelled(fx), CUTOFF)
    return model_runs.metrics_frame(fx.spark, model_runs.baselines(splits, q_models.TREES))


@query("refit_consistency", oracle(f"""
SELECT r.state, '{models.PRIMARY}' AS model, 'temporal / static+rain' AS primary_evaluation, r.samples, r.positives, {rnd('l.low', 6)} AS pct_low_accuracy, l.dates AS independent_events, 11 AS n_features, true AS measured, true AS scored_alike FROM (
 SELECT state, count(*) AS samples, count(*) FILTER (WHERE target = 1) AS positives, count(DISTINCT target) FILTER (WHERE y <= {CUTOFF}) + count(DISTINCT target) FILTER (WHERE y > {CUTOFF}) AS sides FROM (SELECT *, year(CAST(event_date AS DATE)) AS y FROM m) GROUP BY state) r
JOIN (SELECT state, count(*) FILTER (WHERE event_id % 3 = 0) * 100e0 / count(*) AS low, count(DISTINCT CAST(event_date AS DATE)) AS dates FROM pos GROUP BY state) l USING (state) WHERE r.sides = 4""", *AREA_VIEWS, "fx_rain_daily", **LABELLED_CTES))
def refit_consistency(fx):
    """Train, decide, refit, save, reload and record; then score by the saved models' node table.

    A record exists only where the reloaded refit reproduced the reported numbers, so the row of
    every state that can be trained says that its model did. The models are the primary ones.
    """
    data = labelled(fx)
    positives = q_matrix.positives(fx).withColumn("low_accuracy", F.col("event_id") % 3 == 0)
    sets = {model_runs.PRIMARY_SET: vocab.MODEL_FEATURES}
    _, saved, records = model_runs.train_decide_record(
        data, positives, scratch_path(fx.spark, "records"), None, CUTOFF, REFIT_TREES, names=(models.PRIMARY,), sets=sets)
    stored = data.where("false").withColumns({"direct": F.lit(None).cast("double"), "stored": F.lit(None).cast("double")})
    direct = stored.drop("stored")
    for state, folder in sorted(saved.items()):  # the table against the model itself, state by state
        direct = direct.unionByName(models.score(ensembles.load(folder), data.where(F.col("state") == state), "direct").select(direct.columns))
    both = stored
    if saved:
        nodes = through_table(ensembles.node_table(fx.spark, saved, vocab.MODEL_FEATURES), "nodes")
        both = direct.withColumn("stored", ensembles.probability(fx.spark, nodes, "state", vocab.MODEL_FEATURES))
    worst = both.groupBy("state").agg((F.max(F.abs(F.col("stored") - F.col("direct"))) < 1e-9).alias("scored_alike"))
    measured = F.col("pr_auc").between(0, 1) & F.col("roc_auc").between(0, 1) & F.col("final_recommendation").isNotNull()
    return records.join(worst, "state").select(
        "state", "model", "primary_evaluation", "samples", "positives", (F.rint(F.col("pct_low_accuracy") * 1e6) / 1e6).alias("pct_low_accuracy"),
        "independent_events", "n_features", measured.alias("measured"), "scored_alike",
    )
