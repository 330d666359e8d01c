"""Documents, evidence, availability, decisions, reports and their files."""

from pyspark.sql import functions as F

from scarpline import vocab
from scarpline.operators import status
from scarpline.plans import sweep
from scarpline.session import scratch_path
from scarpline.sources import documents

from . import q_catalog
from .fixtures import FEATURES_OK, oracle
from .registry import query

REQUIRED = vocab.MODEL_FEATURES
REQ = "[" + ", ".join(f"'{f}'" for f in REQUIRED) + "]"
JSON_TEXT = """'{"validation_metrics": {"PR-AUC": ' || pr_text || ', "ROC-AUC": ' || roc_text || '}, "metrics_source": "' || metrics_source || '", "primary_model": "gbt", "internal_path": "x"}'"""


def runs(fx):
    return fx.runs.withColumn("metrics_json", F.expr(JSON_TEXT))


@query("column_presence", oracle(f"""
SELECT run_id, concat_ws('; ', CASE WHEN len(m) > 0 THEN 'missing: ' || array_to_string(m, ', ') END, CASE WHEN len(feature_names) <> len(list_distinct(feature_names)) THEN 'duplicate names' END) AS problems
FROM (SELECT *, list_filter({REQ}, lambda x: NOT list_contains(feature_names, x)) AS m FROM fx_runs)""", "fx_runs"))
def column_presence(fx):
    return fx.runs.select("run_id", status.column_presence("feature_names", REQUIRED).alias("problems"))


@query("feature_order_guard", oracle(f"SELECT run_id, array_to_string(feature_names, ',') = '{FEATURES_OK}' AS usable FROM fx_runs", "fx_runs"))
def feature_order_guard(fx):
    return fx.runs.select("run_id", status.feature_order_matches("feature_names").alias("usable"))


SCHEMA_PROBLEMS = """concat_ws('; ', CASE WHEN len(feature_names) <> len(list_distinct(feature_names)) THEN 'feature_names contains duplicates' END, CASE WHEN coalesce(n_features, -1) <> len(feature_names) THEN 'n_features does not match' END,
 CASE WHEN len(u) > 0 THEN 'not documented: ' || array_to_string(u, ', ') END)"""


@query("evidence_projection", oracle(f"""
SELECT run_id, CASE WHEN NOT has_model OR NOT has_schema THEN 'MISSING' WHEN p <> '' THEN 'INVALID' ELSE 'VALID' END AS verdict, p AS problems, CASE WHEN pr_text <> 'NaN' THEN metrics_source END AS metrics_source, CASE WHEN pr_text <> 'NaN' THEN 'gbt' END AS primary_model
FROM (SELECT *, {SCHEMA_PROBLEMS} AS p FROM (SELECT *, list_filter(list_distinct(feature_names), lambda x: NOT list_contains(documented, x)) AS u FROM fx_runs))""", "fx_runs"))
def evidence_projection(fx):
    doc = F.try_parse_json("metrics_json")
    missing = F.array_compact(F.array(F.when(~F.col("has_model"), "model"), F.when(~F.col("has_schema"), "schema")))
    problems = status.schema_problems("feature_names", "n_features", "documented")
    return runs(fx).select(
        "run_id", status.document_verdict(missing, problems).alias("verdict"), problems.alias("problems"),
        F.try_variant_get(doc, "$.metrics_source", "string").alias("metrics_source"), F.try_variant_get(doc, "$.primary_model", "string").alias("primary_model"),
    )


NOT_NUMBER = "pr_text IN ('true', '\"0.7\"', 'null')"
GATE = f"""
SELECT *, problems = '' AS complete FROM (SELECT *, concat_ws('; ', CASE WHEN NOT has_model THEN 'model artifact missing' END, CASE WHEN NOT has_schema THEN 'schema artifact missing' END, CASE WHEN pr_text = 'NaN' THEN 'metrics document unreadable' END,
 CASE WHEN {NOT_NUMBER} THEN 'PR-AUC is not a finite number' END, CASE WHEN pr_text <> 'NaN' AND metrics_source <> 'computed_from_validation_run' THEN 'metrics source not certified' END, CASE WHEN pr_text = '0.7762' AND roc_text = '0.919' THEN 'identical to quarantined historical figures' END) AS problems FROM fx_runs)"""


@query("evidence_gate", oracle("SELECT run_id, complete, problems, CASE WHEN complete THEN CAST(pr_text AS DOUBLE) END AS pr_auc, CASE WHEN complete THEN CAST(roc_text AS DOUBLE) END AS roc_auc FROM gate", "fx_runs", gate=GATE))
def evidence_gate(fx):
    return status.evidence_gate(runs(fx)).select("run_id", "complete", "problems", "pr_auc", "roc_auc")


@query("bundle_consistency", oracle("""
SELECT *, problems = '' AS consistent FROM (SELECT run_id, concat_ws('; ', CASE WHEN feature_names <> provenance_features THEN 'feature lists disagree' END, CASE WHEN rain_word = 'GUESSED' THEN 'input status outside the vocabulary' END, CASE WHEN trim(model_type) = '' THEN 'model_type is missing or empty' END) AS problems FROM fx_runs)""", "fx_runs"))
def bundle_consistency(fx):
    bundle = fx.runs.select(
        "run_id", F.col("feature_names").alias("schema_features"), "provenance_features", "model_type",
        F.create_map(F.lit("dem"), F.lit("REAL"), F.lit("rainfall"), F.col("rain_word")).alias("input_status"),
    )
    return status.bundle_consistency(bundle).select("run_id", "problems", "consistent")


AVAIL = """
SELECT a.state, CASE WHEN max(f.length) FILTER (WHERE f.kind = 'dem') > 1000 THEN 'Available' ELSE 'Missing (Requires Download)' END AS dem_status, CASE WHEN max(f.length) FILTER (WHERE f.kind = 'exposure') > 100 THEN 'Available' ELSE 'Missing (Requires Download)' END AS exposure_status,
 CASE WHEN max(f.length) FILTER (WHERE f.kind = 'rainfall') > 0 THEN 'Authenticated (Satellite IMERG)' ELSE 'Unavailable (no login for the satellite archive)' END AS rainfall_status
FROM fx_aoi a LEFT JOIN fx_files f ON f.state = a.state WHERE a.kind = 'admin' GROUP BY a.state"""


@query("availability", oracle("SELECT * FROM av", "fx_files", av=AVAIL))
def availability(fx):
    return status.availability(fx.admins, fx.files)


@query("artifact_plan", oracle("""
SELECT state, array_to_string(m, '; ') AS missing, CASE WHEN len(m) = 0 THEN 'skip' WHEN list_contains(m, 'elevation') THEN 'acquire_dem_and_derivatives' ELSE 'derivatives_only' END AS action
FROM (SELECT a.state, coalesce(list(t.feature ORDER BY t.feature) FILTER (WHERE NOT EXISTS (SELECT 1 FROM fx_files f WHERE f.state = a.state AND f.feature = t.feature AND f.length > 0)), []) AS m
 FROM fx_aoi a, (VALUES ('elevation'), ('slope'), ('aspect'), ('roughness'), ('tpi')) AS t(feature) WHERE a.kind = 'admin' GROUP BY a.state)""", "fx_files"))
def artifact_plan(fx):
    return status.artifact_plan(fx.admins, vocab.TERRAIN_FEATURES, fx.files)


DEC_IN = """
SELECT run_id, state, run_id % 3 = 0 AS is_pilot, CASE WHEN run_id % 5 = 0 THEN 'Missing (Requires Download)' ELSE 'Available' END AS dem_status, CASE WHEN run_id % 7 = 0 THEN 'Missing (Requires Download)' ELSE 'Available' END AS exposure_status,
 CASE run_id % 11 WHEN 0 THEN 'Unauthenticated' WHEN 1 THEN 'Unavailable (no login for the satellite archive)' ELSE 'Authenticated (Satellite IMERG)' END AS rainfall_status, CAST(run_id % 100 AS BIGINT) AS usable_events, has_model AND has_schema AS evidence_complete FROM {runs}"""


def decision_sql(source):
    p, c = "coalesce(is_pilot, false)", "coalesce(evidence_complete, false)"
    dem, osm, few = f"(NOT {p} AND dem_status <> 'Available')", f"(NOT {p} AND exposure_status <> 'Available')", f"(NOT {p} AND coalesce(usable_events, 0) < 50)"
    rain = f"(NOT {p} AND regexp_matches(rainfall_status, '^(Unauthenticated$|Missing|Unavailable)'))"
    return f"""
SELECT *, CASE WHEN {p} AND {c} THEN 'VALIDATED_PILOT' WHEN {p} THEN 'VALIDATION_REQUIRED' WHEN {dem} OR {osm} OR {rain} THEN 'DATA UNAVAILABLE' WHEN {few} THEN 'INSUFFICIENT DATA' ELSE 'VALIDATION IN PROGRESS' END AS overall_status,
 CASE WHEN {p} AND {c} THEN 'Trained & Validated' WHEN {p} THEN 'Validation Required (Persisted Model/Metrics Artifacts Absent)' WHEN {dem} OR {osm} OR {rain} OR {few} THEN 'Not Trained' ELSE 'Data Ready (Pending Training)' END AS model_status,
 concat_ws('; ', CASE WHEN {dem} THEN 'Missing DEM Data' END, CASE WHEN {osm} THEN 'Missing OSM Exposure Data' END, CASE WHEN {rain} THEN 'Missing Earthdata Credentials for IMERG' END, CASE WHEN {few} THEN 'Insufficient usable landslide events (' || CAST(coalesce(usable_events, 0) AS STRING) || ' < 50)' END,
  CASE WHEN {p} AND NOT {c} THEN 'Missing Persisted Validation Evidence (' || coalesce(missing_text, 'model') || ')' END) AS blocking_reasons FROM {source}"""


@query("status_decision", oracle("SELECT run_id, overall_status, model_status, blocking_reasons FROM d", "fx_runs",
    i=DEC_IN.format(runs="fx_runs"), j="SELECT *, 'model' AS missing_text FROM i", d=decision_sql("j")))
def status_decision(fx):
    rows = fx.sql(DEC_IN, runs=fx.runs).withColumn("evidence_missing", F.array(F.lit("model")))
    return status.status_decision(rows).select("run_id", "overall_status", "model_status", "blocking_reasons")


NEWEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY run_id DESC) AS rn FROM gate) WHERE rn = 1"
SWEEP_IN = """
SELECT a.state, a.is_pilot, q.inventory_events, q.usable_events, q.spatial_quality, q.temporal_quality, v.dem_status, v.exposure_status, v.rainfall_status, n.complete AS evidence_complete, n.problems AS missing_text, CASE WHEN n.complete THEN CAST(n.pr_text AS DOUBLE) END AS run_pr, CASE WHEN n.complete THEN CAST(n.roc_text AS DOUBLE) END AS run_roc
FROM fx_aoi a JOIN q ON q.state = a.state JOIN av v ON v.state = a.state LEFT JOIN newest n ON n.state = a.state WHERE a.kind = 'admin'"""
SWEEP_CTES = dict(ae=q_catalog.ADMIN_EVENTS, q=q_catalog.QUALITY, av=AVAIL, gate=GATE, newest=NEWEST, i=SWEEP_IN,
                  j="SELECT * REPLACE (replace(missing_text, '; ', ', ') AS missing_text) FROM i", d=decision_sql("j"))
SWEEP_COLUMNS = ["state", "is_pilot", "inventory_events", "usable_events", "spatial_quality", "temporal_quality", "dem_status", "exposure_status", "rainfall_status", "overall_status", "model_status", "blocking_reasons"]
SWEEP_SQL = f"SELECT {', '.join(SWEEP_COLUMNS)}, CASE WHEN overall_status = 'VALIDATED_PILOT' THEN run_pr END AS pr_auc, CASE WHEN overall_status = 'VALIDATED_PILOT' THEN run_roc END AS roc_auc FROM d"


def swept(fx):
    return sweep.state_sweep(fx.events, fx.admins, fx.files, runs(fx))


@query("state_sweep", oracle(SWEEP_SQL, "fx_events", "fx_files", "fx_runs", **SWEEP_CTES))
def state_sweep(fx):
    return swept(fx).select(*SWEEP_COLUMNS, "pr_auc", "roc_auc")


@query("state_report_sink", oracle("""
SELECT state, CASE WHEN state IN ('Mizoram', 'Tripura') THEN 'ERROR' ELSE 'COMPLETED' END AS processing_status, CASE WHEN state NOT IN ('Tripura') THEN overall_status END AS overall_status, CASE WHEN state NOT IN ('Tripura') THEN inventory_events END AS inventory_events,
 CASE state WHEN 'Mizoram' THEN 'disk full' WHEN 'Tripura' THEN 'no result for this state' END AS error FROM d""", "fx_events", "fx_files", "fx_runs", **SWEEP_CTES))
def state_report_sink(fx):
    failed = fx.spark.sql("SELECT 'Mizoram' AS state, 'disk full' AS error")
    reports = swept(fx).where("state <> 'Tripura'").select("state", "overall_status", "inventory_events", "blocking_reasons")
    path = scratch_path(fx.spark, "report")
    documents.write_json(status.with_error_rows(fx.admins, reports, failed), path)
    schema = "state STRING, processing_status STRING, overall_status STRING, inventory_events BIGINT, blocking_reasons ARRAY<STRING>, error STRING"
    return fx.spark.read.schema(schema).json(path).drop("blocking_reasons")


EVID = "SELECT s.state, CASE WHEN n.complete IS NULL THEN NULL ELSE n.complete END AS complete, n.problems FROM (SELECT DISTINCT state FROM fx_reports) s LEFT JOIN newest n ON n.state = s.state"


@query("evidence_downgrade", oracle("""
SELECT report_id, CASE WHEN low THEN 'VALIDATION_REQUIRED' ELSE overall_status END AS overall_status, CASE WHEN low THEN 'Validation Required (Persisted Model/Metrics Artifacts Absent)' ELSE model_status END AS model_status, CASE WHEN NOT low THEN pr_auc END AS pr_auc,
 CASE WHEN low THEN 'claim lowered: required evidence (' || coalesce(replace(problems, '; ', ', '), 'model, metrics, schema') || ') is absent; the stored record is unchanged' END AS reported_status_note
FROM (SELECT r.*, e.problems, (coalesce(r.overall_status = 'VALIDATED_PILOT', false) OR r.model_status = 'Trained & Validated') AND NOT coalesce(e.complete, false) AS low FROM fx_reports r LEFT JOIN evid e ON e.state = r.state)""",
    "fx_reports", "fx_runs", gate=GATE, newest=NEWEST, evid=EVID))
def evidence_downgrade(fx):
    evidence = sweep.latest_evidence(runs(fx)).select("state", F.col("evidence_complete").alias("complete"), F.col("evidence_missing").alias("missing"))
    return status.evidence_downgrade(fx.reports, evidence).select("report_id", "overall_status", "model_status", "pr_auc", "reported_status_note")


KEPT = "CASE WHEN report_id % 2 = 0 THEN 'Inventory is thin' END"


@query("evidence_refresh", oracle(f"""
SELECT report_id, dem AS dem_status, osm AS exposure_status, CASE WHEN done THEN 'Trained & Validated' ELSE 'Validation Required (Persisted Model/Metrics Artifacts Absent)' END AS model_status, CASE WHEN done THEN 'VALIDATED_PILOT' WHEN dem = 'Available' AND osm = 'Available' THEN 'VALIDATION_REQUIRED' ELSE 'DATA UNAVAILABLE' END AS overall_status,
 concat_ws('; ', {KEPT}, CASE WHEN dem <> 'Available' THEN 'Missing DEM Data' END, CASE WHEN osm <> 'Available' THEN 'Missing OSM Exposure Data' END, CASE WHEN NOT done THEN 'Missing Persisted Validation Evidence (' || coalesce(problems, 'model') || ')' END) AS blocking_reasons
FROM (SELECT r.report_id, CASE WHEN v.dem_status IS NULL THEN r.dem_status ELSE v.dem_status END AS dem, v.exposure_status AS osm, coalesce(n.complete, false) AS done, replace(n.problems, '; ', ', ') AS problems FROM fx_reports r LEFT JOIN av2 v ON v.state = r.state LEFT JOIN newest n ON n.state = r.state)""",
    "fx_reports", "fx_runs", "fx_files", av=AVAIL, av2="SELECT * REPLACE (CASE WHEN state = 'Manipur' THEN NULL ELSE dem_status END AS dem_status) FROM av", gate=GATE, newest=NEWEST))
def evidence_refresh(fx):
    have = status.availability(fx.admins, fx.files)
    # One state's DEM could not be checked: its stored word must survive.
    artifacts = have.join(sweep.latest_evidence(runs(fx)), "state", "left").select(
        "state", F.when(F.col("state") != "Manipur", F.col("dem_status") == "Available").alias("dem_available"), (F.col("exposure_status") == "Available").alias("exposure_available"), "evidence_complete", "evidence_missing",
    )
    stored = fx.reports.withColumn("blocking_reasons", F.array_compact(F.array(
        F.lit("Missing DEM Data"), F.expr(KEPT), F.lit("Missing Persisted Validation Evidence (old)"))))
    return status.evidence_refresh(stored, artifacts).select("report_id", "dem_status", "exposure_status", "model_status", "overall_status", "blocking_reasons")


JOINED = """
SELECT a.state, a.is_pilot, r.report_id, r.overall_status, r.inventory_events, CASE WHEN r.report_id IS NOT NULL AND r.overall_status IS NOT NULL THEN CASE WHEN contains(r.overall_status, 'VALIDATED_PILOT') THEN 'pilot' ELSE 'pending' END WHEN a.is_pilot THEN 'pilot' ELSE 'pending' END AS tone
FROM fx_aoi a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY state ORDER BY report_id DESC) AS rn FROM fx_reports) r ON r.state = a.state AND r.rn = 1 WHERE a.kind = 'admin'"""


def regions(fx):
    reports = fx.reports.select("report_id", "state_key", "overall_status", "inventory_events")
    return status.status_region_join(fx.admins.select("state", "is_pilot"), reports, "report_id")


@query("status_region_join", oracle("SELECT state, report_id, overall_status, inventory_events FROM j", "fx_reports", j=JOINED))
def status_region_join(fx):
    return regions(fx).select("state", "report_id", "overall_status", "inventory_events")


@query("region_ranking", oracle("SELECT state, tone, inventory_events FROM j ORDER BY tone = 'pilot' DESC, coalesce(inventory_events, 0) DESC, state", "fx_reports", j=JOINED))
def region_ranking(fx):
    return status.region_ranking(regions(fx)).select("state", "tone", "inventory_events")


@query("region_totals", oracle("SELECT count(*) FILTER (WHERE tone = 'pilot') AS validated, count(*) FILTER (WHERE tone <> 'pilot') AS pending, CAST(sum(coalesce(inventory_events, 0)) AS BIGINT) AS total_events FROM j", "fx_reports", j=JOINED))
def region_totals(fx):
    return status.region_totals(status.region_ranking(regions(fx)))


# --- files ------------------------------------------------------------------------------------

@query("file_integrity", oracle("""
SELECT 'cell_id=' || CAST(cell_id AS STRING) AS cell, CASE WHEN cell_id % 6 = 1 THEN 'no manifest entry' WHEN cell_id % 6 = 2 THEN 'size mismatch' WHEN cell_id % 6 = 3 THEN 'sha256 mismatch' ELSE 'ok' END AS verdict FROM (SELECT DISTINCT cell_id FROM fx_rain_daily)
UNION ALL SELECT 'ghost', 'no local file'""", "fx_rain_daily"))
def file_integrity(fx):
    """One file per rainfall cell, checked against a manifest with planted faults."""
    path = scratch_path(fx.spark, "files")
    lines = fx.rain_daily.select("cell_id", F.to_json(F.struct("day", "mm")).alias("value"))
    lines.repartition("cell_id").sortWithinPartitions("cell_id", "value").write.partitionBy("cell_id").text(path)
    # Spark names the file; the folder is the stable name.
    raw = documents.file_inventory(fx.spark, path, r"(cell_id=\d+)")
    n = F.regexp_extract("name", r"(\d+)$", 1).cast("int") % 6
    manifest = raw.where(n != 1).select(
        "name", (F.col("length") + F.when(n == 2, 1).otherwise(0)).alias("length"), F.when(n == 3, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")).alias("sha256")
    ).unionByName(fx.spark.sql("SELECT 'ghost' AS name, 10L AS length, sha2('g', 256) AS sha256"))
    return documents.file_integrity(raw, manifest).select(F.col("name").alias("cell"), "verdict")


@query("manifest_difference", oracle("""
SELECT CAST(file_id AS STRING) AS name, 'manifest' AS only_in FROM fx_files WHERE file_id % 8 = 2 AND file_id % 9 <> 4 UNION ALL SELECT CAST(file_id AS STRING), 'files' FROM fx_files WHERE file_id % 9 = 4 AND file_id % 8 <> 2""", "fx_files"))
def manifest_difference(fx):
    names = fx.files.withColumn("name", F.col("file_id").cast("string"))
    return documents.manifest_difference(names.where("file_id % 9 <> 4"), names.where("file_id % 8 <> 2"))


@query("static_identity", oracle("""
SELECT 'cell ' || CAST(p_partkey AS STRING) AS cell, p_size AS slope, 'first' AS only_in FROM part WHERE p_partkey % 50 = 7
UNION ALL SELECT 'cell ' || CAST(p_partkey AS STRING), p_size + 1, 'second' FROM part WHERE p_partkey % 50 = 7"""))
def static_identity(fx):
    """Static columns of two runs; only the tampered cells differ, rainfall may differ freely."""
    part = fx.table("part")
    run = lambda slope: part.select(F.concat(F.lit("cell "), F.col("p_partkey").cast("string")).alias("cell"), slope.alias("slope"))
    first = run(F.col("p_size"))
    second = run(F.col("p_size") + F.when(F.col("p_partkey") % 50 == 7, 1).otherwise(0))
    return documents.rows_that_differ(first, second)


@query("run_record_sink", oracle("SELECT run_id, state, pr_auc, roc_auc, 11 AS n_features, 'slope' AS second_feature, 'int32' AS cover_type FROM fx_runs", "fx_runs"))
def run_record_sink(fx):
    types = {f: "int32" if f == vocab.LAND_COVER_FEATURE else "float32" for f in REQUIRED}
    records = fx.runs.select("run_id", "state", "pr_auc", "roc_auc", *documents.run_record(REQUIRED, types, {}))
    path = scratch_path(fx.spark, "runs")
    documents.append_run_records(records.where("run_id % 2 = 0"), path)
    documents.append_run_records(records.where("run_id % 2 = 1"), path)
    return fx.spark.read.parquet(path).select(
        "run_id", "state", "pr_auc", "roc_auc", "n_features", F.col("feature_names")[1].alias("second_feature"), F.col("dtype")[vocab.LAND_COVER_FEATURE].alias("cover_type")
    )
