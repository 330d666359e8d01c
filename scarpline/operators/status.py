"""Validation status of regions: availability, evidence, decisions and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import provenance as prov
from ..functions.numbers import col, reasons, text_list
from .aoi import state_id
from .catalog import first_rows

MISSING, AVAILABLE = vocab.FILE_MISSING, vocab.FILE_AVAILABLE


def availability(states: DataFrame, files: DataFrame) -> DataFrame:
    """Per state: a DEM above 1000 bytes, an exposure file above 100, a rainfall source.

    files: state, kind ('dem' | 'exposure' | 'rainfall'), length.
    """
    largest = files.groupBy("state").agg(*[
        F.max(F.when(F.col("kind") == k, F.col("length"))).alias(f"_{k}")
        for k in ("dem", "exposure", "rainfall")
    ])
    has = lambda c, n: F.coalesce(F.col(c) > n, F.lit(False))
    return states.select("state").join(largest, "state", "left").select(
        "state",
        F.when(has("_dem", vocab.MIN_DEM_BYTES), AVAILABLE).otherwise(MISSING).alias("dem_status"),
        F.when(has("_exposure", vocab.MIN_EXPOSURE_BYTES), AVAILABLE).otherwise(MISSING).alias("exposure_status"),
        F.when(has("_rainfall", 0), vocab.RAIN_AUTHENTICATED)
        .otherwise(vocab.RAIN_UNAVAILABLE).alias("rainfall_status"),
    )


def artifact_plan(states: DataFrame, required: list[str], files: DataFrame) -> DataFrame:
    """What each state still has to build: nothing, the derivatives, or DEM and all."""
    wanted = states.select("state", F.explode(text_list(required)).alias("feature"))
    # Distinct first: many files of one kind shrink to one row per task before the join.
    present = files.where(F.col("length") > 0).select("state", "feature").distinct()
    missing = (
        wanted.join(present, ["state", "feature"], "left_anti")
        .groupBy("state").agg(F.array_sort(F.collect_set("feature")).alias("missing"))
    )
    none = F.array().cast("array<string>")
    out = states.select("state").join(missing, "state", "left").withColumn(
        "missing", F.coalesce("missing", none)
    )
    return out.withColumn(
        "action",
        F.when(F.size("missing") == 0, "skip")
        .when(F.array_contains("missing", "elevation"), "acquire_dem_and_derivatives")
        .otherwise("derivatives_only"),
    )


def rainfall_unavailable(c: Column | str) -> Column:
    s = F.coalesce(col(c), F.lit("Missing"))
    return (
        (s == "Unauthenticated") | s.startswith("Missing") | s.startswith("Unavailable")
        | s.contains("Missing Earthdata")
    )


def status_decision(df: DataFrame, minimum_events: int = vocab.MIN_DATES_TEMPORAL_GATE) -> DataFrame:
    """Overall status with blockers.

    Wants is_pilot, dem_status, exposure_status, rainfall_status, usable_events,
    evidence_complete and evidence_missing (array). A pilot stands on evidence alone.
    """
    pilot = F.coalesce("is_pilot", F.lit(False))
    complete = F.coalesce("evidence_complete", F.lit(False))
    gap = lambda c: ~pilot & (F.coalesce(c, F.lit("")) != AVAILABLE)
    usable = F.coalesce("usable_events", F.lit(0))
    no_dem, no_osm = gap("dem_status"), gap("exposure_status")
    no_rain = ~pilot & rainfall_unavailable("rainfall_status")
    few = ~pilot & (usable < minimum_events)
    blockers = reasons(
        (no_dem, vocab.BLOCKER_DEM),
        (no_osm, vocab.BLOCKER_OSM),
        (no_rain, vocab.BLOCKER_RAIN),
        (few, F.format_string(vocab.BLOCKER_EVENTS.format(minimum=minimum_events), usable)),
        (pilot & ~complete, evidence_blocker("evidence_missing")),
    )
    overall = (
        F.when(pilot & complete, "VALIDATED_PILOT")
        .when(pilot, "VALIDATION_REQUIRED")
        .when(no_dem | no_osm | no_rain, "DATA UNAVAILABLE")
        .when(few, "INSUFFICIENT DATA")
        .otherwise("VALIDATION IN PROGRESS")
    )
    model = (
        F.when(pilot & complete, vocab.MODEL_STATUS_TRAINED)
        .when(pilot, vocab.MODEL_STATUS_REQUIRED)
        .when(no_dem | no_osm | no_rain | few, "Not Trained")
        .otherwise("Data Ready (Pending Training)")
    )
    return df.withColumns({
        "overall_status": overall, "model_status": model, "blocking_reasons": blockers,
    })


def evidence_blocker(missing: str) -> Column:
    listed = F.array_join(F.coalesce(F.col(missing), F.array(F.lit("model"))), ", ")
    return F.concat(F.lit(vocab.BLOCKER_EVIDENCE + " ("), listed, F.lit(")"))


# --- evidence documents --------------------------------------------------------------

def json_number(doc: Column, *path: str) -> Column:
    """A number only if the document really holds one: no bool, string or NaN."""
    where = "$" + "".join(f"['{p}']" for p in path)
    value = F.try_variant_get(doc, where, "variant")
    kind = F.schema_of_variant(value)
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(F.coalesce(number, F.lit(False)), F.try_variant_get(doc, where, "double"))


def evidence_gate(runs: DataFrame, metrics: list[str] = vocab.GATE_METRICS) -> DataFrame:
    """Is a run's record complete evidence, and if not, why.

    runs: metrics_json (text), has_model, has_schema. Typed access keeps a quoted or
    boolean metric from passing as a number; historical figures are refused.
    """
    doc = runs.withColumn("_doc", F.try_parse_json("metrics_json"))
    num = lambda m: json_number(F.col("_doc"), "validation_metrics", m)
    present = lambda m: F.try_variant_get(F.col("_doc"), f"$['validation_metrics']['{m}']", "variant").isNotNull()
    parsed = doc.withColumns({f"_m{i}": num(m) for i, m in enumerate(vocab.FULL_METRICS)})
    at = {m: F.col(f"_m{i}") for i, m in enumerate(vocab.FULL_METRICS)}
    quarantined = F.lit(False)
    for block in vocab.QUARANTINED_METRICS:
        # Metrics a document does not have are not compared; the two gate ones must match.
        same = F.lit(True)
        for name, figure in block.items():
            equal = at[name] == figure
            same = same & (
                F.coalesce(equal, F.lit(False)) if name in vocab.GATE_METRICS
                else F.coalesce(equal, F.lit(True))
            )
        quarantined = quarantined | same
    source = F.try_variant_get(F.col("_doc"), "$.metrics_source", "string")
    unreadable = F.col("_doc").isNull()
    have_block = F.coalesce(
        F.schema_of_variant(F.try_variant_get(F.col("_doc"), "$.validation_metrics", "variant"))
        .startswith("OBJECT"), F.lit(False)
    )
    problems = reasons(
        (~F.coalesce("has_model", F.lit(False)), "model artifact missing"),
        (~F.coalesce("has_schema", F.lit(False)), "schema artifact missing"),
        (unreadable, "metrics document unreadable"),
        (~unreadable & ~have_block, "metrics block missing"),
        *[(have_block & ~present(m), f"{m} missing") for m in metrics],
        *[(have_block & present(m) & at[m].isNull(), f"{m} is not a finite number") for m in metrics],
        (~unreadable & (F.coalesce(source, F.lit("")) != vocab.METRICS_SOURCE), "metrics source not certified"),
        (quarantined, "identical to quarantined historical figures"),
    )
    return parsed.withColumn("problems", problems).withColumns({
        "complete": F.size("problems") == 0,
        "pr_auc": F.when(F.size("problems") == 0, at["PR-AUC"]),
        "roc_auc": F.when(F.size("problems") == 0, at["ROC-AUC"]),
    }).drop("_doc", *[f"_m{i}" for i in range(len(vocab.FULL_METRICS))])


def schema_problems(names: str, n_features: str, documented: str) -> Column:
    """Problems of a feature-schema record: emptiness, repeats, count, coverage."""
    listed = F.coalesce(F.size(names), F.lit(0)) > 0
    uncovered = F.array_except(F.col(names), F.col(documented))
    return reasons(
        (~listed, "feature_names is missing or empty"),
        (listed & prov.has_duplicates(names), "feature_names contains duplicates"),
        (listed & (F.coalesce(F.col(n_features), F.lit(-1)) != F.size(names)), "n_features does not match"),
        (listed & (F.size(uncovered) > 0), F.concat(F.lit("not documented: "), F.array_join(uncovered, ", "))),
    )


def column_presence(names: str, required: list[str]) -> Column:
    missing = prov.missing_names(names, required)
    return reasons(
        (F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
        (prov.has_duplicates(names), "duplicate names"),
    )


def feature_order_matches(names: str, expected=tuple(vocab.MODEL_FEATURES)) -> Column:
    return F.col(names).eqNullSafe(text_list(expected))


def bundle_consistency(df: DataFrame) -> DataFrame:
    """Schema and provenance must list the same features and use the known words.

    Wants schema_features, provenance_features (arrays), input_status (map), model_type.
    """
    words = F.array(*[F.lit(w) for w in vocab.INPUT_STATUSES])
    foreign = F.exists(
        F.coalesce(F.map_values("input_status"), F.array().cast("array<string>")),
        lambda w: ~F.coalesce(F.array_contains(words, w), F.lit(False)),
    )
    why = reasons(
        (~F.col("schema_features").eqNullSafe(F.col("provenance_features")), "feature lists disagree"),
        (foreign, "input status outside the vocabulary"),
        (F.coalesce(F.trim("model_type"), F.lit("")) == "", "model_type is missing or empty"),
        (F.coalesce(F.size("provenance_features"), F.lit(0)) <= 0, "feature_list is missing or empty"),
    )
    return df.withColumn("problems", why).withColumn("consistent", F.size("problems") == 0)


def document_verdict(missing: Column, problems: Column) -> Column:
    return F.when(F.size(missing) > 0, "MISSING").when(F.size(problems) > 0, "INVALID").otherwise("VALID")


# --- reports ----------------------------------------------------------------------------

def evidence_downgrade(reports: DataFrame, evidence: DataFrame, key: str = "state") -> DataFrame:
    """Claims of validation without complete evidence are lowered; others stay as they are."""
    e = evidence.select(key, F.col("complete").alias("_complete"), F.col("missing").alias("_missing"))
    claims = (
        F.coalesce(F.col("overall_status") == "VALIDATED_PILOT", F.lit(False))
        | F.coalesce(F.col("model_status") == vocab.MODEL_STATUS_TRAINED, F.lit(False))
    )
    lower = claims & ~F.coalesce("_complete", F.lit(False))
    listed = F.array_join(F.coalesce("_missing", F.array(F.lit("model"), F.lit("metrics"), F.lit("schema"))), ", ")
    note = F.concat(
        F.lit("claim lowered: required evidence ("), listed, F.lit(") is absent; the stored record is unchanged")
    )
    return reports.join(e, key, "left").withColumns({
        "reported_status_note": F.when(lower, note),
        "new_overall": F.when(lower, "VALIDATION_REQUIRED").otherwise(F.col("overall_status")),
        "new_model": F.when(lower, vocab.MODEL_STATUS_REQUIRED).otherwise(F.col("model_status")),
        "new_pr_auc": F.when(~lower, F.col("pr_auc")),
    }).select(
        *[c for c in reports.columns if c not in ("overall_status", "model_status", "pr_auc")],
        F.col("new_overall").alias("overall_status"), F.col("new_model").alias("model_status"),
        F.col("new_pr_auc").alias("pr_auc"), "reported_status_note",
    )


OWNED_BLOCKERS = [vocab.BLOCKER_DEM, vocab.BLOCKER_OSM, vocab.BLOCKER_EVIDENCE]


def evidence_refresh(reports: DataFrame, artifacts: DataFrame, key: str = "state") -> DataFrame:
    """Records lifted to what the artifacts show now; reasons of other origin are kept.

    artifacts: dem_available (null = not checked), exposure_available,
    evidence_complete, evidence_missing.
    """
    j = reports.join(artifacts, key, "left")
    complete = F.coalesce("evidence_complete", F.lit(False))
    dem = (
        F.when(F.col("dem_available"), AVAILABLE).when(~F.col("dem_available"), MISSING)
        .otherwise(F.col("dem_status"))
    )
    osm = F.when(F.coalesce("exposure_available", F.lit(False)), AVAILABLE).otherwise(MISSING)
    j = j.withColumns({"dem_status": dem, "exposure_status": osm})
    data_ready = (F.col("dem_status") == AVAILABLE) & (F.col("exposure_status") == AVAILABLE)
    kept = F.filter(
        F.coalesce("blocking_reasons", F.array().cast("array<string>")),
        lambda b: ~(b.startswith(OWNED_BLOCKERS[0]) | b.startswith(OWNED_BLOCKERS[1])
                    | b.startswith(OWNED_BLOCKERS[2])),
    )
    raised = reasons(
        (F.col("dem_status") != AVAILABLE, OWNED_BLOCKERS[0]),
        (F.col("exposure_status") != AVAILABLE, OWNED_BLOCKERS[1]),
        (~complete, evidence_blocker("evidence_missing")),
    )
    return j.withColumns({
        "blocking_reasons": F.concat(kept, raised),
        "model_status": F.when(complete, vocab.MODEL_STATUS_TRAINED).otherwise(vocab.MODEL_STATUS_REQUIRED),
        "overall_status": F.when(complete, "VALIDATED_PILOT")
        .when(data_ready, "VALIDATION_REQUIRED").otherwise("DATA UNAVAILABLE"),
    }).select(*reports.columns)


def status_region_join(regions: DataFrame, reports: DataFrame, order: str) -> DataFrame:
    """Every region with its newest report, keys compared trimmed and folded."""
    newest = first_rows(reports.withColumn("_k", state_id("state_key")), ["_k"], order, last=True)
    keyed = regions.withColumn("_k", state_id("state"))
    named = newest.select("_k", *[F.col(c).alias(f"_r_{c}") for c in reports.columns])
    return keyed.join(named, "_k", "left").select(
        *regions.columns, *[F.col(f"_r_{c}").alias(c) for c in reports.columns]
    )


def region_ranking(joined: DataFrame) -> DataFrame:
    """Pilot regions first, then by inventory; the flag stands in for a missing report."""
    tone = F.when(F.col("overall_status").isNotNull(), prov.region_tone("overall_status")).otherwise(
        F.when(F.coalesce("is_pilot", F.lit(False)), "pilot").otherwise("pending")
    )
    return joined.withColumn("tone", tone).orderBy(
        (F.col("tone") == "pilot").desc(),
        F.coalesce("inventory_events", F.lit(0)).desc(), "state",
    )


def region_totals(joined: DataFrame) -> DataFrame:
    return joined.agg(
        F.count_if(F.col("tone") == "pilot").alias("validated"),
        F.count_if(F.col("tone") != "pilot").alias("pending"),
        F.sum(F.coalesce("inventory_events", F.lit(0))).alias("total_events"),
    )


def with_error_rows(states: DataFrame, reports: DataFrame, failed: DataFrame) -> DataFrame:
    """One record per state; a state without a result gets an ERROR record."""
    return states.select("state").join(reports, "state", "left").join(
        failed.select("state", "error"), "state", "left"
    ).withColumns({
        "processing_status": F.when(
            F.col("error").isNull() & F.col("overall_status").isNotNull(), "COMPLETED"
        ).otherwise("ERROR"),
        "error": F.when(F.col("error").isNotNull(), F.col("error")).when(
            F.col("overall_status").isNull(), F.lit("no result for this state")
        ),
    })
