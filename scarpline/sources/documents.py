"""Written results: map features, state reports, run records, matrices, file integrity."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import vocab
from ..functions import provenance as prov
from ..operators.matrix import cast_features
from ..plans import grid
from ..session import write_by

FEATURE_PROPERTIES = ["cell_id", "status", "probability", "risk_class", "exceeds_decision_threshold"]


def geojson_feature() -> Column:
    """One map feature as JSON text: [lon, lat] and the five properties, nulls shown."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.col("cell_id").alias("id"),
            F.struct(
                F.lit("Point").alias("type"),
                F.array(F.col("longitude").cast("double"), F.col("latitude").cast("double")).alias("coordinates"),
            ).alias("geometry"),
            F.struct(*FEATURE_PROPERTIES).alias("properties"),
        ),
        {"ignoreNullFields": "false"},
    )


def geojson_lines(cells: DataFrame) -> DataFrame:
    """All cells, scored or not; a cell without a coordinate stops the job."""
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return cells.where(F.assert_true(placed, F.lit("a cell has no coordinate")).isNull()).select(
        geojson_feature().alias("value")
    )


def write_geojson(cells: DataFrame, path: str) -> None:
    geojson_lines(cells).write.text(path)


def map_header(summary: DataFrame, rain: DataFrame, target_day: str, step_deg: float) -> DataFrame:
    """One record per state to go with the features: what was computed, from which rain.

    summary: grid_summary by state; rain: one row per state from the source ladder. The
    daily series and the feature values are left out of the rainfall view.
    """
    counts = grid.class_counts_map()
    j = summary.join(rain, "state", "left")
    label = prov.source_label("source", "source_kind", "data_quality_status", "is_fallback")
    shown = [c for c in prov.RAIN_VIEW_FIELDS if c in rain.columns]
    return j.select(
        F.lit("FeatureCollection").alias("type"), "state",
        F.lit(target_day).alias("target_date"),
        F.concat(F.lit("susceptibility model + "), label).alias("generated_from"),
        F.lit(vocab.DECISION_THRESHOLD).alias("decision_threshold"),
        F.struct(F.lit(float(step_deg)).alias("step_deg"), F.col("cells_total").alias("cell_count")).alias("grid"),
        F.struct(*shown).alias("rainfall"),
        F.struct(
            "cells_total", "cells_scored", "cells_unavailable", counts.alias("risk_class_counts"),
            "cells_exceeding_threshold", "max_probability", "mean_probability",
        ).alias("summary"),
    )


GEOJSON_SCHEMA = (
    "type STRING, id STRING, geometry STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>, "
    "properties STRUCT<cell_id: STRING, status: STRING, probability: DOUBLE, risk_class: STRING, "
    "exceeds_decision_threshold: BOOLEAN>"
)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GEOJSON_SCHEMA).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One record per line; nulls are written, so a gap stays visible."""
    df.write.option("ignoreNullFields", "false").json(path)


# --- training matrix ---------------------------------------------------------------------

def write_matrix(matrix: DataFrame, path: str) -> None:
    """Features, target and metadata in their stored types."""
    missing = [c for c in [*vocab.MODEL_FEATURES, "target"] if c not in matrix.columns]
    if missing:
        raise ValueError(f"matrix lacks column(s): {', '.join(missing)}")
    cast_features(matrix).write.parquet(path)


def read_matrix(spark: SparkSession, path: str, required=(*vocab.MODEL_FEATURES, "target")) -> DataFrame:
    df = spark.read.parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"matrix lacks column(s): {', '.join(missing)}")
    return df


# --- run records --------------------------------------------------------------------------

def run_record(features: list[str], types: dict[str, str], meanings: dict[str, str]) -> list[Column]:
    """Feature contract of a run: names with order, types and meanings."""
    pairs = lambda d: F.create_map(*[F.lit(v) for f in features for v in (f, d.get(f, "undocumented"))])
    return [
        F.array(*map(F.lit, features)).alias("feature_names"),
        F.array(*[F.lit(i) for i in range(len(features))]).alias("feature_order"),
        F.lit(len(features)).alias("n_features"),
        pairs(types).alias("dtype"),
        pairs(meanings).alias("meaning"),
    ]


def append_run_records(records: DataFrame, path: str) -> None:
    """Metrics verbatim, appended per state."""
    write_by(records, "state", path, "append")


# --- file integrity -------------------------------------------------------------------------

#: Files above this are hashed in pieces; smaller ones are read whole, in batches of few.
WHOLE_BYTES = 64 << 20
PIECE_BYTES = 8 << 20


def _digest(path: str) -> str | None:
    """SHA-256 of a file read piece by piece; null when no file system here can open it."""
    from pyarrow import fs

    try:
        store, name = fs.FileSystem.from_uri(path)
        found = hashlib.sha256()
        with store.open_input_stream(name) as stream:
            while piece := stream.read(PIECE_BYTES):
                found.update(piece)
        return found.hexdigest()
    except (OSError, ValueError, NotImplementedError):  # Arrow's errors are among these
        return None


def file_inventory(spark: SparkSession, path: str, pattern: str = r"([^/]+)$", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """name, length and sha256 of every file below a folder whose path has a name.

    The pattern's first group is the name: the file's own by default, or for instance
    the partition folder of a table, whose files have generated names. Files of at most
    `whole_bytes` are hashed as they are read; larger ones, of any size, are read in pieces
    of a few MB, so no task holds one whole. A file that cannot be opened so has no digest.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("name", F.regexp_extract("path", pattern, 1)).where("name <> ''")
    # The length is known from the listing, and the filter on it spares reading the content.
    small = files.where(F.col("length") <= whole_bytes).select("name", "length", F.sha2("content", 256).alias("sha256"))

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["name"], batch["length"], pa.array([_digest(p) for p in batch["path"].to_pylist()], pa.string())], ["name", "length", "sha256"])

    large = files.where(F.col("length") > whole_bytes).select("name", "length", "path").mapInArrow(hashed, "name string, length bigint, sha256 string")
    return small.unionByName(large)


def manifest_entries(manifest: DataFrame) -> DataFrame:
    """Usable entries of a map column `artifacts`: positive length and 64-hex digest."""
    e = manifest.select(F.explode("artifacts").alias("name", "entry"))
    digest = F.lower(F.trim("entry.sha256"))
    return e.where((F.col("entry.bytes") > 0) & digest.rlike("^[0-9a-f]{64}$")).select(
        "name", F.col("entry.bytes").alias("length"), digest.alias("sha256")
    )


def file_integrity(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Every file and entry with its verdict; a size mismatch is reported before a digest."""
    j = files.alias("f").join(entries.alias("m"), "name", "full_outer")
    verdict = (
        F.when(F.col("f.length").isNull(), "no local file")
        .when(F.col("m.length").isNull(), "no manifest entry")
        .when(F.col("f.length") != F.col("m.length"), "size mismatch")
        .when(F.col("f.sha256").isNull(), "not readable")
        .when(F.col("f.sha256") != F.col("m.sha256"), "sha256 mismatch")
        .otherwise("ok")
    )
    return j.select("name", verdict.alias("verdict"))


def manifest_difference(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Names on one side only, by multiset difference both ways."""
    a, b = entries.select("name"), files.select("name")
    return a.exceptAll(b).withColumn("only_in", F.lit("manifest")).unionByName(
        b.exceptAll(a).withColumn("only_in", F.lit("files"))
    )


def rows_that_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows present in one frame only, tagged; empty when both hold the same rows."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(
        b.exceptAll(a).withColumn("only_in", F.lit("second"))
    )
