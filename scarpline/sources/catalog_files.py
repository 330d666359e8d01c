"""The event catalogue as CSV text and as snapshot documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import vocab
from ..operators import aoi as aoi_ops
from ..operators import catalog
from ..functions import geo
from ..session import write_by

CATALOG_COLUMNS = [
    "event_id", "latitude", "longitude", "event_date", *vocab.EVENT_TEXT_FIELDS,
    "fatality_count", "admin_division_name", "country_name",
]


def _all_text(columns) -> str:
    return ", ".join(f"`{c}` STRING" for c in columns)


def read_catalog(spark: SparkSession, path: str, columns=tuple(CATALOG_COLUMNS),
                 multi_line: bool = False) -> DataFrame:
    """A catalogue CSV with header, every column as text, coerced and filtered.

    The file's own header order is used, so columns may be missing or extra. Files with
    line breaks inside quotes need multi_line, at the price of one task per file.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')
    return catalog.coerce_catalog(
        raw.select(*[c for c in raw.columns if c in columns]),
        keep=["event_id", "admin_division_name", "country_name"],
    )


def from_lines(lines: DataFrame, columns: list[str], line: str = "line") -> DataFrame:
    """Header-less CSV lines of a text column as all-text columns."""
    return lines.select(F.from_csv(F.col(line), F.lit(_all_text(columns))).alias("r")).select("r.*")


def snapshot_events(docs: DataFrame, boxes: DataFrame, doc: str = "doc", extra: list[str] = ()) -> DataFrame:
    """Events of snapshot documents (one JSON text per row).

    Only the known fields are read; the uncertainty label is always recomputed; rows
    with bad coordinates or outside the live box of their state are dropped.
    """
    fields = [*extra, "latitude", "longitude", "event_date", *vocab.EVENT_TEXT_FIELDS, "fatality_count"]
    schema = f"state STRING, events ARRAY<STRUCT<{', '.join(f'{f}: STRING' for f in fields)}>>"
    rows = (
        docs.select(F.from_json(doc, schema).alias("d"))
        .select("d.state", F.inline("d.events"))
    )
    typed = catalog.coerce_catalog(rows, keep=["state", *extra])
    labelled = typed.withColumn("spatial_uncertainty", catalog.accuracy_class("location_accuracy"))
    return (
        labelled.join(boxes.select("state", *geo.EDGES), "state")
        .where(geo.in_box("latitude", "longitude"))
        .drop(*geo.EDGES)
    )


def read_snapshot(spark: SparkSession, path: str, boxes: DataFrame) -> DataFrame:
    """Snapshot files: one JSON document per file, pretty-printed or not."""
    return snapshot_events(spark.read.text(path, wholetext=True).select(F.col("value").alias("doc")), boxes)


def write_snapshot(events: DataFrame, boxes: DataFrame, path: str) -> None:
    """Event rows as Parquet by state, and one header record per state as JSON.

    The header is aggregated; the events themselves never pass through one task.
    """
    edges = boxes.select("state", *geo.EDGES)
    rows = aoi_ops.match_boxes(events, edges, "inner").drop(*geo.EDGES).withColumn(
        "spatial_uncertainty", catalog.accuracy_class("location_accuracy")
    )
    write_by(rows, "state", f"{path}/events")
    stored = events.sparkSession.read.parquet(f"{path}/events")
    summary = catalog.uncertainty_summary(stored, ["state"])
    header = summary.join(edges, "state").select(
        "state",
        F.lit("1.0.0").alias("snapshot_schema_version"),
        (F.col("precise_lt_5km") + F.col("approximate_ge_5km")).alias("count"),
        F.struct(*geo.EDGES).alias("aoi"),
        F.struct("precise_lt_5km", "approximate_ge_5km", "pct_approximate_ge_5km").alias("uncertainty"),
        F.struct(
            F.lit("box, dated rows, first per place and date").alias("filter"),
            F.array(*map(F.lit, vocab.PRECISE_ACCURACY)).alias("precise_accuracy_values"),
        ).alias("derivation"),
    )
    header.write.json(f"{path}/header")


HEADER_SCHEMA = (
    "state STRING, snapshot_schema_version STRING, count BIGINT, "
    "aoi STRUCT<min_lat: DOUBLE, max_lat: DOUBLE, min_lon: DOUBLE, max_lon: DOUBLE>, "
    "uncertainty STRUCT<precise_lt_5km: BIGINT, approximate_ge_5km: BIGINT, pct_approximate_ge_5km: DOUBLE>, "
    "derivation STRUCT<filter: STRING, precise_accuracy_values: ARRAY<STRING>>"
)


def read_written_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, rows) of a written snapshot."""
    return spark.read.schema(HEADER_SCHEMA).json(f"{path}/header"), spark.read.parquet(f"{path}/events")
