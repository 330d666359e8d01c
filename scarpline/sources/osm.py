"""Map elements to assets: nodes become points, ways with two or more vertices lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

POINT = "STRUCT<lat: DOUBLE, lon: DOUBLE>"
OSM_SCHEMA = (
    f"elements ARRAY<STRUCT<type: STRING, id: BIGINT, lat: DOUBLE, lon: DOUBLE, "
    f"geometry: ARRAY<{POINT}>, tags: MAP<STRING, STRING>>>"
)


def osm_assets(docs: DataFrame) -> DataFrame:
    """Assets of parsed documents (column `elements`); no elements give no assets."""
    e = docs.select(F.explode("elements").alias("e")).select("e.*")
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    vertices = F.filter(F.coalesce("geometry", F.array().cast(f"array<{POINT}>")), lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    is_point = (F.col("type") == "node") & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    coords = F.when(
        is_point, F.array(F.struct("lon", "lat"))
    ).when(
        F.col("type") == "way", F.transform(vertices, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    )
    placed = e.withColumn("coords", coords)
    return placed.where(is_point | ((F.col("type") == "way") & (F.size("coords") >= 2))).select(
        F.col("id").alias("osm_id"),
        F.coalesce(tag("amenity"), F.lit("road")).alias("asset_type"),
        F.coalesce(tag("name"), F.concat_ws(" ", F.lit("OSM"), F.initcap("type"), F.col("id").cast("string"))).alias("asset_name"),
        "coords",
    )


def from_text(docs: DataFrame, column: str = "value") -> DataFrame:
    return docs.select(F.from_json(column, OSM_SCHEMA).alias("d")).select("d.elements").where("elements IS NOT NULL")


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """Element documents, one per file."""
    return osm_assets(spark.read.schema(OSM_SCHEMA).json(path, multiLine=True).where("elements IS NOT NULL"))
