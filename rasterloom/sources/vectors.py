"""GeoJSON features as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import schema
from rasterloom.functions import geo


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features as (fid, props, geom_type, coordinates). A feature collection
    is one document per file; `lines=True` reads one feature per line, which
    splits. Coordinates stay JSON text until the geometry type is known."""
    feature = schema.GEOJSON_FEATURES["features"].dataType.elementType
    if lines:
        f = spark.read.text(path).select(F.from_json("value", feature).alias("f"))
    else:
        doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema.GEOJSON_FEATURES).alias("d"))
        f = doc.select(F.explode("d.features").alias("f"))
    return f.select(
        F.monotonically_increasing_id().alias("fid"), F.col("f.properties").alias("props"),
        F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"),
    )


def _points(ring):
    return F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def point_features(features: DataFrame) -> DataFrame:
    p = F.from_json("coordinates", "array<double>")
    return features.where("geom_type = 'Point'").select("fid", "props", p[0].alias("x"), p[1].alias("y"))


def line_features(features: DataFrame) -> DataFrame:
    """One row per line part with `coords`; other geometry types drop out."""
    one = F.array(F.from_json("coordinates", "array<array<double>>"))
    many = F.from_json("coordinates", "array<array<array<double>>>")
    parts = F.when(F.col("geom_type") == "LineString", one).when(F.col("geom_type") == "MultiLineString", many)
    rows = features.select("fid", "props", F.posexplode(parts).alias("part", "_c"))
    return rows.select("fid", "props", "part", _points(F.col("_c")).alias("coords"))


def polygon_features(features: DataFrame) -> DataFrame:
    """One row per polygon with `rings` (outer first, then holes)."""
    one = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("geom_type") == "Polygon", one).when(F.col("geom_type") == "MultiPolygon", many)
    rows = features.select("fid", "props", F.posexplode(parts).alias("part", "_c"))
    return rows.select("fid", "props", "part", F.transform("_c", _points).alias("rings"))


def rings_of(polygons: DataFrame, project_zone: int | None = None) -> list[list[tuple[float, float]]]:
    """Rings of a small polygon table as literals for `geo.is_inside`; the
    vertex count is checked before anything reaches the driver."""
    pts = polygons.select("fid", "part", F.posexplode("rings").alias("ring", "_r")).select(
        "fid", "part", "ring", F.posexplode("_r").alias("i", "p"))
    x, y = F.col("p.x"), F.col("p.y")
    if project_zone is not None:
        x, y = geo.lonlat_to_utm(x, y, project_zone)
    rows = pts.select("fid", "part", "ring", "i", x.alias("x"), y.alias("y")).take(geo.MAX_LITERAL_EDGES + 1)
    if len(rows) > geo.MAX_LITERAL_EDGES:
        raise ValueError("polygon too large for a literal; use polygons.edge_table, which the clipping operators take")
    rings: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: (r.fid, r.part, r.ring, r.i)):
        rings.setdefault((r.fid, r.part, r.ring), []).append((r.x, r.y))
    return list(rings.values())


def named_properties(features: DataFrame, names: list[str]) -> DataFrame:
    """Selected properties as columns; a missing one is an empty string."""
    return features.withColumns({n: F.coalesce(F.col("props")[n], F.lit("")) for n in names})
