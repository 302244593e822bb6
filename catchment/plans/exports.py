"""Queries of flattened exports, envelopes and GeoJSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources import sinks
from .geometry import rings


@query("x03_flatten", "SELECT stop_id, lat AS \"coordinates.lat\", lon AS \"coordinates.lon\", direction || ' | ' || pair AS tags FROM stops")
def x03(t):
    return sinks.flattened(t.stops.select("stop_id", F.struct("lat", "lon").alias("coordinates"), F.array("direction", "pair").alias("tags")))


@query("x01_csv_lines", """SELECT 'stop_id,stop_name,status' AS line UNION ALL SELECT CAST(stop_id AS VARCHAR) || ',"' || stop_name || ', ' || direction || '",' || status FROM stops""")
def x01(t):
    return sinks.csv_lines(t.stops.select("stop_id", F.concat_ws(", ", "stop_name", "direction").alias("stop_name"), "status")).select("line")


@query("x08_envelope", """SELECT stop_id, '{"schema":"stops","version":1,"build":"b1","generatedAt":"2026-08-01","payload":{"stop_id":' || CAST(stop_id AS VARCHAR) || ',"stop_name":"' || stop_name || '"}}' AS document FROM stops""")
def x08(t):
    return t.stops.select("stop_id", sinks.envelope("stops", "b1", "2026-08-01", "stop_id", "stop_name").alias("document"))


@query("x12_feature_collection", "SELECT polygon_id, '{\"type\":\"Feature\",\"properties\":{\"id\":' || CAST(polygon_id AS VARCHAR) || '},\"kind\":\"Polygon\",\"positions\":5}' AS feature FROM squares")
def x12(t):
    r = rings(t.squares)
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("polygon_id").alias("id")).alias("properties"), F.lit("Polygon").alias("kind"), F.size("ring").alias("positions"))
    return r.select("polygon_id", F.to_json(feature).alias("feature"))


@query("c07_geometry_type", "SELECT polygon_id, CASE polygon_id % 3 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'LineString' ELSE NULL END AS type FROM squares")
def c07(t):
    """A closed ring of four positions or more is a polygon, two or more positions are a line, fewer are nothing."""
    r = rings(t.squares).withColumn("g", F.when(F.col("polygon_id") % 3 == 1, F.slice("ring", 1, 4)).when(F.col("polygon_id") % 3 == 2, F.slice("ring", 1, 1)).otherwise(F.col("ring")))
    ends = (F.element_at("g", 1)["lon"] == F.element_at("g", -1)["lon"]) & (F.element_at("g", 1)["lat"] == F.element_at("g", -1)["lat"])
    return r.select("polygon_id", F.when((F.size("g") >= 4) & ends, "Polygon").when(F.size("g") >= 2, "LineString").alias("type"))


@query("p01_element_centre", "SELECT osm_id, CASE WHEN osm_type = 'node' THEN lat WHEN osm_id % 4 <> 0 THEN lat + 1 END AS lat FROM elements")
def p01(t):
    """A node's own place, else its centre, else none."""
    e = t.elements.withColumn("center", F.when(F.col("osm_id") % 4 != 0, F.struct((F.col("lat") + 1).alias("lat"), F.col("lon").alias("lon"))))
    own = F.when(F.col("osm_type") == "node", F.struct("lat", "lon"))
    return e.select("osm_id", F.coalesce(own, F.col("center"))["lat"].alias("lat"))


@query("s14_parsed_rows", "SELECT stop_id, stop_name, CAST(stop_id * 9 AS INTEGER) AS metres FROM stops")
def s14(t):
    """Fields of a printed row, by patterns."""
    row = F.concat("stop_name", F.lit(" ("), F.col("stop_id").cast("string"), F.lit(") — "), (F.col("stop_id") * 9).cast("string"), F.lit(" m walk"))
    r = t.stops.select("stop_id", row.alias("row"))
    return r.select("stop_id", F.regexp_extract("row", r"^(.*) \(\d+\)", 1).alias("stop_name"), F.regexp_extract("row", r"— (\d+) m", 1).cast("int").alias("metres"))
