"""Queries of the smaller data-bearing functions: lookups, record shapes, preferences, styles and line checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..functions import geo, keys
from ..functions.text import normal_ascii, text
from ..operators import quality, scans, select, spatial
from ..registry import query
from ..sources import masters
from ..sources.scratch import shared_folder
from ..sources.sinks import publish
from .geometry import _RING_METRES, _hav, rings
from .scalars import _norm
from .search import within_sql


@query("s08_gazetteer", f"SELECT stop_id, place_id FROM (SELECT s.stop_id, r.route_id AS place_id, row_number() OVER (PARTITION BY s.stop_id ORDER BY r.route_id % 10, r.route_id) AS rn FROM stops AS s JOIN routes AS r ON {_norm('s.stop_name')} = 'stop ' || CAST(r.route_id % 17 AS VARCHAR)) AS q WHERE rn <= 5")
def s08(t):
    """Up to five places for each name."""
    places = t.routes.select(F.col("route_id").alias("place_id"), (F.col("route_id") % 10).alias("rank"), F.concat(F.lit("stop "), (F.col("route_id") % 17).cast("string")).alias("place_key"))
    names = t.stops.select("stop_id", F.col("stop_id").alias("query"), normal_ascii("stop_name").alias("query_key"))
    return masters.gazetteer_lookup(names, places).select("stop_id", "place_id")


@query("s12_effective_union", "SELECT key, layer, seq FROM (SELECT key, 0 AS layer, seq FROM master UNION ALL SELECT key, 1, seq FROM proposed) AS u")
def s12(t):
    return select.layered(t.master, t.proposed).select("key", "layer", "seq")


@query("m06_effective_rebuild", "SELECT key, arg_max(seq, layer * 1000000000 + seq) AS seq FROM (SELECT key, 0 AS layer, seq FROM master UNION ALL SELECT key, 1, seq FROM proposed) AS u GROUP BY key")
def m06(t):
    rows = select.layered(t.master, t.proposed)
    return select.ranked(rows, "key", [F.col("layer").desc(), F.col("seq").desc()]).select("key", "seq")


@query("f16_visible_classes", "SELECT osm_id FROM elements WHERE highway IN ('motorway', 'primary') OR (highway = '' AND railway <> '')")
def f16(t):
    """Elements of classes that a drawing mode shows."""
    shown = t.spark.createDataFrame([("motorway",), ("primary",), ("rail",)], "class string")
    kind = F.when(F.col("highway") != "", F.col("highway")).when(F.col("railway") != "", "rail").otherwise("hidden")
    return t.elements.withColumn("class", kind).join(F.broadcast(shown), "class", "left_semi").select("osm_id")  # three rows


@query("p27_field_defaults", "SELECT key, field, value, CASE WHEN status LIKE 'verified%' THEN 'verified' WHEN status IN ('missing', 'needs_review', 'requires_professional_review', 'manual') THEN status WHEN value <> '' THEN 'needs_review' ELSE 'missing' END AS status FROM (SELECT key, field, value, CASE WHEN record_id % 4 = 0 THEN 'odd' ELSE status END AS status FROM rail_fields) AS q")
def p27(t):
    """A status that isn't known follows from whether there is a value."""
    f = t.rail_fields.withColumn("status", F.when(F.col("record_id") % 4 == 0, "odd").otherwise(F.col("status")))
    known = F.col("status").isin("missing", "needs_review", "requires_professional_review", "manual")
    return f.select("key", "field", "value", F.when(ev.is_verified("status"), "verified").when(known, F.col("status")).when(F.col("value") != "", "needs_review").otherwise("missing").alias("status"))


@query("p29_unwrapped_records", "SELECT stop_id, CASE WHEN stop_id % 3 = 0 THEN 'C' || CAST(stop_id AS VARCHAR) WHEN stop_id % 3 = 1 THEN 'R' || CAST(stop_id AS VARCHAR) ELSE '' END AS crs FROM stops")
def p29(t):
    """The completed record inside a wrapper, else the record, else what existed; inner identifiers first."""
    shape = lambda prefix: F.struct(F.concat(F.lit(prefix), F.col("stop_id").cast("string")).alias("crs"))
    s = t.stops.select("stop_id", F.when(F.col("stop_id") % 3 == 0, shape("C")).alias("completed"), F.when(F.col("stop_id") % 3 != 2, shape("R")).alias("record"))
    return s.select("stop_id", text(F.coalesce("completed", "record")["crs"]).alias("crs"))


@query("p31_patched_paths", "SELECT stop_id, '{\"a\":{\"n\":' || CASE WHEN stop_id % 2 = 0 THEN '7' ELSE CAST(stop_id AS VARCHAR) END || '},\"s\":\"x\"}' AS document FROM stops")
def p31(t):
    """A nested number is replaced and stays a number."""
    s = t.stops.select("stop_id", F.struct(F.struct(F.col("stop_id").alias("n")).alias("a"), F.lit("x").alias("s")).alias("d"))
    patched = F.when(F.col("stop_id") % 2 == 0, F.col("d").withField("a.n", F.lit(7).cast("long"))).otherwise(F.col("d"))
    return s.select("stop_id", F.to_json(patched).alias("document"))


@query("p35_stop_identities", f"SELECT stop_id, coalesce(nullif({_norm('naptan')}, ''), {_norm('stop_name')} || CASE WHEN direction = '' THEN '' ELSE ' ' || {_norm('direction')} END) AS workflow FROM stops")
def p35(t):
    none = F.lit("")
    return t.stops.select("stop_id", keys.stop_workflow("naptan", none, none, "stop_name", "direction").alias("workflow"))


@query("k02_element_key", "SELECT osm_id, osm_type || '/' || CAST(osm_id AS VARCHAR) AS key FROM elements")
def k02(t):
    return t.elements.select("osm_id", keys.element("osm_type", "osm_id").alias("key"))


@query("j10_end_to_ring", f"SELECT polygon_id, round({_RING_METRES('51.5e0', '-0.1e0')}, 1) AS metres FROM squares")
def j10(t):
    """How far a fixed point is from the nearest side of each ring."""
    lat, lon = F.lit(51.5), F.lit(-0.1)
    sides = rings(t.squares).select("polygon_id", F.explode(F.arrays_zip(F.slice("ring", 1, 4).alias("a"), F.slice("ring", 2, 4).alias("b"))).alias("s"))
    s = sides.select("polygon_id", F.col("s.a.lon").alias("lon"), F.col("s.a.lat").alias("lat"), F.col("s.b.lon").alias("lon2"), F.col("s.b.lat").alias("lat2"))
    return s.groupBy("polygon_id").agg(F.round(F.min(spatial.segment_distance(lat, lon)), 1).alias("metres"))


_PAGE = "(?i)/(?:services?|routes?|timetables?)/[^/?#]+"
_SCORE = f"CASE WHEN trim(url) = '' THEN 0 WHEN regexp_matches(url, '{_PAGE}') THEN 8 ELSE 2 END"
_FILLED = " + ".join(f"CAST(trim({c}) <> '' AS INT)" for c in ("operator", "origin", "destination", "context", "retrieval_date", "status"))


@query("w08_preferred_route", f"SELECT route_number, route_id FROM (SELECT *, row_number() OVER (PARTITION BY route_number ORDER BY CASE WHEN status ILIKE 'verified%' THEN 40 ELSE 0 END + 10 * ({_SCORE}) + {_FILLED} DESC, retrieval_date DESC, route_id) AS rn FROM routes) AS q WHERE rn = 1")
def w08(t):
    """The route by which each number is known: by verified status, evidence and filled fields, then the newest, then the first."""
    from .networks import preference

    routes = t.routes.withColumn("authority", F.lit(""))
    return select.ranked(routes, "route_number", [preference().desc(), F.col("retrieval_date").desc(), F.col("route_id")]).select("route_number", "route_id")


@query("n19_family_score", f"SELECT route_id, CAST({_SCORE} AS INTEGER) AS score, regexp_extract('route:' || lower(operator) || ':x', '^route:([^:]+):', 1) AS authority FROM routes")
def n19(t):
    """Evidence of a route: eight for each source on a services, routes or timetables page of its own, two for any other."""
    key = F.concat(F.lit("route:"), F.lower("operator"), F.lit(":x"))
    return t.routes.select("route_id", ev.family_score(F.array("url")).alias("score"), F.regexp_extract(key, "^route:([^:]+):", 1).alias("authority"))


@query("o01_distance_order", f"SELECT site_id, osm_id, CAST(row_number() OVER (PARTITION BY site_id ORDER BY round(straight, 3), seq) AS INTEGER) AS place FROM ({within_sql(2000)}) AS r")
def o01(t):
    near = spatial.radius_join(t.sites, t.elements, 2000.0)
    return near.select("site_id", "osm_id", F.row_number().over(W.partitionBy("site_id").orderBy(F.round("straight", 3), "seq")).alias("place"))


@query("o06_key_order", "SELECT key, field, CAST(row_number() OVER (PARTITION BY field ORDER BY key) AS INTEGER) AS place FROM rail_fields")
def o06(t):
    return scans.placed(t.rail_fields, "field", [F.col("key")], "at").select("key", "field", (F.col("at") + 1).cast("int").alias("place"))


@query("o07_name_order", "SELECT osm_id, CAST(row_number() OVER (PARTITION BY osm_type ORDER BY name, osm_id) AS INTEGER) AS place FROM elements")
def o07(t):
    return scans.placed(t.elements, "osm_type", [F.col("name"), F.col("osm_id")], "at").select("osm_id", (F.col("at") + 1).cast("int").alias("place"))


@query("g02_haversine_asin", "SELECT osm_id, round(2e0 * 6371000e0 * asin(sqrt(pow(sin(radians(lat - 51.4e0) / 2e0), 2e0) + cos(radians(51.4e0)) * cos(radians(lat)) * pow(sin(radians(lon + 0.2e0) / 2e0), 2e0))), 3) AS metres FROM elements")
def g02(t):
    return t.elements.select("osm_id", F.round(geo.haversine_asin(F.lit(51.4), F.lit(-0.2), "lat", "lon"), 3).alias("metres"))


@query("g03_haversine_drawing", f"SELECT osm_id, round({_hav('51.4e0', '-0.2e0', 'lat', 'lon')}, 3) AS metres FROM elements")
def g03(t):
    return t.elements.select("osm_id", F.round(geo.haversine(F.lit(51.4), F.lit(-0.2), "lat", "lon", geo.RADIUS_DRAWING), 3).alias("metres"))


@query("g05_point_segment", "SELECT osm_id, round(CASE WHEN x < 0 THEN sqrt(x * x + y * y) WHEN x > 100 THEN sqrt((x - 100) * (x - 100) + y * y) ELSE abs(y) END, 6) AS metres FROM (SELECT osm_id, CAST(osm_id % 300 - 100 AS DOUBLE) AS x, CAST(osm_id % 77 - 30 AS DOUBLE) AS y FROM elements) AS q")
def g05(t):
    """Distance to the segment from (0, 0) to (100, 0)."""
    zero, end = F.lit(0.0), F.lit(100.0)
    x, y = (F.col("osm_id") % 300 - 100).cast("double"), (F.col("osm_id") % 77 - 30).cast("double")
    return t.elements.select("osm_id", F.round(geo.point_segment(x, y, zero, zero, end, zero), 6).alias("metres"))


@query("g10_ring_with_hole", "SELECT osm_id, polygon_id FROM elements JOIN squares ON lat >= south AND lat < south + height AND lon >= west AND lon < west + width WHERE NOT (lat >= south + height / 4 AND lat < south + height * 3 / 4 AND lon >= west + width / 4 AND lon < west + width * 3 / 4)")
def g10(t):
    """Points in rings and outside of their holes."""
    part = lambda a, b: F.col(a) + F.col(b) / 4
    far = lambda a, b: F.col(a) + F.col(b) * 3 / 4
    corner = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    w, e, s, n = part("west", "width"), far("west", "width"), part("south", "height"), far("south", "height")
    hole = F.array(corner(w, s), corner(e, s), corner(e, n), corner(w, n), corner(w, s))
    polygons = rings(t.squares).withColumn("hole", hole).select("polygon_id", "ring", "hole")
    inside = spatial.points_in_polygons(t.elements.select("osm_id", "lat", "lon"), polygons)
    return inside.filter(~spatial.inside_ring(F.col("lat"), F.col("lon"), F.col("hole"))).select("osm_id", "polygon_id")


@query("r01_speeds", "SELECT osm_id, round(osm_id / (4.8e0 * 1000 / 3600), 6) AS walk, round(osm_id / (15.5e0 * 1000 / 3600), 6) AS cycle FROM elements")
def r01(t):
    m = F.col("osm_id").cast("double")
    return t.elements.select("osm_id", F.round(geo.travel_seconds(m, "walk"), 6).alias("walk"), F.round(geo.travel_seconds(m, "cycle"), 6).alias("cycle"))


_CANONICAL = f"{_norm('route_number')} || ':' || least({_norm('origin')}, {_norm('destination')}) || ':' || greatest({_norm('origin')}, {_norm('destination')})"


@query("m19_migration_report", f"SELECT count(*) AS before_count, count(DISTINCT {_CANONICAL}) AS after_count, count(*) - count(DISTINCT {_CANONICAL}) AS merged FROM routes WHERE origin <> ''")
def m19(t):
    ends = F.array_sort(F.array(normal_ascii("origin"), normal_ascii("destination")))
    r = t.routes.filter("origin <> ''").select(F.concat_ws(":", normal_ascii("route_number"), ends[0], ends[1]).alias("c"))
    return r.agg(F.count("*").alias("before_count"), F.countDistinct("c").alias("after_count")).withColumn("merged", F.col("before_count") - F.col("after_count"))


@query("n02_source_register", "SELECT 'route' AS kind, route_id AS id, url FROM routes WHERE url <> '' UNION ALL SELECT 'stop', stop_id, 'https://stops.example/' || naptan FROM stops WHERE naptan <> ''")
def n02(t):
    routes = t.routes.filter("url <> ''").select(F.lit("route").alias("kind"), F.col("route_id").alias("id"), "url")
    stops = t.stops.filter("naptan <> ''").select(F.lit("stop").alias("kind"), F.col("stop_id").alias("id"), F.concat(F.lit("https://stops.example/"), "naptan").alias("url"))
    return routes.unionByName(stops)


@query("n07_knowledge_errors", "SELECT key, array_to_string(list_filter([CASE WHEN bool_or(field > 16) THEN 'unknown field' END, CASE WHEN count(*) <> 15 THEN 'missing fields' END, CASE WHEN bool_or(status = '') THEN 'no status' END], lambda x: x IS NOT NULL), '; ') AS errors FROM rail_fields GROUP BY key")
def n07(t):
    g = t.rail_fields.groupBy("key").agg(F.max(F.col("field") > 16).alias("u"), F.count("*").alias("n"), F.max(F.col("status") == "").alias("s"))
    return g.select("key", F.array_join(quality.array_of((F.col("u"), "unknown field"), (F.col("n") != 15, "missing fields"), (F.col("s"), "no status")), "; ").alias("errors"))


@query("n08_shared_counterpart", "SELECT p.key, CAST(greatest(p.date, m.date) AS VARCHAR) AS latest, m.key IS NOT NULL AS shared FROM proposed AS p LEFT JOIN master AS m ON m.key = p.key")
def n08(t):
    m = t.master.select("key", F.col("date").alias("m_date"), F.lit(True).alias("shared"))
    out = t.proposed.join(m, "key", "left")
    return out.select("key", F.greatest("date", "m_date").cast("string").alias("latest"), F.coalesce("shared", F.lit(False)).alias("shared"))


@query("n11_stop_export", "SELECT stop_id, coalesce(nullif(naptan, ''), 'none') AS code, stop_name || CASE WHEN direction = '' THEN '' ELSE ' (' || direction || ')' END AS title FROM stops")
def n11(t):
    title = F.concat("stop_name", F.when(F.col("direction") == "", "").otherwise(F.concat(F.lit(" ("), "direction", F.lit(")"))))
    return t.stops.select("stop_id", F.coalesce(F.nullif(F.col("naptan"), F.lit("")), F.lit("none")).alias("code"), title.alias("title"))


@query("n13_unselected_stops", "SELECT DISTINCT stop_id FROM stop_routes WHERE stop_id NOT IN (SELECT stop_id FROM stops WHERE stop_id % 3 <> 0)")
def n13(t):
    """Imported stops that weren't selected; an import needs none."""
    return t.stop_routes.select("stop_id").distinct().join(t.stops.filter("stop_id % 3 <> 0"), "stop_id", "left_anti")


@query("n17_single_import", "SELECT m.key, CASE WHEN m.seq % 9 = 0 THEN 'identity differs' ELSE 'imported' END AS state, CASE WHEN m.seq % 9 = 0 THEN m.value ELSE m.value + 1 END AS value FROM master AS m")
def n17(t):
    """One record's return must name the record that was asked for; then it's laid over."""
    m = t.master
    back = m.select("key", F.when(F.col("seq") % 9 == 0, "other").otherwise(F.col("key")).alias("named"), (F.col("value") + 1).alias("new"))
    out = m.join(back, "key")
    ok = F.col("named") == F.col("key")
    return out.select("key", F.when(ok, "imported").otherwise("identity differs").alias("state"), F.when(ok, F.col("new")).otherwise(F.col("value")).alias("value"))


@query("n18_saved_proposals", "SELECT kind, key, max(seq) AS seq FROM (SELECT CASE WHEN seq % 2 = 0 THEN 'rail' ELSE 'stop' END AS kind, key, seq FROM proposed) AS q GROUP BY kind, key")
def n18(t):
    """The last proposal of each type and key."""
    p = t.proposed.withColumn("kind", F.when(F.col("seq") % 2 == 0, "rail").otherwise("stop"))
    return select.last_wins(p, ["kind", "key"]).select("kind", "key", "seq")


@query("n23_offset_lines", "SELECT polygon_id, round(west * 1e3 + 1e0, 4) AS x, round(-south * 1e3, 4) AS y FROM squares")
def n23(t):
    """View coordinates of the first corner of each ring, and its left side moved inward by one unit."""
    r = rings(t.squares).select("polygon_id", F.get("ring", 0)["lon"].alias("lon"), F.get("ring", 0)["lat"].alias("lat"), F.get("ring", 3)["lat"].alias("up"))
    normal = F.signum(F.col("up") - F.col("lat"))  # of a side that runs north
    return r.select("polygon_id", F.round(F.col("lon") * 1e3 + normal, 4).alias("x"), F.round(-F.col("lat") * 1e3, 4).alias("y"))


@query("n26_community_choice", "SELECT osm_id, 'community:' || CAST(osm_id AS VARCHAR) AS overlay, osm_id % 3 = 0 AS added FROM elements WHERE amenity IN ('school', 'college', 'library')")
def n26(t):
    """Candidates with the overlay that they'd become, and whether it's there."""
    there = t.elements.filter("osm_id % 3 = 0").select(F.concat(F.lit("community:"), F.col("osm_id").cast("string")).alias("overlay"), F.lit(True).alias("added"))
    c = t.elements.filter(F.col("amenity").isin("school", "college", "library")).select("osm_id", F.concat(F.lit("community:"), F.col("osm_id").cast("string")).alias("overlay"))
    return c.join(there, "overlay", "left").select("osm_id", "overlay", F.coalesce("added", F.lit(False)).alias("added"))


@query("n32_project_context", "SELECT site_id, CASE WHEN site_id % 4 = 0 THEN 'unsupported version' WHEN site_lat IS NULL THEN 'no site' ELSE '' END AS problem FROM sites")
def n32(t):
    doc = F.to_json(F.struct(F.when(F.col("site_id") % 4 == 0, 1).otherwise(2).alias("version"), F.struct("site_lat", "site_lon").alias("site")))
    back = t.sites.select("site_id", F.from_json(doc, "version int, site struct<site_lat:double,site_lon:double>").alias("d"))
    ok = geo.valid_coordinates("d.site.site_lat", "d.site.site_lon")
    return back.select("site_id", F.when(F.col("d.version") != 2, "unsupported version").when(~ok, "no site").otherwise("").alias("problem"))


@query("n33_mode_defaults", "SELECT polygon_id, CASE polygon_id % 2 WHEN 0 THEN 'regional' ELSE 'local' END AS mode, CASE polygon_id % 2 WHEN 0 THEN 50000 ELSE 2500 END AS scale FROM squares")
def n33(t):
    modes = t.spark.createDataFrame([("regional", 50000), ("local", 2500)], "mode string, scale int")
    s = t.squares.select("polygon_id", F.when(F.col("polygon_id") % 2 == 0, "regional").otherwise("local").alias("mode"))
    return s.join(F.broadcast(modes), "mode").select("polygon_id", "mode", "scale")  # two rows


@query("t05_last_good_snapshot", "SELECT key, CASE WHEN key IN (SELECT key FROM master WHERE seq % 5 = 0) THEN 'snapshot' ELSE 'current' END AS source FROM master")
def t05(t):
    """Rows that the current source lacks come from the last good snapshot."""
    current = t.master.filter("seq % 5 <> 0").select("key", F.lit("current").alias("source"))
    snapshot = t.master.select("key", F.lit("snapshot").alias("source"))
    return select.merged_missing(current, snapshot, ["key"])


@query("e04_plan_rules", "SELECT route_id FROM routes WHERE origin <> '' AND status <> 'missing' AND route_id % 3 = 0")
def e04(t):
    """Rules that are given as functions are applied to a plan's input one after the other."""
    rules = [lambda df: df.filter("origin <> ''"), lambda df: df.filter("status <> 'missing'"), lambda df: df.filter("route_id % 3 = 0")]
    out = t.routes
    for rule in rules:
        out = out.transform(rule)
    return out.select("route_id")


@query("x09_publish_gate", "SELECT count(*) FILTER (origin <> '') AS published, count(*) FILTER (origin = '') AS blocked FROM routes")
def x09(t):
    """What passes the gate is published as a new version of a table and read back; the rest is counted."""
    ok = t.routes.filter("origin <> ''")
    path = f"{shared_folder(t.spark)}/published-{uuid.uuid4().hex}"
    version = publish(ok, path, "route_id", None)
    n = t.spark.read.parquet(f"{path}/v={version}").agg(F.count("*").alias("published"))
    return n.crossJoin(t.routes.filter("origin = ''").agg(F.count("*").alias("blocked")))  # one row each

