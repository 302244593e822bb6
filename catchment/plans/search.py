"""Accessibility search queries: scans, classification, nearest facilities, estimates and display order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, keys
from ..functions.text import address, distance_text, duration_text
from ..operators import classify, nearest, select, spatial
from ..registry import query

_TAG_COLUMNS = ("amenity", "shop", "leisure", "railway", "station", "network", "healthcare", "highway", "public_transport", "bus", "waterway", "name", "operator", "ref")


def tagged(elements):
    """Derived elements with their tag columns as a map; empty tags are left out."""
    pairs = [x for c in _TAG_COLUMNS for x in (F.lit(c), F.col(c))] + [F.lit("isced:level"), F.col("isced_level")]
    return elements.withColumn("tags", F.map_filter(F.create_map(*pairs), lambda _, v: v != ""))


_HAV = "6371000e0 * 2e0 * atan2(sqrt(h), sqrt(1e0 - h))"
_H = "pow(sin(radians(lat - site_lat) / 2e0), 2e0) + cos(radians(site_lat)) * cos(radians(lat)) * pow(sin(radians(lon - site_lon) / 2e0), 2e0)"


def within_sql(metres: int, table: str = "elements") -> str:
    return f"SELECT * FROM (SELECT *, {_HAV} AS straight FROM (SELECT *, {_H} AS h FROM sites CROSS JOIN {table}) AS a) AS b WHERE straight <= {metres}"


_NAME = "lower(name || ' ' || operator || ' ' || network || ' ')"


def _rules_sql(variant: str = "module") -> str:
    name = "lower(name || ' ' || operator || ' ')" if variant == "engine" else _NAME
    has = lambda *w: f"regexp_matches({name}, '\\b({'|'.join(w)})\\b')"
    c = classify
    station = "railway IN ('station', 'halt')"
    mode = "lower(station || ' ' || network || ' ' || operator)"
    under = f"(station = 'subway' OR {mode} LIKE '%underground%')"
    over = f"(NOT {under} AND {mode} LIKE '%overground%')"
    dlr = f"(NOT {under} AND NOT {over} AND ({mode} LIKE '%dlr%' OR {mode} LIKE '%docklands%'))"
    level = lambda n: f"list_contains(string_split(isced_level, ';'), '{n}')"
    primary = f"(amenity = 'school' AND ({level(1)} OR {has(*c.PRIMARY)}))"
    secondary = f"(amenity = 'school' AND ({level(2)} OR {level(3)} OR {has(*c.SECONDARY)}))"
    if variant == "engine":
        secondary = f"(({secondary} OR (amenity = 'school' AND {has('academy')})) AND NOT {primary})"
    if variant == "catalogue":
        secondary = f"({secondary} OR (amenity = 'school' AND {has('academy')} AND NOT {primary}))"
    college = f"(amenity = 'college' AND NOT {has(*c.ADULT)})"
    engine = variant == "engine"
    rules = [
        ("bus_stop", "highway = 'bus_stop' OR (public_transport IN ('platform', 'stop_position') AND bus = 'yes')"), ("cycle_parking", "amenity = 'bicycle_parking'"),
        ("underground_station", f"{station} AND {under}"), ("overground_station", f"{station} AND {over}"), ("dlr_station", f"{station} AND {dlr}"), ("national_rail_station", f"{station} AND NOT {under} AND NOT {over} AND NOT {dlr}"),
        ("tram_stop", "railway = 'tram_stop'"), ("nursery", "amenity IN ('kindergarten', 'childcare')"), ("primary_school", primary), ("secondary_school", secondary),
        ("sixth_form", "false" if engine else f"amenity = 'school' AND {has('sixth form')}"), ("sixth_form", f"{college} AND {has('sixth form')}"), ("fe_college", f"{college} AND NOT {has('sixth form')}"), ("university", "amenity = 'university'"),
        ("supermarket", "shop = 'supermarket'"), ("convenience_store", "shop = 'convenience'"), ("post_office", "amenity = 'post_office' OR shop = 'post_office'"), ("bank", "amenity = 'bank'"), ("cashpoint", "amenity = 'atm'"), ("petrol_station", "amenity = 'fuel'"),
        ("gp_surgery", "amenity = 'doctors' OR healthcare IN ('general_practitioner', 'doctor')"), ("gp_surgery", f"amenity = 'clinic' AND {has(*c.GP)} AND NOT {has(*c.NOT_GP)}"),
        ("pharmacy", "amenity = 'pharmacy' OR healthcare = 'pharmacy'"), ("dentist", "amenity = 'dentist' OR healthcare = 'dentist'"), ("hospital", "amenity = 'hospital' OR healthcare = 'hospital'"),
        ("urgent_care", "false" if engine else f"(amenity = 'clinic' OR healthcare = 'clinic') AND {has(*c.URGENT)}"), ("optician", "healthcare = 'optometrist' OR shop = 'optician'"),
        ("park_open_space", "leisure IN ('park', 'recreation_ground')" if variant != "catalogue" else "leisure IN ('park', 'recreation_ground', 'nature_reserve')"), ("playground", "leisure = 'playground'"), ("gym_leisure", "leisure = 'fitness_centre'"),
        ("gym_leisure", "leisure = 'sports_centre'" if engine else f"leisure = 'sports_centre' AND trim(name) <> '' AND {has(*c.GYM)}"), ("sports_facility", "false" if engine else "leisure = 'sports_centre'"),
        ("sports_facility", "leisure IN ('sports_hall', 'pitch', 'track', 'stadium')"), ("library", "amenity = 'library'"), ("community_centre", "amenity = 'community_centre'"), ("place_of_worship", "amenity = 'place_of_worship'"),
        ("pub_bar", "amenity IN ('pub', 'bar')"), ("cafe", "amenity = 'cafe'"), ("restaurant", "amenity = 'restaurant'"),
    ]
    return " UNION ALL ".join(f"SELECT e.*, {i} AS rule, '{k}' AS category FROM e WHERE {cond}" for i, (k, cond) in enumerate(rules))


def classified_sql(source: str, variant: str = "module") -> str:
    return f"(WITH e AS ({source}) {_rules_sql(variant)})"


def _facility_query(name: str, variant: str):
    @query(name, f"SELECT osm_type, osm_id, category, CAST(rule AS INTEGER) AS rule FROM {classified_sql('SELECT * FROM elements', variant)} AS x")
    def run(t):
        return classify.classify_facilities(tagged(t.elements), variant).select("osm_type", "osm_id", "category", "rule")


_facility_query("c01_facility_classify", "module")
_facility_query("c02_engine_classify", "engine")
_facility_query("c03_catalogue_classify", "catalogue")


def _found(t, metres: float):
    near = spatial.radius_join(t.sites, tagged(t.elements), metres)
    out = classify.classify_facilities(near).withColumn("facility", keys.facility("category", "osm_type", "osm_id"))
    return select.first_wins(out, ["site_id", "facility"], "rule")


_FOUND_SQL = lambda metres: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, category, osm_type, osm_id ORDER BY rule) AS dup FROM {classified_sql(within_sql(metres))} AS c) AS d WHERE dup = 1)"


@query("j01_radius_join", f"SELECT site_id, osm_id, round(straight, 3) AS straight FROM ({within_sql(2000)}) AS r")
def j01(t):
    return spatial.radius_join(t.sites, t.elements, 2000.0).select("site_id", "osm_id", F.round("straight", 3).alias("straight"))


@query("s01_around_scan", f"SELECT site_id, osm_type, osm_id FROM ({within_sql(2000)}) AS r WHERE amenity <> '' OR shop <> '' OR leisure <> '' OR healthcare <> '' OR railway IN ('station', 'halt', 'tram_stop') OR highway = 'bus_stop' OR public_transport <> ''")
def s01(t):
    wanted = "amenity <> '' or shop <> '' or leisure <> '' or healthcare <> '' or railway in ('station', 'halt', 'tram_stop') or highway = 'bus_stop' or public_transport <> ''"
    return spatial.radius_join(t.sites, t.elements.filter(wanted), 2000.0).select("site_id", "osm_type", "osm_id")


@query("s02_extension_scan", f"SELECT site_id, osm_type, osm_id FROM ({within_sql(5000)}) AS r WHERE railway IN ('station', 'halt', 'tram_stop') OR amenity IN ('school', 'college', 'university', 'hospital', 'clinic')")
def s02(t):
    wanted = "railway in ('station', 'halt', 'tram_stop') or amenity in ('school', 'college', 'university', 'hospital', 'clinic')"
    return spatial.radius_join(t.sites, t.elements.filter(wanted), 5000.0).select("site_id", "osm_type", "osm_id")


@query("s03_stop_scan", f"SELECT site_id, osm_id FROM ({within_sql(800)}) AS r WHERE highway = 'bus_stop' OR (public_transport IN ('platform', 'stop_position') AND bus = 'yes')")
def s03(t):
    wanted = "highway = 'bus_stop' or (public_transport in ('platform', 'stop_position') and bus = 'yes')"
    return spatial.radius_join(t.sites, t.elements.filter(wanted), 800.0).select("site_id", "osm_id")


@query("s04_station_scan", f"SELECT site_id, osm_id FROM ({within_sql(5000)}) AS r WHERE railway IN ('station', 'halt', 'tram_stop') OR station IN ('subway', 'light_rail') OR regexp_matches(network, '(?i)rail|underground|overground|dlr|tram')")
def s04(t):
    wanted = F.col("railway").isin("station", "halt", "tram_stop") | F.col("station").isin("subway", "light_rail") | F.col("network").rlike("(?i)rail|underground|overground|dlr|tram")
    return spatial.radius_join(t.sites, t.elements.filter(wanted), 5000.0).select("site_id", "osm_id")


_NEAR_SEMI = f"""SELECT osm_id FROM elements AS b WHERE osm_type <> 'node' AND EXISTS (SELECT 1 FROM elements AS a WHERE (a.amenity <> '' OR a.shop <> '') AND a.osm_type = 'node'
 AND abs(a.lat - b.lat) < 2e-3 AND abs(a.lon - b.lon) < 4e-3 AND {_HAV.replace('h)', '(' + _H.replace('site_lat', 'a.lat').replace('site_lon', 'a.lon').replace('radians(lat ', 'radians(b.lat ').replace('radians(lon ', 'radians(b.lon ').replace('cos(radians(lat))', 'cos(radians(b.lat))') + '))')} <= 100)"""


@query("s05_near_candidates", f"SELECT osm_id FROM elements AS b WHERE osm_type <> 'node' AND osm_id IN (SELECT osm_id FROM (SELECT osm_id, {_HAV} AS straight FROM (SELECT b.osm_id, {_H} AS h FROM (SELECT lat AS site_lat, lon AS site_lon FROM elements WHERE osm_type = 'node' AND (amenity <> '' OR shop <> '')) AS a JOIN elements AS b ON abs(b.lat - a.site_lat) < 2e-3 AND abs(b.lon - a.site_lon) < 4e-3) AS x) AS y WHERE straight <= 100)")
def s05(t):
    """Buildings within 100 m of a named candidate, as a semi-join."""
    e = t.elements
    candidates = e.filter("osm_type = 'node' and (amenity <> '' or shop <> '')").select(F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon")).distinct()
    near = spatial.radius_join(candidates, e.filter("osm_type <> 'node'"), 100.0)
    return near.select("osm_id").distinct()


@query("f04_radius_filter", f"SELECT site_id, count(*) AS n FROM ({within_sql(5000)}) AS r GROUP BY site_id")
def f04(t):
    return spatial.radius_join(t.sites, t.elements, 5000.0).groupBy("site_id").agg(F.count("*").alias("n"))


@query("a01_nearest_per_category", f"""SELECT site_id, category, osm_type, osm_id, round(straight, 3) AS straight, round(straight * 1.2e0, 3) AS walk_metres, round(straight * 1.2e0 / (4.8e0 * 1000 / 3600), 2) AS walk_seconds
FROM (SELECT *, row_number() OVER (PARTITION BY site_id, category ORDER BY straight, seq) AS rn FROM {_FOUND_SQL(5000)} AS f) AS g WHERE rn = 1""")
def a01(t):
    """The nearest facility of each category around each site, with estimated walks."""
    nearest = select.ranked(_found(t, 5000.0), ["site_id", "category"], ["straight", "seq"])
    walk = geo.estimated_metres("straight")
    return nearest.select("site_id", "category", "osm_type", "osm_id", F.round("straight", 3).alias("straight"), F.round(walk, 3).alias("walk_metres"), F.round(geo.travel_seconds(walk, "walk"), 2).alias("walk_seconds"))


@query("a01_nearest_anywhere", "SELECT site_id, amenity, round(min(sqrt(pow((lon - site_lon) * 111320e0 * cos(radians(site_lat)), 2e0) + pow((lat - site_lat) * 110540e0, 2e0))), 3) AS nearest FROM sites CROSS JOIN elements WHERE amenity <> '' GROUP BY site_id, amenity")
def a01_anywhere(t):
    """How far each site is from the nearest element of each kind, at any distance."""
    sites = t.sites.select("site_id", F.col("site_lat").alias("p_lat"), F.col("site_lon").alias("p_lon"))
    found = t.elements.filter("amenity <> ''").select("amenity", "lon", "lat", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return nearest.nearest(sites, found, "site_id", by=["amenity"]).select("site_id", "amenity", F.round("nearest", 3).alias("nearest"))


@query("a02_group_lists", f"SELECT site_id, category, count(*) AS n, string_agg(CAST(osm_id AS VARCHAR), ',' ORDER BY straight, osm_id) AS facilities FROM {_FOUND_SQL(2000)} AS f GROUP BY site_id, category")
def a02(t):
    found = _found(t, 2000.0)
    lists = found.groupBy("site_id", "category").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("straight", "osm_id"))).alias("l"))
    return lists.select("site_id", "category", "n", F.array_join(F.transform("l", lambda x: x["osm_id"].cast("string")), ",").alias("facilities"))


@query("w01_first_wins", f"SELECT site_id, category, osm_type, osm_id, CAST(rule AS INTEGER) AS rule FROM {_FOUND_SQL(2000)} AS f")
def w01(t):
    return _found(t, 2000.0).select("site_id", "category", "osm_type", "osm_id", "rule")


@query("w05_topk", f"SELECT site_id, osm_id, rn FROM (SELECT site_id, osm_id, CAST(row_number() OVER (PARTITION BY site_id ORDER BY round(straight, 3), name, osm_id) AS INTEGER) AS rn FROM ({within_sql(5000)}) AS r) AS s WHERE rn <= 10")
def w05(t):
    near = spatial.radius_join(t.sites, t.elements, 5000.0)
    return select.ranked(near, "site_id", [F.round("straight", 3), F.col("name"), F.col("osm_id")], 10, name="rn").select("site_id", "osm_id", "rn")


_GROUP_OF = {c: (g, k) for g, (_, cs) in enumerate(classify.GROUPS.items()) for k, c in enumerate(cs)}


@query("o02_group_order", f"""SELECT site_id, category, osm_id, CAST(row_number() OVER (PARTITION BY site_id ORDER BY pos, CASE WHEN osm_id % 3 = 0 THEN CAST(osm_id % 2500 AS BIGINT) ELSE CAST(round(straight) AS BIGINT) END, osm_id, osm_type, category) AS INTEGER) AS shown FROM (SELECT f.*, CASE category {' '.join(f"WHEN '{c}' THEN {g}" for c, (g, _) in _GROUP_OF.items())} END AS pos FROM {_FOUND_SQL(2000)} AS f) AS p""")
def o02(t):
    """Display order: group, then the walk to it in whole metres where it is known, else the straight distance."""
    pos = F.create_map(*[F.lit(x) for c, (g, _) in _GROUP_OF.items() for x in (c, g)])
    walks = t.elements.filter("osm_id % 3 = 0").select("osm_id", (F.col("osm_id") % 2500).cast("long").alias("walk"))
    found = _found(t, 2000.0).withColumn("pos", pos[F.col("category")]).join(walks, "osm_id", "left")
    away = F.coalesce("walk", F.round("straight").cast("long"))
    return select.ranked(found, "site_id", [F.col("pos"), away, F.col("osm_id"), F.col("osm_type"), F.col("category")], 1 << 30, name="shown").select("site_id", "category", "osm_id", "shown")


_WIDE_SQL = ", ".join(f"'{w}'" for w in classify.WIDE)


@query("u07_two_phase_search", f"""SELECT site_id, category, osm_id FROM (
 SELECT a.*, row_number() OVER (PARTITION BY site_id, category ORDER BY straight, seq) AS rn FROM (
  SELECT n.* FROM {_FOUND_SQL(2000)} AS n
  UNION ALL
  SELECT w.* FROM {_FOUND_SQL(5000)} AS w WHERE straight > 2000 AND (railway IN ('station', 'halt', 'tram_stop') OR amenity IN ('school', 'college', 'university', 'hospital', 'clinic'))
   AND site_id NOT IN (SELECT site_id FROM {_FOUND_SQL(2000)} AS k WHERE category IN ({_WIDE_SQL}) GROUP BY site_id HAVING count(DISTINCT category) = {len(classify.WIDE)})) AS a) AS b WHERE rn = 1""")
def u07(t):
    """A wider scan joins in for every site that lacks any of the wide categories; then all is classified again."""
    near = _found(t, 2000.0)
    whole = near.filter(F.col("category").isin(*classify.WIDE)).groupBy("site_id").agg(F.countDistinct("category").alias("n")).filter(F.col("n") == len(classify.WIDE))
    wanted = "railway in ('station', 'halt', 'tram_stop') or amenity in ('school', 'college', 'university', 'hospital', 'clinic')"
    wide = _found(t, 5000.0).filter("straight > 2000").filter(wanted).join(whole, "site_id", "left_anti")
    return select.ranked(near.unionByName(wide), ["site_id", "category"], ["straight", "seq"]).select("site_id", "category", "osm_id")


@query("j02_route_or_estimate", f"""SELECT r.site_id, r.osm_id, CASE WHEN r.osm_id % 3 = 0 THEN 'routed' ELSE 'estimated' END AS status, round(CASE WHEN r.osm_id % 3 = 0 THEN CAST(r.osm_id AS DOUBLE) ELSE straight * 1.2e0 END, 3) AS metres FROM ({within_sql(2000)}) AS r""")
def j02(t):
    """Known routes where there are any, estimates elsewhere."""
    near = spatial.radius_join(t.sites, t.elements, 2000.0)
    routes = t.elements.filter("osm_id % 3 = 0").select("osm_id", F.col("osm_id").cast("double").alias("routed"))
    out = near.join(routes, "osm_id", "left")
    status = F.when(F.col("routed").isNotNull(), "routed").otherwise("estimated")
    return out.select("site_id", "osm_id", status.alias("status"), F.round(F.coalesce("routed", geo.estimated_metres("straight")), 3).alias("metres"))


@query("r02_estimate", f"SELECT site_id, osm_id, round(straight * 1.2e0, 3) AS metres, round(straight * 1.2e0 / (4.8e0 * 1000 / 3600), 3) AS walk, round(straight * 1.2e0 / (15.5e0 * 1000 / 3600), 3) AS cycle FROM ({within_sql(2000)}) AS r")
def r02(t):
    near = spatial.radius_join(t.sites, t.elements, 2000.0)
    m = geo.estimated_metres("straight")
    return near.select("site_id", "osm_id", F.round(m, 3).alias("metres"), F.round(geo.travel_seconds(m, "walk"), 3).alias("walk"), F.round(geo.travel_seconds(m, "cycle"), 3).alias("cycle"))


@query("r03_rail_estimate", f"SELECT site_id, osm_id, round(straight * 1.25e0, 3) AS metres, round(straight * 1.25e0 / (15e0 * 1000 / 3600), 3) AS cycle FROM ({within_sql(2000)}) AS r")
def r03(t):
    near = spatial.radius_join(t.sites, t.elements, 2000.0)
    m = geo.estimated_metres("straight", rail=True)
    return near.select("site_id", "osm_id", F.round(m, 3).alias("metres"), F.round(geo.travel_seconds(m, "cycle", rail=True), 3).alias("cycle"))


@query("n31_manual_rows", f"""SELECT site_id, category, osm_id, manual FROM (SELECT *, row_number() OVER (PARTITION BY site_id, category ORDER BY manual DESC, straight, osm_id) AS rn FROM (
 SELECT site_id, category, osm_id, straight, false AS manual FROM {_FOUND_SQL(2000)} AS f UNION ALL SELECT site_id, 'library', -site_id, 0e0, true FROM sites WHERE site_id % 2 = 0) AS u) AS v WHERE rn = 1""")
def n31(t):
    """A row entered by hand replaces what was found for its category."""
    found = _found(t, 2000.0).select("site_id", "category", "osm_id", "straight", F.lit(False).alias("manual"))
    own = t.sites.filter("site_id % 2 = 0").select("site_id", F.lit("library").alias("category"), (-F.col("site_id")).alias("osm_id"), F.lit(0.0).alias("straight"), F.lit(True).alias("manual"))
    return select.ranked(found.union(own), ["site_id", "category"], [F.col("manual").desc(), F.col("straight"), F.col("osm_id")]).select("site_id", "category", "osm_id", "manual")


@query("p03_distance_text", "SELECT osm_id, CASE WHEN osm_id * 7e0 / 3 < 1000 THEN CAST(CAST(floor(osm_id * 7e0 / 3 + 0.5e0) AS BIGINT) AS VARCHAR) || ' m' ELSE printf('%.1f', floor(osm_id * 7e0 / 3 / 100e0 + 0.5e0) / 10) || ' km' END AS shown FROM elements")
def p03(t):
    return t.elements.select("osm_id", distance_text(F.col("osm_id") * 7.0 / 3).alias("shown"))


@query("p04_duration_text", "SELECT osm_id, CAST(greatest(1, CAST(floor(osm_id * 11e0 / 60e0 + 0.5e0) AS BIGINT)) AS VARCHAR) || ' min' AS shown FROM elements")
def p04(t):
    return t.elements.select("osm_id", duration_text(F.col("osm_id") * 11.0).alias("shown"))


@query("p02_address", "SELECT osm_id, concat_ws(', ', nullif(concat_ws(' ', nullif(ref, ''), nullif(name, '')), ''), nullif(network, ''), nullif(operator, '')) AS address FROM elements")
def p02(t):
    return t.elements.select("osm_id", address("ref", "name", "network", "operator").alias("address"))


@query("f03_rail_evidence", """SELECT osm_id FROM elements WHERE railway IN ('station', 'halt', 'tram_stop') OR station IN ('train', 'subway', 'light_rail', 'monorail') OR regexp_matches(lower(network || ' ' || operator || ' ' || name), '\\b(rail|railway|underground|overground|tram|dlr|metro)\\b')""")
def f03(t):
    return tagged(t.elements).filter(classify.has_rail_evidence(classify.Tags())).select("osm_id")


_MODE = "lower(concat_ws(' ', nullif(network, ''), nullif(operator, ''), nullif(station, ''), nullif(name, '')))"


@query("c04_rail_mode", f"""SELECT osm_id, CASE WHEN railway = 'tram_stop' OR {_MODE} LIKE '%tram%' THEN 'Tram/light rail' WHEN {_MODE} LIKE '%docklands light railway%' OR {_MODE} LIKE '% dlr%' OR {_MODE} LIKE 'dlr%' THEN 'DLR'
 WHEN {_MODE} LIKE '%overground%' THEN 'London Overground' WHEN station = 'subway' OR {_MODE} LIKE '%underground%' THEN 'London Underground' WHEN station = 'light_rail' THEN 'Tram/light rail' ELSE 'National Rail' END AS mode FROM elements WHERE railway <> ''""")
def c04(t):
    return tagged(t.elements).filter("railway <> ''").select("osm_id", classify.station_mode(classify.Tags()).alias("mode"))


@query("c05_line_mode", """SELECT osm_id, CASE WHEN s LIKE '%docklands light railway%' OR regexp_matches(s, '\\bdlr\\b') THEN 'DLR' WHEN s LIKE '%overground%' THEN 'London Overground' WHEN railway = 'subway' OR s LIKE '%underground%' THEN 'London Underground'
 WHEN railway IN ('tram', 'light_rail') OR s LIKE '%tram%' THEN 'Tram/light rail' WHEN s LIKE '%national rail%' OR s LIKE '%network rail%' THEN 'National Rail' ELSE '' END AS mode
 FROM (SELECT *, lower(concat_ws(' ', nullif(network, ''), nullif(operator, ''), nullif(name, ''))) AS s FROM elements WHERE railway <> '') AS x""")
def c05(t):
    return tagged(t.elements).filter("railway <> ''").select("osm_id", classify.line_mode(classify.Tags()).alias("mode"))


_GEOM = "CASE WHEN osm_type = 'node' THEN 'Point' WHEN osm_id % 5 = 0 THEN 'Polygon' ELSE 'LineString' END"


@query("c06_drawing_class", f"""SELECT osm_id, CASE WHEN amenity IN ({', '.join(f"'{a}'" for a in classify.COMMUNITY_AMENITY)}) OR shop IN ('supermarket', 'convenience') THEN 'community-candidate' WHEN highway LIKE 'motorway%' THEN 'motorway' WHEN highway LIKE 'primary%' THEN 'main-road'
 WHEN highway = 'residential' THEN 'context-road-minor' WHEN highway = 'cycleway' THEN 'cycle-route' WHEN railway = 'rail' THEN 'railway'
 WHEN railway IN ('station', 'halt', 'tram_stop') THEN CASE WHEN railway = 'tram_stop' OR {_MODE} LIKE '%tram%' THEN 'station-tram' WHEN {_MODE} LIKE '% dlr%' OR {_MODE} LIKE 'dlr%' THEN 'station-dlr' WHEN {_MODE} LIKE '%overground%' THEN 'station-overground' WHEN station = 'subway' THEN 'station-underground' WHEN station = 'light_rail' THEN 'station-tram' ELSE 'station-national-rail' END
 WHEN waterway IN ('river', 'canal') THEN 'waterway-review' END AS class FROM elements""")
def c06(t):
    drawn = tagged(t.elements).withColumn("geometry_type", F.expr(_GEOM))
    return drawn.select("osm_id", classify.drawing_class(classify.Tags()).alias("class"))


@query("a03_class_counts", f"SELECT category, count(*) AS n FROM {classified_sql('SELECT * FROM elements')} AS x GROUP BY category")
def a03(t):
    return classify.classify_facilities(tagged(t.elements)).groupBy("category").agg(F.count("*").alias("n"))
