"""Queries of the geometry kernel, lines, polygons and map frames."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import nearest, scans, spatial
from ..operators import rings as rings_
from ..registry import query

_hav = lambda a, b, c, d, r="6371008.8e0": f"(2e0 * {r} * atan2(sqrt(pow(sin(radians({c} - {a}) / 2e0), 2e0) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2e0), 2e0)), sqrt(1e0 - (pow(sin(radians({c} - {a}) / 2e0), 2e0) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2e0), 2e0)))))"
_STEPS = f"(SELECT *, coalesce({_hav('plat', 'plon', 'lat', 'lon')}, 0e0) AS step FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM traces WINDOW w AS (PARTITION BY route_id ORDER BY seq)) AS l)"
_MEASURED = f"(SELECT *, sum(step) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS measure FROM {_STEPS} AS s)"
_SEGMENTS = "(SELECT route_id, seq, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM traces WINDOW w AS (PARTITION BY route_id ORDER BY seq))"


@query("g01_haversine", f"SELECT osm_id, round({_hav('51.5e0', '-0.1e0', 'lat', 'lon', '6371000e0')}, 3) AS atan, round(2e0 * 6371000e0 * asin(sqrt(pow(sin(radians(lat - 51.5e0) / 2e0), 2e0) + cos(radians(51.5e0)) * cos(radians(lat)) * pow(sin(radians(lon + 0.1e0) / 2e0), 2e0))), 3) AS asin, round({_hav('51.5e0', '-0.1e0', 'lat', 'lon')}, 3) AS drawing FROM elements")
def g01(t):
    lat0, lon0 = F.lit(51.5), F.lit(-0.1)
    return t.elements.select(
        "osm_id", F.round(geo.haversine(lat0, lon0, "lat", "lon"), 3).alias("atan"), F.round(geo.haversine_asin(lat0, lon0, "lat", "lon"), 3).alias("asin"), F.round(geo.haversine(lat0, lon0, "lat", "lon", geo.RADIUS_DRAWING), 3).alias("drawing")
    )


@query("g04_local_metres", "SELECT osm_id, round((lon + 0.1e0) * 111320e0 * cos(radians(51.5e0)), 3) AS east, round((lat - 51.5e0) * 110540e0, 3) AS north FROM elements")
def g04(t):
    east, north = geo.local_xy("lat", "lon", F.lit(51.5), F.lit(-0.1))
    return t.elements.select("osm_id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query("g06_national_grid")
def g06(t):
    """Grid metres and the error of the way back, in millimetres of latitude."""
    g = t.elements.withColumn("g", geo.to_grid("lat", "lon"))
    back = geo.from_grid("g.east", "g.north")
    return g.select("osm_id", F.round("g.east", 2).alias("east"), F.round("g.north", 2).alias("north"), F.round(F.abs(back["lat"] - F.col("lat")) * 110540.0 * 1000, 0).alias("error_mm"))


@query("g07_map_frame", "SELECT polygon_id, scale, round(scale * 33.6e1 / 1000, 3) AS ground_width, round(scale * 24.5e1 / 1000, 3) AS ground_height, round(500e0 / scale * 1000, 4) AS bar_mm FROM (SELECT polygon_id, CASE polygon_id % 3 WHEN 0 THEN 50000e0 WHEN 1 THEN 2500e0 ELSE 10000e0 END AS scale FROM squares) AS q")
def g07(t):
    """Ground size of a paper frame and paper length of a bar of 500 m."""
    s = t.squares.withColumn("scale", F.expr("case polygon_id % 3 when 0 then 50000D when 1 then 2500D else 10000D end"))
    return s.select("polygon_id", "scale", F.round(F.col("scale") * 336.0 / 1000, 3).alias("ground_width"), F.round(F.col("scale") * 245.0 / 1000, 3).alias("ground_height"), F.round(F.lit(500.0) / F.col("scale") * 1000, 4).alias("bar_mm"))


@query("g08_web_mercator", "SELECT osm_id, round((lon + 180e0) / 360e0 * 2097152e0, 3) AS x, round((1e0 - asinh(tan(radians(lat))) / pi()) / 2e0 * 2097152e0, 3) AS y, round(lat, 6) AS lat, round(lon, 6) AS lon FROM elements")
def g08(t):
    x, y = geo.web_mercator("lat", "lon", 13)
    p = t.elements.select("osm_id", x.alias("x"), y.alias("y"))
    lat, lon = geo.from_web_mercator("x", "y", 13)
    return p.select("osm_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("s06_grid_box")
def s06(t):
    """WGS84 box of grid extents around each square's corner, from all four corners."""
    g = t.squares.select("polygon_id", geo.to_grid("south", "west").alias("g"))
    corners = [geo.from_grid(F.col("g.east") + dx, F.col("g.north") + dy) for dx in (0.0, 800.0) for dy in (0.0, 700.0)]
    lat, lon = [c["lat"] for c in corners], [c["lon"] for c in corners]
    return g.select("polygon_id", F.round(F.least(*lat), 6).alias("south"), F.round(F.greatest(*lat), 6).alias("north"), F.round(F.least(*lon), 6).alias("west"), F.round(F.greatest(*lon), 6).alias("east"))


_TX = lambda c: f"CAST(floor(({c} + 180e0) / 360e0 * 8192e0) AS BIGINT)"
_TY = lambda c: f"CAST(floor((1e0 - asinh(tan(radians({c}))) / pi()) / 2e0 * 8192e0) AS BIGINT)"


@query("s16_tile_manifest", f"SELECT polygon_id, x, y, CAST(n AS BIGINT) AS n FROM (SELECT *, count(*) OVER (PARTITION BY polygon_id) AS n FROM (SELECT polygon_id, x, unnest(range({_TY('south + height')}, {_TY('south')} + 1)) AS y FROM (SELECT *, unnest(range({_TX('west')}, {_TX('west + width')} + 1)) AS x FROM squares) AS a) AS b) AS c WHERE n <= 80")
def s16(t):
    """Tiles of zoom 13 over each square; views of more than 80 tiles aren't drawn."""
    tile = lambda lat, lon: tuple(F.floor(v / 256.0) for v in geo.web_mercator(lat, lon, 13))
    x0, y0 = tile(F.col("south") + F.col("height"), F.col("west"))
    x1, y1 = tile(F.col("south"), F.col("west") + F.col("width"))
    n = ((x1 - x0 + 1) * (y1 - y0 + 1)).cast("long")
    s = t.squares.withColumn("n", n).filter("n <= 80").withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y", F.explode(F.sequence(y0, y1)))
    return s.select("polygon_id", "x", "y", "n")


@query("a21_tile_summary", f"SELECT polygon_id, count(*) AS tiles, min(x) AS min_x, max(y) AS max_y FROM (SELECT polygon_id, x, unnest(range({_TY('south + height')}, {_TY('south')} + 1)) AS y FROM (SELECT *, unnest(range({_TX('west')}, {_TX('west + width')} + 1)) AS x FROM squares) AS a) AS b GROUP BY polygon_id HAVING count(*) <= 80")
def a21(t):
    return s16(t).groupBy("polygon_id").agg(F.count("*").alias("tiles"), F.min("x").alias("min_x"), F.max("y").alias("max_y"))


def rings(squares):
    """Vertices of the closed ring of each square, counter-clockwise."""
    corner = lambda seq, dx, dy: F.struct(F.lit(seq).alias("seq"), (F.col("west") + F.col("width") * dx).alias("lon"), (F.col("south") + F.col("height") * dy).alias("lat"))
    ring = F.array(*[corner(i, dx, dy) for i, (dx, dy) in enumerate(((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)))])
    return squares.withColumn("ring", ring)


def vertices(squares):
    return rings(squares).select("polygon_id", F.explode("ring").alias("v")).select("polygon_id", "v.seq", "v.lon", "v.lat")


@query("j08_point_in_polygon", "SELECT osm_id, polygon_id FROM elements JOIN squares ON lat >= south AND lat < south + height AND lon >= west AND lon < west + width")
def j08(t):
    return spatial.points_in_polygons(t.elements.select("osm_id", "lat", "lon"), rings(t.squares).select("polygon_id", "ring")).select("osm_id", "polygon_id")


@query("j08_adopted_footprint", "SELECT osm_id, count(polygon_id) AS matches, CASE count(polygon_id) WHEN 1 THEN 'adopted' WHEN 0 THEN 'review' ELSE 'choice' END AS state, CASE WHEN count(polygon_id) = 1 THEN min(polygon_id) END AS adopted FROM elements LEFT JOIN squares ON lat >= south AND lat < south + height AND lon >= west AND lon < west + width GROUP BY osm_id")
def j08_adopted(t):
    points = t.elements.select("osm_id", "lat", "lon")
    pairs = spatial.points_in_polygons(points, rings(t.squares).select("polygon_id", "ring")).select("osm_id", "polygon_id")
    return spatial.adopt_containing(points.join(pairs, "osm_id", "left"), "osm_id", "polygon_id")


_RINGS = "(SELECT ring_id, place AS i, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, count(*) OVER (PARTITION BY ring_id) - 1 AS n FROM outlines WINDOW w AS (PARTITION BY ring_id ORDER BY place))"
_SIDE = lambda a, b, c: f"CASE WHEN abs(({b}lat - {a}lat) * ({c}lon - {b}lon) - ({b}lon - {a}lon) * ({c}lat - {b}lat)) < 1e-12 THEN 0 ELSE sign(({b}lat - {a}lat) * ({c}lon - {b}lon) - ({b}lon - {a}lon) * ({c}lat - {b}lat)) END".replace("2lat", "lat2").replace("2lon", "lon2")
_CROSSED = f"(SELECT DISTINCT x.ring_id FROM {_RINGS} AS x JOIN {_RINGS} AS y ON x.ring_id = y.ring_id WHERE y.i > x.i + 1 AND NOT (x.i = 0 AND y.i = x.n - 1) AND x.lon2 IS NOT NULL AND y.lon2 IS NOT NULL AND {_SIDE('x.', 'x.2', 'y.')} <> {_SIDE('x.', 'x.2', 'y.2')} AND {_SIDE('y.', 'y.2', 'x.')} <> {_SIDE('y.', 'y.2', 'x.2')})"


@query("g09_polygon_validity", f"""SELECT ring_id, CASE WHEN positions < 4 THEN 'short' WHEN NOT closed THEN 'open' WHEN ring_id IN {_CROSSED} THEN 'self-intersecting' WHEN area < 1e-14 THEN 'flat' ELSE '' END AS reason FROM
 (SELECT ring_id, count(*) AS positions, arg_min(lon, i) = arg_max(lon, i) AND arg_min(lat, i) = arg_max(lat, i) AS closed, coalesce(abs(sum(lon * lat2 - lon2 * lat) / 2e0), 0e0) AS area FROM {_RINGS} AS r GROUP BY ring_id) AS g""")
def g09(t):
    """Why a ring isn't valid, '' if it is: at least four positions, closed, no crossing of its own, an area, within range."""
    return rings_.checked(t.outlines, "ring_id", "place")


@query("j22_self_intersection", f"SELECT ring_id FROM {_CROSSED} AS c")
def j22(t):
    """Rings two of whose segments that aren't neighbours cross."""
    return rings_.crossings(t.outlines, "ring_id", "place").select("ring_id").distinct()


@query("a10_line_length", f"SELECT route_id, round(sum(step), 2) AS length, count(*) AS vertices FROM {_STEPS} AS s GROUP BY route_id")
def a10(t):
    return spatial.line_lengths(t.traces, "route_id", "seq").select("route_id", F.round("length", 2).alias("length"), "vertices")


@query("a11_bounds", "SELECT polygon_id, round(west, 6) AS west, round(west + width, 6) AS east, round(south, 6) AS south, round(south + height, 6) AS north, round((west * 3 + (west + width) * 2) / 5, 6) AS mean_lon, round((south * 3 + (south + height) * 2) / 5, 6) AS mean_lat FROM squares")
def a11(t):
    b = spatial.bounds(vertices(t.squares), "polygon_id")
    return b.select("polygon_id", *[F.round(c, 6).alias(c) for c in ("west", "east", "south", "north", "mean_lon", "mean_lat")])


@query("a12_signed_area", "SELECT polygon_id, round(width * height, 8) AS area FROM squares")
def a12(t):
    return spatial.signed_area(vertices(t.squares), "polygon_id", "seq").select("polygon_id", F.round("area", 8).alias("area"))


@query("w11_measures", f"SELECT route_id, seq, round(measure, 2) AS measure FROM {_MEASURED} AS m")
def w11(t):
    return spatial.measures(t.traces, "route_id", "seq").select("route_id", "seq", F.round("measure", 2).alias("measure"))


_HALF = f"(SELECT route_id, max(measure) / 2 AS goal FROM {_MEASURED} AS m GROUP BY route_id)"


@query("g15_line_anchor", f"SELECT route_id, round(lon + (lon2 - lon) * CASE WHEN measure2 > measure THEN (goal - measure) / (measure2 - measure) ELSE 0e0 END, 6) AS lon, round(lat + (lat2 - lat) * CASE WHEN measure2 > measure THEN (goal - measure) / (measure2 - measure) ELSE 0e0 END, 6) AS lat FROM (SELECT m.*, goal, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(measure) OVER w AS measure2, row_number() OVER w AS rank FROM {_MEASURED} AS m JOIN {_HALF} AS h USING (route_id) WINDOW w AS (PARTITION BY route_id ORDER BY seq)) AS q WHERE goal <= measure2 AND (goal > measure OR rank = 1 AND goal = measure)")
def g15(t):
    """The point at half of each line's length."""
    m = spatial.measures(t.traces, "route_id", "seq")
    half = m.groupBy("route_id").agg((F.max("measure") / 2).alias("at"))
    return spatial.points_at(m, "route_id", "seq", half).select("route_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("w12_arrow_places", f"SELECT route_id, CAST(arrow AS INTEGER) AS arrow, round(length * arrow / (n + 1), 2) AS at FROM (SELECT *, unnest(range(1, n + 1)) AS arrow FROM (SELECT route_id, sum(step) AS length, least(7, greatest(1, CAST(floor(sum(step) / 3000e0) AS BIGINT))) AS n FROM {_STEPS} AS s GROUP BY route_id) AS a) AS b")
def w12(t):
    lengths = spatial.line_lengths(t.traces, "route_id", "seq")
    return spatial.arrow_places(lengths, "route_id", 3000.0).select("route_id", "arrow", F.round("at", 2).alias("at"))


@query("w13_densified", f"SELECT route_id, count(*) AS points, CAST(sum(CASE WHEN part = 0 THEN 1 ELSE 0 END) AS BIGINT) AS originals FROM (SELECT route_id, seq, unnest(range(0, extra + 1)) AS part FROM (SELECT route_id, seq, coalesce(least(16, greatest(0, CAST(ceil({_hav('lat', 'lon', 'lat2', 'lon2')} / 60e0) AS BIGINT) - 1)), 0) AS extra FROM {_SEGMENTS} AS s) AS a) AS b GROUP BY route_id")
def w13(t):
    d = spatial.densified(t.traces, "route_id", "seq", 60.0)
    return d.groupBy("route_id").agg(F.count("*").alias("points"), F.sum(F.col("original").cast("long")).alias("originals"))


_LOCAL = "SELECT *, (a.lon - p_lon) * 111320e0 * cos(radians(p_lat)) AS ax, (a.lat - p_lat) * 110540e0 AS ay, (a.lon2 - p_lon) * 111320e0 * cos(radians(p_lat)) AS bx2, (a.lat2 - p_lat) * 110540e0 AS by2"
_NEAREST = f"""SELECT osm_id, round(min(sqrt(pow(ax + k * (bx2 - ax), 2e0) + pow(ay + k * (by2 - ay), 2e0))), 3) AS nearest FROM (SELECT *, CASE WHEN pow(bx2 - ax, 2e0) + pow(by2 - ay, 2e0) > 0 THEN least(1e0, greatest(0e0, (-ax * (bx2 - ax) - ay * (by2 - ay)) / (pow(bx2 - ax, 2e0) + pow(by2 - ay, 2e0)))) ELSE 0e0 END AS k
 FROM ({_LOCAL} FROM (SELECT * FROM {_SEGMENTS} AS s WHERE lon2 IS NOT NULL) AS a CROSS JOIN (SELECT osm_id, lat AS p_lat, lon AS p_lon FROM elements WHERE railway <> '') AS p) AS l) AS d GROUP BY osm_id"""


@query("j09_nearest_line", _NEAREST)
def j09(t):
    """How far each station is from the nearest line, at any distance."""
    segs = spatial.segments(t.traces, "route_id", "seq")
    stations = t.elements.filter("railway <> ''").select("osm_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    return nearest.nearest(stations, segs, "osm_id").select("osm_id", F.round("nearest", 3).alias("nearest"))


@query("c20_station_review", f"SELECT e.osm_id, coalesce(nearest > 200, true) AS review FROM (SELECT osm_id FROM elements WHERE railway <> '') AS e LEFT JOIN ({_NEAREST}) AS n ON n.osm_id = e.osm_id")
def c20(t):
    """Stations farther than 200 m from any line are marked for review."""
    stations = t.elements.filter("railway <> ''").select("osm_id")
    return stations.join(j09(t), "osm_id", "left").select("osm_id", F.coalesce(F.col("nearest") > 200, F.lit(True)).alias("review"))


def _seg(lat: str, lon: str, a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
    """SQL of a point's distance to the segment a-b (lat, lon each) in its local plane, and the nearest place's share of the segment."""
    x = lambda c: f"(({c}) - ({lon})) * 111320e0 * cos(radians({lat}))"
    y = lambda c: f"(({c}) - ({lat})) * 110540e0"
    ax, ay, dx, dy = x(a[1]), y(a[0]), f"({x(b[1])} - {x(a[1])})", f"({y(b[0])} - {y(a[0])})"
    k = f"CASE WHEN {dx} * {dx} + {dy} * {dy} > 0 THEN least(1e0, greatest(0e0, (-{ax} * {dx} - {ay} * {dy}) / ({dx} * {dx} + {dy} * {dy}))) ELSE 0e0 END"
    return f"sqrt(pow({ax} + ({k}) * {dx}, 2e0) + pow({ay} + ({k}) * {dy}, 2e0))", f"({k})"


_CORNERS = [("south", "west"), ("south", "west + width"), ("south + height", "west + width"), ("south + height", "west")]
_RING_METRES = lambda lat, lon: f"least({', '.join(_seg(lat, lon, a, b)[0] for a, b in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1]))})"


@query("g12_direction", f"""SELECT route_id, class, CASE WHEN abs(a - b) <= greatest(1e1, least(5e1, length / 1e2)) THEN 'review-required' ELSE 'confirmed' END AS status,
 abs(a - b) > greatest(1e1, least(5e1, length / 1e2)) AND (a < b) = (class = 'route-to-site') AS reversed, round(a, 2) AS start_metres, round(b, 2) AS end_metres
FROM (SELECT route_id, length, CASE WHEN route_id % 2 = 0 THEN 'route-to-site' ELSE 'route-from-site' END AS class, {_RING_METRES('lat1', 'lon1')} AS a, {_RING_METRES('lat2', 'lon2')} AS b
 FROM (SELECT route_id, sum(step) AS length, arg_min(lat, seq) AS lat1, arg_min(lon, seq) AS lon1, arg_max(lat, seq) AS lat2, arg_max(lon, seq) AS lon2 FROM {_STEPS} AS s GROUP BY route_id) AS e JOIN squares ON polygon_id = route_id % 25) AS q""")
def g12(t):
    """Lines to and from a site's ring: the right end must be nearest to it, else the line is reversed; within a band of 1 % of the length (10 to 50 m) that is open."""
    measured = spatial.measures(t.traces, "route_id", "seq")
    ends = measured.groupBy("route_id").agg(F.sum("step").alias("length"), *[f(c, "seq").alias(f"{c}{i}") for i, f in ((1, F.min_by), (2, F.max_by)) for c in ("lat", "lon")])
    sites = rings(t.squares).select(F.col("polygon_id").alias("site"), "ring")
    d = ends.withColumn("site", F.col("route_id") % 25).join(sites, "site")
    away = lambda i: F.array_min(F.transform(F.arrays_zip(F.slice("ring", 1, 4).alias("p"), F.slice("ring", 2, 4).alias("q")), lambda side: _to_side(F.col(f"lat{i}"), F.col(f"lon{i}"), side)))
    a, b = away(1), away(2)
    d = d.select("route_id", F.when(F.col("route_id") % 2 == 0, "route-to-site").otherwise("route-from-site").alias("class"), "length", a.alias("a"), b.alias("b"))
    open_ = F.abs(F.col("a") - F.col("b")) <= F.greatest(F.lit(10.0), F.least(F.lit(50.0), F.col("length") / 100.0))
    wrong = (F.col("a") < F.col("b")) == (F.col("class") == "route-to-site")
    return d.select("route_id", "class", F.when(open_, "review-required").otherwise("confirmed").alias("status"), (~open_ & wrong).alias("reversed"), F.round("a", 2).alias("start_metres"), F.round("b", 2).alias("end_metres"))


def _to_side(lat, lon, side):
    zero = F.lit(0.0)
    return geo.point_segment(zero, zero, *geo.local_xy(side["p"]["lat"], side["p"]["lon"], lat, lon), *geo.local_xy(side["q"]["lat"], side["q"]["lon"], lat, lon))


@query("g13_guidance_profile", f"SELECT route_id, CASE WHEN length <= 2500 THEN 50 WHEN length <= 8000 THEN 80 ELSE 150 END AS tolerance FROM (SELECT route_id, round(sum(step), 2) AS length FROM {_STEPS} AS s GROUP BY route_id) AS q")
def g13(t):
    n = F.col("length")
    return a10(t).select("route_id", F.when(n <= 2500, 50).when(n <= 8000, 80).otherwise(150).alias("tolerance"))


#: How far a guidance point is looked for on its snapped line: the widest tolerance.
REACH = 150.0


def _matched_sql(points: str) -> str:
    """points(route_id, place, lat, lon) with distance and measure on the snapped line, null beyond REACH."""
    d, k = _seg("p.lat", "p.lon", ("g.lat", "g.lon"), ("g.lat2", "g.lon2"))
    measured = f"(SELECT *, sum(step) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS measure FROM {_STEPS.replace('FROM traces', 'FROM snapped')} AS s)"
    segs = f"(SELECT * FROM (SELECT route_id, seq, lat, lon, measure, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(step) OVER w AS length FROM {measured} AS m WINDOW w AS (PARTITION BY route_id ORDER BY seq)) AS n WHERE lat2 IS NOT NULL)"
    best = f"(SELECT route_id, place, distance, measure FROM (SELECT *, row_number() OVER (PARTITION BY route_id, place ORDER BY distance, seq) AS rn FROM (SELECT p.route_id, p.place, g.seq, {d} AS distance, g.measure + {k} * g.length AS measure FROM {points} AS p JOIN {segs} AS g ON g.route_id = p.route_id) AS x WHERE distance <= {REACH}) AS y WHERE rn = 1)"
    return f"(SELECT p.route_id, p.place, b.distance, b.measure FROM {points} AS p LEFT JOIN {best} AS b ON b.route_id = p.route_id AND b.place = p.place)"


_POINTS = "(SELECT route_id, seq AS place, lat, lon FROM traces)"
_PREPARED = f"""(SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY seq, part) AS place, CASE WHEN part = 0 THEN lat ELSE lat + (lat2 - lat) * (part / (extra + 1e0)) END AS lat, CASE WHEN part = 0 THEN lon ELSE lon + (lon2 - lon) * (part / (extra + 1e0)) END AS lon
 FROM (SELECT *, unnest(range(0, extra + 1)) AS part FROM (SELECT *, coalesce(least(16, greatest(0, CAST(ceil({_hav('lat', 'lon', 'lat2', 'lon2')} / 60e0) AS BIGINT) - 1)), 0) AS extra FROM {_SEGMENTS} AS s) AS a) AS b)"""
_ASSESSED = lambda points: f"(SELECT route_id, bool_and(coalesce(measure + 5 >= before, true)) AS kept, max(coalesce(distance, 1e9)) AS deviation, avg(CASE WHEN distance <= 50 THEN 1e0 ELSE 0e0 END) AS covered FROM (SELECT *, lag(measure IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY place) AS before FROM {_matched_sql(points)} AS m) AS l GROUP BY route_id)"


def _assessed(t, points):
    """Of each line's guidance points against its snapped line: whether their order is kept (within 5 m, points beyond REACH left out), the largest deviation (1e9 beyond REACH), and the share within 50 m."""
    m = spatial.matched_measures(points, t.snapped, "route_id", "seq", REACH)
    before = F.last("measure", ignorenulls=True).over(W.partitionBy("route_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    m = m.withColumn("ok", F.coalesce(F.col("measure") + 5 >= before, F.lit(True)))
    return m.groupBy("route_id").agg(F.min("ok").alias("kept"), F.max(F.coalesce("distance", F.lit(1e9))).alias("deviation"), F.avg(F.coalesce((F.col("distance") <= 50).cast("double"), F.lit(0.0))).alias("covered"))


def _guidance(t):
    return t.traces.select("route_id", F.col("seq").alias("place"), "lat", "lon")


@query("a14_coverage", f"SELECT route_id, round(covered, 6) AS covered FROM {_ASSESSED(_POINTS)} AS q")
def a14(t):
    """The share of a line's points within 50 m of its snapped line."""
    return _assessed(t, _guidance(t)).select("route_id", F.round("covered", 6).alias("covered"))


@query("a13_order_kept", f"SELECT route_id, kept, round(CASE WHEN deviation < 1e9 THEN deviation END, 3) AS deviation FROM {_ASSESSED(_POINTS)} AS q")
def a13(t):
    """Whether a line's points keep their order on its snapped line, and how far they are from it (null: beyond reach)."""
    return _assessed(t, _guidance(t)).select("route_id", "kept", F.round(F.when(F.col("deviation") < 1e9, F.col("deviation")), 3).alias("deviation"))


_LENGTHS = lambda table: f"(SELECT route_id, sum(step) AS length FROM {_STEPS.replace('FROM traces', 'FROM ' + table)} AS s GROUP BY route_id)"


@query("g14_snap_verdict", f"""SELECT route_id, concat_ws('; ', CASE WHEN NOT g_kept THEN 'point order' END, CASE WHEN g_dev > tolerance THEN 'point deviation' END, CASE WHEN NOT p_kept THEN 'prepared order' END, CASE WHEN p_dev > tolerance + 10 THEN 'prepared deviation' END) AS reasons,
 NOT g_kept OR g_dev > tolerance OR NOT p_kept OR p_dev > tolerance + 10 AS review, round(snapped_length / rough_length, 6) AS length_ratio
FROM (SELECT g.route_id, g.kept AS g_kept, g.deviation AS g_dev, p.kept AS p_kept, p.deviation AS p_dev, r.length AS rough_length, n.length AS snapped_length, CASE WHEN r.length <= 2500 THEN 50 WHEN r.length <= 8000 THEN 80 ELSE 150 END AS tolerance
 FROM {_ASSESSED(_POINTS)} AS g JOIN {_ASSESSED(_PREPARED)} AS p ON p.route_id = g.route_id JOIN {_LENGTHS('traces')} AS r ON r.route_id = g.route_id JOIN {_LENGTHS('snapped')} AS n ON n.route_id = g.route_id) AS q""")
def g14(t):
    """The reasons for which a snapped line goes to review, of four, and its length against the rough line's (a diagnostic only)."""
    prepared = spatial.densified(t.traces, "route_id", "seq", 60.0).withColumn("place", F.row_number().over(W.partitionBy("route_id").orderBy("seq", "part"))).select("route_id", "place", "lat", "lon")
    side = lambda d, p: d.select("route_id", F.col("kept").alias(f"{p}_kept"), F.col("deviation").alias(f"{p}_dev"))
    long = lambda d, name: spatial.line_lengths(d, "route_id", "seq").select("route_id", F.col("length").alias(name))
    q = side(_assessed(t, _guidance(t)), "g").join(side(_assessed(t, prepared), "p"), "route_id").join(long(t.traces, "rough"), "route_id").join(long(t.snapped, "snapped"), "route_id")
    limit = F.when(F.col("rough") <= 2500, 50).when(F.col("rough") <= 8000, 80).otherwise(150)
    checks = {"point order": ~F.col("g_kept"), "point deviation": F.col("g_dev") > limit, "prepared order": ~F.col("p_kept"), "prepared deviation": F.col("p_dev") > limit + 10}
    reasons = F.concat_ws("; ", *[F.when(c, name) for name, c in checks.items()])
    return q.select("route_id", reasons.alias("reasons"), (reasons != "").alias("review"), F.round(F.col("snapped") / F.col("rough"), 6).alias("length_ratio"))


@query("g16_sampled_vertices", "SELECT route_id, seq FROM (SELECT route_id, seq, count(*) OVER (PARTITION BY route_id) AS n FROM traces) AS q WHERE n <= 36 OR CAST(floor((seq - 1) * 35e0 / (n - 1) + 1e-9) AS BIGINT) <> CAST(floor((seq - 2) * 35e0 / (n - 1) + 1e-9) AS BIGINT)")
def g16(t):
    """At most 36 vertices of each line, evenly by index, both ends among them."""
    n = F.count("*").over(W.partitionBy("route_id"))
    step = lambda k: F.floor((F.col("seq") - k) * 35.0 / (F.col("n") - 1) + 1e-9)
    return t.traces.withColumn("n", n).filter(F.when(F.col("n") <= 36, True).otherwise(step(1) != step(2))).select("route_id", "seq")


_CHUNK_STEPS = """SELECT v.route_id, v.spot, CASE WHEN r.spot < v.last AND r.back > v.spot THEN r.back ELSE r.spot END AS nxt FROM verts AS v JOIN verts AS r ON r.route_id = v.route_id AND r.spot = least(v.spot + 39, v.last) WHERE v.spot < v.last"""
_VERTS = """SELECT route_id, seq, spot, last, max(CASE WHEN event_id % 5 < 2 THEN spot END) OVER (PARTITION BY route_id ORDER BY spot) AS back FROM
 (SELECT route_id, seq, event_id, row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1 AS spot, count(*) OVER (PARTITION BY route_id) - 1 AS last FROM traces) AS q"""


@query("w14_chunks_with_overlap", f"""WITH RECURSIVE verts AS ({_VERTS}), steps AS ({_CHUNK_STEPS}),
 chunks AS (SELECT route_id, CAST(0 AS BIGINT) AS chunk, spot, nxt FROM steps WHERE spot = 0 UNION ALL SELECT c.route_id, c.chunk + 1, s.spot, s.nxt FROM chunks AS c JOIN steps AS s ON s.route_id = c.route_id AND s.spot = c.nxt)
 SELECT c.route_id, c.chunk, f.seq AS first, l.seq AS last, c.nxt - c.spot + 1 AS n FROM chunks AS c JOIN verts AS f ON f.route_id = c.route_id AND f.spot = c.spot JOIN verts AS l ON l.route_id = c.route_id AND l.spot = c.nxt""")
def w14(t):
    """Runs of at most 40 vertices that share one vertex with the next run and end at an original vertex (two in five are) where they hold one: (route_id, chunk, first, last, n)."""
    return scans.overlapping_chunks(t.traces.withColumn("own", F.col("event_id") % 5 < 2), 40, original="own")


_ENDS = """SELECT route_id, CAST(floor(spot / 1e1) AS BIGINT) AS piece, arg_min(lon, spot) AS lon0, arg_min(lat, spot) AS lat0, arg_max(lon, spot) AS lon1, arg_max(lat, spot) AS lat1 FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1 AS spot FROM traces) AS q GROUP BY 1, 2"""
_JOIN = lambda state, end: _hav(f"CASE WHEN {state} THEN p.lat0 ELSE p.lat1 END", f"CASE WHEN {state} THEN p.lon0 ELSE p.lon1 END", f"n.lat{end}", f"n.lon{end}")


@query("g11_stitched_lines", f"""WITH RECURSIVE ends AS ({_ENDS}), walk AS (SELECT route_id, piece, lon0, lat0, lon1, lat1, false AS turned, CAST(0 AS DOUBLE) AS gap FROM ends WHERE piece = 0 UNION ALL
 SELECT route_id, piece, lon0, lat0, lon1, lat1, back + 0.5e0 < straight, CASE WHEN back + 0.5e0 < straight THEN back ELSE straight END FROM
  (SELECT n.*, {_JOIN('p.turned', 0)} AS straight, {_JOIN('p.turned', 1)} AS back FROM walk AS p JOIN ends AS n ON n.route_id = p.route_id AND n.piece = p.piece + 1) AS s)
 SELECT route_id, count(*) AS pieces, count(*) FILTER (turned) AS turned, count(*) FILTER (gap > 15e0) AS gaps FROM walk GROUP BY route_id""")
def g11(t):
    """Pieces of each line put together again: pieces are turned where that joins better, and gaps over 15 m are counted."""
    return scans.stitched(t.traces)


@query("n22_grid_lines", "SELECT polygon_id, unnest(range(CAST(ceil(south * 1e3 / 1e1) AS BIGINT) * 10, CAST(floor((south + height) * 1e3 / 1e1) AS BIGINT) * 10 + 1, 10)) AS at FROM squares")
def n22(t):
    """Grid lines at every ten units inside each frame."""
    lo, hi = F.ceil(F.col("south") * 1e3 / 1e1) * 10, F.floor((F.col("south") + F.col("height")) * 1e3 / 1e1) * 10
    return t.squares.select("polygon_id", F.explode(F.when(lo <= hi, F.sequence(lo, hi, F.lit(10).cast("long")))).alias("at"))


@query("n28_feature_coordinate", "SELECT polygon_id, round((south * 3 + (south + height) * 2) / 5, 6) AS lat, regexp_replace('1:' || CAST(polygon_id AS VARCHAR) || ',500', '[^0-9]', '', 'g') AS scale FROM squares")
def n28(t):
    b = spatial.bounds(vertices(t.squares), "polygon_id")
    scale = F.regexp_replace(F.concat(F.lit("1:"), F.col("polygon_id").cast("string"), F.lit(",500")), "[^0-9]", "")
    return b.select("polygon_id", F.round("mean_lat", 6).alias("lat"), scale.alias("scale"))
