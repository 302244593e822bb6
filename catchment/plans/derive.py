"""Domain tables made from the driver's tables by integer arithmetic, as SQL text that reads alike in Spark and elsewhere.

Each entry is one SELECT over base tables or earlier entries. Rows that the domain needs and the data lacks (empty codes, duplicates, placeholders) come from CASEs on keys.
"""

from __future__ import annotations

_N = "(p_partkey * 13 + p_size) % 56"


def _tag(**by_number: str) -> str:
    """CASE over the element number: value='3 4 5'."""
    arms = " ".join(f"WHEN {_N} IN ({', '.join(v.split())}) THEN '{k.replace('__', ' ')}'" for k, v in by_number.items())
    return f"CASE {arms} ELSE '' END"


DERIVED: dict[str, str] = {
    "sites": "SELECT CAST(n_nationkey AS BIGINT) AS site_id, 51.4e0 + (n_nationkey * 37 % 100) / 5e2 AS site_lat, -0.3e0 + (n_nationkey * 61 % 100) / 2.5e2 AS site_lon FROM nation",
    "elements": f"""
SELECT p_partkey AS osm_id, CASE p_partkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS osm_type, p_partkey AS seq,
  51.35e0 + (p_partkey * 7919 % 1000) / 2.5e3 AS lat, -0.35e0 + (p_partkey * 104729 % 1000) / 1.25e3 AS lon,
  {_tag(school='0 1 2 3', college='4 5 6', university='7', kindergarten='8', childcare='9', post_office='10', bank='11', atm='12', fuel='13', doctors='14', clinic='15 16 17', pharmacy='18', dentist='19', hospital='20', library='21', community_centre='22', place_of_worship='23', pub='24', bar='25', cafe='26', restaurant='27', bicycle_parking='28')} AS amenity,
  {_tag(supermarket='29', convenience='30', optician='31')} AS shop,
  {_tag(park='32', recreation_ground='33', playground='34', fitness_centre='35', sports_centre='36 37', pitch='38')} AS leisure,
  {_tag(station='39 40 41 42', halt='43', tram_stop='44', rail='45')} AS railway,
  {_tag(subway='40', light_rail='42')} AS station,
  {_tag(London__Overground='41', Docklands='42', Tramlink='44')} AS network,
  {_tag(doctor='46', optometrist='47')} AS healthcare,
  {_tag(bus_stop='48', motorway='50', primary='51', residential='52', cycleway='53')} AS highway,
  {_tag(platform='49')} AS public_transport, {_tag(yes='49')} AS bus,
  {_tag(river='54', canal='55')} AS waterway,
  CASE {_N} WHEN 0 THEN 'Hill Primary School' WHEN 1 THEN 'Dale Secondary School' WHEN 2 THEN 'Vale High School and Sixth Form' WHEN 3 THEN 'Old Academy' WHEN 4 THEN 'North Sixth Form' WHEN 5 THEN 'Adult Education Centre'
    WHEN 6 THEN 'City College' WHEN 15 THEN 'Mill Surgery' WHEN 16 THEN 'Walk-in Centre' WHEN 17 THEN 'Fitness Medical Centre' WHEN 36 THEN 'Lake Leisure Centre' WHEN 37 THEN '' ELSE p_name END AS name,
  p_brand AS operator, CASE WHEN {_N} = 3 THEN '1;2' ELSE '' END AS isced_level,
  CASE WHEN {_N} = 50 THEN 'M' || CAST(p_size AS STRING) WHEN {_N} = 51 THEN 'B1; A' || CAST(p_size AS STRING) ELSE '' END AS ref
FROM part""",
    "stops": """
SELECT s_suppkey AS stop_id, s_suppkey AS seq, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'NP' || CAST(s_suppkey - s_suppkey % 7 % 2 AS STRING) END AS naptan,
  'Stop ' || CAST(s_suppkey % 17 AS STRING) AS stop_name, CASE s_suppkey % 4 WHEN 0 THEN 'Northbound' WHEN 1 THEN 'Southbound' WHEN 2 THEN 'N-bound' ELSE '' END AS direction,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'PAIR ' || CAST(CAST(floor(s_suppkey / 2e0) AS BIGINT) % 40 AS STRING) END AS pair,
  51.4e0 + (s_suppkey % 17 * 13 % 100) / 5e2 + (s_suppkey % 3) / 1e4 AS lat, -0.2e0 + (s_suppkey % 17 * 29 % 100) / 2.5e2 AS lon, s_acctbal AS balance, s_nationkey % 25 AS site_id,
  CASE s_suppkey % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'Verified - desk' WHEN 2 THEN 'needs review' WHEN 3 THEN 'missing' WHEN 4 THEN '' ELSE 'manual' END AS status
FROM supplier""",
    "routes": """
SELECT p_partkey AS route_id, p_partkey AS seq, CAST(p_size AS STRING) || CASE p_partkey % 4 WHEN 0 THEN 'A' ELSE '' END AS route_number, p_brand AS operator,
  CASE WHEN p_partkey % 23 = 0 THEN '' ELSE 'Town ' || CAST(p_partkey % 9 AS STRING) END AS origin, 'Market ' || CAST(p_partkey % 7 AS STRING) || ' Station' AS destination,
  CASE p_partkey % 4 WHEN 0 THEN 'East London' WHEN 1 THEN 'Herts' ELSE '' END AS context, CASE WHEN p_partkey % 11 = 0 THEN 'via Hill' ELSE '' END AS variant,
  CASE p_partkey % 5 WHEN 0 THEN 'https://tfl.gov.uk/bus/route/' || CAST(p_size AS STRING) WHEN 1 THEN 'https://intalink.org.uk/services' WHEN 2 THEN 'https://operator.example/routes/' WHEN 3 THEN 'not a url' ELSE '' END AS url,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'Timetable page' END AS title, CASE WHEN p_partkey % 8 = 0 THEN '' ELSE 'Publisher' END AS publisher,
  CASE p_partkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'needs review' ELSE 'missing' END AS status,
  CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'research required' WHEN 2 THEN 'No service' WHEN 3 THEN 'approx. 06:00-23:00' ELSE '06:00-23:00' END AS weekday,
  CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'No Sunday service' ELSE '08:00-22:00' END AS sunday, CAST(p_partkey % 7 AS BIGINT) AS tph, 'Every day' AS pattern,
  '2026-0' || CAST(1 + p_partkey % 9 AS STRING) || '-1' || CAST(p_partkey % 10 AS STRING) AS retrieval_date
FROM part""",
    "route_records": """
SELECT p_partkey AS route_id, CASE p_partkey % 7 WHEN 0 THEN n || ' / ' || m || 'a' WHEN 1 THEN 'N' || n WHEN 2 THEN m || 'A' WHEN 3 THEN CASE WHEN p_partkey % 3 = 0 THEN '' ELSE n END ELSE n END AS route_number,
  CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Red-Line' WHEN 2 THEN 'red line' ELSE 'Blue ' || CAST(p_size % 2 AS STRING) END AS operator,
  CASE p_partkey % 9 WHEN 0 THEN 'City Region' WHEN 1 THEN 'County' ELSE '' END AS authority, CASE p_partkey % 9 WHEN 2 THEN 'route:city-region:' || n WHEN 3 THEN 'bus:county' ELSE '' END AS canonical_key,
  CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN 'Hill Town' WHEN 2 THEN 'The Mill' WHEN 3 THEN 'Mill Lane' WHEN 4 THEN 'Old Station' ELSE 'Station' END AS origin,
  CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'Mill Centre' WHEN 2 THEN 'Quay' WHEN 3 THEN 'station' ELSE 'Hill Top' END AS destination,
  CASE p_partkey % 4 WHEN 0 THEN '' ELSE 'East' END AS context, CASE p_partkey % 3 WHEN 0 THEN 'Verified - desk' WHEN 1 THEN 'needs review' ELSE '' END AS status,
  CASE p_partkey % 4 WHEN 0 THEN 'https://op.example/services/12' WHEN 1 THEN 'https://op.example/services/' WHEN 2 THEN 'https://op.example' ELSE '' END AS url, '2026-0' || CAST(1 + p_size % 9 AS STRING) || '-10' AS retrieval_date
FROM (SELECT p_partkey, p_size, CAST(CAST(floor(p_partkey / 16e0) AS BIGINT) * 2 + p_size % 2 AS STRING) AS n, CAST(CAST(floor(p_partkey / 16e0) AS BIGINT) * 2 + 1 - p_size % 2 AS STRING) AS m FROM part) AS numbered""",
    "stop_routes": """
SELECT l_suppkey AS stop_id, l_partkey AS route_id, count(*) AS links, min(l_returnflag) AS flag, max(l_quantity) AS quantity FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "master": """
SELECT 'crs:K' || CAST(o_custkey AS STRING) AS key, min(o_orderkey) AS seq, min(CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'needs review' ELSE 'missing' END) AS status, min(o_orderpriority) AS name, max(CAST(o_orderdate AS DATE)) AS date,
  max(CAST(floor(o_totalprice) AS BIGINT)) AS value FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey""",
    "proposed": """
SELECT CASE WHEN o_custkey % 50 = 0 THEN 'crs:' WHEN o_custkey % 41 = 0 THEN '' ELSE 'crs:K' || CAST(o_custkey AS STRING) END AS key, min(o_orderkey) AS seq, min(CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'needs review' ELSE 'missing' END) AS status,
  min(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END) AS name, max(CAST(o_orderdate AS DATE)) AS date, max(CAST(floor(o_totalprice) AS BIGINT)) AS value FROM orders WHERE o_orderkey % 3 = 1 GROUP BY o_custkey""",
    "rail_fields": """
SELECT c_custkey AS record_id, 'crs:' || CAST(c_custkey AS STRING) AS key, f AS field, CASE WHEN (c_custkey * 7 + f * 3) % 5 = 0 THEN '' WHEN (c_custkey + f) % 13 = 0 THEN 'refer to the operator website' ELSE 'Value ' || CAST((c_custkey + f) % 29 AS STRING) END AS value,
  CASE (c_custkey + f) % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'missing' ELSE 'verified' END AS status,
  CASE WHEN (c_custkey * 3 + f) % 6 = 0 THEN '' ELSE '2026-0' || CAST(1 + (c_custkey + f) % 9 AS STRING) || '-15' END AS retrieval_date,
  CASE (c_custkey + 2 * f) % 5 WHEN 0 THEN '' WHEN 1 THEN 'https://rail.example/stations' WHEN 2 THEN 'https://rail.example/stations/k' ELSE 'https://rail.example/stations/' || CAST(c_custkey AS STRING) END AS source,
  CASE WHEN (c_custkey + f) % 3 = 0 THEN '' ELSE 'Title' END AS source_title, CASE WHEN (c_custkey + f) % 7 = 0 THEN '' ELSE 'Publisher' END AS publisher
FROM customer CROSS JOIN (SELECT r_regionkey * 3 + 1 AS f FROM region UNION ALL SELECT r_regionkey * 3 + 2 FROM region UNION ALL SELECT r_regionkey * 3 + 3 FROM region) AS dims""",
    "traces": """
SELECT user_id AS route_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, -0.1e0 + (user_id % 50) / 1e3 + (event_id * 7919 % 1000) / 1e5 AS lon, 51.5e0 + (event_id * 104729 % 1000) / 1e5 AS lat FROM events""",
    "snapped": """
SELECT route_id, seq, lon, lat + 2e-4 AS lat FROM traces WHERE route_id % 3 <> 1 OR seq % 2 = 1""",
    "squares": """
SELECT CAST(n_nationkey AS BIGINT) AS polygon_id, 51.35e0 + (n_nationkey * 11 % 25) / 6e1 AS south, -0.35e0 + (n_nationkey * 7 % 25) / 4e1 AS west, 0.03e0 + (n_nationkey % 4) / 1e2 AS height, 0.04e0 + (n_nationkey % 3) / 1e2 AS width FROM nation""",
    "outlines": """
SELECT ring_id, place, lon, lat FROM corners UNION ALL SELECT ring_id, n AS place, lon, lat FROM corners WHERE place = 0 AND ring_id % 9 <> 0""",
    "corners": """
SELECT ring_id, n, row_number() OVER (PARTITION BY ring_id ORDER BY turn) - 1 AS place, -0.1e0 + far * cos(6.283185307179586e0 * k / n) AS lon, 51.5e0 + far * sin(6.283185307179586e0 * k / n) AS lat FROM
 (SELECT o_custkey AS ring_id, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_orderkey % 31 = 0 THEN 1.5e0 ELSE 0e0 END AS turn,
  CASE WHEN o_custkey % 17 = 0 THEN 0e0 ELSE 1e-2 * (1 + floor(o_totalprice) % 100 / 1e2) END AS far FROM orders) AS q""",
    "pack_lines": """
SELECT l_orderkey AS task, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, 'S' || CAST(l_suppkey AS STRING) AS stop_key, 'route:' || CAST(l_partkey % 60 AS STRING) AS route_key, CAST(p_size AS STRING) AS number, l_partkey AS part, l_returnflag AS flag, l_quantity AS quantity
FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "pack_allowed": """
SELECT DISTINCT task, stop_key FROM pack_lines WHERE place <= 4 UNION SELECT o_orderkey AS task, 'S-none' AS stop_key FROM orders WHERE o_orderkey % 11 = 0""",
    "pack_stops": """
SELECT task, min(place) AS place, stop_key, CASE WHEN min(quantity) < 4 THEN 'missing or weak fields: direction' ELSE '' END AS fault FROM pack_lines GROUP BY task, stop_key""",
    "pack_routes": """
SELECT task, place, CASE WHEN part % 29 = 0 THEN '' ELSE route_key END AS route_key, part % 13 <> 0 AS identified, 'number:' || number AS alias, CASE WHEN flag = 'R' AND quantity > 45 THEN 'missing or weak fields: weekday' ELSE '' END AS fault FROM pack_lines""",
    "pack_links": """
SELECT task, place, stop_key || '|' || CASE WHEN part % 7 = 0 THEN 'x' ELSE route_key END AS link_key, stop_key, CASE WHEN part % 5 = 0 THEN 'number:' || number ELSE route_key END AS route_alias, number, CASE WHEN flag = 'A' AND quantity > 46 THEN 'missing or weak fields: sunday' ELSE '' END AS fault FROM pack_lines""",
    "pack_served": """
SELECT task, stop_key, number FROM pack_lines WHERE place % 7 <> 5""",
    "publishable": """
SELECT l.stop_id * 10000000 + l.route_id AS seq, 'naptan:' || CAST(l.stop_id AS STRING) AS stop_key, r.route_number AS number, CASE l.flag WHEN 'A' THEN 'Northbound' WHEN 'N' THEN 'northbound' ELSE '' END AS direction, r.destination AS destination,
  CASE CAST(l.quantity AS BIGINT) % 5 WHEN 0 THEN '' WHEN 1 THEN 'research required' WHEN 2 THEN '06:00-23:00' WHEN 3 THEN '06.00 - 23.00' ELSE '07:00-22:00' END AS weekday, r.sunday AS sunday, r.retrieval_date AS date, CASE (l.stop_id + l.route_id) % 4 WHEN 0 THEN 'needs review' ELSE 'Verified' END AS status
FROM stop_routes AS l JOIN routes AS r ON r.route_id = l.route_id""",
    "results": """
SELECT o_orderkey AS task_id, o_custkey % 97 AS record, CASE o_orderkey % 5 WHEN 0 THEN 'rail' WHEN 1 THEN 'bus-stop' ELSE 'bus-route' END AS kind, o_orderstatus AS outcome FROM orders WHERE o_orderkey % 10 < 6""",
    "tasks": """
SELECT o_orderkey AS task_id, o_custkey % 97 AS record, CASE WHEN o_orderkey % 7 = 0 THEN 'rail' WHEN o_orderkey % 5 = 0 THEN 'rail' WHEN o_orderkey % 5 = 1 THEN 'bus-stop' ELSE 'bus-route' END AS kind FROM orders WHERE o_orderkey % 10 BETWEEN 3 AND 8""",
}
