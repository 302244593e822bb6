"""Queries of single functions: normalisers, statuses, URLs, keys, hashes and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence, geo, keys
from ..functions import text as x
from ..operators import nested
from ..registry import query

_A = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_norm = lambda c: _A.format(f"coalesce({c}, '')")
_quality = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9:/._-]+', ' ', 'g'))"


@query("p05_normal_ascii", f"SELECT doc_id, {_norm('text')} AS v FROM documents")
def p05(t):
    return t.documents.select("doc_id", x.normal_ascii("text").alias("v"))


@query("p06_normal_folded")
def p06(t):
    return t.conversations.select("conv_id", "turn", x.normal_folded("text").alias("v"))


@query("p07_normal_quality")
def p07(t):
    return t.conversations.select("conv_id", "turn", x.normal_quality("text").alias("v"))


@query("p08_normal_spaces", "SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS v FROM conversations")
def p08(t):
    return t.conversations.select("conv_id", "turn", x.normal_spaces("text").alias("v"))


@query("p09_station_name", "SELECT osm_id, trim(regexp_replace(replace(regexp_replace(lower(name || ' & ' || operator || ' DLR Station'), 'railway station|underground station|overground station|dlr station|station', '', 'g'), '&', 'and'), '[^a-z0-9]+', ' ', 'g')) AS v FROM elements")
def p09(t):
    return t.elements.select("osm_id", x.station_name(F.concat("name", F.lit(" & "), "operator", F.lit(" DLR Station"))).alias("v"))


@query("p10_label", "SELECT osm_id, upper(regexp_replace(trim('  ' || name || '   ' || operator), '\\s+', ' ', 'g')) AS v FROM elements")
def p10(t):
    return t.elements.select("osm_id", x.label(F.concat(F.lit("  "), "name", F.lit("   "), "operator")).alias("v"))


@query("p11_slug", f"SELECT osm_id, coalesce(nullif(replace({_norm('name')}, ' ', '-'), ''), 'project') AS v FROM elements")
def p11(t):
    return t.elements.select("osm_id", x.slug("name").alias("v"))


_STATUS = "replace(trim(regexp_replace(lower({0}), '[^a-z0-9:/._-]+', ' ', 'g')), '_', '-')"
status_sql = lambda c: f"CASE WHEN {_STATUS.format(c)} LIKE 'verified%' THEN 'verified' WHEN regexp_matches({_STATUS.format(c)}, 'review|unresolved|professional') THEN 'review' WHEN regexp_matches({_STATUS.format(c)}, 'missing|research-required') THEN 'missing' ELSE coalesce(nullif({_STATUS.format(c)}, ''), 'missing') END"


@query("p12_status_class", f"SELECT stop_id, {status_sql('status')} AS v FROM stops")
def p12(t):
    return t.stops.select("stop_id", x.status_class("status").alias("v"))


@query("p13_fnv_hash")
def p13(t):
    return t.elements.select("osm_id", x.fnv32(x.json_string(F.concat_ws(" ", "name", "operator"))).alias("v"))


@query("p14_palette", "SELECT route_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(route_number, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) % 4 AS v FROM routes")
def p14(t):
    return t.routes.select("route_id", x.palette_index("route_number").alias("v"))


@query("p15_checksum", "SELECT osm_id, sha256('{\"id\":' || CAST(osm_id AS VARCHAR) || ',\"class\":\"' || amenity || '\"}') AS v FROM elements")
def p15(t):
    return t.elements.select("osm_id", F.sha2(F.to_json(F.struct(F.col("osm_id").alias("id"), F.col("amenity").alias("class"))), 256).alias("v"))


@query("p16_road_reference", "SELECT osm_id, upper(regexp_extract(ref, '(?i)(?:^|[;,\\s])(A\\d{1,4}[A-Z]?)(?:$|[;,\\s])', 1)) AS a, upper(regexp_extract(ref, '(?i)(?:^|[;,\\s])(M\\d{1,4}[A-Z]?)(?:$|[;,\\s])', 1)) AS m FROM elements")
def p16(t):
    return t.elements.select("osm_id", x.road_reference("ref", "A").alias("a"), x.road_reference("ref", "M").alias("m"))


_NET = "CASE osm_id % 6 WHEN 0 THEN 'lcn' WHEN 1 THEN 'rcn;ncn' WHEN 2 THEN 'LCN, ICN' WHEN 3 THEN 'other' ELSE '' END"


@query("p17_cycle_network", "SELECT osm_id, CASE osm_id % 6 WHEN 0 THEN 'lcn' WHEN 1 THEN 'ncn' WHEN 2 THEN 'icn' ELSE '' END AS v FROM elements")
def p17(t):
    return t.elements.select("osm_id", x.cycle_network(F.expr(_NET)).alias("v"))


@query("f15_current_cycle_route", "SELECT osm_id FROM elements WHERE osm_id % 7 NOT IN (0, 1, 2, 3)")
def f15(t):
    from ..operators.classify import Tags, is_current_cycle_route

    tags = F.expr("map('state', case osm_id % 7 when 0 then 'Proposed' else '' end, 'proposed', case osm_id % 7 when 1 then 'yes' else '' end, 'construction', case osm_id % 7 when 2 then 'minor' when 4 then 'no' else '' end, 'disused:route', case osm_id % 7 when 3 then 'bicycle' else '' end)")
    return t.elements.withColumn("tags", tags).filter(is_current_cycle_route(Tags())).select("osm_id")


@query("p18_route_tokens", "SELECT route_id, array_to_string(list_distinct_in_order, ',') AS v FROM (SELECT route_id, list_filter(regexp_extract_all(upper(route_number || '/' || 'N' || route_number), '[A-Z]*[0-9]+[A-Z]*'), lambda z, i: list_position(regexp_extract_all(upper(route_number || '/' || 'N' || route_number), '[A-Z]*[0-9]+[A-Z]*'), z) = i) AS list_distinct_in_order FROM routes) AS q")
def p18(t):
    return t.routes.select("route_id", F.array_join(x.route_tokens(F.concat("route_number", F.lit("/N"), "route_number")), ",").alias("v"))


@query("p19_endpoint_words", "SELECT route_id, CASE WHEN origin = '' THEN '' ELSE split_part(origin, ' ', 2) END = split_part(destination, ' ', 2) AND false AS overlap, 'market' AS words FROM routes")
def p19(t):
    """Towns and stations are stop words, so an origin has none left and a destination only its market."""
    overlap = F.arrays_overlap(x.endpoint_words("origin"), x.endpoint_words("destination"))
    return t.routes.select("route_id", overlap.alias("overlap"), F.array_join(x.endpoint_words("destination"), " ").alias("words"))


_PERIOD = "CASE WHEN weekday = '' OR regexp_matches(weekday, '(?i)no service') THEN 'Mon–Fri: No service' WHEN regexp_matches(weekday, '(?i)research required') THEN 'Mon–Fri: Research required' ELSE 'Mon–Fri: Approx. ' || regexp_replace(weekday, '^(?i)approx(?:imately)?\\.?\\s*', '') END"


@query("p20_period_line", f"SELECT route_id, {_PERIOD} AS v FROM routes")
def p20(t):
    return t.routes.select("route_id", x.period_line("Mon–Fri", "weekday").alias("v"))


_WORDS = "CASE WHEN tph <= 0 THEN '' WHEN tph = 1 THEN 'Hourly daytime service.' WHEN tph = 2 THEN 'Approximately 2 buses per hour.' WHEN tph = 3 THEN 'Approximately every 20 minutes during the typical daytime period.' WHEN tph = 4 THEN 'Approximately every 15 minutes during the typical daytime period.' ELSE 'Approximately ' || CAST(tph AS VARCHAR) || ' buses per hour during the typical daytime period.' END"


@query("p21_frequency_words", f"SELECT route_id, {_WORDS} AS v FROM routes")
def p21(t):
    return t.routes.select("route_id", x.frequency_words("tph").alias("v"))


@query("p22_service_pattern", f"SELECT route_id, 'Every day.' || CASE WHEN tph > 0 THEN ' ' || {_WORDS} ELSE '' END || CASE WHEN sunday = '' OR regexp_matches(sunday, '(?i)no service') THEN ' No Sunday service.' ELSE '' END AS v FROM routes")
def p22(t):
    none = F.when((F.col("sunday") == "") | F.col("sunday").rlike("(?i)no service"), "No Sunday service.").otherwise("")
    return t.routes.select("route_id", x.sentences(F.array("pattern", x.frequency_words("tph"), "pattern", none)).alias("v"))


_is_url = lambda c: f"regexp_matches({c}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+[^?#\\s]*(?:[?#]\\S*)?$')"
_path = lambda c: f"lower(regexp_replace(regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+([^?#\\s]*)', 1), '/+$', ''))"
_generic = lambda c, invalid: f"CASE WHEN {_is_url(c)} THEN regexp_matches({_path(c)}, '^/(?:services?|routes?|timetables?|stations?|bus|rail)?$') OR regexp_matches({_path(c)}, '/search(?:/|$)') ELSE {invalid} END"
_cited = f"(url <> '' AND NOT {_generic('url', 'true')} AND title <> '' AND publisher <> '' AND regexp_matches(retrieval_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}'))"


@query("p23_service_display", f"SELECT route_id, CASE WHEN sunday = '' THEN 'Not established' WHEN regexp_matches(sunday, '(?i)\\bno\\s+(sunday\\s+)?service\\b') AND NOT (status LIKE 'verified%' AND {_cited}) THEN 'Requires review' ELSE sunday END AS v FROM routes")
def p23(t):
    shown = evidence.is_verified("status") & evidence.cited_source("url", "title", "publisher", "retrieval_date")
    return t.routes.select("route_id", x.service_display("sunday", shown).alias("v"))


@query("p24_step_free_mark", "SELECT stop_id, CASE WHEN status = '' OR regexp_matches(lower(status), '^(no|none|not available|false)|not step[- ]?free') THEN '✗' ELSE '✓' END AS v FROM (SELECT stop_id, CASE stop_id % 4 WHEN 0 THEN 'No lifts' WHEN 1 THEN 'Step-free' WHEN 2 THEN 'not step free' ELSE '' END AS status FROM stops) AS q")
def p24(t):
    return t.stops.select("stop_id", x.step_free_mark(F.expr("case stop_id % 4 when 0 then 'No lifts' when 1 then 'Step-free' when 2 then 'not step free' else '' end")).alias("v"))


@query("p25_directional_frequency", "SELECT route_id, CAST(tph AS VARCHAR) || ' tph ' || destination || CASE WHEN variant <> '' THEN ' (' || variant || ')' ELSE '' END || '; — tph ' || origin AS v FROM routes")
def p25(t):
    row = lambda n, d, q: F.struct(n.alias("tph"), d.alias("destination"), q.alias("qualifier"))
    rows = F.array(row(F.col("tph").cast("string"), F.col("destination"), F.col("variant")), row(F.lit(None).cast("string"), F.col("origin"), F.lit("")))
    return t.routes.select("route_id", x.directional_frequency(rows).alias("v"))


@query("p33_source_score", f"SELECT route_id, CAST((CASE WHEN {_is_url('url')} THEN 10 + CASE WHEN len(list_filter(string_split({_path('url')}, '/'), lambda z: z <> '')) >= 1 THEN 10 ELSE 0 END + CASE WHEN len(list_filter(string_split({_path('url')}, '/'), lambda z: z <> '')) >= 2 THEN 10 ELSE 0 END ELSE 0 END) + CASE WHEN title <> '' THEN 5 ELSE 0 END + CASE WHEN publisher <> '' THEN 5 ELSE 0 END + 5 AS INTEGER) AS v FROM routes")
def p33(t):
    return t.routes.select("route_id", evidence.source_score("url", "title", "publisher", "retrieval_date").alias("v"))


@query("p34_completeness", "SELECT route_id, CAST((origin <> '')::INT + (destination <> '')::INT + (weekday <> '' AND weekday <> 'research required')::INT + (sunday <> '')::INT + (title <> '')::INT AS INTEGER) AS v FROM routes")
def p34(t):
    return t.routes.select("route_id", sum((evidence.useful(c).cast("int") for c in ("destination", "weekday", "sunday", "title")), evidence.useful("origin").cast("int")).alias("v"))


@query("x07_escape_html", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '\"', '&quot;') AS v FROM pages")
def x07(t):
    return t.pages.select("page_id", x.escape_html("html").alias("v"))


@query("x02_csv_escape", """SELECT page_id, CASE WHEN regexp_matches(html, '[",\n]') THEN '"' || replace(html, '"', '""') || '"' ELSE html END AS v, '"' || replace(url, '"', '""') || '"' AS q FROM pages""")
def x02(t):
    return t.pages.select("page_id", x.csv_if_needed("html").alias("v"), x.csv_quoted("url").alias("q"))


@query("x13_links", "SELECT osm_id, 'https://www.openstreetmap.org/' || osm_type || '/' || CAST(osm_id AS VARCHAR) AS v FROM elements")
def x13(t):
    return t.elements.select("osm_id", F.concat(F.lit("https://www.openstreetmap.org/"), keys.element("osm_type", "osm_id")).alias("v"))


@query("f01_valid_coordinates", "SELECT event_id FROM events WHERE value * 10 - 200 BETWEEN -90 AND 90 AND value * 20 - 300 BETWEEN -180 AND 180")
def f01(t):
    return t.events.filter(geo.valid_coordinates(F.col("value") * 10 - 200, F.col("value") * 20 - 300)).select("event_id")


@query("f02_united_kingdom", "SELECT osm_id FROM elements WHERE lat + osm_id % 20 BETWEEN 49.5e0 AND 61.1e0 AND lon - osm_id % 12 BETWEEN -8.7e0 AND 2.2e0")
def f02(t):
    return t.elements.filter(geo.in_united_kingdom(F.col("lat") + F.col("osm_id") % 20, F.col("lon") - F.col("osm_id") % 12)).select("osm_id")


@query("f05_named_located", "SELECT osm_id FROM elements WHERE trim(name) <> '' AND railway IN ('station', 'halt', 'tram_stop')")
def f05(t):
    from ..operators.classify import Tags, has_rail_evidence
    from .search import tagged

    stations = tagged(t.elements).filter(F.col("railway").isin("station", "halt", "tram_stop"))
    return stations.filter((F.trim("name") != "") & has_rail_evidence(Tags()) & geo.valid_coordinates("lat", "lon")).select("osm_id")


@query("f06_included_rows", "SELECT stop_id FROM stops WHERE status <> 'missing' AND NOT (stop_id % 9 = 0)")
def f06(t):
    """A missing flag counts as included."""
    flagged = t.stops.withColumn("included", F.expr("case when stop_id % 9 = 0 then false when stop_id % 9 = 1 then true end"))
    return flagged.filter((F.col("status") != "missing") & F.coalesce("included", F.lit(True))).select("stop_id")


@query("f07_library_search", f"SELECT route_id FROM routes WHERE {_norm('route_number')} || ' ' || {_norm('operator')} LIKE '%brand 1%' AND status = 'verified'")
def f07(t):
    hay = x.normal_ascii(F.to_json(F.struct("route_number", "operator")))
    return t.routes.filter(hay.contains("brand 1") & (F.col("status") == "verified")).select("route_id")


_PHRASE = "CASE doc_id % 12 WHEN 0 THEN 'See the official operator website. ' WHEN 1 THEN 'Refer to timetable. ' WHEN 2 THEN 'Please consult the operator! ' WHEN 3 THEN 'Check TfL; ' WHEN 4 THEN 'Research required. ' WHEN 5 THEN 'Details are not found. ' WHEN 6 THEN 'Facilities require confirmation. ' WHEN 7 THEN 'No published information was found. ' ELSE 'All fine. ' END"


def _planted():
    """The phrase and the whole text; a null text is empty."""
    return F.concat(F.expr(_PHRASE), F.coalesce("text", F.lit("")))


@query("f08_placeholder", "SELECT doc_id FROM documents WHERE doc_id % 12 < 8")
def f08(t):
    """Placeholder wording anywhere in a document's whole text, with a phrase planted before it."""
    return t.documents.filter(evidence.is_placeholder(_planted())).select("doc_id")


@query("f09_not_importable", "SELECT doc_id FROM documents WHERE doc_id % 12 IN (1, 3)")
def f09(t):
    return t.documents.filter(evidence.is_lazy(_planted())).select("doc_id")


#: The pattern of texts that bar a record, for SQL. Fixed value.
_LAZY = r"(?i)\b(see|check|refer to)\s+(the\s+)?(station |operator )?website\b|\bcheck\s+(national rail|tfl|operator)\b|\brefer to timetable\b|\b(details|information)\s+(available\s+)?online\b|\bverify manually\b|\bnot researched\b"


@query("f09_nested_placeholders", f"""SELECT doc_id, 'parts[' || CAST(i AS VARCHAR) || '].body' AS path FROM (SELECT doc_id, unnest(range(CAST(len(string_split(t, chr(10))) AS BIGINT))) AS i, unnest(string_split(t, chr(10))) AS line FROM (SELECT doc_id, {_PHRASE} || coalesce(text, '') AS t FROM documents) AS d) AS l WHERE regexp_matches(line, '{_LAZY}')""")
def f09_nested(t):
    """Paths of the texts that bar each document, as a record of its lines: a phrase planted in the first one counts, the same phrase among the record's sources doesn't."""
    lines = F.transform(F.split(_planted(), "\n"), lambda x: F.struct(x.alias("body"), F.expr(_PHRASE).alias("sourceTitle")))
    record = F.to_json(F.struct(F.col("lang").alias("title"), F.array(F.expr(_PHRASE)).alias("sources"), lines.alias("parts")))
    return nested.placeholder_paths(t.documents.select("doc_id", record.alias("record")), "doc_id", "record")


_SPECIFIC = lambda c: f"({_is_url(c)} AND regexp_matches({c}, '(?i)^https?:') AND regexp_matches({_path(c)}, '[^/]'))"


@query("f10_specific_url", f"SELECT page_id, {_SPECIFIC('url')} AS v FROM pages UNION ALL SELECT -1 - route_id, {_SPECIFIC('url')} FROM routes")
def f10(t):
    urls = t.pages.select("page_id", "url").union(t.routes.select(-1 - F.col("route_id"), "url"))
    return urls.select("page_id", evidence.is_specific_url("url").alias("v"))


@query("f11_generic_url", f"SELECT route_id, {_generic('url', 'false')} AS quality, {_generic('url', 'true')} AS workflow FROM routes UNION ALL SELECT -1 - page_id, {_generic('url', 'false')}, {_generic('url', 'true')} FROM pages")
def f11(t):
    urls = t.routes.select("route_id", "url").union(t.pages.select(-1 - F.col("page_id"), "url"))
    return urls.select("route_id", evidence.is_generic_url("url").alias("quality"), evidence.is_generic_url("url", invalid=True).alias("workflow"))


@query("f12_direct_evidence", f"SELECT route_id, {_SPECIFIC('url')} AND NOT {_generic('url', 'false')} AND title <> '' AND publisher <> '' AS direct, {_cited} AS cited FROM routes")
def f12(t):
    columns = ("url", "title", "publisher", "retrieval_date")
    return t.routes.select("route_id", evidence.direct_source(*columns).alias("direct"), evidence.cited_source(*columns).alias("cited"))


@query("f13_fresh", "SELECT route_id, date_diff('day', CAST(retrieval_date AS DATE), DATE '2027-04-01') <= 400 AS v FROM routes")
def f13(t):
    return t.routes.select("route_id", evidence.is_fresh(evidence.day("retrieval_date"), "2027-04-01").alias("v"))


@query("f14_stale_records", "SELECT key FROM rail_fields GROUP BY key HAVING bool_or(value <> '' AND (retrieval_date = '' OR date_diff('day', TRY_CAST(nullif(retrieval_date, '') AS DATE), DATE '2027-03-01') > 365))")
def f14(t):
    return t.rail_fields.groupBy("key").agg(F.max(evidence.is_stale("value", "retrieval_date", "2027-03-01")).alias("stale")).filter("stale").select("key")


@query("k01_facility_key", "SELECT osm_id, 'cafe:' || osm_type || ':' || CAST(osm_id AS VARCHAR) AS facility, osm_type || '/' || CAST(osm_id AS VARCHAR) AS element FROM elements")
def k01(t):
    return t.elements.select("osm_id", keys.facility(F.lit("cafe"), "osm_type", "osm_id").alias("facility"), keys.element("osm_type", "osm_id").alias("element"))


@query("k03_stop_key", "SELECT stop_id, CASE WHEN naptan <> '' THEN 'naptan:' || naptan ELSE 'osm:node/' || CAST(stop_id AS VARCHAR) END AS key, CASE WHEN direction = '' THEN 'Direction not stated' ELSE direction END AS direction FROM stops")
def k03(t):
    tags = F.expr("map('naptan:AtcoCode', case when stop_id % 2 = 0 then naptan else '' end, 'ref:GB:NaPTAN', naptan, 'bearing', direction)")
    s = t.stops.withColumn("tags", tags)
    return s.select("stop_id", keys.stop("tags", F.lit("node"), "stop_id").alias("key"), keys.stop_direction("tags").alias("direction"))


@query("k04_rail_keys", "SELECT stop_id, CASE WHEN stop_id % 4 = 0 THEN 'crs:' || upper(direction || 'x') WHEN naptan <> '' THEN 'naptan:' || naptan ELSE 'fallback:' || lower(stop_name) || '|Rail|' || CAST(CAST(floor(lat * 1e3 + 0.5e0) AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(floor(lon * 1e3 + 0.5e0) AS BIGINT) AS VARCHAR) END AS library, CASE WHEN stop_id % 4 = 0 THEN 'crs:' || upper(direction || 'x') WHEN naptan <> '' THEN 'naptan:' || naptan ELSE 'fallback:' || lower(stop_name) || '|rail' END AS workflow, CASE WHEN stop_id % 4 = 0 THEN 'crs:' || direction || 'x' WHEN naptan <> '' THEN 'naptan:' || naptan ELSE stop_name END AS master FROM stops")
def k04(t):
    s = t.stops.withColumn("crs", F.when(F.col("stop_id") % 4 == 0, F.concat("direction", F.lit("x"))).otherwise(""))
    no = F.lit("")
    library = F.replace(keys.rail_library("crs", no, "naptan", no, no, "stop_name", F.lit("Rail"), "lat", "lon"), F.lit("\u0000"), F.lit(""))
    return s.select("stop_id", library.alias("library"), keys.rail_workflow(no, "crs", no, "naptan", no, "stop_name", F.lit("Rail")).alias("workflow"), keys.rail_master(no, "crs", "naptan", "stop_name").alias("master"))


legacy_sql = f"{_norm('route_number')} || '|' || {_norm('operator')} || '|' || {_norm('origin')} || '|' || {_norm('destination')} || '|' || {_norm('context')}"
authority_sql = f"CASE WHEN regexp_matches({_norm('url')}, 'tfl gov uk') OR regexp_matches({_norm('context')}, '\\b(east|north|south|west|central) london\\b') THEN 'transport-for-london' WHEN regexp_matches({_norm('url')}, 'intalink org uk') THEN 'hertfordshire-intalink' ELSE 'region-unresolved' END"
canonical_sql = f"'route:' || {authority_sql} || ':' || {_norm('route_number')} || ':' || CASE WHEN origin = '' THEN {_norm('destination')} WHEN {_norm('origin')} < {_norm('destination')} THEN {_norm('origin')} || '~' || {_norm('destination')} ELSE {_norm('destination')} || '~' || {_norm('origin')} END || ':' || {_norm('variant')}"


def route_keys(routes):
    """Routes with authority, canonical_key and legacy_key."""
    r = routes.withColumn("authority", keys.authority(F.lit(""), "url", "context"))
    r = r.withColumn("canonical_key", keys.route_canonical(F.lit(""), F.col("authority"), "route_number", "origin", "destination", "variant"))
    return r.withColumn("legacy_key", keys.route_legacy("route_number", "operator", "origin", "destination", "context"))


@query("k05_legacy_route_key", f"SELECT route_id, {legacy_sql} AS v FROM routes")
def k05(t):
    return route_keys(t.routes).select("route_id", F.col("legacy_key").alias("v"))


@query("k06_canonical_route_key", f"SELECT route_id, {canonical_sql} AS v FROM routes")
def k06(t):
    return route_keys(t.routes).select("route_id", F.col("canonical_key").alias("v"))


@query("k07_authority", f"SELECT route_id, {authority_sql} AS v FROM routes")
def k07(t):
    return route_keys(t.routes).select("route_id", F.col("authority").alias("v"))


@query("k08_route_aliases", f"SELECT route_id, alias FROM (SELECT route_id, {_norm('canonical')} AS alias FROM (SELECT route_id, {canonical_sql} AS canonical FROM routes) AS a UNION SELECT route_id, {_norm('legacy')} FROM (SELECT route_id, {legacy_sql} AS legacy FROM routes) AS b UNION SELECT route_id, 'r' || CAST(route_id % 10 AS VARCHAR) FROM routes) AS c")
def k08(t):
    r = route_keys(t.routes)
    recorded = F.array(F.concat(F.lit("R"), (F.col("route_id") % 10).cast("string")))
    return r.select("route_id", F.explode(keys.route_aliases(F.col("canonical_key"), F.col("legacy_key"), recorded)).alias("alias"))


@query("k09_relationship_keys", f"SELECT stop_id, {_norm('naptan')} || '|' || {_norm('stop_name')} AS two, {_norm('naptan')} || '|' || {_norm('stop_name')} || '|' || {_norm('direction')} || '|' || {_norm('pair')} AS four FROM stops")
def k09(t):
    stop = x.normal_ascii("naptan")
    return t.stops.select("stop_id", keys.relationship(stop, F.col("stop_name")).alias("two"), keys.relationship(stop, F.col("stop_name"), "direction", "pair").alias("four"))


@query("k10_similar_stop_key", f"SELECT stop_id, {_norm('stop_name')} || '|' || CAST(CAST(floor(lat * 1e5 + 0.5e0) AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(floor(lon * 1e5 + 0.5e0) AS BIGINT) AS VARCHAR) || '|' || {_norm('direction')} AS v FROM stops")
def k10(t):
    return t.stops.select("stop_id", keys.similar_stop("stop_name", "lat", "lon", "direction").alias("v"))


@query("k11_end_point_key", "SELECT route_id, seq, CAST(CAST(floor(lon * 1e5 + 0.5e0) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(lat * 1e5 + 0.5e0) AS BIGINT) AS VARCHAR) AS v FROM traces")
def k11(t):
    return t.traces.select("route_id", "seq", keys.end_point("lon", "lat").alias("v"))


@query("k12_duplicate_identities", "SELECT stop_id, first_seq FROM (SELECT stop_id, seq, min(seq) OVER (PARTITION BY naptan) AS first_seq FROM stops WHERE naptan <> '') AS q WHERE seq > first_seq")
def k12(t):
    from ..operators.select import duplicates

    return duplicates(t.stops.filter("naptan <> ''"), "naptan").select("stop_id", "first_seq")
