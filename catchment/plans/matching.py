"""Queries of matching, deduplication and choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence, keys
from ..functions.text import normal_ascii
from ..operators import match, quality, rounds, select
from ..registry import query
from .scalars import _norm, route_keys
from .search import _HAV, _H

_LIB = "(SELECT stop_id AS lib_id, -stop_id AS lib_seq, CASE WHEN stop_id % 3 = 0 THEN naptan ELSE '' END AS lib_naptan, stop_name AS lib_name, CASE WHEN stop_id % 5 = 1 THEN '' ELSE direction END AS lib_direction, pair AS lib_pair, lat + 3e-4 AS lib_lat, lon AS lib_lon FROM stops WHERE stop_id % 2 = 0)"
_DIST = f"(SELECT *, {_HAV} AS metres FROM (SELECT *, {_H.replace('site_lat', 'lib_lat').replace('site_lon', 'lib_lon')} AS h FROM stops CROSS JOIN {_LIB} AS l) AS a)"


def _library(t):
    lib = t.stops.filter("stop_id % 2 = 0").selectExpr("stop_id as lib_id", "-stop_id as lib_seq", "case when stop_id % 3 = 0 then naptan else '' end as lib_naptan", "stop_name", "case when stop_id % 5 = 1 then '' else direction end as lib_direction", "pair as lib_pair", "lat + 3e-4D as lib_lat", "lon as lib_lon")
    return lib.select("lib_id", "lib_seq", "lib_naptan", normal_ascii("stop_name").alias("lib_name_key"), normal_ascii("lib_direction").alias("lib_dir_key"), "lib_pair", "lib_lat", "lib_lon")


def _stops(t):
    return t.stops.select("stop_id", "naptan", normal_ascii("stop_name").alias("name_key"), normal_ascii("direction").alias("dir_key"), "pair", "lat", "lon")


@query("j03_stop_match", f"SELECT stop_id, arg_max(lib_id, lib_seq) AS lib_id FROM {_DIST} AS d WHERE (naptan <> '' AND naptan = lib_naptan) OR (stop_name = lib_name AND metres <= 120 AND (direction = '' OR lib_direction = '' OR {_norm('direction')} = {_norm('lib_direction')} OR (pair <> '' AND pair = lib_pair))) GROUP BY stop_id")
def j03(t):
    return match.stop_matches(_stops(t), _library(t))


_HARD = f"(SELECT stop_id, arg_min(lib_id, lib_seq) AS lib_id FROM {_DIST} AS d WHERE naptan <> '' AND naptan = lib_naptan GROUP BY stop_id)"


@query("j04_station_match", f"SELECT stop_id, lib_id FROM {_HARD} AS h UNION ALL SELECT stop_id, min(lib_id) AS lib_id FROM {_DIST} AS d WHERE stop_name = lib_name AND metres <= 500 AND stop_id NOT IN (SELECT stop_id FROM {_HARD} AS k) GROUP BY stop_id HAVING count(*) = 1")
def j04(t):
    return match.station_matches(_stops(t), _library(t), [("naptan", "lib_naptan")])


@query("j05_stop_routes", "SELECT s.stop_id, r.route_id FROM stops AS s JOIN stop_routes AS r ON s.stop_id = r.stop_id WHERE s.naptan <> ''")
def j05(t):
    return t.stops.filter("naptan <> ''").join(t.stop_routes, "stop_id").select("stop_id", "route_id")


_ALIASES = f"(SELECT route_id, seq, {_norm('route_number')} || ' ' || {_norm('operator')} AS alias FROM routes UNION SELECT route_id, seq, 'r' || CAST(route_id % 50 AS VARCHAR) FROM routes)"


@query("j06_alias_match", f"SELECT l.stop_id, l.route_id AS link_id, f.route_id FROM stop_routes AS l LEFT JOIN (SELECT alias, arg_min(route_id, seq) AS route_id FROM {_ALIASES} AS a GROUP BY alias) AS f ON f.alias = 'r' || CAST(l.route_id % 70 AS VARCHAR)")
def j06(t):
    """Links find their route by any of its names."""
    r = t.routes
    named = F.concat_ws(" ", normal_ascii("route_number"), normal_ascii("operator"))
    aliases = r.select("route_id", "seq", F.explode(F.array(named, F.concat(F.lit("r"), (F.col("route_id") % 50).cast("string")))).alias("alias")).distinct()
    links = t.stop_routes.select("stop_id", F.col("route_id").alias("link_id"), F.concat(F.lit("r"), (F.col("route_id") % 70).cast("string")).alias("link_key"))
    return match.by_alias(links, aliases).select("stop_id", "link_id", "route_id")


@query("j07_only_candidate", "SELECT l.route_id AS link_id, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN only_id END AS route_id FROM routes AS l LEFT JOIN (SELECT route_number, count(*) AS n, min(route_id) AS only_id FROM routes WHERE route_id % 30 = 0 GROUP BY route_number) AS c USING (route_number)")
def j07(t):
    links = t.routes.select(F.col("route_id").alias("link_id"), "route_number")
    return match.only_candidate(links, t.routes.filter("route_id % 30 = 0")).select("link_id", "candidates", "route_id")


@query("j11_relevant_subset", "SELECT DISTINCT r.route_id FROM routes AS r JOIN stop_routes AS l ON l.route_id = r.route_id JOIN stops AS s ON s.stop_id = l.stop_id WHERE s.status = 'verified'")
def j11(t):
    """Routes of selected stops, by two semi-joins."""
    links = t.stop_routes.join(t.stops.filter("status = 'verified'").select("stop_id"), "stop_id", "left_semi")
    return t.routes.join(links, "route_id", "left_semi").select("route_id")


@query("j12_plan_anti", "SELECT route_id FROM routes WHERE route_id % 3 = 1 AND route_number NOT IN (SELECT route_number FROM routes WHERE route_id % 3 = 0 AND weekday NOT IN ('', 'research required'))")
def j12(t):
    """What is needed less what is known completely."""
    known = t.routes.filter("route_id % 3 = 0").filter(evidence.useful("weekday")).select("route_number").distinct()
    return t.routes.filter("route_id % 3 = 1").join(known, "route_number", "left_anti").select("route_id")


@query("j13_cleanup_split", "SELECT route_id, route_id % 4 = 0 AS confirmed FROM routes")
def j13(t):
    wanted = t.routes.filter("route_id % 4 = 0").select("route_id")
    out = t.routes.select("route_id")
    return out.join(wanted, "route_id", "left_semi").withColumn("confirmed", F.lit(True)).union(out.join(wanted, "route_id", "left_anti").withColumn("confirmed", F.lit(False)))


_STATE = "CASE WHEN t.task_id IS NULL THEN 'unassigned' WHEN r.task_id IS NULL THEN 'unreturned' WHEN r.kind <> t.kind THEN 'kind differs' WHEN r.record <> t.record THEN 'record differs' ELSE 'accepted' END"


@query("j14_validate_results", f"SELECT coalesce(r.task_id, t.task_id) AS task_id, {_STATE} AS state FROM results AS r FULL JOIN tasks AS t ON r.task_id = t.task_id")
def j14(t):
    return match.compared(t.results, t.tasks)


@query("m15_pack_acceptance", f"SELECT state, count(*) AS n FROM (SELECT {_STATE} AS state FROM results AS r FULL JOIN tasks AS t ON r.task_id = t.task_id) AS q GROUP BY state")
def m15(t):
    return match.compared(t.results, t.tasks).groupBy("state").agg(F.count("*").alias("n"))


@query("j15_identity_overlap", "SELECT stop_id, (naptan <> '' AND stop_id % 3 <> 1) OR (naptan = '' AND stop_id % 4 = 0) AS same FROM stops")
def j15(t):
    """Requested and returned stations agree if any identifier does, or if neither has one and the names do."""
    ids = lambda *c: F.filter(F.array(*c), lambda x: x != "")
    asked = ids("naptan")
    back = ids(F.expr("case when stop_id % 3 <> 1 then naptan else concat('X', naptan) end"))
    back = F.when(F.col("naptan") == "", ids(F.lit(""))).otherwise(back)
    names = F.col("stop_name") == F.expr("case when stop_id % 4 = 0 then stop_name else 'other' end")
    return t.stops.select("stop_id", (F.arrays_overlap(asked, back) | (F.size(asked) == 0) & (F.size(back) == 0) & names).alias("same"))


@query("j17_requested_identity", "SELECT task_id, CASE WHEN NOT has THEN 'missing' WHEN n1 <> n2 THEN 'number differs' ELSE 'ok' END AS state FROM (SELECT t.task_id, r.task_id IS NOT NULL AS has, t.record AS n1, r.record AS n2 FROM tasks AS t LEFT JOIN results AS r ON r.task_id = t.task_id) AS q")
def j17(t):
    r = t.results.select("task_id", F.col("record").alias("got"), F.lit(True).alias("has"))
    return t.tasks.join(r, "task_id", "left").select("task_id", F.when(F.col("has").isNull(), "missing").when(F.col("record") != F.col("got"), "number differs").otherwise("ok").alias("state"))


@query("j18_presentation_group", "SELECT route_id, coalesce(CASE operator WHEN 'Brand#1' THEN 'group-1' WHEN 'Brand#2' THEN 'group-2' END, 'none') AS grp FROM routes")
def j18(t):
    groups = t.spark.createDataFrame([("Brand#1", "group-1"), ("Brand#2", "group-2")], "operator string, grp string")
    return t.routes.join(F.broadcast(groups), "operator", "left").select("route_id", F.coalesce("grp", F.lit("none")).alias("grp"))  # two rows


@query("j23_link_synthesis", "SELECT s.stop_id, x.n AS route, l.stop_id IS NOT NULL AS known FROM stops AS s CROSS JOIN (SELECT unnest(range(1, 4)) AS n) AS x LEFT JOIN (SELECT DISTINCT stop_id, route_id FROM stop_routes) AS l ON l.stop_id = s.stop_id AND l.route_id = s.stop_id * 3 + x.n")
def j23(t):
    """Links that a stop's own list names and the table lacks are made up from the list."""
    named = t.stops.select("stop_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("route")).withColumn("route_id", F.col("stop_id") * 3 + F.col("route"))
    have = t.stop_routes.select("stop_id", "route_id").distinct()
    known = named.join(have, ["stop_id", "route_id"], "left_semi").withColumn("known", F.lit(True))
    made = named.join(have, ["stop_id", "route_id"], "left_anti").withColumn("known", F.lit(False))
    return known.union(made).select("stop_id", "route", "known")


@query("w02_last_wins", "SELECT stop_name, max(stop_id) AS stop_id FROM stops GROUP BY stop_name")
def w02(t):
    return select.last_wins(t.stops, "stop_name").select("stop_name", "stop_id")


_EXACT = "CASE WHEN naptan <> '' THEN 'naptan:' || naptan ELSE 'osm:' || CAST(stop_id AS VARCHAR) END"
_SIMILAR = f"{_norm('stop_name')} || '|' || CAST(CAST(floor(lat * 1e5 + 0.5e0) AS BIGINT) AS VARCHAR) || '|' || {_norm('direction')}"


@query("w03_two_level_dedupe", f"SELECT stop_id FROM (SELECT *, row_number() OVER (PARTITION BY {_SIMILAR} ORDER BY seq) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY {_EXACT} ORDER BY seq) AS r1 FROM stops) AS a WHERE r1 = 1) AS b WHERE r2 = 1")
def w03(t):
    exact = F.when(F.col("naptan") != "", F.concat(F.lit("naptan:"), "naptan")).otherwise(F.concat(F.lit("osm:"), F.col("stop_id").cast("string")))
    similar = F.concat_ws("|", normal_ascii("stop_name"), keys.place("lat", 5), normal_ascii("direction"))
    return select.two_level(t.stops, exact, similar).select("stop_id")


@query("w04_greedy_resolution")
def w04(t):
    s = t.stops.select("site_id", "seq", normal_ascii("stop_name").alias("name"), F.lit("Rail").alias("mode"), F.col("naptan").alias("code"), "lat", "lon", (F.col("stop_id") % 5).alias("richness"), F.abs("balance").alias("straight"))
    return rounds.resolved_stations(s.withColumn("site_id", F.col("site_id").cast("long")))


_MISSING = "((origin = '')::INT + (weekday IN ('', 'research required'))::INT + (sunday = '')::INT + (title = '')::INT)"


@query("w06_best_match", f"SELECT route_number, route_id FROM (SELECT *, row_number() OVER (PARTITION BY route_number ORDER BY {_MISSING}, retrieval_date DESC, route_id) AS rn FROM routes) AS q WHERE rn = 1")
def w06(t):
    missing = sum(((~evidence.useful(c)).cast("int") for c in ("weekday", "sunday", "title")), (~evidence.useful("origin")).cast("int"))
    return select.ranked(t.routes, "route_number", [missing, F.col("retrieval_date").desc(), F.col("route_id")]).select("route_number", "route_id")


@query("w07_choose_best", f"SELECT route_number, route_id FROM (SELECT *, row_number() OVER (PARTITION BY route_number ORDER BY CASE WHEN status = 'verified' THEN 0 ELSE 1 END, retrieval_date DESC, {_MISSING}, route_id) AS rn FROM routes) AS q WHERE rn = 1")
def w07(t):
    missing = sum(((~evidence.useful(c)).cast("int") for c in ("weekday", "sunday", "title")), (~evidence.useful("origin")).cast("int"))
    order = [(~evidence.is_verified("status")).cast("int"), F.col("retrieval_date").desc(), missing, F.col("route_id")]
    return select.ranked(t.routes, "route_number", order).select("route_number", "route_id")


@query("w09_label_dedupe", "SELECT stop_name, arg_min(stop_id, stop_id % 4 * 100000 + stop_id) AS stop_id, min(seq) AS place FROM stops GROUP BY stop_name")
def w09(t):
    """One label for each name, of the best rank, at the place of the first."""
    return t.stops.groupBy("stop_name").agg(F.min_by("stop_id", F.col("stop_id") % 4 * 100000 + F.col("stop_id")).alias("stop_id"), F.min("seq").alias("place"))


@query("w10_capped_labels", "SELECT stop_id FROM (SELECT stop_id, row_number() OVER (PARTITION BY stop_name ORDER BY stop_id) AS rn FROM stops) AS q WHERE rn <= 2")
def w10(t):
    return select.ranked(t.stops, "stop_name", F.col("stop_id"), 2).select("stop_id")


@query("j21_placed_labels")
def j21(t):
    labels = t.stops.select(F.col("site_id").cast("long").alias("drawing"), F.col("stop_name").alias("label"), (F.col("stop_id") % 3).alias("priority"), (F.col("lon") * 1000).alias("x"), (F.col("lat") * 1000).alias("y"), F.lit(12.0).alias("w"), F.lit(4.0).alias("h"), "seq")
    return rounds.placed_labels(labels)


@query("m05_sequential_upsert")
def m05_sequential(t):
    """Stops with an odd number upserted one after another into those with an even one: by identifier (code, pair), else by the only stop of the name and direction within 500 m, else inserted. Later ones meet earlier ones."""
    rows = t.stops.select(F.concat(F.lit("stop:"), F.col("stop_id").cast("string")).alias("key"), "seq", normal_ascii("stop_name").alias("name"), F.col("direction").alias("mode"), "lat", "lon", F.col("naptan").alias("code"), "pair")
    return rounds.upserted(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1"), ["code", "pair"])


@query("w15_chunks", "SELECT stop_id, CAST(floor((row_number() OVER (ORDER BY stop_name, stop_id) - 1) / 5e0) AS BIGINT) AS chunk FROM stops")
def w15(t):
    return select.chunked(t.stops, 5, [F.col("stop_name"), F.col("stop_id")]).select("stop_id", "chunk")


@query("w18_group_offsets", "SELECT route_id, row_number() OVER (PARTITION BY route_number ORDER BY route_id) - (count(*) OVER (PARTITION BY route_number) + 1) / 2e0 AS shift FROM routes")
def w18(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("route_number")
    return t.routes.select("route_id", (F.row_number().over(w.orderBy("route_id")) - (F.count("*").over(w) + 1) / 2.0).alias("shift"))


@query("o03_natural_order", "SELECT route_id, CAST(row_number() OVER (ORDER BY regexp_extract(lower(route_number), '^(\\D*)', 1), CAST(regexp_extract(route_number, '(\\d+)', 1) AS INTEGER), lower(route_number), route_number, route_id) AS INTEGER) AS shown FROM routes")
def o03(t):
    """Numbers in names sort by value. One list for display."""
    routes = t.routes.select("route_id", "route_number")
    return select.numbered(routes, [*select.natural_order("route_number"), F.col("route_id")], "shown").select("route_id", F.col("shown").cast("int").alias("shown"))


@query("u02_union_distinct", "SELECT route_id FROM routes WHERE route_id % 2 = 0 UNION SELECT route_id FROM stop_routes")
def u02(t):
    return t.routes.filter("route_id % 2 = 0").select("route_id").union(t.stop_routes.select("route_id")).distinct()


@query("u03_set_equality", "SELECT stop_id, count(*) % 2 = 0 AS same FROM stop_routes GROUP BY stop_id")
def u03(t):
    """Declared against actual routes of each stop; every other list lacks one."""
    actual = t.stop_routes.groupBy("stop_id").agg(F.array_sort(F.collect_set("route_id")).alias("actual"))
    declared = F.when(F.size("actual") % 2 == 0, F.reverse("actual")).otherwise(F.slice("actual", F.lit(1), F.size("actual") - 1))
    return actual.select("stop_id", (F.array_sort(F.array_distinct(declared)) == F.col("actual")).alias("same"))


@query("u04_except", "SELECT DISTINCT route_id FROM routes WHERE route_id NOT IN (SELECT route_id FROM stop_routes WHERE quantity >= 50)")
def u04(t):
    return t.routes.select("route_id").join(t.stop_routes.filter("quantity >= 50"), "route_id", "left_anti")


@query("u05_first_group_only", "SELECT route_id, min(grp) AS grp FROM (SELECT route_id, stop_id % 7 AS grp FROM stop_routes) AS q GROUP BY route_id")
def u05(t):
    """Each route stays in the first group that names it."""
    return t.stop_routes.select("route_id", (F.col("stop_id") % 7).alias("grp")).groupBy("route_id").agg(F.min("grp").alias("grp"))


@query("a15_distinct_join", "SELECT stop_name, string_agg(d, ' / ' ORDER BY d) AS directions FROM (SELECT DISTINCT stop_name, direction AS d FROM stops WHERE direction <> '') AS q GROUP BY stop_name")
def a15(t):
    d = t.stops.filter("direction <> ''").groupBy("stop_name").agg(F.array_sort(F.collect_set("direction")).alias("d"))
    return d.select("stop_name", F.array_join("d", " / ").alias("directions"))


@query("a16_merged_sources", "SELECT url, max(route_id) AS best FROM routes WHERE url <> '' GROUP BY url")
def a16(t):
    """One source for each URL, that of the latest record."""
    return select.ranked(t.routes.filter("url <> ''"), "url", F.col("route_id").desc()).select("url", F.col("route_id").alias("best"))




@query("a18_canonical_migration", f"SELECT canonical, count(*) AS merged, min(route_id) AS keeper FROM (SELECT route_id, {_norm('route_number')} || ':' || least({_norm('origin')}, {_norm('destination')}) || ':' || greatest({_norm('origin')}, {_norm('destination')}) AS canonical FROM routes WHERE origin <> '') AS q GROUP BY canonical")
def a18(t):
    """Records are grouped under their canonical key; the first is kept."""
    ends = F.array_sort(F.array(normal_ascii("origin"), normal_ascii("destination")))
    canonical = F.concat_ws(":", normal_ascii("route_number"), ends[0], ends[1])
    return t.routes.filter("origin <> ''").groupBy(canonical.alias("canonical")).agg(F.count("*").alias("merged"), F.min("route_id").alias("keeper"))


_MIGRATING = "SELECT route_id, 'route:' || route_number || ':' || origin AS ck FROM routes"
_FIRSTS = f"SELECT ck, min(route_id) AS first FROM ({_MIGRATING}) AS m GROUP BY ck"
_LINEAGE = f"""SELECT k, arg_max(ck, first) AS ck FROM (SELECT 'legacy ' || CAST(route_id AS VARCHAR) AS k, ck, first FROM ({_MIGRATING}) AS m JOIN ({_FIRSTS}) AS f USING (ck) UNION ALL SELECT 'old ' || CAST(route_id % 500 AS VARCHAR), ck, first FROM ({_MIGRATING}) AS n JOIN ({_FIRSTS}) AS g USING (ck)
 UNION ALL SELECT {_norm('ck')}, ck, first FROM ({_FIRSTS}) AS h) AS names GROUP BY k"""


def _migrated(t):
    from ..operators import migration

    routes = t.routes.select(F.col("route_id").alias("seq"), F.concat(F.lit("legacy:"), F.col("route_id").cast("string")).alias("legacy_key"), F.concat(F.lit("route:"), "route_number", F.lit(":"), "origin").alias("canonical_key"), F.col("route_number").alias("number"))
    aliases = t.routes.select(F.col("route_id").alias("seq"), F.lit(0).cast("long").alias("at"), F.concat(F.lit("old:"), (F.col("route_id") % 500).cast("string")).alias("alias"))
    sources = t.routes.select(F.col("route_id").alias("seq"), F.lit(0).cast("long").alias("at"), "url", "title", "publisher", F.col("retrieval_date").alias("retrieved"))
    revisions = t.routes.select(F.col("route_id").alias("seq"), F.lit(0).cast("long").alias("at"), F.col("variant").alias("revision")).filter("revision <> ''")
    known = F.when(F.col("route_id") % 3 == 0, F.concat(F.lit("old:"), (F.col("route_id") % 500).cast("string"))).otherwise(F.concat(F.lit("legacy:"), F.col("route_id").cast("string")))
    links = t.stop_routes.select("stop_id", "route_id", known.alias("route_key"))
    return migration.canonical_migration(routes, aliases, sources, revisions, links, normal_ascii)


@query("a18_migrated_links", f"""SELECT stop_id, route_id, coalesce(ck, was) AS route_key, CASE WHEN ck IS NOT NULL THEN was END AS legacy_route_key FROM (SELECT stop_id, route_id, CASE WHEN route_id % 3 = 0 THEN 'old:' || CAST(route_id % 500 AS VARCHAR) ELSE 'legacy:' || CAST(route_id AS VARCHAR) END AS was FROM stop_routes) AS l LEFT JOIN ({_LINEAGE}) AS g ON g.k = {_norm('was')}""")
def a18_links(t):
    """Links rewritten through the lineage of their routes' keys."""
    return _migrated(t).links


@query("a18_migration_report", f"""SELECT (SELECT count(*) FROM routes) AS routes_before, (SELECT count(*) FROM ({_FIRSTS}) AS f) AS routes_after, (SELECT count(*) FROM (SELECT ck FROM ({_MIGRATING}) AS m GROUP BY ck HAVING count(*) > 1) AS c) AS merged_candidates, (SELECT count(*) FROM routes) - (SELECT count(*) FROM ({_FIRSTS}) AS h) AS records_merged,
 (SELECT count(*) FROM stop_routes) AS links, (SELECT count(*) FROM stop_routes AS l JOIN routes AS r ON r.route_id = l.route_id) AS references_updated, (SELECT count(*) FROM (SELECT {_norm('route_number')} AS n FROM routes GROUP BY 1 HAVING count(DISTINCT origin) > 1) AS a) AS numbers_apart""")
def a18_report(t):
    """Counts before and after the migration."""
    return _migrated(t).report


@query("a19_numbers_kept_apart", "SELECT route_number, count(DISTINCT origin) AS n FROM routes GROUP BY route_number HAVING count(DISTINCT origin) > 1")
def a19(t):
    return t.routes.groupBy("route_number").agg(F.countDistinct("origin").alias("n")).filter("n > 1")


@query("n15_linked_stops", "SELECT route_id, count(DISTINCT stop_id) AS stops, CAST(sum(links) AS BIGINT) AS links FROM stop_routes GROUP BY route_id")
def n15(t):
    return t.stop_routes.groupBy("route_id").agg(F.countDistinct("stop_id").alias("stops"), F.sum("links").alias("links"))


@query("n10_enriched_stops", "SELECT s.stop_id, count(DISTINCT r.route_number) AS routes FROM stops AS s LEFT JOIN stop_routes AS l ON l.stop_id = s.stop_id LEFT JOIN routes AS r ON r.route_id = l.route_id GROUP BY s.stop_id")
def n10(t):
    links = t.stop_routes.join(t.routes.select("route_id", "route_number"), "route_id")
    return t.stops.select("stop_id").join(links.select("stop_id", "route_number").distinct(), "stop_id", "left").groupBy("stop_id").agg(F.count("route_number").alias("routes"))


@query("f17_review_override", "SELECT stop_id FROM stops WHERE CASE WHEN stop_id % 5 = 0 THEN true WHEN stop_id % 5 = 1 THEN false ELSE status <> 'missing' END")
def f17(t):
    """A decision by hand overrides the default, which leaves out what is marked."""
    decided = t.stops.filter("stop_id % 5 < 2").select("stop_id", (F.col("stop_id") % 5 == 0).alias("own"))
    return t.stops.join(decided, "stop_id", "left").filter(F.coalesce("own", F.col("status") != "missing")).select("stop_id")


@query("f19_allow_list", "SELECT stop_id, stop_id % 2 = 0 AS allowed FROM stops")
def f19(t):
    allowed = t.stops.filter("stop_id % 2 = 0").select("stop_id", F.lit(True).alias("allowed"))
    return t.stops.select("stop_id").join(allowed, "stop_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
