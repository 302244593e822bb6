"""Queries of research quality: fields, records, imports, completeness and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..functions.text import status_class
from ..operators import quality as q
from ..registry import query
from .scalars import _SPECIFIC, _cited, _generic, status_sql

_ISSUES = f"""list_filter([CASE WHEN value LIKE 'refer to the operator website' THEN '{q.PLACEHOLDER}' END, CASE WHEN status = 'verified' AND NOT ({_SPECIFIC('source')} AND NOT {_generic('source', 'false')}) THEN '{q.NO_URL}' END,
 CASE WHEN status = 'verified' AND source_title = '' THEN '{q.NO_TITLE}' END, CASE WHEN status = 'verified' AND publisher = '' THEN '{q.NO_PUBLISHER}' END, CASE WHEN status = 'verified' AND retrieval_date = '' THEN '{q.NO_DATE}' END], lambda i: i IS NOT NULL)"""
_STATE = "CASE WHEN value LIKE 'refer to the operator website' OR (status = 'verified' AND len(issues) > 0) THEN 'rejected' WHEN status <> 'verified' AND len(issues) = 0 THEN 'review' ELSE 'accepted' END"
_FIELDS = f"(SELECT *, {_STATE} AS state FROM (SELECT *, {_ISSUES} AS issues FROM rail_fields) AS f)"


def checked(t):
    return t.rail_fields.withColumn("r", q.field_result()).select("key", "field", "value", "status", "r.state", "r.issues")


@query("c09_field_result", f"SELECT key, field, state, array_to_string(issues, '; ') AS issues FROM {_FIELDS} AS s")
def c09(t):
    return checked(t).select("key", "field", "state", F.array_join("issues", "; ").alias("issues"))


_RECORDS = f"""(SELECT key, blanks, n_issues, CASE WHEN n_issues > 0 THEN '{q.POOR}' WHEN review THEN '{q.REVIEW}' WHEN verified AND blanks > ceil(n / 3e0) THEN '{q.LEGACY}' WHEN blanks > ceil(n / 3e0) THEN '{q.PARTIAL}' ELSE '{q.COMPLETE}' END AS quality FROM
 (SELECT key, count(*) AS n, count(*) FILTER (value = '') AS blanks, CAST(coalesce(sum(len(issues)) FILTER (value <> ''), 0) AS BIGINT) AS n_issues, bool_or(value <> '' AND state = 'review') AS review, bool_or(value <> '' AND state = 'accepted') AS verified FROM {_FIELDS} AS s GROUP BY key) AS g)"""


@query("c12_record_quality", f"SELECT *, quality = '{q.COMPLETE}' AND n_issues = 0 AS publishable FROM {_RECORDS} AS r")
def c12(t):
    return q.analyse_records(checked(t))


_STATIONS = f"SELECT k.key, k.batch, k.record, r.n_issues, r.quality, NOT (r.quality = '{q.COMPLETE}' AND r.n_issues = 0) AS bad FROM (SELECT DISTINCT key, record_id % 12 AS batch, 'Station ' || CAST(record_id % 500 AS VARCHAR) AS record FROM rail_fields) AS k JOIN {_RECORDS} AS r ON r.key = k.key WHERE batch NOT IN (5, 7)"
_ISSUES = f"SELECT s.batch, s.record, CAST(f.field AS VARCHAR) AS field, unnest(f.issues) AS reason, r.source AS url FROM {_FIELDS} AS f JOIN ({_STATIONS}) AS s ON s.key = f.key JOIN rail_fields AS r ON r.key = f.key AND r.field = f.field WHERE s.bad AND f.value <> ''"
_FAILURES = f"SELECT * FROM ({_ISSUES}) AS i UNION ALL SELECT batch, record, NULL, quality, '' FROM ({_STATIONS}) AS s WHERE bad AND n_issues = 0"


def _imported(t):
    from ..operators import imports

    fields = t.rail_fields.select((F.col("record_id") % 12).alias("batch"), F.concat(F.lit("Station "), (F.col("record_id") % 500).cast("string")).alias("record"), "key", "field", "value", "status", "source", "source_title", "publisher", "retrieval_date")
    came = fields.select("batch").distinct().withColumns({"request_group": F.lit("g1"), "sequence": F.col("batch") + 1, "total": F.when(F.col("batch") == 5, 11).otherwise(12)})
    plan = came.filter("batch <> 7").withColumn("total", F.lit(12))
    master = t.rail_fields.select("key", "field", F.lit("Earlier value").alias("value"), F.lit("verified").alias("status"), F.lit("2026-05-01").alias("date"))
    return imports.rail_import(plan, came, fields, master)


@query("n03_import_states", f"""SELECT b.batch, CASE WHEN b.batch IN (5, 7) THEN 'rejected' WHEN coalesce(c.failed, 0) > 0 THEN 'correction-required' ELSE 'imported' END AS state, CASE b.batch WHEN 5 THEN 'total does not match the plan' WHEN 7 THEN 'batch was not planned' ELSE '' END AS problems,
 coalesce(c.passed, 0) AS passed, coalesce(c.failed, 0) AS failed, coalesce(f.n, 0) AS failures FROM (SELECT DISTINCT record_id % 12 AS batch FROM rail_fields) AS b
 LEFT JOIN (SELECT s.batch, count(*) FILTER (x.record IS NULL) AS passed, count(*) FILTER (x.record IS NOT NULL) AS failed FROM ({_STATIONS}) AS s LEFT JOIN (SELECT DISTINCT batch, record FROM ({_STATIONS}) AS y WHERE bad) AS x ON x.batch = s.batch AND x.record = s.record GROUP BY s.batch) AS c ON c.batch = b.batch
 LEFT JOIN (SELECT batch, count(*) AS n FROM ({_FAILURES}) AS z GROUP BY batch) AS f ON f.batch = b.batch""")
def n03_states(t):
    """How each returned batch of rail research ends: rejected by its metadata, for correction, or imported."""
    return _imported(t).states


@query("n03_import_failures", _FAILURES)
def n03_failures(t):
    """Every reason for which a station of a sound batch goes back."""
    return _imported(t).failures


@query("a06_quality_roll_up", f"SELECT count(*) FILTER (quality = '{q.COMPLETE}' AND n_issues = 0) AS accepted, count(*) FILTER (quality = '{q.REVIEW}') AS for_review, count(*) FILTER (quality = '{q.POOR}') AS poor, count(*) FILTER (n_issues > 0) AS rejected, CAST(sum(n_issues) AS BIGINT) AS to_correct FROM {_RECORDS} AS r")
def a06(t):
    return q.roll_up(q.analyse_records(checked(t)))


@query("c08_import_state", f"""SELECT route_id, CASE WHEN origin = '' THEN 'quarantined' WHEN {status_sql('status')} <> 'verified' THEN 'review' WHEN {_generic('url', 'true')} THEN 'review' WHEN weekday = '' OR sunday = '' THEN 'review' ELSE 'accepted' END AS state,
 CASE WHEN origin = '' THEN 'Incomplete composite route identity: origin' WHEN {status_sql('status')} <> 'verified' THEN 'Verification status requires professional review' WHEN {_generic('url', 'true')} THEN 'Only a generic services or routes page is cited'
 WHEN weekday = '' OR sunday = '' THEN 'Verified legacy route — enrichment recommended: ' || concat_ws(', ', CASE WHEN weekday = '' THEN 'weekday' END, CASE WHEN sunday = '' THEN 'sunday' END) ELSE 'Complete composite identity and record-specific evidence' END AS reason FROM routes""")
def c08(t):
    return t.routes.withColumn("r", q.import_state_route()).select("route_id", "r.state", "r.reason")


@query("c10_adequate_audit", "SELECT route_id, route_id % 6 <> 0 AND route_id % 8 <> 0 AND route_id % 4 <> 1 AS v FROM routes")
def c10(t):
    """Two complete sources, terms, sections and a reason."""
    source = lambda n: F.struct(F.lit(f"https://one.example/page/{n}").alias("url"), F.col("title").alias("title"), F.col("publisher").alias("publisher"), F.col("retrieval_date").alias("retrievalDate"))
    sources = F.when(F.col("route_id") % 4 == 1, F.array(source(1))).otherwise(F.array(source(1), source(2)))
    words = F.array(F.lit("x"))
    return t.routes.select("route_id", ev.adequate_audit(sources, words, words, F.lit("No page of the operator states it.")).alias("v"))


_MISSING = "list_filter([CASE WHEN origin = '' THEN 'origin' END, CASE WHEN context = '' THEN 'context' END, CASE WHEN weekday IN ('', 'research required') THEN 'weekday' END, CASE WHEN sunday = '' THEN 'sunday' END, CASE WHEN NOT {c} THEN 'direct route-specific evidence' END, CASE WHEN status <> 'verified' THEN 'eligible verification status' END], lambda i: i IS NOT NULL)".replace("{c}", _cited)


@query("c11_required_fields", f"SELECT route_id, array_to_string(list_filter({_MISSING}, lambda i: NOT i LIKE '% %'), ',') AS missing FROM routes")
def c11(t):
    from ..operators.quality import ROUTE_REQUIRED, array_of

    return t.routes.select("route_id", F.array_join(array_of(*[(~ev.useful(c), c) for c in ROUTE_REQUIRED]), ",").alias("missing"))


@query("c13_missing_fields", f"SELECT route_id, array_to_string({_MISSING}, ', ') || CASE WHEN date_diff('day', CAST(retrieval_date AS DATE), DATE '2027-04-01') > 400 THEN ', retrievalDate' ELSE '' END AS missing FROM routes")
def c13(t):
    fresh = ev.is_fresh(ev.day("retrieval_date"), "2027-04-01")
    missing = F.concat(q.missing_route_fields(), F.when(fresh, F.array().cast("array<string>")).otherwise(F.array(F.lit("retrievalDate"))))
    head, stale = F.array_join(q.missing_route_fields(), ", "), F.when(fresh, "").otherwise(", retrievalDate")
    return t.routes.withColumn("all", missing).select("route_id", F.concat(head, stale).alias("missing"))


_DAYS_OLD = "date_diff('day', CAST(retrieval_date AS DATE), DATE '2027-04-01') > 400"
_STOP_LACKS = f"""list_distinct(list_filter([CASE WHEN stop_name = '' THEN 'stop_name' END, CASE WHEN pair = '' THEN 'locality' END, CASE WHEN direction = '' THEN 'direction' END, CASE WHEN served IS NULL THEN 'routes_served' END, CASE WHEN url = '' THEN 'sources' END, CASE WHEN status = '' THEN 'status' END,
 CASE WHEN naptan = '' THEN 'stop identity' END, CASE WHEN NOT status ILIKE 'verified%' THEN 'status' END, CASE WHEN NOT {_cited} THEN 'direct stop-specific evidence' END, CASE WHEN {_DAYS_OLD} THEN 'retrieval_date' END], lambda i: i IS NOT NULL))"""


@query("c13_stop_missing", f"""SELECT stop_id, field FROM (SELECT stop_id, unnest({_STOP_LACKS}) AS field FROM (SELECT s.stop_id, s.stop_name, s.pair, s.direction, s.status, s.naptan, r.url, r.title, r.publisher, r.retrieval_date, n.served FROM stops AS s JOIN routes AS r ON r.route_id = s.stop_id LEFT JOIN (SELECT stop_id, count(*) AS served FROM stop_routes GROUP BY stop_id) AS n ON n.stop_id = s.stop_id) AS j) AS q""")
def c13_stops(t):
    """What each stop's record lacks, a row for each; a stop's source is that of the route of its number, its locality the pair's."""
    cited = t.routes.select(F.col("route_id").alias("stop_id"), "url", "title", "publisher", "retrieval_date")
    served = t.stop_routes.groupBy("stop_id").agg(F.count("*").alias("served"))
    s = t.stops.withColumn("locality", F.col("pair")).join(cited, "stop_id").join(served, "stop_id", "left")
    return s.select("stop_id", F.explode(q.missing_stop_fields(ev.is_fresh(ev.day("retrieval_date"), "2027-04-01"), F.col("served"))).alias("field"))


_USE_ = lambda c: f"(trim({c}) <> '' AND NOT lower({c}) LIKE '%research required%')"
_LINK_LACKS = f"""list_filter([{', '.join(f"CASE WHEN NOT {_USE_(c)} THEN '{c}' END" for c in ('naptan', 'operator', 'origin', 'context', 'direction', 'weekday', 'sunday', 'variant'))}, CASE WHEN NOT {_cited} THEN 'direct stop-specific evidence' END, CASE WHEN status <> 'verified' THEN 'eligible verification status' END, CASE WHEN {_DAYS_OLD} THEN 'retrieval_date' END], lambda i: i IS NOT NULL)"""


@query("c13_link_missing", f"SELECT stop_id, route_id, array_to_string({_LINK_LACKS}, ', ') AS missing FROM (SELECT l.stop_id, r.*, s.naptan, s.direction FROM stop_routes AS l JOIN routes AS r ON r.route_id = l.route_id JOIN stops AS s ON s.stop_id = l.stop_id) AS j")
def c13_links(t):
    """What each link of a stop and a route lacks: the required fields that the tables have, evidence, status and freshness."""
    rows = t.stop_routes.select("stop_id", "route_id").join(t.routes, "route_id").join(t.stops.select("stop_id", "naptan", "direction"), "stop_id").withColumn("route_key", F.col("route_id").cast("string"))
    missing = q.missing_link_fields(ev.is_fresh(ev.day("retrieval_date"), "2027-04-01"), ("naptan", "operator", "origin", "context", "direction", "weekday", "sunday", "variant"))
    return rows.select("stop_id", "route_id", F.array_join(missing, ", ").alias("missing"))


@query("c14_assessment_status", """SELECT route_id, CASE WHEN coalesce(n, 0) = 0 THEN 'Research not started' WHEN open > 0 THEN 'Stop discovery required' WHEN url = '' OR status = 'missing' THEN 'Route/service research required' WHEN origin = '' THEN 'Research incomplete'
 WHEN weekday IN ('', 'research required') OR sunday = '' THEN 'Import requires review' WHEN title <> '' AND publisher <> '' THEN 'Published and confirmed' WHEN publisher <> '' THEN 'Ready for Shared Library publication' ELSE 'Research complete and ready for output' END AS state
FROM routes LEFT JOIN (SELECT l.route_id, count(*) AS n, count(*) FILTER (s.status = 'missing') AS open FROM stop_routes AS l JOIN stops AS s ON s.stop_id = l.stop_id WHERE s.naptan <> '' AND s.site_id = l.route_id % 25 GROUP BY l.route_id) AS p USING (route_id)""")
def c14(t):
    """The state of each route's assessment, by eight outcomes in order: stops selected, found, route researched, record whole, fields complete, published, ready."""
    stops = t.stops.filter("naptan <> ''").select("stop_id", "site_id", F.col("status").alias("stop_status"))
    chosen = t.stop_routes.join(stops, "stop_id").filter(F.col("site_id") == F.col("route_id") % 25).groupBy("route_id").agg(F.count("*").alias("n"), F.count_if(F.col("stop_status") == "missing").alias("open"))
    r = t.routes.join(chosen, "route_id", "left")
    state = q.assessment_state(
        selected=F.coalesce("n", F.lit(0)) > 0, stops_found=F.coalesce("open", F.lit(0)) == 0, researched=(F.col("url") != "") & (F.col("status") != "missing"), whole=F.col("origin") != "",
        complete=ev.useful("weekday") & ev.useful("sunday"), published=(F.col("title") != "") & (F.col("publisher") != ""), ready=F.col("publisher") != "",
    )
    return r.select("route_id", state.alias("state"))


@query("c15_publish_prediction", f"SELECT r.route_id, CASE WHEN r.route_id % 5 = 4 THEN 'not selected' WHEN r.origin = '' THEN 'blocked' WHEN m.route_id IS NULL THEN 'add' WHEN m.status = 'verified' AND r.status <> 'verified' THEN 'preserved' ELSE 'update' END AS prediction FROM routes AS r LEFT JOIN (SELECT route_id + 1 AS route_id, status FROM routes WHERE route_id % 2 = 0) AS m ON m.route_id = r.route_id")
def c15(t):
    m = t.routes.filter("route_id % 2 = 0").select((F.col("route_id") + 1).alias("route_id"), F.col("status").alias("old"))
    out = t.routes.join(m, "route_id", "left")
    kind = F.when(F.col("route_id") % 5 == 4, "not selected").when(F.col("origin") == "", "blocked").when(F.col("old").isNull(), "add").when(ev.is_verified("old") & ~ev.is_verified("status"), "preserved").otherwise("update")
    return out.select("route_id", kind.alias("prediction"))


@query("c16_status_summary", "SELECT key, CASE WHEN bool_or(status IN ('needs_review', 'missing')) THEN 'needs_review' WHEN bool_and(status = 'verified') THEN 'verified' ELSE 'mixed' END AS summary FROM rail_fields GROUP BY key")
def c16(t):
    return q.status_summary(t.rail_fields)


@query("c17_field_errors", "SELECT key, field, array_to_string(list_filter([CASE WHEN status NOT IN ('missing', 'needs_review', 'requires_professional_review', 'verified', 'manual') THEN 'status is invalid' END, CASE WHEN field = 4 AND record_id % 200 > 100 THEN 'tph is invalid' END, CASE WHEN status = 'verified' AND (source = '' OR retrieval_date = '') THEN 'verified fields require source and date' END], lambda i: i IS NOT NULL), '; ') AS errors FROM rail_fields")
def c17(t):
    """Errors of fields: unknown status, frequency outside 0 to 100, verified without source or date."""
    tph = F.when(F.col("field") == 4, F.col("record_id") % 200)
    errors = q.array_of(
        (~F.col("status").isin("missing", "needs_review", "requires_professional_review", "verified", "manual"), "status is invalid"), (F.coalesce(~tph.between(0, 100), F.lit(False)), "tph is invalid"),
        ((F.col("status") == "verified") & ((F.trim("source") == "") | ~F.col("retrieval_date").rlike(ev.DATE_PREFIX)), "verified fields require source and date"),
    )
    return t.rail_fields.select("key", "field", F.array_join(errors, "; ").alias("errors"))


@query("c18_route_readiness", "SELECT site_id, CASE WHEN bool_or(status = 'missing') THEN 'missing' WHEN bool_or(status LIKE '%review%') THEN 'review' WHEN bool_and(lower(status) LIKE 'verified%') THEN 'ready' ELSE 'open' END AS state FROM stops GROUP BY site_id")
def c18(t):
    """The first issue by priority of each site's stops."""
    low = status_class("status")
    g = t.stops.groupBy("site_id").agg(F.max(F.col("status") == "missing").alias("m"), F.max(low == "review").alias("r"), F.min(low == "verified").alias("v"))
    return g.select("site_id", F.when(F.col("m"), "missing").when(F.col("r"), "review").when(F.col("v"), "ready").otherwise("open").alias("state"))


@query("c19_required_classes", "SELECT site_id, array_to_string(list_filter(['motorway', 'railway', 'station'], lambda c: NOT list_contains(have, c)), ',') AS missing FROM (SELECT osm_id % 25 AS site_id, list(DISTINCT CASE WHEN highway = 'motorway' THEN 'motorway' WHEN railway = 'rail' THEN 'railway' WHEN railway IN ('station', 'halt') THEN 'station' ELSE '-' END) AS have FROM elements GROUP BY 1) AS q")
def c19(t):
    """Classes that a drawing requires less those that it has, with station standing for its modes."""
    kind = F.when(F.col("highway") == "motorway", "motorway").when(F.col("railway") == "rail", "railway").when(F.col("railway").isin("station", "halt"), "station").otherwise("-")
    have = t.elements.groupBy((F.col("osm_id") % 25).alias("site_id")).agg(F.collect_set(kind).alias("have"))
    need = F.array(*[F.lit(c) for c in ("motorway", "railway", "station")])
    return have.select("site_id", F.array_join(F.array_except(need, F.col("have")), ",").alias("missing"))


@query("f18_batch_metadata", "SELECT task_id, array_to_string(list_filter([CASE WHEN record % 3 = 0 THEN 'kind' END, CASE WHEN record % 5 = 0 THEN 'total' END], lambda i: i IS NOT NULL), ',') AS problems FROM tasks")
def f18(t):
    """Columns of a batch's metadata that don't match what was planned."""
    plan = t.tasks.withColumns({"kind2": F.when(F.col("record") % 3 == 0, "other").otherwise(F.col("kind")), "total": F.lit(9), "total2": F.when(F.col("record") % 5 == 0, 8).otherwise(9)})
    return plan.select("task_id", F.array_join(q.array_of((F.col("kind") != F.col("kind2"), "kind"), (F.col("total") != F.col("total2"), "total")), ",").alias("problems"))


@query("n06_fields_to_research", "SELECT key, string_agg(CAST(field AS VARCHAR), ',' ORDER BY field) AS fields FROM rail_fields WHERE value = '' OR status <> 'verified' GROUP BY key")
def n06(t):
    open_ = t.rail_fields.filter((F.col("value") == "") | ~ev.is_verified("status"))
    return open_.groupBy("key").agg(F.array_sort(F.collect_list("field")).alias("f")).select("key", F.array_join(F.transform("f", lambda x: x.cast("string")), ",").alias("fields"))


@query("n05_rail_plan", "SELECT DISTINCT key FROM rail_fields WHERE value = '' OR status <> 'verified'")
def n05(t):
    return t.rail_fields.filter((F.col("value") == "") | ~ev.is_verified("status")).select("key").distinct()


@query("n25_print_gate", """SELECT route_id, CASE WHEN weekday = '' THEN 'scale' WHEN status = 'missing' THEN 'basemap incomplete' WHEN sunday = '' THEN 'not generated' WHEN weekday = 'No service' THEN 'basemap loading' WHEN origin = '' THEN 'no site boundary'
 WHEN url = 'not a url' THEN 'routes under review' WHEN context = 'Herts' AND title = '' THEN 'review not confirmed' WHEN variant = '' THEN 'layers missing' ELSE '' END AS reason,
 weekday = '' OR status = 'missing' OR sunday = '' OR weekday = 'No service' OR url = 'not a url' OR (context = 'Herts' AND title = '') AS blocked FROM routes""")
def n25(t):
    """The first reason, in order, why a drawing isn't ready, and whether it blocks printing (a lack of boundary or layers only warns)."""
    reason, blocked = q.print_gate(
        scale=F.col("weekday") != "", basemap=F.when(F.col("status") == "missing", "failed").when(F.col("sunday") == "", "none").when(F.col("weekday") == "No service", "loading").otherwise("success"),
        site=F.col("origin") != "", routes=F.col("url") != "not a url", confirmed=(F.col("context") != "Herts") | (F.col("title") != ""), layers=F.col("variant") != "",
    )
    return t.routes.select("route_id", reason.alias("reason"), blocked.alias("blocked"))


@query("n24_approval_transitions", "SELECT stop_id, CASE WHEN lower(status) LIKE 'verified%' THEN 'approved' WHEN status = 'needs review' THEN 'retry' WHEN status = 'manual' THEN 'manual-fallback' ELSE 'review' END AS next FROM stops")
def n24(t):
    return t.stops.select("stop_id", F.when(ev.is_verified("status"), "approved").when(F.col("status") == "needs review", "retry").when(F.col("status") == "manual", "manual-fallback").otherwise("review").alias("next"))
