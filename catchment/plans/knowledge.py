"""Queries of merging and of the shared master tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..operators import merge, select
from ..registry import query

_OK = "key <> '' AND NOT key LIKE '%:'"
_OUTER = f"(SELECT coalesce(o.key, n.key) AS key, o.key AS ok, n.key AS nk, o.status AS os, n.status AS ns, o.name AS oname, n.name AS nname, o.date AS od, n.date AS nd, o.value AS ov, n.value AS nv, o.seq AS oseq, n.seq AS nseq FROM master AS o FULL JOIN (SELECT * FROM proposed WHERE {_OK}) AS n ON o.key = n.key)"
_HELD = "(ok IS NOT NULL AND os LIKE 'verified%' AND (coalesce(ns, '') NOT LIKE 'verified%' OR od > nd))"
_ACTION = f"CASE WHEN nk IS NULL THEN 'kept' WHEN {_HELD} THEN 'preserved' WHEN ok IS NULL THEN 'addition' ELSE 'update' END"
_TAKE = lambda c: f"CASE WHEN action IN ('addition', 'update') THEN coalesce(n{c}, o{c}) ELSE o{c} END"
_MERGED = f"SELECT key, {_TAKE('s')} AS status, {_TAKE('name')} AS name, {_TAKE('v')} AS value, action FROM (SELECT *, {_ACTION} AS action FROM {_OUTER} AS q) AS r UNION ALL SELECT key, status, name, value, 'rejected' FROM proposed WHERE NOT ({_OK})"


@query("m01_master_merge", _MERGED)
def m01(t):
    return merge.merge_master(t.master, t.proposed).select("key", "status", "name", "value", "action")


@query("a04_merge_preview", f"SELECT count(*) FILTER (action = 'addition') AS additions, count(*) FILTER (action = 'update') AS updates, count(*) FILTER (action = 'preserved') AS preserved, count(*) FILTER (action = 'preserved') AS conflicts, count(*) FILTER (action = 'rejected') AS rejected FROM ({_MERGED}) AS m")
def a04(t):
    return merge.preview(merge.merge_master(t.master, t.proposed))


@query("m01_lenient_keys", "SELECT count(*) AS rejected FROM proposed WHERE key = ''")
def m01_lenient(t):
    """Without the strict rule only empty keys are rejected."""
    return merge.merge_master(t.master, t.proposed.filter("key <> 'crs:'"), strict=False).agg(F.count_if(F.col("action") == "rejected").alias("rejected"))


_HELD2 = "(ok IS NOT NULL AND ((os LIKE 'verified%' AND ns NOT LIKE 'verified%') OR od > nd OR (os IS NOT DISTINCT FROM ns AND oname IS NOT DISTINCT FROM nname AND od IS NOT DISTINCT FROM nd AND ov IS NOT DISTINCT FROM nv AND oseq IS NOT DISTINCT FROM nseq)))"


@query("m02_local_merge", f"SELECT key, {_TAKE('s')} AS status, {_TAKE('v')} AS value, action FROM (SELECT *, CASE WHEN nk IS NULL THEN 'kept' WHEN {_HELD2} THEN 'preserved' WHEN ok IS NULL THEN 'addition' ELSE 'update' END AS action FROM {_OUTER} AS q) AS r")
def m02(t):
    return merge.merge_local(t.master, t.proposed.filter(_OK)).select("key", "status", "value", "action")


@query("m03_newest_merge", f"SELECT key, CASE WHEN action IN ('addition', 'update') THEN ns ELSE os END AS status, CASE WHEN action IN ('addition', 'update') THEN nname ELSE oname END AS name, action FROM (SELECT *, CASE WHEN nk IS NULL THEN 'kept' WHEN ok IS NOT NULL AND od > nd THEN 'preserved' WHEN ok IS NULL THEN 'addition' ELSE 'update' END AS action FROM {_OUTER} AS q) AS r")
def m03(t):
    return merge.merge_newest(t.master, t.proposed.filter(_OK)).select("key", "status", "name", "action")


_OLD = "(SELECT * FROM rail_fields WHERE record_id % 3 <> 2)"
_NEW = "(SELECT key, field, CASE WHEN field % 4 = 0 THEN '' ELSE 'New ' || value END AS value, CASE WHEN field % 3 = 0 THEN 'needs_review' ELSE 'verified' END AS status, '2026-05-15' AS date FROM rail_fields WHERE record_id % 3 <> 1)"


@query("m04_field_merge", f"""SELECT key, field, CASE WHEN outcome = 'updated' OR ok IS NULL THEN nvalue ELSE value END AS value, CASE WHEN outcome = 'updated' OR ok IS NULL THEN nstatus ELSE status END AS status, outcome,
 CASE WHEN outcome <> 'conflict' THEN '' WHEN nstatus = 'verified' THEN 'older verified import preserved existing newer value' ELSE 'unverified import did not replace verified value' END AS flag FROM (
 SELECT *, CASE WHEN nk IS NULL THEN 'kept' WHEN nvalue = '' THEN 'preserved' WHEN status = 'verified' AND (nstatus <> 'verified' OR retrieval_date > ndate) THEN 'conflict' ELSE 'updated' END AS outcome
 FROM (SELECT coalesce(o.key, n.key) AS key, coalesce(o.field, n.field) AS field, o.key AS ok, n.key AS nk, o.value, o.status, o.retrieval_date, n.value AS nvalue, n.status AS nstatus, n.date AS ndate FROM {_OLD} AS o FULL JOIN {_NEW} AS n ON o.key = n.key AND o.field = n.field) AS a) AS b""")
def m04(t):
    f = t.rail_fields
    old = f.filter("record_id % 3 <> 2").select("key", "field", "value", "status", F.col("retrieval_date").alias("date"))
    new = f.filter("record_id % 3 <> 1").selectExpr("key", "field", "case when field % 4 = 0 then '' else concat('New ', value) end as value", "case when field % 3 = 0 then 'needs_review' else 'verified' end as status", "'2026-05-15' as date")
    return merge.merge_fields(old, new).select("key", "field", "value", "status", "outcome", "flag")


@query("a05_import_counters", f"SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN nk IS NULL THEN 'kept' WHEN nvalue = '' THEN 'preserved' WHEN status = 'verified' AND (nstatus <> 'verified' OR retrieval_date > ndate) THEN 'conflict' ELSE 'updated' END AS outcome FROM (SELECT o.status, o.retrieval_date, n.key AS nk, n.value AS nvalue, n.status AS nstatus, n.date AS ndate FROM {_OLD} AS o FULL JOIN {_NEW} AS n ON o.key = n.key AND o.field = n.field) AS a) AS b GROUP BY outcome")
def a05(t):
    return m04(t).groupBy("outcome").agg(F.count("*").alias("n"))


@query("m05_upsert", f"SELECT key, count(*) AS steps, arg_max(name, seq) AS name FROM (SELECT key, seq, coalesce(name, '') AS name FROM master UNION ALL SELECT key, seq, coalesce(name, '') FROM proposed WHERE {_OK}) AS u GROUP BY key")
def m05(t):
    """Several rows of a key are folded in their order before one merge: the last statement of each column stands."""
    rows = select.layered(t.master, t.proposed.filter(_OK))
    return rows.groupBy("key").agg(F.count("*").alias("steps"), F.max_by(F.coalesce("name", F.lit("")), "seq").alias("name"))


@query("u01_effective_library", "SELECT key, CASE WHEN n.key IS NULL THEN 0 ELSE 1 END AS layer FROM (SELECT key FROM master UNION SELECT key FROM proposed WHERE key <> '' AND NOT key LIKE '%:') AS a LEFT JOIN (SELECT DISTINCT key FROM proposed) AS n USING (key)")
def u01(t):
    """Shared rows, then local ones; the later layer wins."""
    rows = select.layered(t.master, t.proposed.filter(_OK))
    return select.ranked(rows, "key", F.col("layer").desc()).select("key", "layer")


@query("u06_merge_missing", f"SELECT key, seq FROM master UNION ALL SELECT key, seq FROM proposed WHERE {_OK} AND key NOT IN (SELECT key FROM master)")
def u06(t):
    return select.merged_missing(t.master, t.proposed.filter(_OK), ["key"]).select("key", "seq")


@query("x10_delete_unchanged", "SELECT key FROM master WHERE NOT (seq % 6 = 0)")
def x10(t):
    """Rows are asked to go as they were loaded; every other one has changed since and stays."""
    m = t.master
    wanted = m.filter("seq % 3 = 0").withColumn("value", F.when(F.col("seq") % 6 == 0, F.col("value")).otherwise(F.col("value") + 1))
    return merge.delete_unchanged(m, wanted).select("key")


@query("j16_proposal_overlay", f"SELECT m.key, coalesce(p.name, m.name) AS name, p.key IS NOT NULL AS proposed FROM master AS m LEFT JOIN (SELECT * FROM proposed WHERE {_OK}) AS p USING (key)")
def j16(t):
    p = t.proposed.filter(_OK).select("key", F.col("name").alias("p_name"), F.lit(True).alias("there"))
    return t.master.join(p, "key", "left").select("key", F.coalesce("p_name", "name").alias("name"), F.coalesce("there", F.lit(False)).alias("proposed"))


@query("p32_audit_columns", f"SELECT key, 'editor' AS editor_name, '2026-08-01' AS updated_at, 'build' AS originating_build FROM proposed WHERE {_OK}")
def p32(t):
    return merge.with_audit(t.proposed.filter(_OK), "editor", "2026-08-01", "build").select("key", "editor_name", "updated_at", "originating_build")


@query("w17_revisions", "SELECT key, seq, coalesce(lag(seq) OVER (PARTITION BY key ORDER BY seq), -1) AS previous FROM (SELECT key, seq FROM master UNION ALL SELECT key, seq FROM proposed) AS u")
def w17(t):
    from pyspark.sql import Window as W

    rows = t.master.select("key", "seq").union(t.proposed.select("key", "seq"))
    return rows.select("key", "seq", F.coalesce(F.lag("seq").over(W.partitionBy("key").orderBy("seq")), F.lit(-1)).alias("previous"))


@query("a08_library_summary", "SELECT count(DISTINCT key) AS records, max(retrieval_date) AS last_review, count(DISTINCT CASE WHEN value <> '' AND retrieval_date = '' THEN key END) AS undated FROM rail_fields")
def a08(t):
    undated = F.when((F.col("value") != "") & (F.col("retrieval_date") == ""), F.col("key"))
    return t.rail_fields.agg(F.countDistinct("key").alias("records"), F.max("retrieval_date").alias("last_review"), F.countDistinct(undated).alias("undated"))


@query("a09_distinct_counts", "SELECT count(DISTINCT naptan) AS stops, count(DISTINCT stop_name) AS names FROM stops WHERE naptan <> ''")
def a09(t):
    return t.stops.filter("naptan <> ''").agg(F.countDistinct("naptan").alias("stops"), F.countDistinct("stop_name").alias("names"))


@query("a17_newest_date", "SELECT key, max(retrieval_date) AS newest FROM rail_fields WHERE regexp_matches(retrieval_date, '^\\d{4}-\\d{2}-\\d{2}') GROUP BY key")
def a17(t):
    return t.rail_fields.filter(F.col("retrieval_date").rlike(ev.DATE_PREFIX)).groupBy("key").agg(F.max("retrieval_date").alias("newest"))


@query("n01_evidence_register", "SELECT key, field, source FROM rail_fields WHERE source <> '' UNION ALL SELECT DISTINCT key, 0, 'map' FROM rail_fields")
def n01(t):
    f = t.rail_fields
    return f.filter("source <> ''").select("key", "field", "source").union(f.select("key", F.lit(0).alias("field"), F.lit("map").alias("source")).distinct())


@query("n14_record_date", "SELECT key, coalesce(max(nullif(retrieval_date, '')), '2026-01-01') AS date FROM rail_fields GROUP BY key")
def n14(t):
    return t.rail_fields.groupBy("key").agg(F.coalesce(F.max(F.nullif(F.col("retrieval_date"), F.lit(""))), F.lit("2026-01-01")).alias("date"))


@query("p28_record_defaults", "SELECT d.key, d.field, coalesce(f.value, '') AS value, coalesce(f.status, 'missing') AS status FROM (SELECT DISTINCT r.key, x.field FROM rail_fields AS r CROSS JOIN (SELECT DISTINCT field FROM rail_fields) AS x) AS d LEFT JOIN (SELECT * FROM rail_fields WHERE (record_id + field) % 3 <> 0) AS f ON f.key = d.key AND f.field = d.field")
def p28(t):
    """Every record has every field; those that it lacks are empty and missing."""
    f = t.rail_fields
    have = f.filter("(record_id + field) % 3 <> 0").select("key", F.struct("field", "value", "status").alias("e")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("e.field"), F.struct("e.value", "e.status")))).alias("m"))
    every = f.select("key").distinct().join(have, "key", "left").withColumn("field", F.explode(F.sequence(F.lit(1), F.lit(15))))
    got = F.try_element_at("m", F.col("field"))
    return every.select("key", "field", F.coalesce(got["value"], F.lit("")).alias("value"), F.coalesce(got["status"], F.lit("missing")).alias("status"))


@query("n16_cleared_fields", "SELECT key, field, CASE WHEN field <= 3 THEN value ELSE 'Research required' END AS value, CASE WHEN field <= 3 THEN status ELSE 'needs_review' END AS status FROM rail_fields")
def n16(t):
    """Researched fields are cleared for new research; identity fields are not."""
    own = F.col("field") <= 3
    return t.rail_fields.select("key", "field", F.when(own, F.col("value")).otherwise("Research required").alias("value"), F.when(own, F.col("status")).otherwise("needs_review").alias("status"))


@query("p30_sanitised_columns", "SELECT stop_id, CAST(2 AS INTEGER) AS removed FROM stops")
def p30(t):
    """Columns of a project don't enter the shared table: their names begin with fixed words."""
    s = t.stops.withColumns({"walkingMetres": F.lit(1), "siteDistance": F.lit(2)})
    pattern = r"(?i)^(?:walking|cycling|existingsavedrecord|currentsite|site(?:distance|duration|routing|record)|assessment(?:source|routing)|savedrecord)"
    import re

    gone = [c for c in s.columns if re.match(pattern, c)]
    return s.drop(*gone).select("stop_id", F.lit(len(gone)).alias("removed"))


@query("m20_overlay_store", "SELECT polygon_id, CASE WHEN polygon_id % 5 = 0 THEN 'unknown class' WHEN polygon_id % 5 = 1 THEN 'geometry not allowed' ELSE '' END AS warning FROM squares")
def m20(t):
    """Overlays are checked against the classes that are allowed and their geometries; bad ones are set aside with a warning."""
    allowed = t.spark.createDataFrame([("community", "Polygon"), ("route-to-site", "LineString")], "class string, geometry string")
    rows = t.squares.selectExpr("polygon_id", "case polygon_id % 5 when 0 then 'nothing' when 1 then 'route-to-site' else 'community' end as class", "'Polygon' as is_geometry")
    out = rows.join(F.broadcast(allowed), "class", "left")  # two rows
    return out.select("polygon_id", F.when(F.col("geometry").isNull(), "unknown class").when(F.col("geometry") != F.col("is_geometry"), "geometry not allowed").otherwise("").alias("warning"))


@query("m21_lifecycle", "SELECT stop_id, CASE WHEN status LIKE 'verified%' OR status LIKE 'Verified%' THEN 'verified' ELSE 'needs_review' END AS lifecycle, CAST(CASE WHEN status LIKE 'verified%' OR status LIKE 'Verified%' THEN 2 ELSE 1 END AS INTEGER) AS steps FROM stops")
def m21(t):
    """A verified record's history gets the reviewer's entry."""
    event = lambda s, by: F.struct(F.lit(s).alias("state"), F.lit(by).alias("by"))
    s = t.stops.withColumn("history", F.array(event("needs_review", "import")))
    ok = ev.is_verified("status")
    return s.select("stop_id", F.when(ok, "verified").otherwise("needs_review").alias("lifecycle"), F.size(F.when(ok, F.array_append("history", event("verified", "reviewer"))).otherwise(F.col("history"))).alias("steps"))
