"""Rules of research quality: fields, records, roll-ups and import states. Issues are arrays of sentences; their wording is fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence as e
from ..functions.text import status_class, text

PLACEHOLDER = "unsupported placeholder wording"
NO_AUDIT = "controlled unresolved outcome lacks an exhaustive research audit"
UNRESOLVED = "unresolved information must not be verified"
NO_URL = "verified value requires a direct record-specific source URL"
NO_TITLE = "verified value requires a source title"
NO_PUBLISHER = "verified value requires a source publisher"
NO_DATE = "verified value requires a valid retrieval date"


def array_of(*pairs: tuple[Column, str]) -> Column:
    """The sentences whose condition holds, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(s)) for c, s in pairs]), lambda x: x.isNotNull())


def field_result(value="value", status="status", url="source", title="source_title", publisher="publisher", date="retrieval_date", audited: Column | None = None, legacy: bool = False) -> Column:
    """struct(state, issues) of a field: accepted, review or rejected. legacy accepts any source and asks for no title or publisher."""
    kind = status_class(status)
    outcome = e.normal_quality_ascii(value).isin(*e.OUTCOMES)
    audited = F.lit(False) if audited is None else audited
    proven = (kind == "verified") & ~outcome
    direct = (F.trim(text(url)) != "") if legacy else e.is_specific_url(url) & ~e.is_generic_url(url)
    issues = array_of(
        (e.is_placeholder(value), PLACEHOLDER),
        (outcome & ~audited, NO_AUDIT),
        (outcome & (kind == "verified"), UNRESOLVED),
        (proven & ~direct, NO_URL),
        (proven & F.lit(not legacy) & (F.trim(text(title)) == ""), NO_TITLE),
        (proven & F.lit(not legacy) & (F.trim(text(publisher)) == ""), NO_PUBLISHER),
        (proven & ~text(date).rlike(e.WHOLE_DATE), NO_DATE),
    )
    rejected = e.is_placeholder(value) | (outcome & ~audited) | proven & (F.size(issues) > 0)
    state = F.when(rejected, "rejected").when(outcome, "review").when((kind != "verified") & (F.size(issues) == 0), "review").otherwise("accepted")
    return F.struct(state.alias("state"), issues.alias("issues"))


#: Quality classes of a record. Fixed values.
POOR, REVIEW, LEGACY, PARTIAL, COMPLETE = "Poor legacy record", "Complete but requires review", "Verified legacy record — enrichment recommended", "Partially complete", "Complete and verified"


def analyse_records(fields: DataFrame, key: str = "key", keys: int | None = None) -> DataFrame:
    """From long fields (key, value, state, issues): per record its issues, blanks, quality and whether it can be published. More than a third of blank fields (rounded up) is too many."""
    blank = text("value") == ""
    out = fields.groupBy(key).agg(
        F.count("*").alias("n"), F.sum(blank.cast("int")).alias("blanks"), F.sum(F.when(blank, 0).otherwise(F.size("issues"))).alias("n_issues"), F.max((~blank & (F.col("state") == "review"))).alias("review"), F.max((~blank & (F.col("state") == "accepted"))).alias("verified")
    )
    many = F.col("blanks") > F.ceil((F.lit(keys) if keys else F.col("n")) / 3)
    legacy = F.col("verified") & (F.col("n_issues") == 0) & ~F.col("review") & many
    quality = F.when(F.col("n_issues") > 0, POOR).when(F.col("review"), REVIEW).when(legacy, LEGACY).when(many, PARTIAL).otherwise(COMPLETE)
    return out.select(key, F.col("blanks").cast("long").alias("blanks"), F.col("n_issues").cast("long").alias("n_issues"), quality.alias("quality"), ((quality == COMPLETE) & (F.col("n_issues") == 0)).alias("publishable"))


def roll_up(records: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c)
    return records.agg(n(F.col("publishable")).alias("accepted"), n(F.col("quality") == REVIEW).alias("for_review"), n(F.col("quality") == POOR).alias("poor"), n(F.col("n_issues") > 0).alias("rejected"), F.sum("n_issues").alias("to_correct"))


#: Required fields of a route record, by the derived columns that hold them.
ROUTE_REQUIRED = ("route_number", "operator", "origin", "destination", "context", "weekday", "sunday", "pattern")


def missing_route_fields(required=ROUTE_REQUIRED) -> Column:
    """Names of required columns without a useful value, then what evidence and status lack."""
    cited = e.cited_source("url", "title", "publisher", "retrieval_date")
    return array_of(*[(~e.useful(c), c) for c in required], (~cited, "direct route-specific evidence"), (~e.is_verified("status"), "eligible verification status"))


#: Required fields of a stop's link to a route, by the columns that hold them. A code may be a fallback identity.
LINK_REQUIRED = ("naptan", "route_number", "operator", "origin", "destination", "context", "direction", "stop_destination", "weekday", "saturday", "sunday", "weekday_tph", "saturday_tph", "sunday_tph", "pattern", "journey")


def missing_link_fields(fresh: Column, required=LINK_REQUIRED, key: str = "route_key") -> Column:
    """Names of a link's required columns without a useful value, then what key, evidence, status and freshness lack."""
    cited = e.cited_source("url", "title", "publisher", "retrieval_date")
    return array_of(*[(~e.useful(c), c) for c in required], (text(key) == "", key), (~cited, "direct stop-specific evidence"), (~e.is_verified("status"), "eligible verification status"), (~fresh, "retrieval_date"))


def missing_stop_fields(fresh: Column, served: Column, identity: str = "naptan") -> Column:
    """What a stop's record lacks, each named once: name, locality, direction, coordinates (both finite), routes served, a source, a date, a status; then identity, a verified status, direct evidence and freshness. A paired group may be absent."""
    finite = lambda c: F.coalesce(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.lit(False))
    cited = e.cited_source("url", "title", "publisher", "retrieval_date")
    lacking = array_of(
        *[(~e.useful(c), c) for c in ("stop_name", "locality", "direction")], (~(finite("lat") & finite("lon")), "coordinates"), (F.coalesce(served, F.lit(0)) == 0, "routes_served"), (text("url") == "", "sources"), (~e.useful("retrieval_date"), "retrieval_date"), (~e.useful("status"), "status"),
        (text(identity) == "", "stop identity"), (~e.is_verified("status"), "status"), (~cited, "direct stop-specific evidence"), (~fresh, "retrieval_date"),
    )
    return F.array_distinct(lacking)


def import_state_route() -> Column:
    """struct(state, reason) of a route record on import: quarantined, review or accepted."""
    identity = array_of(*[(text(c) == "", c) for c in ("route_number", "operator", "origin", "destination")])
    enrich = array_of(*[(text(c) == "", c) for c in ("weekday", "sunday", "pattern")])
    of = lambda state, reason: F.struct(F.lit(state).alias("state"), reason.alias("reason"))
    return (
        F.when(F.size(identity) > 0, of("quarantined", F.concat(F.lit("Incomplete composite route identity: "), F.array_join(identity, ", "))))
        .when(status_class("status") != "verified", of("review", F.lit("Verification status requires professional review")))
        .when(e.is_generic_url("url", invalid=True), of("review", F.lit("Only a generic services or routes page is cited")))
        .when(F.size(enrich) > 0, of("review", F.concat(F.lit("Verified legacy route — enrichment recommended: "), F.array_join(enrich, ", "))))
        .otherwise(of("accepted", F.lit("Complete composite identity and record-specific evidence")))
    )


def status_summary(fields: DataFrame, key: str = "key") -> DataFrame:
    """A record's status from its fields': needs_review if any is in review or missing, verified if all are, else mixed."""
    kind = status_class("status")
    out = fields.groupBy(key).agg(F.max(kind.isin("review", "missing")).alias("open"), F.min(kind == "verified").alias("all"))
    return out.select(key, F.when(F.col("open"), "needs_review").when(F.col("all"), "verified").otherwise("mixed").alias("summary"))


def assessment_state(selected: Column, stops_found: Column, researched: Column, whole: Column, complete: Column, published: Column, ready: Column) -> Column:
    """The state of an assessment: the first condition that fails, in order, then how far it is published. Wording is fixed."""
    return (
        F.when(~selected, "Research not started").when(~stops_found, "Stop discovery required").when(~researched, "Route/service research required").when(~whole, "Research incomplete").when(~complete, "Import requires review")
        .when(published, "Published and confirmed").when(ready, "Ready for Shared Library publication").otherwise("Research complete and ready for output")
    )


def print_gate(scale: Column, basemap: Column, site: Column, routes: Column, confirmed: Column, layers: Column) -> tuple[Column, Column]:
    """(reason, blocked) of a drawing: its first open point in order, '' if none. basemap is failed, none, loading or success; all but success block."""
    reason = (
        F.when(~scale, "scale").when(basemap == "failed", "basemap incomplete").when(basemap == "none", "not generated").when(basemap == "loading", "basemap loading").when(~site, "no site boundary")
        .when(~routes, "routes under review").when(~confirmed, "review not confirmed").when(~layers, "layers missing").otherwise("")
    )
    return reason, ~scale | (basemap != "success") | ~routes | ~confirmed
