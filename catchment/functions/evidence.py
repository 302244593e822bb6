"""Evidence columns: URLs, dates, placeholder wording, sources and freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, normal_quality_ascii, text, words

#: Wording that stands in for research, matched against normal_quality text. Fixed values.
PLACEHOLDERS = (
    words(r"(?:see|check|visit|refer\s+to)\s+(?:the\s+)?(?:relevant\s+)?(?:official\s+)?(?:operator\s+)?website"),
    words(r"(?:refer\s+to|check|see)\s+(?:the\s+)?(?:operator\s+)?timetable"),
    words(r"(?:consult|contact|confirm\s+with|check)\s+(?:the\s+)?operator"),
    words(r"(?:see|check)\s+(?:the\s+)?(?:national\s+rail|tfl)"),
    words(r"(?:not\s+researched|research\s+required|information\s+required)"),
    words(r"(?:details?|information)\s+(?:is\s+|are\s+)?(?:unavailable|not\s+found|unknown)"),
    words(r"(?:details?|information)\s+(?:is\s+|are\s+)?not\s+available\s+online"),
    words(r"(?:not\s+found|unknown|to\s+be\s+confirmed|requires?\s+confirmation|unable\s+to\s+(?:determine|confirm))"),
    words(r"facilit(?:y|ies)\s+require(?:s|d)?\s+confirmation"),
    words(r"no\s+(?:published\s+)?(?:information|details?|[a-z -]+quantity)\s+(?:was\s+|were\s+|has\s+been\s+)?identified"),
    words(r"no\s+(?:published\s+)?information\s+(?:was\s+)?found"),
)
#: Wording that bars a record from import, matched against raw text in either case. Fixed value.
NOT_IMPORTABLE = "(?i)" + "|".join(
    (
        words(r"(?:see|check|refer to)\s+(?:the\s+)?(?:station |operator )?website"),
        words(r"check\s+(?:national rail|tfl|operator)"),
        words("refer to timetable"),
        words(r"(?:details|information)\s+(?:available\s+)?online"),
        words("verify manually"),
        words("not researched"),
    )
)
#: Outcomes that may stand for a value after an exhaustive search. Fixed values.
OUTCOMES = ("not_applicable", "not_publicly_available_after_exhaustive_search", "source_conflict", "requires_professional_review")
WHOLE_DATE, DATE_PREFIX = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}"


def is_placeholder(c) -> Column:
    """One pattern of alternatives, so that the text is normalised and read once."""
    return normal_quality_ascii(c).rlike("|".join(f"(?:{p})" for p in PLACEHOLDERS))


def is_lazy(c) -> Column:
    return text(c).rlike(NOT_IMPORTABLE)


#: Scheme, host, path of an absolute URL with an authority.
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#\s]*)(?:[?#]\S*)?$"


def is_url(c) -> Column:
    return F.trim(text(c)).rlike(_URL)


def url_path(c) -> Column:
    """The path without slashes at its end, lower case; empty for what isn't a URL."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.trim(text(c)), _URL, 3), "/+$", ""))


def is_http_url(c) -> Column:
    return is_url(c) & F.trim(text(c)).rlike("(?i)^https?:")


def is_specific_url(c) -> Column:
    """An http URL with a path."""
    return is_http_url(c) & url_path(c).rlike("[^/]")


def is_generic_url(c, invalid: bool = False) -> Column:
    """An index or search page; invalid says what is returned for what isn't a URL (records: False, workflow: True)."""
    path = url_path(c)
    generic = path.rlike("^/(?:services?|routes?|timetables?|stations?|bus|rail)?$") | path.rlike("/search(?:/|$)")
    return F.when(is_url(c), generic).otherwise(F.lit(invalid))


def direct_source(url, title, publisher, date) -> Column:
    """A page of its own with title, publisher and whole date."""
    return is_specific_url(url) & ~is_generic_url(url) & (F.trim(text(title)) != "") & (F.trim(text(publisher)) != "") & text(date).rlike(WHOLE_DATE)


def cited_source(url, title, publisher, date) -> Column:
    """The workflow's weaker test: not a generic page (what isn't a URL is one), with title, publisher and a date at the start."""
    return (text(url) != "") & ~is_generic_url(url, invalid=True) & (text(title) != "") & (text(publisher) != "") & text(date).rlike(DATE_PREFIX)


def source_score(url, title, publisher, date) -> Column:
    """Ten each for a URL, a path, a deeper path; five each for title, publisher and date."""
    depth = F.size(F.filter(F.split(url_path(url), "/"), lambda x: x != ""))
    points = [(is_url(url), 10), (is_url(url) & (depth >= 1), 10), (is_url(url) & (depth >= 2), 10), (text(title) != "", 5), (text(publisher) != "", 5), (text(date).rlike(DATE_PREFIX), 5)]
    return reduce(lambda a, b: a + b, [F.when(c, n).otherwise(0) for c, n in points])


#: Paths of pages that are about one service. Fixed value.
SERVICE_PAGE = "(?i)/(?:services?|routes?|timetables?)/[^/?#]+"


def family_score(urls: Column) -> Column:
    """Sum over sources: eight for a services, routes or timetables page of its own, two for any other URL. Null or empty ones count nothing."""
    one = lambda u: F.when(F.trim(text(u)) == "", 0).when(text(u).rlike(SERVICE_PAGE), 8).otherwise(2)
    return F.aggregate(F.coalesce(urls, F.array().cast("array<string>")), F.lit(0), lambda total, u: total + one(u))


def is_verified(status) -> Column:
    return normal_quality_ascii(status).startswith("verified")


def useful(c) -> Column:
    return (F.trim(text(c)) != "") & ~text(c).rlike("(?i)research required")


def day(c) -> Column:
    """A date column, null for what isn't a date."""
    return F.try_to_timestamp(F.regexp_extract(text(c), DATE_PREFIX, 0), F.lit("yyyy-MM-dd")).cast("date")


def is_fresh(latest: Column, as_of: str, days: int = 400) -> Column:
    return F.coalesce(F.datediff(F.lit(as_of).cast("date"), latest) <= days, F.lit(False))


def is_stale(value, date, as_of: str, days: int = 365) -> Column:
    """A value without a date, or with one more than days ago."""
    d = day(date)
    return (text(value) != "") & F.coalesce(F.datediff(F.lit(as_of).cast("date"), d) > days, F.lit(True))


def adequate_audit(sources: Column, terms: Column, sections: Column, reason) -> Column:
    """At least two complete sources (url, title, publisher, retrievalDate), and no incomplete one; terms, sections and a reason of 20 characters."""
    whole = F.forall(sources, lambda s: is_specific_url(s["url"]) & (F.trim(text(s["title"])) != "") & (F.trim(text(s["publisher"])) != "") & text(s["retrievalDate"]).rlike(WHOLE_DATE))
    return F.coalesce((F.size(sources) >= 2) & whole & (F.size(terms) > 0) & (F.size(sections) > 0) & (F.length(F.trim(text(reason))) >= 20), F.lit(False))
