"""Text columns: normalisers, statuses, display forms and extraction. Every function takes and returns columns.

The normalisers differ on purpose; each keeps the rule of the data that it serves.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word boundary that counts A-Z, a-z, 0-9 and _ alone as word characters.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(*alternatives: str) -> str:
    """A pattern for any of the alternatives as whole words."""
    return EDGE + "(?:" + "|".join(alternatives) + ")" + EDGE


def text(c) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def filled(c) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(text(c), F.lit(""))


def normal_ascii(c) -> Column:
    """Lower case; every run of other than a-z and 0-9 is one space; trimmed. Accented letters fall out."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def _decompose(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKD")


def nfkd(c) -> Column:
    """Compatibility decomposition, which has no built-in function."""
    return F.pandas_udf(_decompose, T.StringType())(_c(c))


def normal_folded(c) -> Column:
    """As normal_ascii, after decomposition: accents split off, so a letter with one becomes the letter and a space."""
    return F.trim(F.regexp_replace(nfkd(F.lower(text(c))), "[^a-z0-9]+", " "))


def normal_quality(c) -> Column:
    """Decomposed, dashes folded to a hyphen, with : / . _ - kept."""
    dashes = F.regexp_replace(nfkd(F.lower(text(c))), "[‐-―]", "-")
    return F.trim(F.regexp_replace(dashes, "[^a-z0-9:/._-]+", " "))


def normal_quality_ascii(c) -> Column:
    """normal_quality for text that decomposition leaves alone; no Python."""
    dashes = F.regexp_replace(F.lower(text(c)), "[‐-―]", "-")
    return F.trim(F.regexp_replace(dashes, "[^a-z0-9:/._-]+", " "))


def normal_spaces(c) -> Column:
    """Lower case with white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"\s+", " "))


def station_name(c) -> Column:
    """A station's name without its kind."""
    plain = F.regexp_replace(F.lower(text(c)), "railway station|underground station|overground station|dlr station|station", "")
    return F.trim(F.regexp_replace(F.replace(plain, F.lit("&"), F.lit("and")), "[^a-z0-9]+", " "))


def label(c) -> Column:
    return F.upper(F.regexp_replace(F.trim(text(c)), r"\s+", " "))


def slug(c, default: str = "project") -> Column:
    return F.coalesce(filled(F.replace(normal_ascii(c), F.lit(" "), F.lit("-"))), F.lit(default))


def status_class(c) -> Column:
    """verified, review, missing, or the status itself with hyphens."""
    s = F.replace(normal_quality_ascii(c), F.lit("_"), F.lit("-"))
    return F.when(s.startswith("verified"), "verified").when(s.rlike("review|unresolved|professional"), "review").when(s.rlike("missing|research-required"), "missing").otherwise(F.coalesce(filled(s), F.lit("missing")))


def js_round(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + F.lit(0.5))


def distance_text(m) -> Column:
    m = _c(m)
    km = js_round(m / 100.0) / 10
    return F.when(m.isNull() | F.isnan(m), "—").when(m < 1000, F.concat(js_round(m).cast("string"), F.lit(" m"))).otherwise(F.concat(F.format_string("%.1f", km), F.lit(" km")))


def duration_text(seconds) -> Column:
    s = _c(seconds)
    return F.when(s.isNull() | F.isnan(s), "—").otherwise(F.concat(F.greatest(F.lit(1), js_round(s / 60.0)).cast("string"), F.lit(" min")))


def address(number, street, city, postcode) -> Column:
    line = filled(F.concat_ws(" ", filled(number), filled(street)))
    return F.concat_ws(", ", line, filled(city), filled(postcode))


def escape_html(c) -> Column:
    out = text(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def csv_quoted(c) -> Column:
    return F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_if_needed(c) -> Column:
    return F.when(text(c).rlike('[",\\n]'), csv_quoted(c)).otherwise(text(c))


def json_string(c) -> Column:
    """The text as a JSON string."""
    return F.to_json(F.array(text(c))).substr(F.lit(2), F.length(F.to_json(F.array(text(c)))) - 2)


def fnv32(c) -> Column:
    """FNV-1a over code points, in base 36 digits."""
    chars = F.filter(F.split(_c(c), ""), lambda x: x != "")
    value = F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.conv(value.cast("string"), 10, 36))


def palette_index(c, colours: int = 4) -> Column:
    """A stable colour number: the polynomial of base 31 over code points, modulo 2**32, then modulo colours."""
    chars = F.filter(F.split(text(c), ""), lambda x: x != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda h, x: (h * 31 + F.ascii(x)).bitwiseAND(F.lit(4294967295))) % colours


def road_reference(ref, letter: str) -> Column:
    """The first A or M road number in a delimited reference, upper case; empty if none."""
    return F.upper(F.regexp_extract(text(ref), rf"(?i)(?:^|[;,\s])({letter}\d{{1,4}}[A-Z]?)(?=$|[;,\s])", 1))


def cycle_network(c) -> Column:
    """The highest network named: icn, ncn, rcn, lcn."""
    parts = F.split(F.lower(text(c)), r"[;,\s]+")
    out = F.lit("")
    for name in ("lcn", "rcn", "ncn", "icn"):
        out = F.when(F.array_contains(parts, name), name).otherwise(out)
    return out


def route_tokens(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(text(c)), F.lit("[A-Z]*[0-9]+[A-Z]*"), F.lit(0)))


#: Words that say nothing about where a route ends. Fixed values.
STOP_WORDS = ("town", "centre", "center", "route", "service", "station")


def endpoint_words(c) -> Column:
    """Distinct words of an end point that identify it."""
    return F.array_distinct(F.filter(F.split(normal_ascii(c), " "), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def period_line(name: str, c) -> Column:
    """A service period for print; blank counts as no service here (service_display doesn't)."""
    value = text(c)
    shown = F.regexp_replace(value, r"^(?i)approx(?:imately)?\.?\s*", "")
    return F.concat(F.lit(f"{name}: "), F.when((value == "") | value.rlike("(?i)no service"), "No service").when(value.rlike("(?i)research required"), "Research required").otherwise(F.concat(F.lit("Approx. "), shown)))


def frequency_words(n) -> Column:
    """Buses an hour in words; empty for none. The sentences are fixed values."""
    n = _c(n)
    usual = " during the typical daytime period."
    return (
        F.when(n.isNull() | (n <= 0), "")
        .when(n == 1, "Hourly daytime service.")
        .when(n == 2, "Approximately 2 buses per hour.")
        .when(n == 3, "Approximately every 20 minutes" + usual)
        .when(n == 4, "Approximately every 15 minutes" + usual)
        .otherwise(F.concat(F.lit("Approximately "), n.cast("string"), F.lit(" buses per hour" + usual)))
    )


def sentences(parts: Column) -> Column:
    """Distinct non-empty sentences with one full stop each."""
    return F.array_join(F.array_distinct(F.transform(F.filter(parts, lambda x: x.isNotNull() & (x != "")), lambda x: F.when(F.trim(x).endswith("."), F.trim(x)).otherwise(F.concat(F.trim(x), F.lit("."))))), " ")


NO_SERVICE = "(?i)" + words(r"no\s+(?:sunday\s+)?service")


def service_display(value, evidenced: Column) -> Column:
    """A value by its evidence: a blank is never taken for no service, and no service is shown only where it is evidenced."""
    shown = text(value)
    return (
        F.when(shown == "", "Not established")
        .when(shown.rlike("(?i)research required"), "Requires review")
        .when(shown.rlike(NO_SERVICE) & ~evidenced, "Requires review")
        .otherwise(shown)
    )


def step_free_mark(c) -> Column:
    low = F.lower(F.trim(text(c)))
    absent = low.rlike("^(no|none|not available|false)|not step[- ]?free|no step[- ]?free")
    return F.when((low == "") | absent, "✗").otherwise("✓")


def directional_frequency(rows: Column) -> Column:
    """Rows of (tph, destination, qualifier) as one line."""
    return F.array_join(
        F.transform(rows, lambda r: F.concat(F.coalesce(r["tph"], F.lit("—")), F.lit(" tph "), r["destination"], F.when(text(r["qualifier"]) != "", F.concat(F.lit(" ("), r["qualifier"], F.lit(")"))).otherwise(""))), "; "
    )
