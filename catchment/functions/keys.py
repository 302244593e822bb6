"""Identity keys of facilities, stops, stations, routes and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t
from .text import _c, filled, normal_ascii, text


def facility(category, osm_type, osm_id) -> Column:
    return F.concat_ws(":", _c(category), _c(osm_type), _c(osm_id).cast("string"))


def element(osm_type, osm_id) -> Column:
    return F.concat_ws("/", _c(osm_type), _c(osm_id).cast("string"))


#: Tags that hold a stop's national code, by precedence. Fixed values.
NAPTAN_TAGS = ("naptan:AtcoCode", "ref:GB:NaPTAN:AtcoCode", "naptan:Code", "ref:GB:NaPTAN")
DIRECTION_TAGS = ("naptan:Indicator", "ref:GB:NaPTAN:Indicator", "direction", "bearing")


def tag(tags, name: str) -> Column:
    """A tag's text, or null where it is missing or empty."""
    return F.nullif(F.try_element_at(_c(tags), F.lit(name)), F.lit(""))


def stop(tags, osm_type, osm_id) -> Column:
    code = F.coalesce(*[tag(tags, n) for n in NAPTAN_TAGS])
    return F.coalesce(F.concat(F.lit("naptan:"), code), F.concat(F.lit("osm:"), element(osm_type, osm_id)))


def stop_direction(tags) -> Column:
    return F.coalesce(*[tag(tags, n) for n in DIRECTION_TAGS], F.lit("Direction not stated"))


def place(x, digits: int) -> Column:
    """A coordinate as a whole number of units of its last digit, so that keys don't depend on number formats."""
    return F.floor(_c(x) * F.lit(float(10**digits)) + 0.5).cast("long").cast("string")


def similar_stop(name, lat, lon, direction) -> Column:
    return F.concat_ws("|", normal_ascii(name), place(lat, 5), place(lon, 5), normal_ascii(direction))


def end_point(lon, lat, digits: int = 5) -> Column:
    return F.concat_ws(",", place(lon, digits), place(lat, digits))


def rail_library(crs, tfl, naptan, other, osm, name, mode, lat, lon) -> Column:
    """crs, then tfl, naptan, other, osm; else name, mode and place."""
    first = [F.concat(F.lit(f"{n}:"), filled(c)) for n, c in (("crs", F.upper(text(crs))), ("tfl", tfl), ("naptan", naptan), ("other", other), ("osm", osm))]
    rest = F.concat(F.lit("fallback:"), t.station_name(name), F.lit("|"), text(mode), F.lit("|"), place(F.coalesce(_c(lat), F.lit(0.0)), 3), F.lit("|"), place(F.coalesce(_c(lon), F.lit(0.0)), 3))
    return F.coalesce(*first, rest)


def rail_workflow(key, crs, tfl, naptan, osm, name, mode) -> Column:
    first = [filled(key)] + [F.concat(F.lit(f"{n}:"), filled(c)) for n, c in (("crs", F.upper(text(crs))), ("tfl", tfl), ("naptan", naptan), ("osm", osm))]
    return F.coalesce(*first, F.concat(F.lit("fallback:"), normal_ascii(name), F.lit("|"), normal_ascii(mode)))


def rail_master(key, crs, naptan, name) -> Column:
    return F.coalesce(filled(key), F.concat(F.lit("crs:"), filled(crs)), F.concat(F.lit("naptan:"), filled(naptan)), text(name))


def route_legacy(number, operator, origin, destination, context) -> Column:
    return F.concat_ws("|", *[normal_ascii(c) for c in (number, operator, origin, destination, context)])


def authority(explicit, urls, context) -> Column:
    """The transport authority of a route: as stated, else by its sources or its region, else unresolved.

    The second region's hyphenated host is tested against text without hyphens, as its data has always been, so it never matches.
    """
    stated = filled(F.replace(normal_ascii(explicit), F.lit(" "), F.lit("-")))
    where = normal_ascii(urls)
    london = where.rlike("tfl gov uk") | normal_ascii(context).rlike(t.words("(?:east|north|south|west|central) london"))
    return F.coalesce(stated, F.when(london, "transport-for-london").when(where.rlike("intalink org uk|central-connect co uk"), "hertfordshire-intalink"), F.lit("region-unresolved"))


def route_canonical(explicit_key, authority_key: Column, number, origin, destination, variant) -> Column:
    """Independent of the operator and of the order of the termini."""
    ends = F.array_sort(F.filter(F.array(normal_ascii(origin), normal_ascii(destination)), lambda x: x != ""))
    made = F.concat_ws(":", F.lit("route"), authority_key, normal_ascii(number), F.array_join(ends, "~"), normal_ascii(variant))
    return F.coalesce(filled(explicit_key), made)


def route_aliases(canonical: Column, legacy: Column, recorded: Column) -> Column:
    """Distinct normal forms of all keys that a route is known by."""
    every = F.concat(F.array(canonical, legacy), F.coalesce(recorded, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(every, normal_ascii), lambda x: x != ""))


def stop_workflow(naptan, fallback, source_id, name, direction) -> Column:
    return normal_ascii(F.coalesce(filled(naptan), filled(fallback), filled(source_id), F.concat(text(name), F.lit("|"), text(direction))))


def relationship(stop_key: Column, route_key: Column, *more) -> Column:
    return F.concat_ws("|", stop_key, normal_ascii(route_key), *[normal_ascii(c) for c in more])
