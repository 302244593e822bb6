"""Publication of bus records: the best link of each stop, route and direction; the best route of each number, with what its links state; links keyed anew by their route; stops with the routes that serve them.

Tables, one row a record, seq unique and in the order of the library: links(seq, stop_key, number, direction, destination, weekday, saturday, sunday, tph, saturday_tph, sunday_tph, pattern, journey, paragraph, qualifications map, date, status),
routes(seq, number, operator, origin, destination, context, principal array, weekday, saturday, sunday, pattern, qualifications map, date, status), stops(seq, stop_key, name, locality, direction, indicator, served array, date, status); sources in long form:
(seq, at, url, title, publisher, retrieved), at their order within a record. Nulls are empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import evidence
from ..functions.text import normal_folded, text
from ..sources.scratch import stored
from . import select

#: Columns that tell how complete a record is, besides its sources and date. Fixed values.
LINK_FIELDS = ("direction", "destination", "weekday", "saturday", "sunday", "tph", "saturday_tph", "sunday_tph", "pattern", "qualifications", "journey", "paragraph")
ROUTE_FIELDS = ("operator", "origin", "destination", "context", "principal")
STOP_FIELDS = ("name", "locality", "direction", "indicator", "served")
#: What a route takes from its links.
PERIODS = ("weekday", "saturday", "sunday", "pattern")


@dataclass
class Published:
    """Tables of one publication. sources: (kind, seq, place, url, title, publisher, retrieved), place from 1 in the order of their score."""

    links: DataFrame
    routes: DataFrame
    stops: DataFrame
    sources: DataFrame


def useful(df: DataFrame, c: str) -> Column:
    """Whether a column holds anything: a text that isn't empty or research required, an array with elements, a map with a useful value."""
    kind = dict(df.dtypes)[c]
    if kind.startswith("array"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if kind.startswith("map"):
        return F.coalesce(F.exists(F.map_values(c), evidence.useful), F.lit(False))
    return evidence.useful(c)


def chosen(df: DataFrame, keys, fields: tuple[str, ...], has_sources: Column) -> DataFrame:
    """The best record of each key: a verified one before others, then the newest, then the one with the most useful fields (sources and date count), then the first."""
    full = sum((useful(df, c).cast("int") for c in fields), has_sources.cast("int") + evidence.useful("date").cast("int"))
    order = [(~evidence.is_verified("status")).cast("int"), F.coalesce(evidence.day("date"), F.lit("1970-01-01").cast("date")).desc(), full.desc(), F.col("seq")]
    return select.ranked(df, keys, order)


def distinct_join(df: DataFrame, keys: list[str], value: str, order: str = "seq", normal=normal_folded, name: str | None = None) -> DataFrame:
    """(keys, name): the useful values of each key that differ when normalised, as first spelled, in order of their first row, joined by ' / '. Keys without one have no row."""
    some = df.filter(evidence.useful(value)).select(*keys, F.col(order).alias("_o"), F.trim(text(value)).alias("_v")).withColumn("_n", normal("_v"))
    each = some.groupBy(*keys, "_n").agg(F.min(F.struct("_o", "_v")).alias("_f"))
    return each.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_f")), lambda x: x["_v"]), " / ").alias(name or value))


def merged_maps(df: DataFrame, keys: list[str], value: str, order: str = "seq", normal=normal_folded, name: str | None = None) -> DataFrame:
    """(keys, name): maps merged entry by entry in order. A useful value that isn't, when normalised, what the entry holds by then is put behind it with ' / '; so conflicts are kept. Keys without an entry have no row."""
    entry = df.select(*keys, F.col(order).alias("_o"), F.explode(value).alias("_k", "_v")).filter(evidence.useful("_v")).withColumn("_n", normal("_v"))
    rows = entry.groupBy(*keys, "_k").agg(F.array_sort(F.collect_list(F.struct("_o", "_v", "_n"))).alias("_r"))
    # normalising what is joined is joining what is normalised: the separator is no letter
    start = F.struct(F.lit(None).cast("string").alias("v"), F.lit(None).cast("string").alias("n"))

    def step(acc: Column, r: Column) -> Column:
        joined = lambda f, sep, new: F.concat(acc[f], F.lit(sep), new)
        both = F.struct(joined("v", " / ", F.trim(r["_v"])).alias("v"), F.concat_ws(" ", F.when(acc["n"] != "", acc["n"]), F.when(r["_n"] != "", r["_n"])).alias("n"))
        return F.when(acc["v"].isNull(), F.struct(r["_v"].alias("v"), r["_n"].alias("n"))).when(acc["n"] == r["_n"], acc).otherwise(both)

    done = rows.select(*keys, "_k", F.aggregate("_r", start, step)["v"].alias("_v"))
    return done.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(name or value))


def merged_sources(df: DataFrame, keys: list[str], order: list[str], normal=normal_folded) -> DataFrame:
    """(keys, place, url, title, publisher, retrieved): the first source of each URL, or of each title and publisher where there is no URL, by falling score, then order."""
    key = F.when(normal("url") != "", normal("url")).when((normal("title") != "") | (normal("publisher") != ""), F.concat(normal("title"), F.lit("|"), normal("publisher"))).otherwise("|")
    first = select.ranked(df.withColumn("_key", key), [*keys, "_key"], [F.col(c) for c in order])
    score = evidence.source_score("url", "title", "publisher", F.when(F.col("retrieved").rlike(evidence.WHOLE_DATE), F.col("retrieved")))
    score = F.when(evidence.is_url("url"), score - F.when(evidence.is_http_url("url"), 0).otherwise(10)).otherwise(0)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(score.desc(), *[F.col(c) for c in order]))
    return first.withColumn("place", place).select(*keys, "place", "url", "title", "publisher", "retrieved")


def _latest(a: str, b: str) -> Column:
    whole = lambda c: F.when(F.col(c).rlike(evidence.WHOLE_DATE), F.col(c))
    return F.greatest(whole(a), whole(b))


def publication(links: DataFrame, routes: DataFrame, stops: DataFrame, link_sources: DataFrame, route_sources: DataFrame, stop_sources: DataFrame, selected_stops: DataFrame, numbers: DataFrame, normal=normal_folded) -> Published:
    """What is published of the selected stops(stop_key) and included numbers(number). Only verified records take part. A number whose links are verified and whose route isn't gives no route and no links: they are left out, as they can't be published.

    A route without principal locations has its ends, one without a context a corridor between them; its periods and pattern are the distinct ones of its links, where they state any, its qualifications theirs, merged (else its pattern as general), its sources its own and theirs, its
    date the newest. Links take operator, ends, context, key and, where they have none, qualifications of their route. Stops have the numbers of their links added to those they declare, and their direction for a missing indicator; the best one of a key stays.
    """
    chosen_stops, wanted = selected_stops.select("stop_key").distinct(), numbers.select(normal("number").alias("_number")).distinct()
    sourced = lambda s: s.select("seq").distinct().withColumn("_sourced", F.lit(True))
    has = F.coalesce("_sourced", F.lit(False))
    mine = links.filter(evidence.is_verified("status")).withColumn("_number", normal("number")).join(chosen_stops, "stop_key", "left_semi").join(wanted, "_number", "left_semi")
    mine = mine.withColumns({"_direction": normal("direction"), "_destination": normal("destination")}).join(sourced(link_sources), "seq", "left")
    best = chosen(mine, ["stop_key", "_number", "_direction", "_destination"], LINK_FIELDS, has)
    # links come in the order in which their keys came first
    came = mine.groupBy("stop_key", "_number", "_direction", "_destination").agg(F.min("seq").alias("_came"))
    best = stored(best.drop("_sourced").join(came, ["stop_key", "_number", "_direction", "_destination"]), "links")

    r = routes.filter(evidence.is_verified("status")).withColumn("_number", normal("number")).join(best.select("_number").distinct(), "_number", "left_semi").join(sourced(route_sources), "seq", "left")
    r = stored(chosen(r, "_number", ROUTE_FIELDS, has).drop("_sourced"), "routes")
    ends = F.filter(F.array(F.trim(text("origin")), F.trim(text("destination"))), lambda x: evidence.useful(x))
    r = r.withColumn("principal", F.when(useful(r, "principal"), F.col("principal")).otherwise(ends))
    via = F.when(F.size("principal") > 0, F.concat(F.lit(" via "), F.array_join("principal", ", "))).otherwise("")
    corridor = F.concat(F.lit("Service corridor between "), F.trim(text("origin")), F.lit(" and "), F.trim(text("destination")), via, F.lit("."))
    r = r.withColumn("context", F.when(evidence.useful("context"), F.col("context")).otherwise(corridor))
    for c in PERIODS:
        r = r.join(distinct_join(best, ["_number"], c, "_came", normal, f"_{c}"), "_number", "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    r = r.drop("qualifications").join(merged_maps(best, ["_number"], "qualifications", "_came", normal), "_number", "left")
    r = r.withColumn("qualifications", F.coalesce("qualifications", F.create_map(F.lit("general"), text("pattern"))))
    newest = best.groupBy("_number").agg(F.max(F.when(F.col("date").rlike(evidence.WHOLE_DATE), F.col("date"))).alias("_date"))
    r = r.join(newest, "_number", "left").withColumn("date", F.coalesce(_latest("date", "_date"), "date")).drop("_date").withColumn("status", F.lit("verified"))
    r = stored(r, "routes")

    of_routes = r.select("_number", F.col("date").alias("r_date"), F.col("qualifications").alias("r_qualifications"), *[F.col(c).alias(f"r_{c}") for c in ("number", "operator", "origin", "destination", "context")])
    key = F.concat_ws("|", *[normal(f"r_{c}") for c in ("number", "operator", "origin", "destination", "context")])
    out = best.join(of_routes, "_number").withColumns({"route_key": key, "operator": F.col("r_operator"), "route_origin": F.col("r_origin"), "route_destination": F.col("r_destination"), "context": F.col("r_context")})
    out = out.withColumns({"qualifications": F.when(useful(out, "qualifications"), F.col("qualifications")).otherwise(F.col("r_qualifications")), "date": F.coalesce(_latest("date", "r_date"), "r_date"), "status": F.lit("verified")})

    pieces = ["url", "title", "publisher", "retrieved"]
    own = r.select("_number", F.col("seq").alias("_route")).join(route_sources.withColumnRenamed("seq", "_route"), "_route").select("_number", "_route", F.lit(0).alias("_a"), F.lit(0).cast("long").alias("_b"), F.col("at").cast("long").alias("_c"), *pieces)
    theirs = best.select("_number", "seq", "_came").join(link_sources, "seq").join(r.select("_number", F.col("seq").alias("_route")), "_number").select("_number", "_route", F.lit(1).alias("_a"), F.col("_came").cast("long").alias("_b"), F.col("at").cast("long").alias("_c"), *pieces)
    route_all = merged_sources(own.unionByName(theirs), ["_number", "_route"], ["_a", "_b", "_c"], normal)
    link_own = out.select("seq", "_number").join(link_sources, "seq").select("seq", F.lit(0).alias("_a"), F.col("at").cast("long").alias("_c"), *pieces)
    link_more = out.select("seq", "_number").join(route_all, "_number").select("seq", F.lit(1).alias("_a"), F.col("place").cast("long").alias("_c"), *pieces)
    link_all = merged_sources(link_own.unionByName(link_more), ["seq"], ["_a", "_c"], normal)
    sources = route_all.select(F.lit("bus-route").alias("kind"), F.col("_route").alias("seq"), "place", *pieces).unionByName(link_all.select(F.lit("bus-stop-route").alias("kind"), "seq", "place", *pieces))

    s = stops.filter(evidence.is_verified("status")).join(chosen_stops, "stop_key", "left_semi")
    by_stop = out.groupBy("stop_key", "number").agg(F.min("_came").alias("_o")).groupBy("stop_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "number"))), lambda x: x["number"]).alias("_served"))
    none = F.array().cast("array<string>")
    s = s.join(by_stop, "stop_key", "left").withColumn("served", F.array_distinct(F.concat(F.coalesce("served", none), F.coalesce("_served", none)))).drop("_served")
    s = s.withColumn("indicator", F.when(~evidence.useful("indicator") & evidence.useful("direction"), F.col("direction")).otherwise(F.col("indicator")))
    s = chosen(s.join(sourced(stop_sources), "seq", "left"), "stop_key", STOP_FIELDS, has).drop("_sourced")
    return Published(out.drop(*[c for c in out.columns if c.startswith(("_", "r_"))]), r.drop("_number"), s, sources)
