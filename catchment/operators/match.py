"""Matching record sets: alternatives of equalities as unions of equi-joins, fuzzy matches behind a grid, and set comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import spatial


def any_of(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """Distinct (left_id, right_id) for which any of the column pairs is equal and not empty. Columns of right_id and its values must be named apart from left's."""
    def one(a: str, b: str) -> DataFrame:
        l_ = left.filter(F.coalesce(F.col(a), F.lit("")) != "").select(left_id, F.col(a).alias("_k"))
        return l_.join(right.filter(F.coalesce(F.col(b), F.lit("")) != "").select(right_id, F.col(b).alias("_k")), "_k").select(left_id, right_id)

    return reduce(DataFrame.union, [one(a, b) for a, b in pairs]).distinct()


def stop_matches(stops: DataFrame, library: DataFrame, metres: float = 120.0) -> DataFrame:
    """(stop_id, lib_id): for each stop the last library record (by lib_seq) with its code, or with its name within metres and a direction that is missing, the same, or the pair's. Stops without one are left out.

    stops(stop_id, naptan, name_key, dir_key, pair, lat, lon), library(lib_id, lib_seq, lib_naptan, lib_name_key, lib_dir_key, lib_pair, lib_lat, lib_lon).
    """
    by_code = any_of(stops, library, [("naptan", "lib_naptan")], "stop_id", "lib_id")
    near = spatial.radius_join(stops, library, metres, ("lat", "lon"), ("lib_lat", "lib_lon"))
    way = (F.col("dir_key") == "") | (F.col("lib_dir_key") == "") | (F.col("dir_key") == F.col("lib_dir_key")) | ((F.col("pair") != "") & (F.col("pair") == F.col("lib_pair")))
    fuzzy = near.filter((F.col("name_key") == F.col("lib_name_key")) & way).select("stop_id", "lib_id")
    every = by_code.union(fuzzy).distinct().join(library.select("lib_id", "lib_seq"), "lib_id")
    return every.groupBy("stop_id").agg(F.max_by("lib_id", "lib_seq").alias("lib_id"))


def unique_fuzzy(stations: DataFrame, library: DataFrame, metres: float = 500.0) -> DataFrame:
    """(stop_id, lib_id) by equal name within metres, only where exactly one library record qualifies."""
    near = spatial.radius_join(stations, library, metres, ("lat", "lon"), ("lib_lat", "lib_lon")).filter(F.col("name_key") == F.col("lib_name_key"))
    return near.groupBy("stop_id").agg(F.count("*").alias("n"), F.min("lib_id").alias("lib_id")).filter("n = 1").select("stop_id", "lib_id")


def station_matches(stations: DataFrame, library: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """First library record that shares any identifier, else the only one near with the name: (stop_id, lib_id)."""
    hard = any_of(stations, library, pairs, "stop_id", "lib_id").join(library.select("lib_id", "lib_seq"), "lib_id").groupBy("stop_id").agg(F.min_by("lib_id", "lib_seq").alias("lib_id"))
    rest = stations.join(hard, "stop_id", "left_anti")
    return hard.unionByName(unique_fuzzy(rest, library))


def by_alias(links: DataFrame, routes: DataFrame, link_key: str = "link_key", alias: str = "alias") -> DataFrame:
    """links with route_id of the first route (by seq) one of whose aliases is the link's key; null without."""
    first = routes.groupBy(alias).agg(F.min_by("route_id", "seq").alias("route_id"))
    return links.join(first.withColumnRenamed(alias, link_key), link_key, "left")


def only_candidate(links: DataFrame, routes: DataFrame, number: str = "route_number") -> DataFrame:
    """links with route_id and candidates: the route of the link's number where there is exactly one."""
    n = routes.groupBy(number).agg(F.count("*").alias("candidates"), F.min("route_id").alias("_only"))
    out = links.join(n, number, "left")
    return out.withColumn("candidates", F.coalesce("candidates", F.lit(0))).withColumn("route_id", F.when(F.col("candidates") == 1, F.col("_only"))).drop("_only")


def compared(results: DataFrame, tasks: DataFrame, key: str = "task_id", same: tuple[str, ...] = ("kind", "record")) -> DataFrame:
    """(key, state): results against tasks; accepted, unassigned (no task), unreturned (no result), or the first column that differs."""
    r = results.select(key, *[F.col(c).alias(f"r_{c}") for c in same], F.lit(True).alias("_r"))
    t = tasks.select(key, *[F.col(c).alias(f"t_{c}") for c in same], F.lit(True).alias("_t"))
    state = F.when(F.col("_t").isNull(), "unassigned").when(F.col("_r").isNull(), "unreturned")
    for c in same:
        state = state.when(~F.col(f"r_{c}").eqNullSafe(F.col(f"t_{c}")), f"{c} differs")
    return r.join(t, key, "full_outer").select(key, state.otherwise("accepted").alias("state"))


def terminal_keys(*ends: str) -> Column:
    """Keys of which two routes share one where an end of one has the name, or a telling word, of an end of the other. A route without ends has none."""
    one = lambda e: F.when(text.text(e) == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.concat(F.lit("="), text.normal_folded(e))), text.endpoint_words(text.normal_folded(e))))
    return F.array_sort(F.array_distinct(F.concat(*[one(e) for e in ends])))


def compatible_pairs(items: DataFrame) -> DataFrame:
    """Distinct (a, b), a before b, of items that share a token and whose authority, operator and terminals agree or are empty on either side.

    items(item, tokens, authority, operator, terminals). Items that are equal in all four are one class: its first item is paired with its copies and stands for them towards
    other classes, so copies aren't paired with each other, and groups by the pairs are the same. Classes meet on their tokens in an equi-join, which adaptive execution
    splits where a token is frequent. An item without a token is in no pair. Null columns are empty.
    """
    what = ["tokens", "authority", "operator", "terminals"]
    none = F.array().cast("array<string>")
    plain = items.select("item", F.array_sort(F.coalesce("tokens", none)).alias("tokens"), text.text("authority").alias("authority"), text.text("operator").alias("operator"), F.array_sort(F.coalesce("terminals", none)).alias("terminals")).filter(F.size("tokens") > 0)
    classes = plain.groupBy(*what).agg(F.min("item").alias("first"))
    copies = plain.join(classes, what).filter("item <> first").select(F.col("first").alias("a"), F.col("item").alias("b"))
    side = lambda n: classes.select(F.col("first").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in what[1:]], F.explode("tokens").alias("token"))
    agree = lambda c: (F.col(f"a_{c}") == "") | (F.col(f"b_{c}") == "") | (F.col(f"a_{c}") == F.col(f"b_{c}"))
    ends = (F.size("a_terminals") == 0) | (F.size("b_terminals") == 0) | F.arrays_overlap("a_terminals", "b_terminals")
    met = side("a").join(side("b"), "token").filter(F.col("a") < F.col("b")).filter(agree("authority") & agree("operator") & ends)
    return met.select("a", "b").union(copies).distinct()
