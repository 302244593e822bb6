"""Migration of records to canonical keys: one record a key, what it took over in long tables, the lineage of keys, and links rewritten through it.

Tables. routes(seq, legacy_key, canonical_key, number, ...), a row a record, seq unique and in order; aliases(seq, at, alias): further keys by which a record was known; sources(seq, at, url, title, publisher, retrieved); revisions(seq, at, revision): earlier
forms of a record as text. links(link, route_key, ...). Keys are compared in normal form; null or empty ones name nothing. What grows with a record that many others are merged into stays in rows, not in one cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normal_folded
from ..sources.scratch import stored
from . import select

#: Fixed value: the action in the history of a record that others were merged into.
ACTION = "canonical-route-merge"


@dataclass
class Migrated:
    """routes: the first record of each canonical key with members. legacy_keys(canonical_key, place, key), sources(canonical_key, place, url, title, publisher, retrieved), revisions(canonical_key, place, revision): what it holds now, in order, each once.
    history(canonical_key, action, place, merged_key): the records merged into another. lineage(key, canonical_key): where each old key leads. links: with legacy_route_key and route_key. apart(number, canonical_key): numbers with several canonical keys. report: one row of counts."""

    routes: DataFrame
    legacy_keys: DataFrame
    sources: DataFrame
    revisions: DataFrame
    history: DataFrame
    lineage: DataFrame
    links: DataFrame
    apart: DataFrame
    report: DataFrame


def _numbered(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def canonical_migration(routes: DataFrame, aliases: DataFrame, sources: DataFrame, revisions: DataFrame, links: DataFrame, normal=normal_folded) -> Migrated:
    """Merge records of one canonical key into its first one.

    Its legacy keys are those of all its records and their aliases, its sources the last one of each URL (or title without one) at the place of the first, its revisions those of all its records, each record but the first being one itself (as JSON). An old key
    leads to the canonical key of the last group, by first record, that names it; a canonical key leads to itself unless a later group names it. Links whose key leads anywhere take that canonical key and keep their own as legacy_route_key; others stay.
    """
    filled = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    first = routes.groupBy("canonical_key").agg(F.min("seq").alias("_first"), F.count("*").alias("members"))
    every = stored(routes.join(first, "canonical_key"), "members")
    kept = every.filter("seq = _first").drop("_first")
    of = every.select("seq", "canonical_key", "_first")

    # a record's own key comes before its aliases
    named = of.join(every.select("seq", "legacy_key"), "seq").select("canonical_key", "_first", "seq", F.lit(-1).cast("long").alias("at"), F.col("legacy_key").alias("key"))
    named = stored(named.unionByName(of.join(aliases, "seq").select("canonical_key", "_first", "seq", F.col("at").cast("long").alias("at"), F.col("alias").alias("key"))).filter(filled("key")), "named-keys")
    keys = _numbered(select.ranked(named, ["canonical_key", "key"], [F.col("seq"), F.col("at")]), ["canonical_key"], [F.col("seq"), F.col("at")]).select("canonical_key", "place", "key")

    told = of.join(sources, "seq").withColumn("_s", normal(F.coalesce(F.when(filled("url"), F.col("url")), "title")))
    order = F.struct("seq", "at")
    told = told.groupBy("canonical_key", "_s").agg(F.min(order).alias("_o"), F.max_by(F.struct("url", "title", "publisher", "retrieved"), order).alias("_v"))
    told = _numbered(told, ["canonical_key"], [F.col("_o")]).select("canonical_key", "place", "_v.*")

    whole = F.to_json(F.struct(*[F.col(c) for c in routes.columns]))
    old = of.join(revisions, "seq").select("canonical_key", "seq", F.col("at").cast("long").alias("at"), "revision")
    old = old.unionByName(every.filter("seq <> _first").select("canonical_key", "seq", F.lit((1 << 63) - 1).alias("at"), whole.alias("revision"))).filter("revision is not null")
    old = _numbered(select.ranked(old, ["canonical_key", "revision"], [F.col("seq"), F.col("at")]), ["canonical_key"], [F.col("seq"), F.col("at")]).select("canonical_key", "place", "revision")

    merged = every.filter("seq <> _first")
    history = _numbered(merged, ["canonical_key"], [F.col("seq")]).select("canonical_key", F.lit(ACTION).alias("action"), "place", F.col("legacy_key").alias("merged_key"))

    steps = named.select(normal("key").alias("key"), "canonical_key", "_first").unionByName(first.select(normal("canonical_key").alias("key"), "canonical_key", "_first")).filter(filled("key"))
    lineage = stored(steps.groupBy("key").agg(F.max_by("canonical_key", "_first").alias("canonical_key")), "lineage")
    own = links.withColumn("_key", normal("route_key"))
    led = own.join(lineage.withColumnsRenamed({"key": "_key", "canonical_key": "_to"}), "_key", "left")
    new_links = led.withColumn("legacy_route_key", F.when(F.col("_to").isNotNull(), F.coalesce("route_key", F.lit("")))).withColumn("route_key", F.coalesce("_to", "route_key")).select(*links.columns, "legacy_route_key")

    numbers = routes.select(normal("number").alias("number"), "canonical_key").distinct()
    several = numbers.groupBy("number").agg(F.count("*").alias("n")).filter("n > 1").select("number")
    apart = numbers.join(several, "number")
    moved = new_links.agg(F.count("*").alias("links"), F.count_if((F.col("legacy_route_key") != "") & (F.col("legacy_route_key") != F.col("route_key"))).alias("references_updated"))
    counts = first.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("routes_before"), F.count("*").alias("routes_after"), F.count_if(F.col("members") > 1).alias("merged_candidates"), F.coalesce(F.sum(F.col("members") - 1), F.lit(0)).alias("records_merged"))
    report = counts.join(moved).join(several.agg(F.count("*").alias("numbers_apart")))
    return Migrated(kept, keys, told, old, history, lineage, new_links, apart, report)
