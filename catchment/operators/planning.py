"""Research plans: batches and packs of bounded size, state of batches, and validation of what comes back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .select import chunked

#: Records of a rail batch (and of an administrator's), stops, routes and links of a pack. Fixed values.
RAIL, RAIL_BULK, STOPS, ROUTES, LINKS = 5, 10, 2, 6, 12
#: Most of each kind in a combined pack, and its length in characters. Fixed values.
COMBINED = {"rail": 3, "bus-network": 1, "bus-stop": 2, "bus-route": 6, "bus-stop-route": 12}
LENGTH = 220_000


def rail_batches(records: DataFrame, key: str, bulk: bool = False) -> DataFrame:
    """records with batch, by key in fives (bulk: tens)."""
    return chunked(records, RAIL_BULK if bulk else RAIL, F.col(key)).withColumnRenamed("chunk", "batch")


def stop_batches(stops: DataFrame, key: str = "key", pair: str = "pair") -> DataFrame:
    """(key, group): each pair is a group of its own, whatever its size; other stops go in twos. Groups of pairs come first, in order of their first stop."""
    paired = stops.filter(F.col(pair) != "")
    first = paired.groupBy(pair).agg(F.min(key).alias("_first"))
    groups = chunked(first, 1, F.col("_first")).withColumnRenamed("chunk", "group")
    a = paired.join(groups.select(pair, "group"), pair).select(key, "group")
    b = chunked(stops.filter(F.col(pair) == ""), STOPS, F.col(key)).select(key, F.col("chunk").alias("group"))
    n = groups.agg(F.count("*").alias("n"))  # one row
    return a.unionByName(b.crossJoin(F.broadcast(n)).select(key, (F.col("group") + F.col("n")).alias("group")))


def service_packs(links: DataFrame, plan: str = "plan", route: str = "route", order: str = "seq", routes: int = ROUTES, most: int = LINKS) -> DataFrame:
    """(plan, route, order, pack): greedy packs of at most `routes` routes and `most` links; a route's links are cut in runs of `most`. Each depends on the one before, so a plan is one group; plans are small and
    independent."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pack, held, n, rows = 0, set(), 0, []
        for r, g in pdf.sort_values([route, order]).groupby(route, sort=True):
            seqs = g[order].tolist()
            for at in range(0, len(seqs), most):
                part = seqs[at : at + most]
                if (r not in held and len(held) >= routes) or n + len(part) > most:
                    pack, held, n = pack + 1, set(), 0
                held.add(r)
                n += len(part)
                rows += [(pdf[plan].iloc[0], r, s, pack) for s in part]
                if len(held) == routes or n == most:
                    pack, held, n = pack + 1, set(), 0
        return pd.DataFrame(rows, columns=[plan, route, order, "pack"])

    return links.groupBy(plan).applyInPandas(fill, f"{plan} long, {route} long, {order} long, pack long")


def task_packs(tasks: DataFrame, plan: str = "plan", kind: str = "kind", order: str = "task_id") -> DataFrame:
    """(plan, task_id, pack_kind, pack): all tasks of a plan in one combined pack where each kind is within COMBINED and there are rail and bus tasks; else rail by fives, each network alone, and stops by twos, routes by
    sixes, links by twelves side by side."""
    caps = {"rail": RAIL, "bus-network": 1, "bus-stop": STOPS, "bus-route": ROUTES, "bus-stop-route": LINKS}
    size = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    counts = tasks.groupBy(plan).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in caps], F.sum(F.length(kind) + 32).alias("_length"))
    rail, bus = F.col("rail") > 0, F.col("bus-network") + F.col("bus-stop") + F.col("bus-route") + F.col("bus-stop-route") > 0
    fits = rail & bus & (F.col("_length") <= LENGTH)
    for k, n in COMBINED.items():
        fits = fits & (F.col(k) <= n)
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy(plan, kind).orderBy(order)) - 1
    out = tasks.join(counts.select(plan, fits.alias("_all")), plan).withColumn("_n", F.floor(nth / size[F.col(kind)]))
    pack_kind = F.when(F.col("_all"), "combined").when(F.col(kind) == "rail", "railway").when(F.col(kind) == "bus-network", "network").otherwise("bus")
    return out.select(plan, order, pack_kind.alias("pack_kind"), F.when(F.col("_all"), 0).otherwise(F.col("_n")).cast("long").alias("pack"))


def with_saved_state(batches: DataFrame, saved: DataFrame, key: str = "batch") -> DataFrame:
    """Batches of a plan made anew, with the status that was saved for them; new ones are ready."""
    return batches.join(saved, key, "left").withColumn("status", F.coalesce("status", F.lit("ready")))


def marked(state: DataFrame, results: DataFrame, key: str = "batch") -> DataFrame:
    """state(batch, passed, failed) with results(batch, now_passed, now_failed): what passed once stays passed, and what failed and hasn't passed since is failed."""
    none = F.array().cast("array<string>")
    out = state.join(results, key, "left")
    passed = F.array_sort(F.array_union("passed", F.coalesce("now_passed", none)))
    failed = F.array_sort(F.array_except(F.coalesce("now_failed", F.col("failed")), passed))
    return out.select(key, passed.alias("passed"), failed.alias("failed"))


def next_batch(batches: DataFrame, key: str = "batch", plan: str = "plan") -> DataFrame:
    """The first batch of each plan that is neither imported nor blocked."""
    return batches.filter(~F.col("status").isin("imported", "blocked")).groupBy(plan).agg(F.min(key).alias(key))
