"""Digests of snapshots as trees of bounded fan-out: equal trees mean equal tables, and two trees tell where tables differ without comparing their rows.

A row's place is given by its key's own digest: two hexadecimal digits of it for each level, so a node has at most 256 children and lowest nodes hold about LEAF keys each, whatever the ids look like. Rows of one key are added up, in any number and order.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: The digest of an empty text.
EMPTY = hashlib.sha256(b"").hexdigest()
#: Keys in a lowest node, about.
LEAF = 256


def levels_for(rows: int) -> int:
    """How many levels a tree below its root needs."""
    return max(1, math.ceil(math.log(max(1, rows) / LEAF, 256))) if rows > LEAF else 1


def keyed_digests(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, place, digest) for each key: digest of its rows' values in columns. Null and empty differ. Several rows of a key count as a bag: sums of their digests' parts."""
    value = F.to_json(F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(c) for c in columns]), {"ignoreNullFields": "false"})
    digest = F.sha2(value, 256)
    parts = [F.conv(F.substring("_d", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    bag = rows.select(key, digest.alias("_d")).groupBy(key).agg(F.count("*").alias("_n"), *[F.sum(p).alias(f"_s{i}") for i, p in enumerate(parts)])
    name = F.coalesce(F.col(key).cast("string"), F.lit("\u0000"))
    return bag.select(key, F.sha2(name, 256).alias("place"), F.sha2(F.concat_ws(":", name, "_n", *[f"_s{i}" for i in range(4)]), 256).alias("digest"))


def tree(rows: DataFrame, key: str, columns: list[str], levels: int | None = None) -> DataFrame:
    """(level, path, digest, keys): all nodes, level 0 with path '' being the root. A node's digest is that of its children's digests in order of their paths, joined by a comma; lowest nodes digest those of their keys, in order of place. No rows: the root alone, with the digest of an empty text.

    Trees that are to be compared need the same number of levels; by default it follows from the number of keys.
    """
    leaves = stored(keyed_digests(rows, key, columns), "digests")
    levels = levels_for(leaves.count()) if levels is None else levels
    joined = lambda order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "digest"))), lambda x: x["digest"]), ","), 256)
    at = leaves.groupBy(F.substring("place", 1, 2 * levels).alias("path")).agg(joined("place").alias("digest"), F.count("*").alias("keys"))
    nodes = at = stored(at.select(F.lit(levels).alias("level"), "path", "digest", "keys"), "nodes")
    for level in range(levels - 1, -1, -1):
        up = at.groupBy(F.substring("path", 1, 2 * level).alias("up")).agg(joined("path").alias("digest"), F.sum("keys").alias("keys"))
        at = stored(up.select(F.lit(level).alias("level"), F.col("up").alias("path"), "digest", "keys"), "nodes")
        nodes = nodes.unionByName(at)
    if leaves.isEmpty():
        return leaves.sparkSession.createDataFrame([(0, "", EMPTY, 0)], "level int, path string, digest string, keys long")
    return nodes


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths of the lowest nodes in which two trees of the same number of levels differ, found from the root down: only children of nodes that differ are looked at."""
    deep = max((a.agg(F.max("level")).first()[0] or 0), (b.agg(F.max("level")).first()[0] or 0))
    paths = None
    for level in range(deep + 1):
        one = a.filter(F.col("level") == level).select("path", F.col("digest").alias("_a"))
        two = b.filter(F.col("level") == level).select("path", F.col("digest").alias("_b"))
        if paths is not None:
            keep = paths.select(F.col("path").alias("_up"))
            one, two = (x.join(keep, F.substring("path", 1, 2 * level - 2) == F.col("_up"), "left_semi") for x in (one, two))
        paths = stored(one.join(two, "path", "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("path"), "differing")
    return paths


def changed(before: DataFrame, after: DataFrame, key: str, columns: list[str], levels: int | None = None) -> DataFrame:
    """(key, change): added, removed or changed, for each key of two tables that differ. Their trees are compared first; only keys of nodes that differ are compared themselves."""
    levels = levels or levels_for(max(before.select(key).distinct().count(), after.select(key).distinct().count()))
    where = differing(tree(before, key, columns, levels), tree(after, key, columns, levels))
    some = lambda df, n: keyed_digests(df, key, columns).withColumn("path", F.substring("place", 1, 2 * levels)).join(where, "path", "left_semi").select(F.col(key), F.col("place"), F.col("digest").alias(n))
    both = some(before, "_a").withColumnRenamed(key, "_key_a").join(some(after, "_b").withColumnRenamed(key, "_key_b"), "place", "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return both.select(F.coalesce("_key_a", "_key_b").alias(key), change.alias("change"))
