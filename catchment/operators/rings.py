"""Validity of polygon rings, with self-intersection by a grid of each ring's own size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import scans

#: Pieces of segments in one share of a crowded cell.
CELL_PIECES = 1024


def ring_segments(vertices: DataFrame, key: str, order: str) -> DataFrame:
    """(key, i, n, lon, lat, lon2, lat2): segment i of n of each ring given as vertices, from each vertex to the next in order. Nulls don't count as vertices."""
    at = stored(scans.placed(vertices.select(key, order, "lon", "lat").dropna(), key, [F.col(order)], "i"), "vertices")
    n = at.groupBy(key).agg(F.max("i").alias("n"))
    ahead = at.select(key, (F.col("i") - 1).alias("i"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return at.select(key, "i", "lon", "lat").join(ahead, [key, "i"]).join(n, key)


def turn(a: tuple, b: tuple, c: tuple) -> Column:
    """Side of c as seen along a-b: -1, 1, or 0 if they are in line (to within 1e-12 square degrees)."""
    v = (b[1] - a[1]) * (c[0] - b[0]) - (b[0] - a[0]) * (c[1] - b[1])
    return F.when(F.abs(v) < 1e-12, 0).otherwise(F.signum(v).cast("int"))


def crossings(vertices: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct (key, i, j), i before j: segments of a ring that aren't neighbours and cross or touch.

    Segments are cut into pieces about as long as the ring's average segment and filed under the cells of the pieces' boxes; only segments with a cell in common are compared, and only if their boxes meet. Pieces of a crowded cell
    are dealt to shares that meet pairwise in tasks of their own.
    """
    seg = stored(ring_segments(vertices, key, order), "segments")
    size = seg.groupBy(key).agg(F.greatest(F.avg(F.greatest(F.abs(F.col("lon2") - F.col("lon")), F.abs(F.col("lat2") - F.col("lat")))) * 1.5, F.lit(1e-12)).alias("_c"))
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("lon2") - F.col("lon")), F.abs(F.col("lat2") - F.col("lat"))) / F.col("_c")))
    cut = seg.join(size, key).withColumn("_n", n).withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    along = lambda c, d: F.col(c) + (F.col(f"{c}2") - F.col(c)) * (F.col("_p") + d) / F.col("_n")
    slack = F.col("_c") * 1e-6  # rounding at a cell's edge
    span = lambda c: F.sequence(F.floor((F.least(along(c, 0), along(c, 1)) - slack) / F.col("_c")), F.floor((F.greatest(along(c, 0), along(c, 1)) + slack) / F.col("_c")))
    filed = cut.withColumn("_x", F.explode(span("lon"))).withColumn("_y", F.explode(span("lat"))).select(key, "i", "n", "lon", "lat", "lon2", "lat2", "_x", "_y").distinct()
    shares = filed.groupBy(key, "_x", "_y").agg(F.ceil(F.count("*") / CELL_PIECES).alias("_shares"))
    filed = stored(filed.join(shares, [key, "_x", "_y"]).withColumn("_own", F.pmod(F.xxhash64("i"), F.col("_shares"))), "filed")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1))
    left = filed.withColumn("_l", F.col("_own")).withColumn("_r", every)
    right = filed.withColumn("_r", F.col("_own")).withColumn("_l", every).select(key, "_x", "_y", "_l", "_r", F.col("i").alias("j"), *[F.col(c).alias(f"o_{c}") for c in ("lon", "lat", "lon2", "lat2")])
    met = left.join(right, [key, "_x", "_y", "_l", "_r"]).filter((F.col("j") > F.col("i") + 1) & ~((F.col("i") == 0) & (F.col("j") == F.col("n") - 1)))
    meet = lambda c: (F.greatest(c, f"{c}2") >= F.least(f"o_{c}", f"o_{c}2")) & (F.greatest(f"o_{c}", f"o_{c}2") >= F.least(c, f"{c}2"))
    a, b, c, d = ((F.col(x), F.col(y)) for x, y in (("lon", "lat"), ("lon2", "lat2"), ("o_lon", "o_lat"), ("o_lon2", "o_lat2")))
    crossed = met.filter(meet("lon") & meet("lat")).filter((turn(a, b, c) != turn(a, b, d)) & (turn(c, d, a) != turn(c, d, b)))
    return crossed.select(key, "i", "j").distinct()


def checked(vertices: DataFrame, key: str, order: str) -> DataFrame:
    """(key, reason) for each ring given as vertices: '' if it is valid, else the first of: short (fewer than four positions), open, self-intersecting, flat (no area to speak of), out of range. A vertex with a null coordinate makes a ring invalid: malformed."""
    whole = vertices.groupBy(key).agg(
        F.count("*").alias("_n"), F.count_if(F.col("lon").isNull() | F.col("lat").isNull()).alias("_bad"), F.count_if(~F.col("lon").between(-180, 180) | ~F.col("lat").between(-90, 90)).alias("_far"),
        *[f(F.struct("lon", "lat"), order).alias(n) for f, n in ((F.min_by, "_first"), (F.max_by, "_last"))],
    )
    seg = ring_segments(vertices, key, order)
    area = seg.groupBy(key).agg(F.abs(F.sum(F.col("lon") * F.col("lat2") - F.col("lon2") * F.col("lat")) / 2).alias("_area"))
    crossed = crossings(vertices, key, order).select(key).distinct().withColumn("_crossed", F.lit(True))
    all_ = whole.join(area, key, "left").join(crossed, key, "left")
    reason = F.when(F.col("_n") < 4, "short").when(F.col("_bad") > 0, "malformed").when(F.col("_first") != F.col("_last"), "open").when(F.coalesce("_crossed", F.lit(False)), "self-intersecting")
    return all_.select(key, reason.when(F.coalesce("_area", F.lit(0.0)) < 1e-14, "flat").when(F.col("_far") > 0, "out of range").otherwise("").alias("reason"))
