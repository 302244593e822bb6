"""Spatial joins and line measures. Distance joins are equi-joins on grid cells with an exact check, never comparisons of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..functions.text import _c
from ..sources.scratch import stored
from . import blocks, scans


def _neighbours(row: Column, lat: Column, lon: Column, metres: float) -> Column:
    """Cells of three latitude bands that hold everything within metres of a point: (row, column) structs.

    Columns of another band have another width, so each band's columns are computed with its own, one to either side.
    """
    step = metres / geo.DEGREE_LAT

    def cells(offset: int) -> Column:
        r = row + offset
        width = geo._cell_width(r, step)
        c = F.floor(lon / width)
        return F.transform(F.sequence(c - 2, c + 2), lambda x: F.struct(r.cast("long").alias("row"), x.cast("long").alias("col")))

    return F.concat(cells(-1), cells(0), cells(1))


def radius_join(sites: DataFrame, points: DataFrame, metres: float, site: tuple[str, str] = ("site_lat", "site_lon"), point: tuple[str, str] = ("lat", "lon")) -> DataFrame:
    """All pairs of sites and points at most metres apart, with straight, the great-circle distance.

    Sites are copied to the cells around them (they are the few); points fall in one cell each. A crowded cell is an ordinary join key that adaptive execution can split. Distances across the
    180th meridian aren't joined.
    """
    row, col = geo.cell(*point, metres)
    p = points.withColumn("_row", row.cast("long")).withColumn("_col", col.cast("long"))
    s_row, _ = geo.cell(*site, metres)
    around = _neighbours(s_row, _c(site[0]), _c(site[1]), metres)
    s = sites.withColumn("_cell", F.explode(F.array_distinct(around))).select("*", F.col("_cell.row").alias("_srow"), F.col("_cell.col").alias("_scol")).drop("_cell")
    joined = s.join(p, (F.col("_srow") == F.col("_row")) & (F.col("_scol") == F.col("_col"))).drop("_srow", "_scol", "_row", "_col")
    return joined.withColumn("straight", geo.haversine(*site, *point)).filter(F.col("straight") <= metres)


def segments(lines: DataFrame, key: str, order: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """key, order and both ends (lon, lat, lon2, lat2) of every segment of lines given as vertices."""
    w = W.partitionBy(key).orderBy(order)
    out = lines.withColumn("lon2", F.lead(lon).over(w)).withColumn("lat2", F.lead(lat).over(w))
    return out.filter("lon2 is not null").select(key, order, F.col(lon).alias("lon"), F.col(lat).alias("lat"), "lon2", "lat2")


def segment_distance(lat: Column, lon: Column) -> Column:
    """Metres from a point to the segment (lon, lat, lon2, lat2) of the same row, in the point's local plane."""
    ax, ay = geo.local_xy("lat", "lon", lat, lon)
    bx, by = geo.local_xy("lat2", "lon2", lat, lon)
    zero = F.lit(0.0)
    return geo.point_segment(zero, zero, ax, ay, bx, by)


def nearest_segment(points: DataFrame, segs: DataFrame, key: str, metres: float, point: tuple[str, str] = ("p_lat", "p_lon")) -> DataFrame:
    """The distance of each point to the nearest segment at most metres away: key and nearest; points without one are left out.

    Segments are copied to all cells of their bounding boxes, which suits segments that aren't much longer than metres.
    """
    step = metres / geo.DEGREE_LAT
    rows = F.sequence(F.floor(F.least("lat", "lat2") / step), F.floor(F.greatest("lat", "lat2") / step))
    s = segs.withColumn("_row", F.explode(rows))
    width = geo._cell_width(F.col("_row"), step)
    s = s.withColumn("_col", F.explode(F.sequence(F.floor(F.least("lon", "lon2") / width), F.floor(F.greatest("lon", "lon2") / width))))
    p_row, _ = geo.cell(*point, metres)
    around = _neighbours(p_row, _c(point[0]), _c(point[1]), metres)
    p = points.withColumn("_cell", F.explode(F.array_distinct(around))).withColumn("_prow", F.col("_cell.row")).withColumn("_pcol", F.col("_cell.col")).drop("_cell")
    joined = p.join(s, (F.col("_prow") == F.col("_row")) & (F.col("_pcol") == F.col("_col")))
    return joined.groupBy(key).agg(F.min(segment_distance(_c(point[0]), _c(point[1]))).alias("nearest")).filter(F.col("nearest") <= metres)


#: Vertices up to which all segments of a line meet all its points; longer lines are dealt to cells.
WHOLE_LINE = 1024


def _near_cells(segs: DataFrame, metres: float, side: float, whole: Column | None = None) -> DataFrame:
    """segs(lon, lat, lon2, lat2, ...) copied to the cells (_row, _col) of that side, as geo.cell gives them, which hold all points within metres; more than once to some. Where whole holds, to the cell (0, 0) alone.

    Segments are cut into pieces no longer than a cell, which are copied to the cells of their boxes with a margin.
    """
    step, margin = side / geo.DEGREE_LAT, 1.02 * metres / geo.DEGREE_LAT
    whole = F.lit(False) if whole is None else whole
    one = F.array(F.lit(0).cast("long"))
    n = F.when(whole, 1).otherwise(F.greatest(F.lit(1), F.ceil(geo.haversine("lat", "lon", "lat2", "lon2") / side)))
    cut = segs.withColumns({"_whole": whole, "_pieces": n}).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)))
    along = lambda c, i: F.col(c) + (F.col(f"{c}2") - F.col(c)) * (F.col("_piece") + i) / F.col("_pieces")
    y, y2, x, x2 = (along(c, i) for c in ("lat", "lon") for i in (0, 1))
    cut = cut.withColumns({"_s": F.least(y, y2), "_t": F.greatest(y, y2), "_x": F.least(x, x2), "_x2": F.greatest(x, x2)})
    across = 1.02 * metres / geo.DEGREE_LON / F.cos(F.radians(F.least(F.lit(89.9), F.greatest(F.abs("_s"), F.abs("_t")) + 2 * margin)))
    rows = F.sequence(F.floor((F.col("_s") - margin) / step), F.floor((F.col("_t") + margin) / step))
    cut = cut.withColumn("_across", across).withColumn("_row", F.explode(F.when(F.col("_whole"), one).otherwise(rows)))
    width = geo._cell_width(F.col("_row"), step)
    cols = F.sequence(F.floor((F.col("_x") - F.col("_across")) / width), F.floor((F.col("_x2") + F.col("_across")) / width))
    return cut.withColumn("_col", F.explode(F.when(F.col("_whole"), one).otherwise(cols))).select(*segs.columns, "_row", "_col")


def matched_measures(points: DataFrame, lines: DataFrame, key: str, order: str, metres: float, place: str = "place") -> DataFrame:
    """(key, place, distance, measure) of points(key, place, lat, lon): the distance to the line of the same key and the measure along it, at the nearest place (the first of several) at most metres away; null without one.

    Points meet the segments of their own line in blocks; those of a line of more than WHOLE_LINE vertices in cells of four times that width, so a long line is dealt to many tasks and no two ends of it are compared. Nothing is joined pair by pair, nor broadcast.
    """
    side = 4 * metres
    w = W.partitionBy(key).orderBy(order)
    s = measures(lines.filter(F.col(key).isNotNull()), key, order).select(key, "lon", "lat", "measure", F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2"), F.lead("measure").over(w).alias("_next"), F.row_number().over(w).alias("_i"), F.count("*").over(W.partitionBy(key)).alias("_vertices"))
    s = _near_cells(s.filter("lon2 is not null"), metres, side, F.col("_vertices") <= WHOLE_LINE)
    sizes = lines.groupBy(key).agg(F.count("*").alias("_vertices"))
    p = points.select(key, F.col(place).alias("place"), "lat", "lon").join(sizes, key, "left")
    long = F.col("_vertices") > WHOLE_LINE
    row, col = (F.when(long, c).otherwise(F.lit(0)).cast("long") for c in geo.cell("lat", "lon", side))
    none = F.lit(None).cast("double")
    p = p.select(key, row.alias("_row"), col.alias("_col"), F.lit(0).alias("_i"), "place", "lon", "lat", F.cos(F.radians("lat")).alias("lon2"), none.alias("lat2"), none.alias("measure"), none.alias("step"))
    s = s.select(key, "_row", "_col", "_i", F.lit(None).cast(p.schema["place"].dataType).alias("place"), "lon", "lat", "lon2", "lat2", "measure", (F.col("_next") - F.col("measure")).alias("step"))
    group = [key, "_row", "_col"]
    both = p.unionByName(s).repartition(*group).sortWithinPartitions(*group, "_i")
    fields = [both.schema[key], both.schema["place"], T.StructField("distance", T.DoubleType()), T.StructField("measure", T.DoubleType())]
    return both.mapInArrow(blocks.best_places(metres), T.StructType(fields)).withColumnRenamed("place", place)


#: Pieces of segments, and points, in one share of a crowded cell, about.
CELL_PIECES = 4096
#: Lines that are set against as many others in one task, at most.
BLOCK_LINES = 1024


def _corridor_blocks(lines: DataFrame, key: str, order: str, metres: float, most: int) -> tuple[DataFrame, DataFrame, int]:
    """Lines numbered in order of their keys (key, _line); for each pair of blocks of lines (_x, _y) the sampled vertices of either with the lines of the other that are near, as bits; and the lines of a block.

    Vertices at one place are one. They and the segments meet in cells, and only who is near is told, as bits; no pair of a vertex and a segment or a line is a row.
    """
    numbers = stored(scans.placed(lines.select(key).dropna().distinct(), [], [F.col(key)], "_line"), "lines")
    width = min(BLOCK_LINES, max(64, -(-numbers.count() // 64) * 8))
    w = W.partitionBy("_line")
    at, last = F.row_number().over(w.orderBy(order)) - 1, F.count("*").over(w) - 1
    vertices = lines.join(numbers, key).withColumn("_at", at).withColumn("_last", last).filter("_last > 0")
    index = lambda v: F.ceil((F.col("_at") + v) * (most - 1) / F.col("_last"))
    sampled = vertices.filter((F.col("_last") < most) | (index(-0.5) < index(0.5)))
    sampled = stored(sampled.select("_line", "_at", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.count("*").over(w).alias("_n")), "samples")

    side = 4 * metres  # of a cell; what is near a piece lies in its box with a margin, so a vertex has one cell
    row, col = geo.cell("p_lat", "p_lon", side)
    spots = sampled.select("p_lat", "p_lon").dropna().distinct().select("p_lat", "p_lon", row.alias("_row"), col.alias("_col"))
    segs = segments(lines.join(numbers, key), "_line", order).drop(order)
    pieces = _near_cells(segs, metres, side)
    # pieces of a crowded cell are dealt to shares by blocks of lines, so a vertex and a block meet in one; crowded vertices to chunks
    shares = pieces.groupBy("_row", "_col").agg(F.ceil(F.count("*") / CELL_PIECES).alias("_shares"))
    cells = stored(spots.groupBy("_row", "_col").agg(F.ceil(F.count("*") / CELL_PIECES).alias("_chunks")).join(shares, ["_row", "_col"]), "cells")
    none = F.lit(None).cast("double")
    points = spots.join(cells, ["_row", "_col"]).withColumns({"_share": F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1)), "_chunk": F.pmod(F.xxhash64("p_lat", "p_lon"), F.col("_chunks"))})
    points = points.select("_row", "_col", "_share", "_chunk", F.lit(0).alias("_i"), F.lit(-1).cast("long").alias("_line"), F.col("p_lon").alias("lon"), F.col("p_lat").alias("lat"), F.cos(F.radians("p_lat")).alias("lon2"), none.alias("lat2"))
    dealt = pieces.join(cells, ["_row", "_col"]).withColumns({"_share": F.pmod(F.floor(F.col("_line") / width), F.col("_shares")), "_chunk": F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))})
    dealt = dealt.select("_row", "_col", "_share", "_chunk", F.lit(1).alias("_i"), "_line", "lon", "lat", "lon2", "lat2")
    group = ["_row", "_col", "_share", "_chunk"]
    both = points.unionByName(dealt).repartition(*group).sortWithinPartitions(*group, "_i", "_line")
    near = both.mapInArrow(blocks.near_lines(metres, width), "p_lat double, p_lon double, _other long, _bits binary")
    own = F.floor(F.col("_line") / width)
    met = sampled.join(near, ["p_lat", "p_lon"]).select(F.least(own, "_other").alias("_x"), F.greatest(own, "_other").alias("_y"), "_line", "_n", "_other", "_bits")
    return numbers, met, width


def corridor_shares(lines: DataFrame, key: str, order: str, metres: float = 28.0, most: int = 36) -> DataFrame:
    """(a, b, forth, back), a before b: the share of a's sampled vertices at most metres from a segment of b, and of b's from a. Pairs without any such vertex on either side are left out.

    At most `most` vertices of a line are sampled, evenly by index with both ends; lines of one vertex have no segments and are left out. Blocks of lines are set against each other in tasks of bounded size; lines that run near each other all with all are as many rows.
    """
    numbers, met, width = _corridor_blocks(lines, key, order, metres, most)
    shares = met.groupBy("_x", "_y").applyInArrow(blocks.line_shares(width), "_a long, _b long, forth double, back double")
    named = lambda c: numbers.select(F.col("_line").alias(f"_{c}"), F.col(key).alias(c))
    return shares.join(named("a"), "_a").join(named("b"), "_b").select("a", "b", "forth", "back")


def corridor_links(lines: DataFrame, key: str, order: str, adjacent, metres: float = 28.0, most: int = 36) -> DataFrame:
    """(a, b): links that connect lines as all pairs of corridor_shares for which adjacent(forth, back) holds connect them; of each pair of blocks of lines no more than it has lines."""
    numbers, met, width = _corridor_blocks(lines, key, order, metres, most)
    links = met.groupBy("_x", "_y").applyInArrow(blocks.line_links(width, adjacent), "a long, b long")
    named = lambda c: numbers.select(F.col("_line").alias(c), F.col(key).alias(f"_{c}"))
    return links.join(named("a"), "a").join(named("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))


def inside_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (array of struct lon, lat, closed) by counting crossings."""
    n = F.size(ring)

    def crossing(odd: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]) + a["lon"]
        return F.when(spans & (lon < at), ~odd).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), n - 2), F.lit(False), crossing)


def points_in_polygons(points: DataFrame, polygons: DataFrame, ring: str = "ring", point: tuple[str, str] = ("lat", "lon"), degrees: float = 0.05) -> DataFrame:
    """Pairs of points and the polygons whose ring holds them. Polygons are copied to the degree cells of their boxes."""
    ys, xs = F.transform(ring, lambda p: p["lat"]), F.transform(ring, lambda p: p["lon"])
    span = lambda v: F.sequence(F.floor(F.array_min(v) / degrees), F.floor(F.array_max(v) / degrees))
    poly = polygons.withColumn("_y", F.explode(span(ys))).withColumn("_x", F.explode(span(xs)))
    pts = points.withColumn("_py", F.floor(_c(point[0]) / degrees)).withColumn("_px", F.floor(_c(point[1]) / degrees))
    both = pts.join(poly, (F.col("_py") == F.col("_y")) & (F.col("_px") == F.col("_x"))).drop("_y", "_x", "_py", "_px")
    return both.filter(inside_ring(_c(point[0]), _c(point[1]), F.col(ring)))


def adopt_containing(buildings_of: DataFrame, key: str, polygon: str) -> DataFrame:
    """From point-polygon pairs: key, matches, and the polygon to adopt where exactly one holds the point (several: a choice, none: a review)."""
    out = buildings_of.groupBy(key).agg(F.count(polygon).alias("matches"), F.min(polygon).alias("only"))
    state = F.when(F.col("matches") == 1, "adopted").when(F.col("matches") > 1, "choice").otherwise("review")
    return out.select(key, "matches", state.alias("state"), F.when(F.col("matches") == 1, F.col("only")).alias("adopted"))


def measures(lines: DataFrame, key: str, order: str, radius: float = geo.RADIUS_DRAWING) -> DataFrame:
    """lines with step (metres from the vertex before) and measure (metres along the line)."""
    w = W.partitionBy(key).orderBy(order)
    step = F.coalesce(geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon", radius), F.lit(0.0))
    return lines.withColumn("step", step).withColumn("measure", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)))


def line_lengths(lines: DataFrame, key: str, order: str) -> DataFrame:
    return measures(lines, key, order).groupBy(key).agg(F.sum("step").alias("length"), F.count("*").alias("vertices"))


def bounds(vertices: DataFrame, key: str) -> DataFrame:
    """Box and vertex mean of each geometry; a closing vertex counts."""
    agg = [F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.avg("lon").alias("mean_lon"), F.avg("lat").alias("mean_lat")]
    return vertices.groupBy(key).agg(*agg)


def signed_area(vertices: DataFrame, key: str, order: str) -> DataFrame:
    """Half the sum of cross products over consecutive vertices; positive when counter-clockwise."""
    w = W.partitionBy(key).orderBy(order)
    cross = F.col("lon") * F.lead("lat").over(w) - F.lead("lon").over(w) * F.col("lat")
    return vertices.withColumn("cross", cross).groupBy(key).agg((F.sum("cross") / 2).alias("area"))


def points_at(measured: DataFrame, key: str, order: str, wanted: DataFrame, at: str = "at") -> DataFrame:
    """(wanted columns, lon, lat) on each line at the given measures; measures beyond the end are left out.

    Intervals of a line are joined by line; wanted(key, at, ...) should hold few points for each line.
    """
    w = W.partitionBy(key).orderBy(order)
    seg = measured.select(key, order, "lon", "lat", "measure", F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2"), F.lead("measure").over(w).alias("measure2"), F.row_number().over(w).alias("_rank"))
    # the first point of a line belongs to its first interval, any other to the interval that it ends or lies in
    held = (F.col(at) <= F.col("measure2")) & ((F.col(at) > F.col("measure")) | (F.col("_rank") == 1) & (F.col(at) == F.col("measure")))
    out = wanted.join(seg, key).filter(held)
    part = F.when(F.col("measure2") > F.col("measure"), (F.col(at) - F.col("measure")) / (F.col("measure2") - F.col("measure"))).otherwise(0.0)
    return out.select(*wanted.columns, (F.col("lon") + (F.col("lon2") - F.col("lon")) * part).alias("lon"), (F.col("lat") + (F.col("lat2") - F.col("lat")) * part).alias("lat"))


def arrow_places(lengths: DataFrame, key: str, spacing: float) -> DataFrame:
    """Measures at which a line carries arrows: one for each whole spacing, 1 to 7, evenly spread."""
    n = F.least(F.lit(7), F.greatest(F.lit(1), F.floor(F.col("length") / spacing))).cast("int")
    return lengths.select(key, "length", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("arrow")).withColumn("at", F.col("length") * F.col("arrow") / (F.col("n") + 1))


def densified(lines: DataFrame, key: str, order: str, spacing: float, most: int = 16) -> DataFrame:
    """Vertices with up to most points put evenly into each segment, no farther apart than spacing where that allows: key, order, part, lon, lat, original."""
    w = W.partitionBy(key).orderBy(order)
    ends = lines.select(key, order, "lon", "lat", F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2"))
    gap = geo.haversine("lat", "lon", "lat2", "lon2", geo.RADIUS_DRAWING)
    extra = F.coalesce(F.least(F.lit(most), F.greatest(F.lit(0), F.ceil(gap / spacing) - 1)), F.lit(0)).cast("int")
    rows = ends.withColumn("extra", extra).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("extra"))))
    share = F.col("part") / (F.col("extra") + 1)
    lon = F.when(F.col("part") == 0, F.col("lon")).otherwise(F.col("lon") + (F.col("lon2") - F.col("lon")) * share)
    lat = F.when(F.col("part") == 0, F.col("lat")).otherwise(F.col("lat") + (F.col("lat2") - F.col("lat")) * share)
    return rows.select(key, order, "part", lon.alias("lon"), lat.alias("lat"), (F.col("part") == 0).alias("original"))
