"""Order-dependent operators in rounds or in components, so that no table, drawing or site runs as one loop.

* Labels are placed in rounds over a grid. A label that is the best undecided one in every cell that it touches, and of its key, can't be kept out by an undecided one: it is placed, and what overlaps it, or comes after its key's last place,
  goes. Boxes that are placed don't overlap, so a cell places one label a round and no pairs are listed within a crowded cell.
* Rows that are resolved or upserted one after another meet only rows that they share a code with, or a name within some distance. Links along these give components; no row looks beyond its own. A component is read
  in order by one task, which holds what was kept of it, found by code and by cell, not its rows; components run side by side.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.scratch import stored
from . import graph, select


def placed_labels(labels: DataFrame, drawing: str = "drawing", most: int = 32, per_key: int = 2, cell: tuple[float, float] | None = None) -> DataFrame:
    """(drawing, label, seq) of the labels (drawing, label, priority, x, y, w, h, seq) that fit: by priority, then width, label and seq, each is placed unless it overlaps a placed one, its label has per_key places already, or the drawing has `most`.

    x and y are a box's centre; boxes that only touch don't overlap. (label, seq) is unique in a drawing. Cells are as large as the median box unless cell says so. Labels with a null coordinate or size are left out.
    """
    boxes = labels.select(drawing, "label", "priority", "x", "y", "w", "h", "seq").dropna(subset=["x", "y", "w", "h"])
    if cell is None:
        at = boxes.agg(F.percentile_approx("w", 0.5).alias("w"), F.percentile_approx("h", 0.5).alias("h")).first()
        cell = (max(at["w"] or 1.0, 1e-9), max(at["h"] or 1.0, 1e-9))
    span = lambda c, d, size: F.sequence(F.floor((F.col(c) - F.col(d) / 2) / size), F.floor((F.col(c) + F.col(d) / 2) / size))
    order = F.struct((-F.col("priority")).alias("p"), (-F.col("w")).alias("w"), F.col("label").alias("l"), F.col("seq").alias("s"))
    open_ = stored(boxes.withColumn("rank", order), "labels")
    taken: list[DataFrame] = []
    counts = None  # places of each label so far
    while True:
        cells = open_.withColumn("_cx", F.explode(span("x", "w", cell[0]))).withColumn("_cy", F.explode(span("y", "h", cell[1])))
        best = cells.groupBy(drawing, "_cx", "_cy").agg(F.min("rank").alias("_best"))
        wins = cells.join(best, [drawing, "_cx", "_cy"]).groupBy(drawing, "label", "seq").agg(F.min((F.col("rank") == F.col("_best")).cast("int")).alias("_wins"))
        key = open_.groupBy(drawing, "label").agg(F.min("rank").alias("_first"))
        won = open_.join(wins.filter("_wins = 1"), [drawing, "label", "seq"]).join(key, [drawing, "label"]).filter(F.col("rank") == F.col("_first"))
        new = stored(won.select(*open_.columns), "placed")
        if new.isEmpty():
            break
        taken.append(new.select(drawing, "label", "seq", "rank"))
        placed = new.groupBy(drawing, "label").agg(F.count("*").alias("_n"))
        counts = placed if counts is None else counts.unionByName(placed).groupBy(drawing, "label").agg(F.sum("_n").alias("_n"))
        counts = stored(counts, "counts")
        mine = new.withColumn("_cx", F.explode(span("x", "w", cell[0]))).withColumn("_cy", F.explode(span("y", "h", cell[1]))).select(drawing, "_cx", "_cy", *[F.col(c).alias(f"n_{c}") for c in ("x", "y", "w", "h")])
        near = cells.join(mine, [drawing, "_cx", "_cy"])
        hit = near.filter((F.abs(F.col("x") - F.col("n_x")) * 2 < F.col("w") + F.col("n_w")) & (F.abs(F.col("y") - F.col("n_y")) * 2 < F.col("h") + F.col("n_h"))).select(drawing, "label", "seq")
        rest = open_.join(new.select(drawing, "label", "seq"), [drawing, "label", "seq"], "left_anti").join(hit, [drawing, "label", "seq"], "left_anti")
        open_ = stored(rest.join(counts.filter(F.col("_n") >= per_key), [drawing, "label"], "left_anti"), "labels")
    if not taken:
        return boxes.select(drawing, "label", "seq").limit(0)
    every = functools.reduce(DataFrame.unionByName, taken)
    return select.ranked(every, drawing, "rank", most).select(drawing, "label", "seq") if most is not None else every.select(drawing, "label", "seq")


def place_links(rows: DataFrame, key: str, same: list[str], metres: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Links (a, b) between keys such that rows equal in the columns `same` and at most metres apart are connected. No pairs: rows of a cell are linked to its first, and firsts of neighbouring cells to each other, so more may be connected, never less."""
    row, col = geo.cell(lat, lon, metres)
    inside = stored(rows.select(F.col(key).alias("node"), *same, row.cast("long").alias("_row"), col.cast("long").alias("_col"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).dropna(), "cells")
    hubs = inside.groupBy(*same, "_row", "_col").agg(F.min("node").alias("hub"))
    own = inside.join(hubs, [*same, "_row", "_col"]).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    # a cell of the next row has another width: its columns from those of this cell's edges
    step = metres / geo.DEGREE_LAT
    width = geo._cell_width(F.col("_row"), step)
    near = []
    for d in (0, 1):
        other = geo._cell_width(F.col("_row") + d, step)
        columns = F.sequence(F.floor((F.col("_col") * width) / other) - 2, F.floor(((F.col("_col") + 1) * width) / other) + 2)
        near.append(hubs.withColumn("_to", F.explode(columns)).select(*same, F.col("hub").alias("a"), (F.col("_row") + d).alias("_row"), F.col("_to").cast("long").alias("_col")))
    across = near[0].unionByName(near[1]).join(hubs, [*same, "_row", "_col"]).select("a", F.col("hub").alias("b")).filter("a <> b")
    return own.unionByName(across)


def code_links(rows: DataFrame, key: str, codes: list[Column]) -> DataFrame:
    """Links (a, b) between keys that share any of the codes (null or empty ones connect nothing): each to the first with the code."""
    spread = rows.select(F.col(key).alias("a"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.cast("string").alias("v")) for i, c in enumerate(codes)])).alias("c")).filter("c.v <> ''")
    return spread.join(spread.groupBy("c").agg(F.min("a").alias("b")), "c").select("a", "b")


def in_order(rows: DataFrame, links: DataFrame, key: str, order: list[str], fold: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """What fold makes of each component's rows in order. key is unique and tells rows to links (a, b); fold gets one component's rows one after another and should hold only what it keeps of them."""
    labels = graph.components(links).select(F.col("node").alias(key), F.col("label").alias("_component"))
    whole = rows.join(labels, key, "left").withColumn("_component", F.coalesce("_component", key))
    columns = schema.replace(",", " ").split()[::2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records():
            for b in batches:
                yield from b.to_dict("records")

        out, rest = [], records()
        ahead = next(rest, None)
        while ahead is not None:
            component = ahead["_component"]

            def own():
                nonlocal ahead
                while ahead is not None and ahead["_component"] == component:
                    row, ahead = ahead, next(rest, None)
                    yield row

            for made in fold(own()):
                out.append(made)
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    return whole.repartition("_component").sortWithinPartitions("_component", *order).mapInPandas(run, schema)


def metres_between(lat: float, lon: float, lat2: float, lon2: float) -> float:
    from math import atan2, cos, radians, sin, sqrt

    a, b = radians(lat), radians(lat2)
    h = sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin(radians(lon2 - lon) / 2) ** 2
    return 2 * geo.RADIUS * atan2(sqrt(h), sqrt(max(0.0, 1 - h)))


class Kept:
    """Rows kept so far, in the order in which they came, found by codes and by name and mode within some metres."""

    def __init__(self, metres: float):
        self.metres, self.rows = metres, []
        self.codes: dict[object, list[int]] = {}
        self.places: dict[tuple, set[int]] = {}
        self.row_height = metres / geo.DEGREE_LAT

    def _cell(self, row: dict, step: int = 0, side: int = 0) -> tuple:
        from math import cos, floor, radians

        y = floor(row["lat"] / self.row_height) + step
        width = self.row_height / max(0.01, cos(radians(min(89.0, max(abs(y), abs(y + 1)) * self.row_height))))
        return (row["name"], row["mode"], y, floor(row["lon"] / width) + side)

    def _located(self, row: dict) -> bool:
        return bool(row["name"]) and row["lat"] == row["lat"] and row["lon"] == row["lon"] and row["lat"] is not None and row["lon"] is not None

    def add(self, row: dict, codes: list) -> int:
        self.rows.append(row)
        self.index(len(self.rows) - 1, codes)
        return len(self.rows) - 1

    def index(self, i: int, codes: list) -> None:
        for c in codes:
            if i not in (at := self.codes.setdefault(c, [])):
                at.append(i)
        if self._located(self.rows[i]):
            self.places.setdefault(self._cell(self.rows[i]), set()).add(i)

    def moved(self, i: int, old: dict, codes: list) -> None:
        if self._located(old):
            self.places.get(self._cell(old), set()).discard(i)
        self.index(i, codes)

    def by_code(self, codes: list) -> int | None:
        return min((i for c in codes for i in self.codes.get(c, ())), default=None)

    def near(self, row: dict, inclusive: bool) -> list[int]:
        """Kept rows of the row's name and mode within the distance, in order."""
        if not self._located(row):
            return []
        cells = {self._cell(row, step, side) for step in (-1, 0, 1) for side in (-2, -1, 0, 1, 2)}
        found = {i for c in cells for i in self.places.get(c, ())}
        far = lambda i: metres_between(row["lat"], row["lon"], self.rows[i]["lat"], self.rows[i]["lon"])
        return sorted(i for i in found if (d := far(i)) < self.metres or inclusive and d == self.metres)


def resolved_stations(stations: DataFrame, site: str = "site_id", metres: float = 300.0) -> DataFrame:
    """Greedy resolution of stations (site, seq, name, mode, code, lat, lon, richness, straight): in order of seq, one joins the first kept row with its code, or with its name and mode within `metres`; the richer
    row's values win, the first code and the smaller distance are kept. (site, seq, code, straight, members) for each kept row. Later rows are compared with what earlier ones became; sites are independent, seq is unique in a site.

    An empty or null code or name matches nothing. A kept row's values are those of rows that joined it, so what a row may join lies in its own component of rows with a code, or a name and mode nearby, in common.
    """
    keyed = stored(stations.withColumn("_id", F.concat_ws(":", F.col(site).cast("string"), F.col("seq").cast("string"))), "stations")
    coded = F.when(F.coalesce(F.col("code"), F.lit("")) != "", F.concat_ws(":", F.col(site).cast("string"), "code"))
    links = code_links(keyed, "_id", [coded]).unionByName(place_links(keyed.filter("name <> ''"), "_id", [site, "name", "mode"], metres))

    def fold(rows: Iterator[dict]) -> Iterator[dict]:
        kept = Kept(metres)
        for r in rows:
            codes = [r["code"]] if r["code"] else []
            first = min([i for i in (kept.by_code(codes), next(iter(kept.near(r, True)), None)) if i is not None], default=None)
            if first is None:
                kept.add({**r, "members": 1}, codes)
                continue
            k = kept.rows[first]
            old = dict(k)
            if r["richness"] > k["richness"]:
                k.update({c: r[c] for c in ("name", "mode", "lat", "lon", "richness")})
            k.update(code=k["code"] or r["code"], straight=min(k["straight"], r["straight"]), members=k["members"] + 1)
            kept.moved(first, old, [k["code"]] if k["code"] else [])
        for k in kept.rows:
            yield {c: k[c] for c in (site, "seq", "code", "straight", "members")}

    return in_order(keyed, links, "_id", ["seq"], fold, f"{site} long, seq long, code string, straight double, members long")


def upserted(library: DataFrame, proposed: DataFrame, ids: list[str], metres: float = 500.0) -> DataFrame:
    """Sequential upsert: (action, met, target, seq, key, name, mode, lat, lon, ids...) with a row for each proposed one, in order of seq: what it met and what the library then holds there.

    Both tables have key, seq, name, mode, lat, lon and ids; library rows come first, by seq. A proposed row meets the library's row with its key; else the first that shares an identifier of a kind (not empty); else the only one
    with its name and mode less than metres away (several: none); else it is inserted. It meets what earlier rows left: inserted rows, and values that earlier rows laid over (a stated value, neither null nor empty, replaces). met and target tell that row: library or
    proposed, and its seq; both null for an insertion. Keys are unique in the library. A null or empty key meets by identifiers and place alone.
    """
    cols = ["key", "name", "mode", "lat", "lon", *ids]
    side = lambda df, n: df.select("seq", F.lit(n).alias("_side"), *cols)
    both = side(library, 0).unionByName(side(proposed, 1)).withColumn("_id", F.concat_ws(":", F.col("_side").cast("string"), F.col("seq").cast("string")))
    both = stored(both, "upserts")
    links = code_links(both, "_id", [F.concat(F.lit("key:"), F.when(F.col("key") != "", F.col("key"))), *[F.col(c) for c in ids]]).unionByName(place_links(both.filter("name <> ''"), "_id", ["name", "mode"], metres))

    def codes_of(r: dict) -> list:
        return [(c, r[c]) for c in ids if r[c]]

    def fold(rows: Iterator[dict]) -> Iterator[dict]:
        kept, keys = Kept(metres), {}
        for r in rows:
            own = {c: r[c] for c in cols} | {"seq": r["seq"], "side": r["_side"]}
            if r["_side"] == 0:
                at = kept.add(own, codes_of(r))
                if r["key"]:
                    keys[r["key"]] = at
                continue
            at = keys.get(r["key"]) if r["key"] else None
            action = "key"
            if at is None:
                at, action = kept.by_code(codes_of(r)), "identifier"
            if at is None and len(near := kept.near(r, False)) == 1:
                at, action = near[0], "place"
            if at is None:
                at, action, met, target = kept.add(own, codes_of(r)), "insert", None, None
                if r["key"]:
                    keys[r["key"]] = at
            else:
                k = kept.rows[at]
                old, met, target = dict(k), "proposed" if k["side"] else "library", k["seq"]
                k.update({c: r[c] for c in cols if c != "key" and r[c] is not None and r[c] != "" and r[c] == r[c]})
                kept.moved(at, old, codes_of(k))
                for c in set(codes_of(old)) - set(codes_of(k)):
                    kept.codes[c].remove(at)
            k = kept.rows[at]
            yield {"action": action, "met": met, "target": target, "seq": r["seq"]} | {c: k[c] for c in cols}

    types = ", ".join(f"{c} {'double' if c in ('lat', 'lon') else 'string'}" for c in cols)
    return in_order(both, links, "_id", ["_side", "seq"], fold, f"action string, met string, target long, seq long, {types}")
