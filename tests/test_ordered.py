"""Nearest neighbours at any distance, ordered scans, placement and resolution in rounds, rings and digest trees against loops over all rows."""

import hashlib
import math
import random
from itertools import groupby

import pandas as pd
import pytest
from pyspark.sql import functions as F

from catchment.operators import digests, nearest, rings, rounds, scans
from catchment.streaming import pacing

# --- nearest neighbours


def wrapped(x):
    return x - 360 * round(x / 360)


def metres(p, q):
    (_, lat, lon), (_, x, y, x2, y2) = p, q
    kx, ky = 111320 * math.cos(math.radians(lat)), 110540
    x, y, x2, y2 = wrapped(x - lon), y - lat, wrapped(x - lon) + wrapped(x2 - x), y2 - lat
    best = math.inf
    for turn in (-360, 0, 360):
        ax, ay, dx, dy = (x + turn) * kx, y * ky, (x2 - x) * kx, (y2 - y) * ky
        square = dx * dx + dy * dy
        k = min(1, max(0, (-ax * dx - ay * dy) / square)) if square > 0 else 0
        best = min(best, math.hypot(ax + k * dx, ay + k * dy))
    return best


@pytest.fixture(scope="module")
def world():
    rng = random.Random(1)
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(120)]
    points += [(200, 89.99, 10.0), (201, -90.0, 0.0), (202, 10.0, 179.999), (203, 10.0, -179.999), (204, 90.0, 180.0)] + [(300 + i, 51.5 + rng.uniform(-0.05, 0.05), -0.1 + rng.uniform(-0.05, 0.05)) for i in range(60)]
    lines = []
    for i in range(90):
        x, y, d = (rng.uniform(-180, 180), rng.uniform(-80, 80), 3) if i < 40 else (-0.1 + rng.uniform(-0.05, 0.05), 51.5 + rng.uniform(-0.05, 0.05), 0.01)
        lines.append((i, x, y, x + rng.uniform(-d, d), max(-90, min(90, y + rng.uniform(-d, d)))))
    return points, lines + [(100, 179.99, 10.0, -179.9, 10.05), (101, -179.0, 10.0, -179.0, 10.0)]


def test_nearest_at_any_distance(spark, world):
    points, lines = world
    p, g = spark.createDataFrame([*points, (999, None, 1.0)], "id long, p_lat double, p_lon double"), spark.createDataFrame([*lines, (500, None, 1.0, 1.0, 1.0)], "line long, lon double, lat double, lon2 double, lat2 double")
    got = {r["id"]: r for r in nearest.nearest(p, g, "id", name="line").collect()}
    assert len(got) == len(points)
    for q in points:
        want = min((metres(q, line), line[0]) for line in lines)
        assert got[q[0]]["nearest"] == pytest.approx(want[0], rel=1e-6, abs=1e-6)
    kinds = nearest.nearest(p, g.withColumn("kind", F.col("line") % 3), "id", by=["kind"]).collect()
    assert len(kinds) == 3 * len(points)
    by_id = {q[0]: q for q in points}
    for r in kinds:
        assert r["nearest"] == pytest.approx(min(metres(by_id[r["id"]], x) for x in lines if x[0] % 3 == r["kind"]), rel=1e-6, abs=1e-6)
    assert nearest.nearest(p, g.limit(0), "id").count() == nearest.nearest(p.limit(0), g, "id").count() == 0


# --- scans


@pytest.fixture(scope="module")
def traces(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.random() < 0.3, rng.uniform(0, 0.01), 51 + rng.uniform(0, 0.01)) for k, n in enumerate((1, 2, 50, 333)) for i in range(n)]
    rng.shuffle(rows)
    lines = {k: sorted(g, key=lambda r: r[1]) for k, g in groupby(sorted(rows), key=lambda r: r[0])}
    return spark.createDataFrame(rows, "route_id long, seq long, own boolean, lon double, lat double").repartition(4), lines


def chunks_of(k, rows, most, original):
    out, at = [], 0
    while at < len(rows) - 1:
        to = min(at + most - 1, len(rows) - 1)
        back = to
        while original and back > at and to < len(rows) - 1 and not rows[back][2]:
            back -= 1
        to = back if back > at else to
        out.append((k, len(out), rows[at][1], rows[to][1], to - at + 1))
        at = to
    return out


@pytest.mark.parametrize(("most", "original"), [(40, "own"), (2, "own"), (5, None)])
def test_chunks_by_doubling(traces, most, original):
    df, lines = traces
    got = sorted(tuple(r) for r in scans.overlapping_chunks(df, most, original=original).collect())
    assert got == sorted(c for k, rows in lines.items() for c in chunks_of(k, rows, most, original))


def test_chunks_of_no_rows_and_of_one_vertex_at_most(traces):
    df, _ = traces
    assert scans.overlapping_chunks(df.limit(0), 5).count() == scans.overlapping_chunks(df.filter("route_id = 0"), 5).count() == 0
    with pytest.raises(ValueError):
        scans.overlapping_chunks(df, 1)


def haversine(a, b):
    p, q = math.radians(a[4]), math.radians(b[4])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * 6371008.8 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize(("piece", "tolerance"), [(4, 300.0), (1, 100.0), (7, 500.0)])
def test_stitching_by_scan(traces, piece, tolerance):
    df, lines = traces
    want = []
    for k, rows in lines.items():
        parts = [rows[i : i + piece] for i in range(0, len(rows), piece)]
        end, turned, gaps = parts[0][-1], 0, 0
        for p in parts[1:]:
            straight, back = haversine(end, p[0]), haversine(end, p[-1])
            if back + 0.5 < straight:
                turned, p, straight = turned + 1, p[::-1], back
            gaps += straight > tolerance
            end = p[-1]
        want.append((k, len(parts), turned, gaps))
    assert sorted(tuple(r) for r in scans.stitched(df, piece, tolerance=tolerance).collect()) == want
    assert scans.stitched(df.limit(0)).count() == 0


def starts_of(jobs, gap=1000):
    out, last = {}, {}
    for key, job, at in sorted(jobs, key=lambda j: (j[0], j[2] or 0, j[1])):
        last[key] = max(at or 0, last[key] + gap) if key in last else at or 0
        out[key, job] = last[key]
    return out


@pytest.fixture(scope="module")
def jobs():
    rng = random.Random(8)
    return [(k, i, rng.randint(0, 90_000)) for k in "ab" for i in range(120)] + [("c", 1, 7), ("c", 2, 7)]


def test_serial_queue(spark, jobs):
    some = [*jobs, ("a", 500, None)]
    df = spark.createDataFrame(some, "k string, job long, at long").repartition(5)
    got = {(r["k"], r["job"]): r["start"] for r in scans.serial_starts(df, "k", "at", [F.coalesce("at", F.lit(0)), F.col("job")]).collect()}
    assert got == starts_of(some)
    assert scans.serial_starts(df.limit(0), "k", "at", [F.col("job")]).count() == 0


def test_serial_queue_of_a_shuffled_stream(spark, jobs, tmp_path):
    """Rows within the watermark's delay come in any order, in several batches; a last row far ahead moves the watermark past all."""
    rng = random.Random(3)
    when = lambda ms: pd.Timestamp(ms, unit="ms").to_pydatetime()
    given = sorted(jobs, key=lambda j: j[2] + rng.randint(0, 8000))
    schema = "k string, job long, at timestamp"
    for n, a in enumerate(range(0, len(given), 80)):
        rows = [(k, j, when(ms)) for k, j, ms in given[a : a + 80]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{n}")
    end = 10**9
    spark.createDataFrame([("z", 0, when(end))], schema).coalesce(1).write.parquet(f"{tmp_path}/in8")
    spark.createDataFrame([("z", 1, when(end + 1))], schema).coalesce(1).write.parquet(f"{tmp_path}/in9")
    import os
    import shutil
    import time

    os.makedirs(f"{tmp_path}/in")
    for n, folder in enumerate(sorted(f for f in os.listdir(tmp_path) if f != "in")):
        part = next(f for f in os.listdir(f"{tmp_path}/{folder}") if f.endswith(".parquet"))
        shutil.copy(f"{tmp_path}/{folder}/{part}", f"{tmp_path}/in/{n}.parquet")
        os.utime(f"{tmp_path}/in/{n}.parquet", (time.time() - 1000 + n, time.time() - 1000 + n))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = pacing.serial_starts_stream(stream, "k", "at", "job")
    q = out.writeStream.outputMode("append").format("memory").queryName("serial").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["key"], r["job"]): r["start_ms"] for r in spark.table("serial").collect() if r["key"] != "z"}
    assert got == starts_of(jobs)


def test_running_values_and_places(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None, "b"]), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(7)
    got = {r["i"]: r for r in scans.placed(scans.scanned(df, "k", [F.col("i")], sums={"total": F.col("v")}, maxima={"top": F.col("v")}), "k", [F.col("i")], "place").collect()}
    for k in ("a", "b", None):
        own = [r for r in rows if r[0] == k]
        for n, (_, i, _) in enumerate(own):
            seen = [v for _, _, v in own[: n + 1] if v is not None]
            assert (got[i]["total"], got[i]["top"], got[i]["place"]) == (sum(seen), max(seen, default=None), n)


# --- rounds and components


LABELS = "drawing long, label string, priority long, x double, y double, w double, h double, seq long"


def labels_of(rng, n, span, names, drawings):
    return [(rng.randrange(drawings), f"n{rng.randrange(names)}", rng.randrange(4), rng.uniform(0, span), rng.uniform(0, span), rng.uniform(5, 40), rng.uniform(3, 8), i) for i in range(n)]


@pytest.mark.parametrize(("args", "most", "per_key"), [((400, 300, 30, 3), 32, 2), ((250, 90, 300, 1), None, 1)])
def test_labels_in_rounds(spark, args, most, per_key):
    rows = labels_of(random.Random(3), *args)
    df = spark.createDataFrame([*rows, (0, "far", 1, None, 1.0, 5.0, 5.0, 10_000)], LABELS)
    want = []
    for d, own in groupby(sorted(rows, key=lambda r: (r[0], -r[2], -r[5], r[1], r[7])), key=lambda r: r[0]):
        kept = []
        for r in own:
            if most is not None and len(kept) >= most or sum(k[1] == r[1] for k in kept) >= per_key:
                continue
            if not any(abs(r[3] - k[3]) * 2 < r[5] + k[5] and abs(r[4] - k[4]) * 2 < r[6] + k[6] for k in kept):
                kept.append(r)
        want += [(d, k[1], k[7]) for k in kept]
    assert sorted(tuple(r) for r in rounds.placed_labels(df, most=most, per_key=per_key).collect()) == sorted(want)
    assert rounds.placed_labels(df.limit(0)).count() == 0


STATIONS = "site_id long, seq long, name string, mode string, code string, lat double, lon double, richness long, straight double"


def resolved(rows):
    out = []
    for site in sorted({r[0] for r in rows}):
        kept = []
        for r in sorted((r for r in rows if r[0] == site), key=lambda r: r[1]):
            r = dict(zip(("site", "seq", "name", "mode", "code", "lat", "lon", "rich", "straight"), r))
            near = lambda k: r["name"] and r["name"] == k["name"] and r["mode"] == k["mode"] and rounds.metres_between(r["lat"], r["lon"], k["lat"], k["lon"]) <= 300  # noqa: B023, E731
            k = next((k for k in kept if r["code"] and r["code"] == k["code"] or near(k)), None)
            if k is None:
                kept.append(r | {"members": 1})
                continue
            if r["rich"] > k["rich"]:
                k.update({c: r[c] for c in ("name", "mode", "lat", "lon", "rich")})
            k.update(code=k["code"] or r["code"], straight=min(k["straight"], r["straight"]), members=k["members"] + 1)
        out += [(site, k["seq"], k["code"], k["straight"], k["members"]) for k in kept]
    return sorted(out, key=str)


def test_resolution_in_components(spark):
    """Chains in which a row meets a later one only by what a third made of it."""
    rng = random.Random(6)
    rows = [(rng.randrange(4), i, rng.choice(["a", "b", "", None]), rng.choice(["R", "B"]), rng.choice(["x1", "x2", None, "x4"]) if rng.random() < 0.5 else "", 51 + rng.uniform(0, 0.02), rng.uniform(0, 0.02), rng.randrange(5), rng.uniform(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, STATIONS).repartition(3)
    assert sorted((tuple(r) for r in rounds.resolved_stations(df).collect()), key=str) == resolved(rows)
    assert rounds.resolved_stations(df.limit(0)).count() == 0


def test_one_site_with_many_rows(spark):
    n = 30_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("site_id"), F.col("id").alias("seq"), F.concat(F.lit("s"), (F.col("id") % 5000).cast("string")).alias("name"), F.lit("R").alias("mode"), F.lit("").alias("code"), (51 + (F.col("id") % 5000) / 1000).alias("lat"), F.lit(0.0).alias("lon"), F.lit(1).cast("long").alias("richness"), (F.col("id") * 1.0).alias("straight"))
    got = rounds.resolved_stations(df)
    assert got.agg(F.count("*").alias("n"), F.sum("members").alias("m")).first() == (5000, n)


UPSERTS = "key string, seq long, name string, mode string, lat double, lon double, crs string, tfl string"
COLUMNS = UPSERTS.replace(",", "").split()[::2]


def upserted(library, proposed):
    kept, out = [dict(zip(COLUMNS, r)) | {"side": "library"} for r in library], []
    for r in proposed:
        r = dict(zip(COLUMNS, r))
        near = [k for k in kept if r["name"] and k["name"] == r["name"] and k["mode"] == r["mode"] and rounds.metres_between(r["lat"], r["lon"], k["lat"], k["lon"]) < 500]
        found = [next((k for k in kept if r["key"] and k["key"] == r["key"]), None), next((k for k in kept if any(r[c] and r[c] == k[c] for c in ("crs", "tfl"))), None), near[0] if len(near) == 1 else None]
        action, k = next(((a, k) for a, k in zip(("key", "identifier", "place"), found) if k is not None), ("insert", None))
        met = (None, None)
        if k is None:
            k = r | {"side": "proposed"}
            kept.append(k)
        else:
            met = (k["side"], k["seq"])
            k.update({c: r[c] for c in COLUMNS if c not in ("key", "seq") and r[c] not in (None, "")})
        out.append((action, *met, r["seq"], *(k[c] or None for c in ("key", "name", "mode", "lat", "lon", "crs", "tfl"))))
    return out


def test_upsert_meets_what_earlier_rows_left(spark):
    rng = random.Random(4)
    make = lambda i, key: (key, i, rng.choice(["a", "b", ""]), rng.choice(["R", "B"]), 51 + rng.uniform(0, 0.03), rng.uniform(0, 0.03), rng.choice(["", None, f"c{rng.randrange(30)}"]), rng.choice(["", f"t{rng.randrange(30)}", None]))
    library, proposed = [make(i, f"k{i}") for i in range(30)], [make(i, rng.choice([f"k{rng.randrange(60)}", "", None])) for i in range(150)]
    got = rounds.upserted(spark.createDataFrame(library, UPSERTS), spark.createDataFrame(proposed, UPSERTS).repartition(3), ["crs", "tfl"])
    rows = sorted((tuple(v or None if isinstance(v, str) else v for v in r) for r in got.collect()), key=lambda r: r[3])
    want = upserted(library, proposed)
    assert rows == want
    assert {w[0] for w in want} == {"key", "identifier", "place", "insert"} and any(w[1] == "proposed" for w in want)
    assert rounds.upserted(spark.createDataFrame(library, UPSERTS), spark.createDataFrame([], UPSERTS), ["crs", "tfl"]).count() == 0


# --- rings


def side(a, b, c):
    v = (b[1] - a[1]) * (c[0] - b[0]) - (b[0] - a[0]) * (c[1] - b[1])
    return 0 if abs(v) < 1e-12 else 1 if v > 0 else 2


def crossings(ring):
    n = len(ring) - 1
    cross = lambda a, b, c, d: side(a, b, c) != side(a, b, d) and side(c, d, a) != side(c, d, b)
    return {(i, j) for i in range(n) for j in range(i + 2, n) if not (i == 0 and j == n - 1) and cross(ring[i], ring[i + 1], ring[j], ring[j + 1])}


def rows_of(polygons):
    return [(k, i, None if x is None else float(x), None if y is None else float(y)) for k, ring in enumerate(polygons) for i, (x, y) in enumerate(ring)]


RING = "ring long, place long, lon double, lat double"


def test_crossings_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(rings, "CELL_PIECES", 4)
    rng = random.Random(7)
    polygons = []
    for k in range(25):
        n = rng.randint(3, 40)
        ring = [(rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(n)] if k % 2 else [(math.cos(i * 6.28 / n) * rng.uniform(0.5, 1), math.sin(i * 6.28 / n) * rng.uniform(0.5, 1)) for i in range(n)]
        polygons.append([*ring, ring[0]])
    polygons += [[(0, 0), (2, 0), (1, 0), (1, 1), (0, 0)], [(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)], [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]]
    got = {}
    for r in rings.crossings(spark.createDataFrame(rows_of(polygons), RING).repartition(4), "ring", "place").collect():
        got.setdefault(r["ring"], set()).add((r["i"], r["j"]))
    assert got == {k: c for k, ring in enumerate(polygons) if (c := crossings(ring))}


def test_ring_verdicts(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    polygons = [square, square[:3], square[:4], [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)], [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (0.0, 0.0)], [(x * 200, y) for x, y in square], [(0.0, 0.0), (1.0, None), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]
    got = {r["ring"]: r["reason"] for r in rings.checked(spark.createDataFrame(rows_of(polygons), RING), "ring", "place").collect()}
    assert got == dict(enumerate(["", "short", "open", "self-intersecting", "flat", "out of range", "malformed"]))
    assert rings.checked(spark.createDataFrame([], RING), "ring", "place").count() == 0


def test_long_ring(spark):
    n = 100_000
    angle = F.col("id") * 2 * math.pi / n
    wave = 1 + 0.1 * F.sin(F.col("id") * 0.01)
    star = spark.range(n).select(F.lit(1).cast("long").alias("ring"), F.col("id").alias("place"), (F.cos(angle) * wave).alias("lon"), (F.sin(angle) * wave).alias("lat"))
    closed = star.unionByName(star.filter("place = 0").withColumn("place", F.lit(n).cast("long")))
    assert rings.crossings(closed, "ring", "place").count() == 0
    swapped = closed.withColumn("place", F.when(F.col("place") == 500, 501).when(F.col("place") == 501, 500).otherwise(F.col("place")))
    assert [r[1:] for r in rings.crossings(swapped, "ring", "place").collect()] == [(499, 501)]


# --- digests


def test_trees_find_what_changed(spark):
    n = 3000
    a = spark.range(n).select(F.col("id").alias("key"), (F.col("id") % 7).cast("string").alias("v"), F.lit(None).cast("string").alias("w"))
    b = a.filter("key <> 17").withColumn("v", F.when(F.col("key") == 40, "other").otherwise(F.col("v"))).withColumn("w", F.when(F.col("key") == 41, "").otherwise(F.col("w")))
    b = b.unionByName(spark.createDataFrame([(n + 5, "x", None), (50, "1", None)], "key long, v string, w string"))
    assert sorted(tuple(r) for r in digests.changed(a, b, "key", ["v", "w"], levels=2).collect()) == [(17, "removed"), (40, "changed"), (41, "changed"), (50, "changed"), (n + 5, "added")]
    assert digests.changed(a, a.repartition(5), "key", ["v", "w"]).count() == 0


def test_tree_equals_one_made_by_hand(spark):
    df = spark.range(700).select(F.col("id").alias("key"), F.col("id").cast("string").alias("v"))
    leaves = {r["place"]: r["digest"] for r in digests.keyed_digests(df, "key", ["v"]).collect()}
    sha = lambda parts: hashlib.sha256(",".join(parts).encode()).hexdigest()
    at, levels, want = dict(leaves), 2, {}
    for level in (2, 1, 0):
        groups = groupby(sorted(at), key=lambda p: p[: 2 * level])  # noqa: B023
        at = {path: sha([at[p] for p in members]) for path, members in ((k, list(g)) for k, g in groups)}
        want |= {(level, p): d for p, d in at.items()}
    got = {(r["level"], r["path"]): r["digest"] for r in digests.tree(df, "key", ["v"], levels).collect()}
    assert got == want
    empty = digests.tree(df.limit(0), "key", ["v"]).collect()
    assert [(r["level"], r["path"], r["digest"], r["keys"]) for r in empty] == [(0, "", hashlib.sha256(b"").hexdigest(), 0)]


def test_chunks_broadcast_no_rows(spark):
    """Stored places compress to a few bytes a row, so their files' size says little of what a broadcast would hold."""
    df = spark.range(20_000).select((F.col("id") % 300).alias("route_id"), F.col("id").alias("seq"), (F.col("id") % 5 < 2).alias("own"))
    runs = scans.overlapping_chunks(df, 40, original="own")
    assert "Broadcast" not in runs._jdf.queryExecution().executedPlan().toString()
    assert runs.groupBy("route_id").count().count() == 300
