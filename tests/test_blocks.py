"""Points against segments in blocks: equal to loops over all pairs, and no copied rows are broadcast."""

import itertools
import math
import random

import pytest

from catchment import registry
from catchment.operators import graph, nearest, spatial

LINE = "route_id long, seq long, lon double, lat double"


@pytest.mark.parametrize("name", ["a13_order_kept", "a14_coverage"])
def test_copies_to_cells_are_not_broadcast(spark, data, name):
    """The planner doesn't know how many copies explode makes."""
    plan = registry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = itertools.takewhile(lambda x: depth(x) > depth(line), plan[i + 1 :])  # noqa: B023
            assert not any("Generate explode" in x for x in below)


def to_segment(p, a, b):
    c = math.cos(math.radians(p[3]))
    x = lambda q: (q[2] - p[2]) * 111320 * c
    y = lambda q: (q[3] - p[3]) * 110540
    dx, dy = x(b) - x(a), y(b) - y(a)
    square = dx * dx + dy * dy
    k = min(1, max(0, (-x(a) * dx - y(a) * dy) / square)) if square > 0 else 0
    return math.hypot(x(a) + k * dx, y(a) + k * dy), k


@pytest.mark.parametrize("whole", [1024, 20])
def test_places_on_lines_equal_all_pairs(spark, monkeypatch, whole):
    monkeypatch.setattr(spatial, "WHOLE_LINE", whole)
    rng = random.Random(3)
    lines = [(r, i, -0.1 + rng.uniform(0, 0.02), 51.5 + rng.uniform(0, 0.01)) for r, n in ((1, 2), (2, 19), (3, 60), (5, 1)) for i in range(n)]
    points = [(r, i, -0.11 + rng.uniform(0, 0.04), 51.495 + rng.uniform(0, 0.02)) for r in (1, 2, 3, 4, 5) for i in range(50)] + [(3, 99, None, 51.5)]
    got = spatial.matched_measures(spark.createDataFrame(points, LINE).withColumnRenamed("seq", "place"), spark.createDataFrame(lines, LINE).repartition(3), "route_id", "seq", 150.0).collect()
    assert len(got) == len(points)
    found = {(r["route_id"], r["place"]): (r["distance"], r["measure"]) for r in got}
    near = 0
    for p in points:
        own, measure, best = [q for q in lines if q[0] == p[0]], 0.0, None
        for a, b in zip(own, own[1:]) if p[2] is not None else ():
            h = math.sin(math.radians(b[3] - a[3]) / 2) ** 2 + math.cos(math.radians(a[3])) * math.cos(math.radians(b[3])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
            step = 2 * 6371008.8 * math.atan2(math.sqrt(h), math.sqrt(1 - h))
            d, k = to_segment(p, a, b)
            if d <= 150 and (best is None or d < best[0]):
                best = (d, measure + k * step)
            measure += step
        near += best is not None
        assert found[p[:2]] == (pytest.approx(best, abs=1e-5) if best else (None, None))
    assert near > 20


def test_crowded_cells_are_filed_anew(spark, monkeypatch):
    """Long lines over one another, seen from within, from afar and across the 180th meridian: the same distances, from a small share of all pairs."""
    rng = random.Random(11)
    lines = [(i, x, y, x + rng.uniform(-0.02, 0.02), y + rng.uniform(-0.02, 0.02)) for i in range(1500) for x, y in [(-0.1 + rng.uniform(0, 0.02), 51.5 + rng.uniform(0, 0.02))]]
    lines += [(2000, 179.99, 10.0, -179.9, 10.3), (2001, -0.09, 51.51, -0.09, 51.51), (2002, -0.12, 51.5, -0.05, 51.5)]
    spots = [(i, 51.5 + rng.uniform(-0.3, 0.3), -0.1 + rng.uniform(-0.3, 0.3)) for i in range(60)] + [(100 + i, 51.5 + rng.uniform(0, 0.02), -0.1 + rng.uniform(0, 0.02)) for i in range(40)] + [(200, 10.1, 179.999), (201, 51.51, -0.09)]
    points = spots + [(1000 + i, lat, lon) for i, lat, lon in spots]  # places that come twice are one
    compared = []
    kept = nearest.stored
    monkeypatch.setattr(nearest, "stored", lambda df, name: compared.append((name, kept(df, name))) or compared[-1][1])
    segs = spark.createDataFrame(lines, "line long, lon double, lat double, lon2 double, lat2 double")
    got = {r["id"]: r for r in nearest.nearest(spark.createDataFrame(points, "id long, p_lat double, p_lon double"), segs, "id", name="line").collect()}
    assert len(got) == len(points)
    for i, lat, lon in points:
        wrap = lambda x: x - 360 * round((x - lon) / 360)  # noqa: B023, E731
        best = min(to_segment((0, 0, lon, lat), (0, 0, wrap(x), y), (0, 0, wrap(x) + (x2 - x - 360 * round((x2 - x) / 360)), y2))[0] for _, x, y, x2, y2 in lines)
        assert got[i]["nearest"] == pytest.approx(best, abs=1e-6)
    front, pieces = ([df for name, df in compared if name == n][-1] for n in ("front", "pieces"))
    assert front.join(pieces, ["_x", "_y"]).count() < len(spots) * len(lines) / 10


def test_links_of_lines_in_blocks(spark, monkeypatch):
    """150 lines in three blocks, all of which run along many others: the shares of all pairs, and their groups from few links."""
    monkeypatch.setattr(spatial, "BLOCK_LINES", 64)
    rng = random.Random(5)
    rows = []
    for i in range(150):
        band = i * 7 % 4
        rows += [(i * 3, n, -0.1 + 0.0004 * n + rng.uniform(0, 1e-4), 51.5 + 0.003 * band + rng.uniform(0, 2e-4)) for n in range(rng.choice([5, 6, 40]))]
    rows += [(1000, 0, 0.3, 51.5), (1000, 1, 0.31, 51.5), (1001, 0, 0.3, 51.5)]
    traces = spark.createDataFrame(rows, LINE).repartition(4)
    shares = {(r["a"], r["b"]): (r["forth"], r["back"]) for r in spatial.corridor_shares(traces, "route_id", "seq").collect()}
    lines = {k: [r for r in rows if r[0] == k] for k in {r[0] for r in rows}}
    sampled = lambda v: v if len(v) <= 36 else [v[i] for i in sorted({math.floor(j * (len(v) - 1) / 35 + 0.5) for j in range(36)})]
    for a, b in rng.sample(sorted(shares), 40):
        share = [sum(any(to_segment(p, *s)[0] <= 28 for s in zip(lines[y], lines[y][1:])) for p in sampled(lines[x])) / len(sampled(lines[x])) for x, y in ((a, b), (b, a))]
        assert shares[a, b] == pytest.approx(tuple(share))
    along = {k for k, (forth, back) in shares.items() if (forth + back) / 2 >= 0.66 and min(forth, back) >= 0.42}
    links = [tuple(r) for r in spatial.corridor_links(traces, "route_id", "seq", graph.adjacent_arrays).collect()]
    assert len(links) < 6 * 128 < len(along)
    label = {k: k for pair in along for k in pair}
    for _ in label:
        for a, b in along:
            label[a] = label[b] = min(label[a], label[b])
        if all(label[a] == label[b] for a, b in along):
            break
    assert {r["node"]: r["label"] for r in graph.families(spark.createDataFrame(links, "a long, b long")).collect()} == label
