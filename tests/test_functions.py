"""Cases of single functions, and invariants of operators that SQL doesn't check."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment.functions import evidence, geo, text
from catchment.operators import classify, graph, merge, planning, rounds, scans, select, spatial


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("given", "folded", "ascii_"),
    [("Éleère", "e lee re", "le re"), ("  A--b ", "a b", "a b"), ("", "", ""), (None, "", "")],
)
def test_normalisers_differ_on_accents(spark, given, folded, ascii_):
    assert one(spark, text.normal_folded(F.lit(given).cast("string"))) == folded
    assert one(spark, text.normal_ascii(F.lit(given).cast("string"))) == ascii_


@pytest.mark.parametrize(("given", "want"), [("Verified", "verified"), ("needs_review", "review"), ("research-required", "missing"), ("", "missing"), ("manual", "manual")])
def test_status_class(spark, given, want):
    assert one(spark, text.status_class(F.lit(given))) == want


def test_fnv_of_a_json_letter(spark):
    assert one(spark, text.fnv32(text.json_string(F.lit("a")))) == "r37wmi"


@pytest.mark.parametrize(("metres", "want"), [(999.4, "999 m"), (1000.0, "1.0 km"), (1250.0, "1.3 km"), (None, "—")])
def test_distance_text(spark, metres, want):
    assert one(spark, text.distance_text(F.lit(metres).cast("double"))) == want


@pytest.mark.parametrize(
    ("url", "specific", "generic", "workflow"),
    [("https://a.example/stations/abc", True, False, False), ("https://a.example/services/", True, True, True), ("https://a.example", False, False, False), ("https://a.example/x/search?q=1", True, True, True), ("nonsense", False, False, True), ("", False, False, True), ("ftp://a.example/x", False, False, False)],
)
def test_urls(spark, url, specific, generic, workflow):
    c = F.lit(url)
    assert one(spark, evidence.is_specific_url(c)) is specific
    assert one(spark, evidence.is_generic_url(c)) is generic
    assert one(spark, evidence.is_generic_url(c, invalid=True)) is workflow


@pytest.mark.parametrize(("words", "want"), [("See the operator website.", True), ("Details: not found", True), ("Trains to town every hour", False), ("Facilities require confirmation", True), ("No published information was found", True)])
def test_placeholders(spark, words, want):
    assert one(spark, evidence.is_placeholder(F.lit(words))) is want


def test_grid_round_trip():
    lat, lon = np.array([50.1, 51.5007, 55.9, 58.6]), np.array([-5.6, -0.1246, -3.2, -3.1])
    east, north = geo.grid_of(lat, lon)
    back = geo.degrees_of(east, north)
    assert np.abs(back[0] - lat).max() * 110540 < 0.02 and np.abs(back[1] - lon).max() * 70000 < 0.02
    assert abs(east[1] - 530268) < 10 and abs(north[1] - 179640) < 10


CASES = [
    ({"amenity": "school", "name": "Hill Infant School"}, {"primary_school"}),
    ({"amenity": "school", "name": "All-through", "isced:level": "1;2"}, {"primary_school", "secondary_school"}),
    ({"amenity": "college", "name": "Adult Education Centre"}, set()),
    ({"amenity": "clinic", "name": "Mill Surgery"}, {"gp_surgery"}),
    ({"amenity": "clinic", "name": "Gym and Medical Centre"}, set()),
    ({"amenity": "clinic", "name": "Walk-in Centre"}, {"urgent_care"}),
    ({"leisure": "sports_centre"}, {"sports_facility"}),
    ({"leisure": "sports_centre", "name": "Lake Leisure Centre"}, {"gym_leisure", "sports_facility"}),
    ({"shop": "convenience"}, {"convenience_store"}),
    ({"railway": "station", "network": "London Overground"}, {"overground_station"}),
    ({"railway": "station", "station": "subway", "network": "London Overground"}, {"underground_station"}),
    ({"public_transport": "platform"}, set()),
]


def test_facility_rules(spark):
    rows = spark.createDataFrame([(i, tags) for i, (tags, _) in enumerate(CASES)], "i int, tags map<string,string>")
    got = {i: set() for i in range(len(CASES))}
    for r in classify.classify_facilities(rows).collect():
        got[r["i"]].add(r["category"])
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_radius_join_equals_all_pairs(spark):
    rng = random.Random(5)
    sites = [(i, rng.uniform(49, 61), rng.uniform(-8, 2)) for i in range(20)] + [(20, 0.0, 0.0), (21, -33.9, 151.2)]
    points = [(j, a + rng.uniform(-0.03, 0.03), b + rng.uniform(-0.05, 0.05)) for j, (_, a, b) in enumerate(sites * 15)]
    got = spatial.radius_join(spark.createDataFrame(sites, "site int, site_lat double, site_lon double"), spark.createDataFrame(points, "p int, lat double, lon double"), 2000.0)

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    want = {(s, p) for s, a, b in sites for p, c, d in points if metres(a, b, c, d) <= 2000}
    assert {(r["site"], r["p"]) for r in got.collect()} == want and want


def test_merge_twice_changes_nothing(spark):
    old = spark.createDataFrame([("a", "verified", "x", "2026-01-02"), ("b", "missing", "y", "2026-01-01")], "key string, status string, name string, date string")
    new = spark.createDataFrame([("a", "missing", "z", "2026-02-01"), ("b", "verified", None, "2026-02-01"), ("c", "missing", "", "2026-02-01"), ("", "verified", "q", "2026-02-01")], old.schema)
    once = merge.merge_master(old, new)
    rows = {r["key"]: (r["name"], r["action"]) for r in once.collect()}
    assert rows == {"a": ("x", "preserved"), "b": ("y", "update"), "c": ("", "addition"), "": ("q", "rejected")}
    table = once.filter("action <> 'rejected'").drop("action")
    again = merge.merge_master(table, new).filter("action <> 'rejected'").drop("action")
    assert sorted(again.collect()) == sorted(table.collect())


@pytest.mark.parametrize("seed", range(4))
def test_packs_respect_caps(spark, seed):
    rng = random.Random(seed)
    links = [(p, rng.randint(1, 9), i) for p in range(3) for i in range(rng.randint(1, 80))]
    rows = planning.service_packs(spark.createDataFrame(links, "plan long, route long, seq long")).collect()
    assert len(rows) == len(links)
    packs = {}
    for r in rows:
        packs.setdefault((r["plan"], r["pack"]), []).append(r)
    assert all(len(v) <= planning.LINKS and len({r["route"] for r in v}) <= planning.ROUTES for v in packs.values())


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 6)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(7, 7)]])
def test_components_are_smallest_labels(spark, edges):
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()} == label


def test_greedy_resolution_depends_on_kept_rows(spark):
    rows = [(1, 1, "a", "r", "", 51.0, 0.0, 1, 50.0), (1, 2, "a", "r", "X", 51.002, 0.0, 5, 40.0), (1, 3, "b", "r", "X", 51.9, 0.0, 1, 90.0), (2, 1, "a", "r", "", 51.0, 0.0, 1, 5.0)]
    got = rounds.resolved_stations(spark.createDataFrame(rows, "site_id long, seq long, name string, mode string, code string, lat double, lon double, richness long, straight double")).collect()
    assert sorted((r["site_id"], r["seq"], r["code"], r["straight"], r["members"]) for r in got) == [(1, 1, "X", 40.0, 3), (2, 1, "", 5.0, 1)]


def test_chunks_share_a_vertex(spark):
    rows = spark.createDataFrame([(1, i, i % 3 == 0) for i in range(100)], "route_id long, seq long, own boolean")
    got = sorted(tuple(r) for r in scans.overlapping_chunks(rows, 40, original="own").collect())
    assert [g[2] for g in got][1:] == [g[3] for g in got][:-1] and got[0][2] == 0 and got[-1][3] == 99 and all(g[4] <= 40 for g in got)


def corridor_brute(lines, metres=28.0):
    """{(a, b): (forth, back)} by all sampled vertices against all segments."""
    def near(p, a, b):
        k = 111320 * math.cos(math.radians(p[1]))
        (ax, ay), (bx, by) = (((q[0] - p[0]) * k, (q[1] - p[1]) * 110540) for q in (a, b))
        dx, dy = bx - ax, by - ay
        r = max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.hypot(ax + r * dx, ay + r * dy) <= metres

    def samples(v):
        return v if len(v) <= 36 else [v[math.floor(i * (len(v) - 1) / 35 + 0.5)] for i in range(36)]

    def share(a, b):
        s = samples(a)
        return sum(any(near(p, x, y) for x, y in zip(b, b[1:])) for p in s) / len(s)

    ids = sorted(i for i, v in lines.items() if len(v) > 1)
    out = {(i, j): (share(lines[i], lines[j]), share(lines[j], lines[i])) for n, i in enumerate(ids) for j in ids[n + 1 :]}
    return {k: v for k, v in out.items() if max(v) > 0}


@pytest.mark.parametrize("pieces", [4096, 3])
def test_corridor_shares_equal_brute_force(spark, pieces, monkeypatch):
    """Ids beyond 40, lines a few metres apart across a border of 1/400 degree, long segments, lines of more than 36 vertices and of one."""
    monkeypatch.setattr(spatial, "CELL_PIECES", pieces)
    rng = random.Random(3)
    lines = {100: [(0.001 * i, 51.49999) for i in range(6)], 101: [(0.001 * i, 51.50001) for i in range(6)], 102: [(0.0, 51.502), (0.005, 51.502)], 103: [(0.002, 51.5)]}
    for i in range(12):
        lines[7 + 13 * i] = [(rng.random() * 0.006, 51.5 + rng.random() * 0.003) for _ in range(rng.choice([2, 5, 36, 37, 50, 90]))]
    rows = [(i, n, *p) for i, v in lines.items() for n, p in enumerate(v)]
    rng.shuffle(rows)
    got = spatial.corridor_shares(spark.createDataFrame(rows, "route_id long, seq long, lon double, lat double"), "route_id", "seq").collect()
    want = corridor_brute(lines)
    assert want[100, 101] == (1.0, 1.0) and (100, 102) not in want
    flat = lambda pairs: {(*k, i): x for k, v in pairs.items() for i, x in enumerate(v)}
    assert flat({(r["a"], r["b"]): (r["forth"], r["back"]) for r in got}) == pytest.approx(flat(want))


def test_corridor_groups_reach_all_traces(spark):
    from types import SimpleNamespace

    from catchment.plans import networks

    rows = [(i, n, 0.001 * n, 51.49999 + i % 2 * 2e-5) for i in (100, 101) for n in range(6)]
    traces = spark.createDataFrame(rows, "route_id long, seq long, lon double, lat double")
    assert sorted(map(tuple, networks.gr2(SimpleNamespace(traces=traces)).collect())) == [(100, 100), (101, 100)]


def test_placeholders_are_found_in_whole_texts(spark):
    """doc_id 8 to 11 have no phrase planted: only the text can tell."""
    from types import SimpleNamespace

    from catchment.plans import scalars

    far = "All is well here. " * 5000
    rows = [(8, far + "Refer to\n the TIMETABLE"), (9, far), (10, None), (11, far + "Not  researched."), (20, "Details - unknown"), (21, far + "verify manually " + far), (22, ""), (1, None), (0, far), (3, far)]
    t = SimpleNamespace(documents=spark.createDataFrame([(i, x, "en") for i, x in rows], "doc_id long, text string, lang string"))
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(scalars.f08(t)) == [0, 1, 3, 8, 11, 20]
    assert ids(scalars.f09(t)) == [1, 3, 21]


def test_whole_lists_are_numbered_in_ranges(spark):
    rows = [(i * 7919 % 1000, None if i % 50 == 0 else f"n{i % 9}") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, name string").repartition(7)
    got = select.numbered(df, ["name", F.col("id").desc()], "place")
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", -r[0]))
    assert [(r["id"], r["name"]) for r in sorted(got.collect(), key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in got.collect()) == list(range(1, 1001))
    assert select.numbered(df.limit(0), ["id"], "place").count() == 0
    plan = select.chunked(df, 5, [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_range" in plan and plan.count("SinglePartition") == 1  # the counts of ranges


def test_service_packs_are_planned_by_stop(spark):
    from types import SimpleNamespace

    from catchment.plans import planning as plans

    links = spark.createDataFrame([(s, r) for s in (3, 13, 23) for r in range(8)], "stop_id long, route_id long")
    got = Counter((r["plan"], r["pack"]) for r in plans.m09(SimpleNamespace(stop_routes=links)).collect())
    assert got == {(s, k): n for s in (3, 13, 23) for k, n in ((0, 6), (1, 2))}


def test_compatible_pairs_keep_the_groups_of_all_pairs(spark):
    """Groups by the listed pairs are the groups of every compatible pair; empty and null fields agree with anything."""
    import itertools
    import random

    from catchment.operators import graph, match

    rng = random.Random(5)
    some = lambda values: sorted(rng.sample(values, rng.randint(0, 2)))
    rows = [(i, some(["1", "2", "3", "4a", "5"]), rng.choice(["", None, "p", "q"]), rng.choice(["", None, "r", "s", "u"]), rng.choice([None, [], ["=x"], ["=y", "y"], ["y", "z"]])) for i in range(60)]
    rows += [(60, None, "p", "r", ["=x"]), (61, [], None, None, None)]

    def fits(a, b):
        either = lambda v, w: not v or not w or v == w
        return bool(set(a[1] or []) & set(b[1] or [])) and either(a[2], b[2]) and either(a[3], b[3]) and (not a[4] or not b[4] or bool(set(a[4]) & set(b[4])))

    label = {r[0]: r[0] for r in rows}
    want = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if fits(a, b)]
    for _ in rows:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    items = spark.createDataFrame(rows, "item long, tokens array<string>, authority string, operator string, terminals array<string>")
    pairs = match.compatible_pairs(items)
    got = {(r.a, r.b) for r in pairs.collect()}
    assert got <= set(want)
    grouped = graph.with_groups(items, pairs, "item")
    assert {r.item: r.family for r in grouped.collect()} == label
    assert match.compatible_pairs(items.limit(0)).count() == 0
