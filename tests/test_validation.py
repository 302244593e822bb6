"""The cascade of checks of returned packs against a loop over each pack's records."""

import random

from catchment.operators import validation as v


def checked(allowed, stops, routes, links, served):
    """One pack's refusals (step, place, record, reason) and what is accepted, record by record."""
    failed, good_stops, good_routes, good_links, seen_routes, seen_links = [], [], [], [], set(), set()
    if len(routes) > 6:
        failed.append((1, 0, "", v.CAPS[1]))
    if len(links) > 12:
        failed.append((1, 0, "", v.CAPS[2]))
    for place, key, fault in stops:
        if key not in allowed:
            failed.append((2, place, key, v.UNRELATED_STOP[1]))
        elif fault:
            failed.append((2, place, key, fault))
        else:
            good_stops.append((place, key))
    failed += [(3, 0, key, v.NOT_RETURNED[1] + key) for key in allowed if key not in {k for _, k in good_stops}]
    for place, key, identified, aliases, fault in routes[:6]:
        if not identified or not key:
            failed.append((4, place, key, v.BARE_NUMBER[1]))
            continue
        if key in seen_routes:
            failed.append((4, place, key, v.SAME_ROUTE[1]))
            continue
        seen_routes.add(key)
        if fault:
            failed.append((4, place, key, fault))
        else:
            good_routes.append((place, key, {key, *aliases} - {""}))
    for place, key, stop, alias, number, fault in links[:12]:
        if key in seen_links:
            failed.append((5, place, key, v.SAME_LINK[1]))
            continue
        seen_links.add(key)
        if stop not in allowed:
            failed.append((5, place, key, v.UNRELATED_LINK[1]))
        elif sum(alias in names for _, _, names in good_routes) != 1:
            failed.append((5, place, key, v.NO_ROUTE[1]))
        elif fault:
            failed.append((5, place, key, fault))
        else:
            good_links.append((place, key, stop, alias, number))
    linked = [r for r in good_routes if any(k[3] in r[2] for k in good_links)]
    failed += [(6, place, key, v.UNLINKED[1]) for place, key, names in good_routes if (place, key, names) not in linked]
    kept = []
    for place, key in good_stops:
        actual = {n.strip().lower() for _, _, s, _, n in good_links if s == key}
        if {n.strip().lower() for s, n in served if s == key} == actual:
            kept.append(("bus-stop", place, key))
        else:
            failed.append((7, place, key, v.DISAGREES[1]))
    return failed, kept + [("bus-route", p, k) for p, k, _ in linked] + [("bus-stop-route", k[0], k[1]) for k in good_links]


ALLOWED, STOPS, ROUTES = "task long, stop_key string", "task long, place long, stop_key string, fault string", "task long, place long, route_key string, identified boolean, aliases array<string>, fault string"
LINKS, SERVED = "task long, place long, link_key string, stop_key string, route_alias string, number string, fault string", "task long, stop_key string, number string"


def test_random_packs(spark):
    rng = random.Random(13)
    tables, want_failed, want_kept = ([], [], [], [], []), [], []
    for task in range(250):
        keys = ["s1", "s2", "s3"]
        fault = lambda: rng.choice(["", "", "", "", "weak"])
        allowed = rng.sample(keys, rng.randint(0, 2))
        stops = [(i, k, fault()) for i, k in enumerate(rng.sample(keys, rng.randint(0, 3)))]
        routes = [(i, rng.choice(["r1", "r2", "r3", "r4", ""]), rng.random() < 0.85, rng.sample(["a1", "a2", "a3"], rng.randint(0, 2)), fault()) for i in range(rng.randint(0, 8))]
        links = [(i, f"k{rng.randrange(12)}", rng.choice(keys), rng.choice(["r1", "r2", "r3", "a1", "a2", "a3"]), rng.choice(["1", "2 ", "N3"]), fault()) for i in range(rng.randint(0, 14))]
        served = [(k, n) for k in keys for n in rng.sample(["1", "2", "n3"], rng.randint(0, 2))]
        failed, kept = checked(allowed, stops, routes, links, served)
        want_failed += [(task, *f) for f in failed]
        want_kept += [(task, *k) for k in kept]
        for table, rows in zip(tables, ([(k,) for k in allowed], stops, routes, links, served)):
            table += [(task, *r) for r in rows]
    frames = [spark.createDataFrame(rows, schema).repartition(3) for rows, schema in zip(tables, (ALLOWED, STOPS, ROUTES, LINKS, SERVED))]
    accepted, failed = v.network_results(*frames)
    assert sorted(tuple(r) for r in failed.collect()) == sorted(want_failed)
    assert sorted(tuple(r) for r in accepted.collect()) == sorted(want_kept)
    assert {f[1] for f in want_failed} == set(range(1, 8)) and {k[1] for k in want_kept} == {"bus-stop", "bus-route", "bus-stop-route"}


def test_no_packs(spark):
    accepted, failed = v.network_results(*[spark.createDataFrame([], s) for s in (ALLOWED, STOPS, ROUTES, LINKS, SERVED)])
    assert accepted.count() == failed.count() == 0


def test_pack_results(spark):
    assigned = spark.createDataFrame([(1, "rail", "a"), (2, "bus-stop", "b"), (3, "rail", "c"), (4, "bus-route", "d"), (5, "rail", "e"), (6, "rail", None)], "task long, kind string, record string")
    results = spark.createDataFrame([(1, "rail", "a", ""), (2, "rail", "b", ""), (3, "rail", "x", ""), (9, "rail", "z", ""), (4, "bus-route", "d", "weak"), (6, "rail", "f", None)], "task long, kind string, record string, fault string")
    unresolved = spark.createDataFrame([(5, None), (77, "nobody's")], "task long, reason string")
    out = v.pack_results(assigned, results, unresolved)
    assert {(r["task"], r["reason"]) for r in out.collect()} == {(1, ""), (2, v.NOT_ASSIGNED), (3, v.OTHER_IDENTITY), (9, v.NOT_ASSIGNED), (4, "weak"), (6, v.OTHER_IDENTITY), (5, "requires professional review"), (2, v.ABSENT)}
    assert v.pack_summary(out).first().asDict() == {"rail": 1, "bus_stops": 0, "bus_routes": 0, "relationships": 0, "for_review": 7, "complete": False}
    assert v.pack_summary(v.pack_results(assigned.limit(0), results.limit(0), unresolved)).first()["complete"]


def test_lines_of_packs_are_joined_once(spark, data):
    """What the cascade's rules look at is stored, not derived from the driver's tables again for each of them."""
    from catchment import registry

    for name in ("m16_network_limits", "m16_network_accepted"):
        plan = registry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "lineitem.parquet" not in plan and "BroadcastHashJoin" not in plan
