"""Canonical migration against a loop over the records."""

import json
import random
import re

from catchment.operators import migration

ROUTES = "seq long, legacy_key string, canonical_key string, number string, context string"
ALIASES, SOURCES, REVISIONS, LINKS = "seq long, at long, alias string", "seq long, at long, url string, title string, publisher string, retrieved string", "seq long, at long, revision string", "link long, route_key string"


def normal(v):
    return re.sub(r"[^a-z0-9]+", " ", (v or "").strip().lower()).strip()


def migrated(routes, aliases, sources, revisions, links):
    groups, lineage, out = {}, {}, {}
    of = lambda rows, seq: [r[2:] for r in sorted(rows, key=lambda r: (r[0], r[1])) if r[0] == seq]
    for r in sorted(routes):
        groups.setdefault(r[2], []).append(r)
    for key, items in groups.items():
        legacy = list(dict.fromkeys(k for r in items for k in [r[1], *[a for (a,) in of(aliases, r[0])]] if (k or "").strip()))
        told = {}
        for s in (s for r in items for s in of(sources, r[0])):
            told[normal(s[0]) if (s[0] or "").strip() else normal(s[1])] = s
        old = [x for i, r in enumerate(items) for x in [*[v for (v,) in of(revisions, r[0])], *([json.dumps({k: v for k, v in zip(("seq", "legacy_key", "canonical_key", "number", "context"), r) if v is not None}, separators=(",", ":"))] if i else [])]]
        out[key] = (items[0][0], legacy, list(told.values()), list(dict.fromkeys(old)), [r[1] for r in items[1:]])
        for k in legacy:
            if normal(k):
                lineage[normal(k)] = key
        lineage[normal(key)] = key
    new = [(n, lineage.get(normal(k), k), (k or "") if normal(k) in lineage else None) for n, k in links]
    return out, lineage, new


def test_migration_equals_a_loop(spark):
    rng = random.Random(23)
    routes = [(i, rng.choice([f"L{rng.randrange(30)}", "", None]), f"route:a:{rng.randrange(18)}", f"{rng.randrange(9)}", rng.choice(["East", None])) for i in range(60)]
    aliases = [(i, at, rng.choice([f"l{rng.randrange(40)}", f"route:a:{rng.randrange(20)}", "", None])) for i in range(60) for at in range(rng.randint(0, 3))]
    sources = [(i, at, rng.choice(["https://a.example/x", "https://A.example/x", "", None]), rng.choice(["T", "U"]), f"p{i}", None) for i in range(60) for at in range(rng.randint(0, 3))]
    revisions = [(i, at, rng.choice(["r1", "r2", None])) for i in range(60) for at in range(rng.randint(0, 2))]
    revisions = [r for r in revisions if r[2]]
    links = [(i, rng.choice([f"l {rng.randrange(40)}", f"L{rng.randrange(40)}", f"Route:A:{rng.randrange(25)}", "", None])) for i in range(80)]
    frame = lambda r, s: spark.createDataFrame(r, s).repartition(3)
    got = migration.canonical_migration(frame(routes, ROUTES), frame(aliases, ALIASES), frame(sources, SOURCES), frame(revisions, REVISIONS), frame(links, LINKS))
    want, lineage, new = migrated(routes, aliases, sources, revisions, links)
    assert {r["canonical_key"]: r["seq"] for r in got.routes.collect()} == {k: v[0] for k, v in want.items()}
    listed = lambda df, c: {k: [r[c] if isinstance(c, str) else tuple(r[x] for x in c) for r in df.filter(df["canonical_key"] == k).orderBy("place").collect()] for k in want}
    assert listed(got.legacy_keys, "key") == {k: v[1] for k, v in want.items()}
    assert listed(got.sources, ("url", "title", "publisher", "retrieved")) == {k: v[2] for k, v in want.items()}
    assert listed(got.revisions, "revision") == {k: v[3] for k, v in want.items()}
    assert listed(got.history, "merged_key") == {k: v[4] for k, v in want.items()}
    assert {r["key"]: r["canonical_key"] for r in got.lineage.collect()} == lineage
    assert sorted(tuple(r) for r in got.links.collect()) == sorted(new)
    report = got.report.first().asDict()
    by_number = {}
    for r in routes:
        by_number.setdefault(normal(r[3]), set()).add(r[2])
    assert report == {
        "routes_before": 60, "routes_after": len(want), "merged_candidates": sum(len(v[4]) > 0 for v in want.values()), "records_merged": 60 - len(want), "links": 80,
        "references_updated": sum(bool(old) and old != key for _, key, old in new), "numbers_apart": sum(len(k) > 1 for k in by_number.values()),
    }
    assert {r["number"] for r in got.apart.collect()} == {n for n, k in by_number.items() if len(k) > 1}


def test_migration_of_nothing(spark):
    got = migration.canonical_migration(*[spark.createDataFrame([], s) for s in (ROUTES, ALIASES, SOURCES, REVISIONS, LINKS)])
    assert got.routes.count() == got.links.count() == 0 and got.report.first()["routes_before"] == 0
