"""Publication of bus records against a loop over all records."""

import random
import re
from urllib.parse import urlsplit

from catchment.operators import publication as pub

LINKS = "seq long, stop_key string, number string, direction string, destination string, weekday string, saturday string, sunday string, tph string, saturday_tph string, sunday_tph string, pattern string, journey string, paragraph string, qualifications map<string,string>, date string, status string"
ROUTES = "seq long, number string, operator string, origin string, destination string, context string, principal array<string>, weekday string, saturday string, sunday string, pattern string, qualifications map<string,string>, date string, status string"
STOPS = "seq long, stop_key string, name string, locality string, direction string, indicator string, served array<string>, date string, status string"
SOURCES = "seq long, at long, url string, title string, publisher string, retrieved string"


def names(schema):
    return [f.split()[0] for f in re.split(r", (?=\w+ )", schema)]


def normal(v):
    return re.sub(r"[^a-z0-9]+", " ", (v or "").strip().lower()).strip()


def useful(v):
    if isinstance(v, dict):
        return any(map(useful, v.values()))
    return len(v) > 0 if isinstance(v, list) else bool((v or "").strip()) and not re.search("research required", v, re.I)


def best(records, fields):
    score = lambda r: (normal(r["status"]).startswith("verified"), r["date"] if re.match(r"\d{4}-\d\d-\d\d$", r["date"] or "") else "1970-01-01", sum(useful(r[f]) for f in fields))
    return max(records, key=score)  # the first of several


def joined(records, field):
    seen = {}
    for r in records:
        if useful(r[field]):
            seen.setdefault(normal(r[field]), r[field].strip())
    return " / ".join(seen.values())


def worth(s):
    url = urlsplit(s["url"] or "")
    if not url.scheme or not url.netloc:
        return 0
    depth = len([p for p in url.path.split("/") if p])
    return 10 * (url.scheme in ("http", "https")) + 10 * (depth > 0) + 10 * (depth > 1) + 5 * bool(s["title"]) + 5 * bool(s["publisher"]) + 5 * bool(re.match(r"\d{4}-\d\d-\d\d$", s["retrieved"] or ""))


def sources_of(*lists):
    seen = {}
    for s in (s for one in lists for s in one):
        seen.setdefault(normal(s["url"]) or normal(s["title"]) + "|" + normal(s["publisher"]), s)
    return sorted(seen.values(), key=worth, reverse=True)


def newest(records):
    return max((r["date"] for r in records if re.match(r"\d{4}-\d\d-\d\d$", r["date"] or "")), default="")


def published(links, routes, stops, selected, numbers):
    by_key = {}
    for k in links:
        if k["stop_key"] in selected and normal(k["number"]) in numbers and normal(k["status"]).startswith("verified"):
            key = (k["stop_key"], normal(k["number"]), normal(k["direction"]), normal(k["destination"]))
            by_key[key] = best([x for x in (by_key.get(key), k) if x], (*pub.LINK_FIELDS, "sources", "date"))
    chosen, made = list(by_key.values()), {}
    for number in dict.fromkeys(normal(k["number"]) for k in chosen):
        fit = [r for r in routes if normal(r["number"]) == number and normal(r["status"]).startswith("verified")]
        if not fit:
            continue
        r = dict(best(fit, (*pub.ROUTE_FIELDS, "sources", "date")))
        own = [k for k in chosen if normal(k["number"]) == number]
        if not useful(r["principal"] or []):
            r["principal"] = [x.strip() for x in (r["origin"] or "", r["destination"] or "") if useful(x)]
        if not useful(r["context"]):
            r["context"] = f"Service corridor between {(r['origin'] or '').strip()} and {(r['destination'] or '').strip()}" + (" via " + ", ".join(r["principal"]) if r["principal"] else "") + "."
        for p in pub.PERIODS:
            r[p] = joined(own, p) or r[p]
        merged = {}
        for k in own:
            for name, v in (k["qualifications"] or {}).items():
                if useful(v):
                    merged[name] = v if name not in merged else merged[name] if normal(merged[name]) == normal(v) else f"{merged[name].strip()} / {v.strip()}"
        r["qualifications"] = merged or {"general": r["pattern"] or ""}
        r["sources"] = sources_of(r["sources"], *[k["sources"] for k in own])
        r["date"], r["status"] = newest([r, *own]) or r["date"], "verified"
        made[number] = r
    out = []
    for k in chosen:
        if r := made.get(normal(k["number"])):
            k = dict(k) | {"operator": r["operator"], "route_origin": r["origin"], "route_destination": r["destination"], "context": r["context"], "route_key": "|".join(normal(r[c]) for c in ("number", "operator", "origin", "destination", "context"))}
            k["qualifications"] = k["qualifications"] if useful(k["qualifications"] or {}) else r["qualifications"]
            k["sources"], k["date"], k["status"] = sources_of(k["sources"], r["sources"]), newest([k, r]) or r["date"], "verified"
            out.append(k)
    by_stop = {}
    for s in stops:
        if s["stop_key"] in selected and normal(s["status"]).startswith("verified"):
            s = dict(s) | {"served": list(dict.fromkeys([*(s["served"] or []), *[k["number"] for k in out if k["stop_key"] == s["stop_key"]]]))}
            if not useful(s["indicator"]) and useful(s["direction"]):
                s["indicator"] = s["direction"]
            by_stop[s["stop_key"]] = best([x for x in (by_stop.get(s["stop_key"]), s) if x], (*pub.STOP_FIELDS, "sources", "date"))
    return out, list(made.values()), list(by_stop.values())


def test_publication_equals_a_loop(spark):
    rng = random.Random(21)
    some = lambda *v: rng.choice([*v, "", None, "Research required"])
    date, status = lambda: rng.choice(["2026-01-05", "2026-03-01", "bad", "", None]), lambda: rng.choice(["Verified", "verified - desk", "needs review", "verified"])
    quals = lambda: rng.choice([None, {}, {"night": some("None", "none!", "N1")}, {"night": some("N1", "N2"), "evening": some("hourly")}])
    links = [(i, f"s{rng.randrange(5)}", rng.choice(["1", "2", "N 3", "n3", "4"]), some("North", "north"), some("Mill", "Quay"), some("06:00-23:00", "6-23", "06:00-23:00 "), some("7-22"), some("No service"), some("4"), some("2"), some("1"), some("Every day", "every DAY"), some("j"), some("p"), quals(), date(), status()) for i in range(160)]
    routes = [(i, rng.choice(["1", "2", "N3", "n 3"]), some("Red", "Blue"), some("Hill"), some("Mill "), some("East"), rng.choice([None, [], ["Quay", "Mill"]]), some("5-20"), some("x"), some("y"), some("z"), quals(), date(), status()) for i in range(30)]
    stops = [(i, f"s{rng.randrange(6)}", some("Stop"), some("Town"), some("N"), some("N1"), rng.choice([None, [], ["9", "1"]]), date(), status()) for i in range(25)]
    source = lambda: (some("https://a.example/x/y", "https://a.example/", "https://b.example/z", "not a url", "ftp://c.example/q"), some("Title"), some("Publisher"), rng.choice(["2026-01-01", "2026-01-01 soon", ""]))
    attached = [{i: [source() for _ in range(rng.randint(0, 3))] for i in range(len(t))} for t in (links, routes, stops)]
    rows = lambda a: [(i, at, *s) for i, ss in a.items() for at, s in enumerate(ss)]
    frame = lambda r, s: spark.createDataFrame(r, s).repartition(3)
    selected, numbers = ["s0", "s1", "s2", "s3"], ["1", "n 3", "N3", "4"]
    got = pub.publication(
        frame(links, LINKS), frame(routes, ROUTES), frame(stops, STOPS), *[frame(rows(a), SOURCES) for a in attached], spark.createDataFrame([(s,) for s in selected], "stop_key string"), spark.createDataFrame([(n,) for n in numbers], "number string")
    )
    records = [[dict(zip(names(s), r)) | {"sources": [dict(zip(("url", "title", "publisher", "retrieved"), x)) for x in a[r[0]]]} for r in t] for t, s, a in zip((links, routes, stops), (LINKS, ROUTES, STOPS), attached)]
    want_links, want_routes, want_stops = published(*records, selected, [normal(n) for n in numbers])
    for df, want, columns in (
        (got.links, want_links, [*names(LINKS), "operator", "route_origin", "route_destination", "context", "route_key"]), (got.routes, want_routes, names(ROUTES)), (got.stops, want_stops, names(STOPS)),
    ):
        rows_got = sorted((r.asDict() for r in df.collect()), key=lambda r: r["seq"])
        rows_want = sorted(want, key=lambda r: r["seq"])
        assert len(rows_got) == len(rows_want) > 0
        for g, w in zip(rows_got, rows_want):
            assert {c: g[c] for c in columns} == {c: w[c] for c in columns}
    listed = {}
    for r in got.sources.orderBy("kind", "seq", "place").collect():
        listed.setdefault((r["kind"], r["seq"]), []).append((r["url"], r["title"], r["publisher"], r["retrieved"]))
    for kind, want in (("bus-route", want_routes), ("bus-stop-route", want_links)):
        for w in want:
            assert listed.get((kind, w["seq"]), []) == [tuple(s.values()) for s in w["sources"]]


def test_publication_of_nothing(spark):
    none = lambda s: spark.createDataFrame([], s)
    got = pub.publication(none(LINKS), none(ROUTES), none(STOPS), none(SOURCES), none(SOURCES), none(SOURCES), none("stop_key string"), none("number string"))
    assert got.links.count() == got.routes.count() == got.stops.count() == got.sources.count() == 0


def test_maps_keep_conflicts(spark):
    rows = [(1, "k", {"a": "One", "b": "x"}), (2, "k", {"a": "one!", "b": "research required"}), (3, "k", {"a": "two"}), (4, "k", {"a": "two"}), (5, "m", None)]
    df = spark.createDataFrame(rows, "seq long, key string, q map<string,string>")
    assert [(r["key"], r["q"]) for r in pub.merged_maps(df, ["key"], "q").collect()] == [("k", {"a": "One / two / two", "b": "x"})]
