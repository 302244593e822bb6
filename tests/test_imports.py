"""Import of rail research by a small case of each rule."""

from catchment.operators import imports, quality

PLAN, FIELDS, MASTER = "batch long, request_group string, sequence long, total long", "batch long, record string, key string, field long, value string, status string, source string, source_title string, publisher string, retrieval_date string", "key string, field long, value string, status string, date string"
GOOD = ("Value", "verified", "https://rail.example/stations/k/info", "Title", "Publisher", "2026-03-01")


def test_rail_import(spark):
    plan = [(1, "g", 1, 3), (2, "g", 2, 3), (4, "g", 3, 3)]
    came = [(1, "g", 1, 3), (2, "other", 2, None), (3, "g", 1, 3), (4, "g", 3, 3)]
    fields = [(1, "A", "a", 1, *GOOD), (1, "B", "b", 1, "refer to the operator website", *GOOD[1:]), (1, "B", "b2", 1, *GOOD), (2, "A", "a", 1, *GOOD), (3, "A", "a", 1, *GOOD), (1, "C", "c", 1, None, "verified", "", "", "", ""), (1, "C", "c", 2, "", "missing", "", "", "", "")]
    master = [("a", 1, "Old", "verified", "2026-01-01"), ("b2", 1, "Old", "verified", "2026-01-01"), ("z", 1, "Kept", "verified", "")]
    out = imports.rail_import(spark.createDataFrame(plan, PLAN), spark.createDataFrame(came, PLAN), spark.createDataFrame(fields, FIELDS), spark.createDataFrame(master, MASTER))
    assert {r["batch"]: (r["state"], r["passed"], r["failed"], r["failures"]) for r in out.states.collect()} == {1: ("correction-required", 1, 3, 2), 2: ("rejected", 0, 0, 0), 3: ("rejected", 0, 0, 0), 4: ("imported", 0, 0, 0)}
    assert {r["batch"]: r["problems"] for r in out.states.collect()} == {1: "", 2: "request_group does not match the plan; total does not match the plan", 3: "batch was not planned", 4: ""}
    assert {tuple(r) for r in out.failures.collect()} == {(1, "B", "1", quality.PLACEHOLDER, GOOD[2]), (1, "C", None, quality.PARTIAL, "")}
    assert {r["key"]: (r["value"], r["outcome"]) for r in out.merged.collect()} == {"a": ("Value", "updated"), "b2": ("Old", "kept"), "z": ("Kept", "kept")}


def test_import_of_nothing(spark):
    none = lambda s: spark.createDataFrame([], s)
    out = imports.rail_import(none(PLAN), none(PLAN), none(FIELDS), none(MASTER))
    assert out.states.count() == out.failures.count() == out.merged.count() == 0
