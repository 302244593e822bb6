"""Texts of nested records against a recursive walk, and masters with versions."""

import json
import random
import re

import pytest
from pyspark.sql import types as T

from catchment.operators import nested
from catchment.sources import versioned


def walk(value, path=""):
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in walk(v, f"{path}[{i}]")]
    if isinstance(value, dict):
        return [x for k, v in value.items() if not re.match(r"(?i)^(sources?|sourceTitle|url)$", k) for x in walk(v, f"{path}.{k}" if path else k)]
    return [(path, value)] if isinstance(value, str) else []


def made(rng, depth):
    kind = rng.randrange(8 if depth else 4)
    if kind < 4:
        return [rng.choice(["See the operator website.", "plain", "", "refer to timetable", "é"]), rng.randint(-5, 10**12), rng.choice([True, None, 1.5e-7]), "not researched"][kind]
    if kind < 6:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(["a", "b c", "value", "url", "Sources", "sourceTitle", "note", "x.y"]): made(rng, depth - 1) for _ in range(rng.randint(0, 5))}


def test_texts_equal_a_recursive_walk(spark):
    rng = random.Random(17)
    documents = [(i, json.dumps(made(rng, rng.randint(0, 6)))) for i in range(300)] + [(400, None), (401, "{torn"), (402, ""), (403, '"see the website"'), (404, "{}"), (405, "null")]
    df = spark.createDataFrame(documents, "id long, doc string").repartition(3)
    got = sorted((r["id"], r["path"], r["text"]) for r in nested.string_leaves(df, "id", "doc").collect())
    parsed = [(i, json.loads(d)) for i, d in documents if d and d != "{torn"]
    assert got == sorted((i, p, t) for i, d in parsed for p, t in walk(d))
    bad = {(r["id"], r["path"]) for r in nested.placeholder_paths(df, "id", "doc").collect()}
    assert bad == {(i, p) for i, p, t in got if t.startswith(("See the", "see the", "refer to", "not researched"))}
    assert nested.string_leaves(df.limit(0), "id", "doc").count() == 0


RECORD = T.StructType([T.StructField("key", T.StringType()), T.StructField("inner", T.StructType([T.StructField("n", T.LongType())]))])


def document(n, **changes):
    return json.dumps({"schema": "s", "version": 2, "records": [{"key": f"k{n}", "inner": {"n": n}}]} | changes)


@pytest.mark.parametrize(("current", "error"), [(document(0), ""), (document(0)[:-9], "JSONDecodeError"), (None, "FileNotFoundError"), (document(0, schema="other"), "schema other"), (document(0, version=1), "version 1"), (document(0, records={}), "no list of records"), ("[]", "not a document"), ("\udcff", "UnicodeDecodeError")])
def test_the_newest_valid_version_stands_in(spark, tmp_path, current, error):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "2026-01.json").write_text(document(1))
    (tmp_path / "v" / "2026-02.json").write_text(document(2))
    (tmp_path / "v" / "2026-03.json").write_text(document(3)[:-5])
    if current is not None:
        (tmp_path / "now.json").write_bytes(current.encode("utf-8", "surrogateescape"))
    records, attempts = versioned.read_versioned(spark, f"file://{tmp_path}/now.json", f"file://{tmp_path}/v", "s", 2, RECORD)
    tried = [(r["path"].rsplit("/", 1)[1], r["error"]) for r in attempts.orderBy("place").collect()]
    row = records.first()
    if not error:
        assert (row["key"], row["inner"]["n"], tried) == ("k0", 0, [("now.json", "")])
    else:
        assert (row["key"], row["inner"]["n"]) == ("k2", 2) and row["_path"].endswith("2026-02.json")
        assert tried == [("now.json", error), ("2026-03.json", "JSONDecodeError"), ("2026-02.json", "")]


def test_nothing_valid_is_an_error(spark, tmp_path):
    records, attempts = versioned.read_versioned(spark, f"file://{tmp_path}/none.json", f"file://{tmp_path}/v", "s", 2, RECORD)
    with pytest.raises(Exception, match="no valid document"):
        records.collect()
    assert attempts.count() == 1
    (tmp_path / "none.json").write_text(json.dumps({"schema": "s", "version": 2, "records": []}))
    assert versioned.read_versioned(spark, f"file://{tmp_path}/none.json", None, "s", 2, RECORD)[0].count() == 0
