import json

import pytest
from pyspark.sql import types as T

from catchment.sources import masters, sinks
from catchment.streaming import pacing

RECORD = T.StructType([T.StructField("key", T.StringType()), T.StructField("name", T.StringType())])


def write(path, value):
    path.write_text(json.dumps(value))
    return f"file://{path}"


def test_master_needs_its_schema(spark, tmp_path):
    good = write(tmp_path / "a.json", {"schema": "s", "version": 2, "records": [{"key": "k", "name": "n"}]})
    bad = write(tmp_path / "b.json", {"schema": "s", "version": 1, "records": []})
    assert masters.read_master(spark, good, "s", 2, RECORD).collect() == [("k", "n")]
    with pytest.raises(masters.SourceError):
        masters.read_master(spark, bad, "s", 2, RECORD)


def test_first_readable_keeps_attempts(spark, tmp_path):
    good = write(tmp_path / "a.json", {"schema": "s", "version": 2, "records": [{"key": "k", "name": "n"}]})
    read = lambda p: masters.read_master(spark, p, "s", 2, RECORD)
    out, attempts = masters.first_readable(spark, [f"file://{tmp_path}/none.json", good], read)
    assert out.count() == 1 and [bool(r["error"]) for r in attempts.collect()] == [True, False]
    with pytest.raises(masters.SourceError):
        masters.first_readable(spark, [f"file://{tmp_path}/none.json"], read)


def test_masters_tell_what_is_missing(spark, tmp_path):
    write(tmp_path / "rail.json", {"schema": "s", "version": 2, "records": [{"key": "k", "name": "n"}]})
    got, told = masters.read_masters(spark, f"file://{tmp_path}", {"rail": RECORD, "stops": RECORD}, "s", 2)
    assert set(got) == {"rail"} and {r["name"]: r["records"] for r in told.collect()} == {"rail": 1, "stops": 0}


@pytest.mark.parametrize("wrap", [0, 1, 2])
def test_geojson_shapes(spark, tmp_path, wrap):
    geometry = {"type": "LineString", "coordinates": [[0.0, 51.0], [0.1, 51.5]]}
    feature = {"type": "Feature", "properties": {"class": "c"}, "geometry": geometry}
    path = write(tmp_path / "g.json", [geometry, feature, {"type": "FeatureCollection", "features": [feature, feature]}][wrap])
    rows = masters.read_geojson(spark, path).withColumn("p", masters.line_positions()).collect()
    assert len(rows) == (2 if wrap == 2 else 1) and all(r["type"] == "LineString" and r["p"] == geometry["coordinates"] for r in rows)


def test_publish_guards_the_version(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    assert sinks.publish(df, path, "key", None) == 1
    assert sinks.publish(df.limit(1), path, "key", 1) == 2
    with pytest.raises(sinks.PublishError):
        sinks.publish(df, path, "key", 1)
    assert sinks.current_version(spark, path) == 2


def test_csv_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "y", z'), ("b", "line\nbreak")], "key string, name string")
    sinks.write_csv(df, f"file://{tmp_path}/csv")
    back = spark.read.csv(f"file://{tmp_path}/csv", header=True, multiLine=True, escape='"')
    assert sorted(back.collect()) == sorted(df.collect())


def test_docx_is_a_zip():
    import io
    import zipfile

    names = zipfile.ZipFile(io.BytesIO(sinks.docx(["One & two", "Three"]))).namelist()
    assert "word/document.xml" in names


def test_stream_counts_equal_table_counts(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) as ts", "event_type")
    events.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    q = pacing.calls_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("calls").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("calls").collect()) == sorted(pacing.calls_by_window(events).collect())


def test_places_are_chosen_before_names_meet_them(spark):
    """A common name's places aren't paired with each of its texts: two rankings, one on either side of the join."""
    names = spark.createDataFrame([(i, f"k{i % 2}") for i in range(400)], "query long, query_key string")
    places = spark.createDataFrame([(f"k{i % 3}", i % 7, i) for i in range(900)], "place_key string, rank long, place_id long")
    found = masters.gazetteer_lookup(names, places, 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join ")
    assert "row_number()" in plan[:join] and "row_number()" in plan[join:]
    want = [(q, p) for q in range(400) for _, p in sorted((i % 7, i) for i in range(900) if i % 3 == q % 2)[:4]]
    assert sorted((r["query"], r["place_id"]) for r in found.collect()) == want
