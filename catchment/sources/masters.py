"""Reading master documents, GeoJSON and local libraries. A source that can't be read is an error, never an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A record of a source: where a value comes from.
SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "title", "publisher", "retrievalDate")])


class SourceError(RuntimeError):
    """No candidate could be read; attempts holds (path, error) of each."""

    def __init__(self, attempts: list[tuple[str, str]]):
        super().__init__("; ".join(f"{p}: {e}" for p, e in attempts))
        self.attempts = attempts


def read_master(spark: SparkSession, path: str, schema_name: str, version: int, record: T.StructType) -> DataFrame:
    """Records of a JSON master document, if its schema and version are the wanted ones."""
    shape = T.StructType([T.StructField("schema", T.StringType()), T.StructField("version", T.LongType()), T.StructField("records", T.ArrayType(record))])
    doc = spark.read.schema(shape).json(path, multiLine=True)
    wrong = doc.filter(~(F.col("schema").eqNullSafe(F.lit(schema_name)) & F.col("version").eqNullSafe(F.lit(version)))).limit(1).collect()
    if wrong:
        raise SourceError([(path, f"schema {wrong[0]['schema']} version {wrong[0]['version']}")])
    return doc.select(F.explode("records").alias("r")).select("r.*")


def first_readable(spark: SparkSession, paths: list[str], read) -> tuple[DataFrame, DataFrame]:
    """The first of paths that read(path) can read, and the attempts as (path, error). Raises SourceError if none can."""
    attempts: list[tuple[str, str]] = []
    for path in paths:
        try:
            out = read(path)
            out.limit(1).collect()
        except Exception as error:  # noqa: BLE001 - every reason to fail is recorded and the next candidate tried
            attempts.append((path, type(error).__name__))
            continue
        attempts.append((path, ""))
        return out, spark.createDataFrame(attempts, "path string, error string")
    raise SourceError(attempts)


def read_masters(spark: SparkSession, folder: str, names: dict[str, T.StructType], schema_name: str, version: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """Masters by name, with a table (name, records, error); one that can't be read is missing and its error is told."""
    out, told = {}, []
    for name, record in names.items():
        try:
            out[name] = read_master(spark, f"{folder}/{name}.json", schema_name, version, record)
            told.append((name, out[name].count(), ""))
        except Exception as error:  # noqa: BLE001
            out.pop(name, None)
            told.append((name, 0, type(error).__name__))
    return out, spark.createDataFrame(told, "name string, records long, error string")


_POSITIONS = T.ArrayType(T.ArrayType(T.DoubleType()))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(feature, type, properties, coordinates as text, bare) of a Feature, a FeatureCollection or a bare geometry."""
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    feature = T.StructType([T.StructField("type", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", geometry)])
    shape = T.StructType([*feature.fields, T.StructField("features", T.ArrayType(feature)), T.StructField("coordinates", T.StringType())])
    doc = spark.read.schema(shape).json(path, multiLine=True)
    bare = F.struct(F.lit("Feature").alias("type"), F.lit(None).cast(T.MapType(T.StringType(), T.StringType())).alias("properties"), F.struct("type", "coordinates").alias("geometry"))
    whole = F.struct("type", "properties", "geometry")
    features = F.when(F.col("type") == "FeatureCollection", F.col("features")).when(F.col("type") == "Feature", F.array(whole)).otherwise(F.array(bare))
    return doc.select(F.posexplode(features).alias("feature", "f")).select("feature", F.col("f.geometry.type").alias("type"), "f.properties", F.col("f.geometry.coordinates").alias("coordinates"))


def line_positions(coordinates: str = "coordinates"):
    """Positions of a LineString's coordinates text."""
    return F.from_json(coordinates, _POSITIONS)


def gazetteer_lookup(names: DataFrame, gazetteer: DataFrame, most: int = 5) -> DataFrame:
    """Up to `most` places for each query text (query, query_key) by normal name: an equi-join where a service was asked before. A name's best places are chosen once, before the texts meet them."""
    from ..operators.select import ranked

    order = [F.col("rank"), F.col("place_id")]
    best = ranked(gazetteer, "place_key", order, most)
    return ranked(names.join(best, F.col("query_key") == F.col("place_key")), "query", order, most)
