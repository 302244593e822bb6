"""A data source for master documents with versions: the current document if it is valid, else the newest valid version, and what was tried on the way.

A document is JSON with a schema name, a version and records. It is taken whole or not at all: one that is torn, of another schema or version, or without a list of records is passed over, and the next candidate is tried. Nothing valid is an error, never an
empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "versioned_master"


class VersionedMaster(DataSource):
    """Options: path (a URI of the current document), versions (a URI of a folder of earlier ones, whose names sort by age), schema, version; what: records (default) or attempts."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "place int, path string, error string" if self.options.get("what") == "attempts" else "place int, record string, path string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MasterReader(dict(self.options))


class MasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a document is one file, and which one counts is decided once

    def candidates(self) -> list[str]:
        import pyarrow.fs

        out = [self.options["path"]]
        if folder := self.options.get("versions"):
            fs, root = pyarrow.fs.FileSystem.from_uri(folder)
            found = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
            names = sorted((f.base_name for f in found if f.type == pyarrow.fs.FileType.File and f.base_name.endswith(".json")), reverse=True)
            out += [f"{folder.rstrip('/')}/{n}" for n in names]
        return out

    def problem(self, document: object) -> str:
        if not isinstance(document, dict):
            return "not a document"
        if document.get("schema") != self.options.get("schema"):
            return f"schema {document.get('schema')}"
        if str(document.get("version")) != self.options.get("version"):
            return f"version {document.get('version')}"
        return "" if isinstance(document.get("records"), list) else "no list of records"

    def load(self) -> tuple[list, str, list[tuple[str, str]]]:
        """Records, the path that they come from, and (path, error) of each attempt."""
        import pyarrow.fs

        attempts: list[tuple[str, str]] = []
        for path in self.candidates():
            try:
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(at) as f:
                    document = json.loads(f.read().decode())
                error = self.problem(document)
            except (OSError, ValueError) as e:  # missing, unreadable, not text, not JSON
                document, error = None, type(e).__name__
            attempts.append((path, error))
            if not error:
                return document["records"], path, attempts
        return [], "", attempts

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        records, path, attempts = self.load()
        if self.options.get("what") == "attempts":
            yield from ((i, p, e) for i, (p, e) in enumerate(attempts))
            return
        if not path:
            raise ValueError("no valid document: " + "; ".join(f"{p}: {e}" for p, e in attempts))
        yield from ((i, json.dumps(r), path) for i, r in enumerate(records))


def read_versioned(spark: SparkSession, path: str, versions: str | None, schema_name: str, version: int, record: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Records of the current document or of the newest valid version, with _place and _path (where they come from), and the attempts (place, path, error), '' for the one that counts. Reading records raises if nothing is valid; attempts can be read all the same."""
    spark.dataSource.register(VersionedMaster)
    options = {"path": path, "schema": schema_name, "version": str(version)} | ({"versions": versions} if versions else {})
    rows = spark.read.format(NAME).options(**options).load()
    records = rows.select(F.from_json("record", record).alias("r"), F.col("place").alias("_place"), F.col("path").alias("_path")).select("r.*", "_place", "_path")
    return records, spark.read.format(NAME).options(**options, what="attempts").load()
