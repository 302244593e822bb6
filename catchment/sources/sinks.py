"""Writing reports and masters: CSV, JSON envelopes, GeoJSON, and publication with a check of what was written."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import csv_if_needed


class PublishError(RuntimeError):
    pass


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as dotted ones; arrays are joined with ' | '."""

    def walk(kind: T.DataType, column: Column, name: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [c for f in kind.fields for c in walk(f.dataType, column[f.name], f"{name}.{f.name}" if name else f.name)]
        if isinstance(kind, T.ArrayType):
            inner = F.transform(column, lambda x: x.cast("string") if not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)) else F.to_json(x))
            return [F.array_join(inner, " | ").alias(name)]
        return [(F.to_json(column) if isinstance(kind, T.MapType) else column).alias(name)]

    return df.select(*[c for f in df.schema.fields for c in walk(f.dataType, F.col(f"`{f.name}`"), f.name)])


def csv_lines(df: DataFrame) -> DataFrame:
    """One column, line: the header (order 0) and each row, with quotes only where needed."""
    flat = flattened(df)
    row = F.concat_ws(",", *[csv_if_needed(F.col(f"`{c}`")) for c in flat.columns])
    head = df.sparkSession.createDataFrame([(0, ",".join(flat.columns))], "part int, line string")
    return head.union(flat.select(F.lit(1).alias("part"), row.alias("line")))


def write_csv(df: DataFrame, path: str) -> None:
    """Every value quoted, quotes doubled."""
    flattened(df).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def envelope(kind: str, build: str, as_of: str, *columns: str) -> Column:
    """A JSON document of the columns with its metadata."""
    return F.to_json(F.struct(F.lit(kind).alias("schema"), F.lit(1).alias("version"), F.lit(build).alias("build"), F.lit(as_of).alias("generatedAt"), F.struct(*columns).alias("payload")))


def publish(df: DataFrame, path: str, key: str, expected_version: int | None) -> int:
    """Write df as the next version of the table at path, if its current version is the expected one (None: no table yet), and read back every key. Returns the new version."""
    spark = df.sparkSession
    current = current_version(spark, path)
    if current != expected_version:
        raise PublishError(f"version is {current}, not {expected_version}")
    version = (current or 0) + 1
    df.write.mode("errorifexists").parquet(f"{path}/v={version}")
    lost = df.select(key).join(spark.read.parquet(f"{path}/v={version}").select(key), key, "left_anti").limit(1).count()
    if lost:
        raise PublishError("a key wasn't written")
    return version


def current_version(spark: SparkSession, path: str) -> int | None:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")]
    done = [int(p.getName()[2:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=None)


def docx(paragraphs: list[str]) -> bytes:
    """A word-processor file of a short report's paragraphs. Reports are driver-sized by nature."""
    from xml.sax.saxutils import escape

    body = "".join(f"<w:p><w:r><w:t xml:space=\"preserve\">{escape(p)}</w:t></w:r></w:p>" for p in paragraphs)
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {space}><w:body>{body}</w:body></w:document>')
    return out.getvalue()
