"""Walks over nested records of any shape: every text in them with the path to it."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import evidence
from ..sources.scratch import stored

#: Keys below which no research text lies. Fixed values.
SOURCE_KEYS = "(?i)^(?:sources?|sourceTitle|url)$"


def string_leaves(records: DataFrame, key: str, document: str, skip: str = SOURCE_KEYS) -> DataFrame:
    """(key, path, text): the texts within each record's JSON document, as a.b[2].c (a text that is the whole document has the path ''). What lies below an object's key that matches skip is left out.

    Documents are variant values, opened one level of all records at a time, each written to the shared folder, so no record is walked in Python and rounds are as many as the deepest document is deep. A null document or one that isn't JSON has no texts; numbers,
    booleans and nulls aren't texts; records are told apart by key, and of several rows with one key each has its own.
    """
    kind = lambda v: F.schema_of_variant(v)
    level = records.select(F.col(key).alias("_key"), F.lit("").alias("_path"), F.try_parse_json(document).alias("_v")).filter("_v is not null")
    found = []
    while True:
        level = level.withColumn("_kind", kind("_v"))
        texts = level.filter("_kind = 'STRING'").select("_key", "_path", F.try_variant_get("_v", "$", "string").alias("text"))
        inner = level.filter(F.col("_kind").startswith("OBJECT") | F.col("_kind").startswith("ARRAY")).select("_key", "_path", "_v")
        found.append(stored(texts, "texts"))
        opened = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        opened = opened.filter(F.col("key").isNull() | ~F.col("key").rlike(skip))
        step = F.when(F.col("key").isNull(), F.concat("_path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("_path") == "", F.col("key")).otherwise(F.concat("_path", F.lit("."), "key"))
        level = stored(opened.select("_key", step.alias("_path"), F.to_json("value").alias("_t")), "level")
        if level.isEmpty():
            break
        level = level.select("_key", "_path", F.parse_json("_t").alias("_v"))
    return functools.reduce(DataFrame.unionByName, found).select(F.col("_key").alias(key), F.col("_path").alias("path"), "text")


def placeholder_paths(records: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path) of the texts in each record that bar it from import: wording in place of research, anywhere but in sources and URLs."""
    return string_leaves(records, key, document).filter(evidence.is_lazy("text")).select(key, "path")
