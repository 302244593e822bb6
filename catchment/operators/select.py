"""First wins, last wins, top k, best match and chunks, each by an explicit order so that results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored


def _keys(keys) -> list:
    return [keys] if isinstance(keys, (str, Column)) else list(keys)


def ranked(df: DataFrame, keys, order, most: int = 1, name: str | None = None) -> DataFrame:
    """The first `most` rows of each key in an order; name keeps the rank."""
    rank = name or "_rank"
    out = df.withColumn(rank, F.row_number().over(W.partitionBy(*_keys(keys)).orderBy(*_keys(order)))).filter(F.col(rank) <= most)
    return out if name else out.drop(rank)


def first_wins(df: DataFrame, keys, seq: str = "seq") -> DataFrame:
    return ranked(df, keys, F.col(seq))


def last_wins(df: DataFrame, keys, seq: str = "seq") -> DataFrame:
    return ranked(df, keys, F.col(seq).desc())


def two_level(df: DataFrame, exact, similar, seq: str = "seq") -> DataFrame:
    """First of each exact key, then first of each similarity key among those."""
    return first_wins(first_wins(df, exact, seq), similar, seq)


def chunked(df: DataFrame, size: int, order, keys=()) -> DataFrame:
    """df with chunk, the number of its run of size rows within keys, or of the whole table without keys."""
    if not _keys(keys):
        return numbered(df, order, "_place").withColumn("chunk", F.floor((F.col("_place") - 1) / size)).drop("_place")
    w = W.partitionBy(*_keys(keys)).orderBy(*_keys(order))
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))


def numbered(df: DataFrame, order, name: str) -> DataFrame:
    """df with name, the place from 1 of each row of the whole table in an order: places within ranges of the order, after the rows of the ranges before. Only the counts of ranges meet in one task."""
    dealt = stored(df.repartitionByRange(*_keys(order)).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*_keys(order)))
    return dealt.withColumn(name, place).join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def duplicates(df: DataFrame, keys, seq: str = "seq") -> DataFrame:
    """Later rows of a key with the seq of its first row, as first_seq."""
    w = W.partitionBy(*_keys(keys))
    out = df.withColumn("first_seq", F.min(seq).over(w))
    return out.filter(F.col(seq) > F.col("first_seq"))


def merged_missing(base: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """base and those rows of more whose key base lacks."""
    return base.unionByName(more.join(base.select(*keys).distinct(), keys, "left_anti"))


def layered(*layers: DataFrame) -> DataFrame:
    """Union of tables in order of precedence, with layer 0 first."""
    out = layers[0].withColumn("layer", F.lit(0))
    for i, x in enumerate(layers[1:], 1):
        out = out.unionByName(x.withColumn("layer", F.lit(i)), allowMissingColumns=True)
    return out


def natural_order(c: str) -> list[Column]:
    """Sort keys of numeric-aware, case-insensitive order: letters before the number, the number, the rest."""
    low = F.lower(F.col(c))
    number = F.regexp_extract(low, r"(\d+)", 1)
    return [F.regexp_extract(low, r"^(\D*)", 1), F.lpad(number, 20, "0"), low, F.col(c)]
