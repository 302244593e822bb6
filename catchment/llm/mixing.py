"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Every document gets a virtual finish time: the words of its source up to and including it, in a shuffled order, divided by
the source's target. Passes over a source follow one another. All copies are range-sorted by finish time and the mix
takes them in that order until the total budget is reached.

Prefix sums are taken in two levels (ranges of the shuffle key or of the finish time, then rows within a range), so a
source that holds most rows is spread over as many tasks as it has ranges; the number of ranges follows the row count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import row_key, scratch, stored

#: Rows in one range of a prefix sum.
RANGE_ROWS = 1024
#: Parts in which the rows of one key are numbered.
SALTS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(per_source: DataFrame, passes: int = 3) -> DataFrame:
    """Targets for (source, source_size): weights 1, 2, 3 repeating in code point order (null last) share all sizes; a
    target stops at passes times its source's size and the excess is shared by weight among the rest.

    The fill level is found in closed form: by rising cap over weight, a source is full while its cap is at most its share of what
    is left. The window holds one row a source.
    """
    big = lambda c: c.cast("decimal(38,0)")
    rank = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    t = per_source.select("source", "source_size", ((F.row_number().over(rank) - 1) % 3 + 1).cast("long").alias("weight"))
    t = t.withColumn("cap", F.col("source_size") * passes)
    t = t.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("cap_before", F.coalesce(F.sum("cap").over(fill), F.lit(0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(fill), F.lit(0)))
    t = t.withColumn("full", big(F.col("cap")) * big(F.col("weights") - F.col("weight_before")) <= big(F.col("total") - F.col("cap_before")) * big(F.col("weight")))
    t = t.withColumn("cap_full", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything))
    t = t.withColumn("weight_full", F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(everything))
    share = F.try_divide(((F.col("total") - F.col("cap_full")) * F.col("weight")).cast("double"), (F.col("weights") - F.col("weight_full")).cast("double"))
    return t.select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.coalesce(share, F.lit(0.0))).alias("target"))


def ranges_bits(rows: int) -> int:
    return max(0, math.ceil(math.log2(max(rows, 1) / RANGE_ROWS)))


def starts_of_ranges(sums: DataFrame, bits: int) -> DataFrame:
    """(b_source, b_r, range_start) for sums(source, r, range_size): the total of the source's ranges before each. Groups of ranges are summed first, then the
    ranges within a group, so that no task holds more than about the square root of their number."""
    grouped = sums.withColumn("g", F.shiftright("r", bits // 2))
    before = lambda value, *by: F.sum(value).over(W.partitionBy("source", *by[:-1]).orderBy(by[-1])) - F.col(value)
    groups = grouped.groupBy("source", "g").agg(F.sum("range_size").alias("s"))
    groups = groups.select(F.col("source").alias("g_source"), F.col("g").alias("g_g"), before("s", "g").alias("group_start"))
    inner = grouped.select("source", "g", "r", before("range_size", "g", "r").alias("inner_start"))
    both = inner.join(groups, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("g") == F.col("g_g")))
    return both.select(F.col("source").alias("b_source"), F.col("r").alias("b_r"), (F.col("group_start") + F.col("inner_start")).alias("range_start"))


def end_of_budget(by_range: DataFrame, budget: int, bits: int) -> tuple[int, int] | None:
    """(f, sum before f) of the first range by f, of by_range(f, s), in which the running sum passes budget: first its group of ranges, then the range. None: it never does."""
    first = lambda d, key, start: d.select(key, (F.sum("s").over(W.orderBy(key)) + start).alias("c"), "s").filter(F.col("c") > budget).orderBy(key).limit(1).first()
    grouped = by_range.withColumn("g", F.shiftright("f", bits // 2))
    over = first(grouped.groupBy("g").agg(F.sum("s").alias("s")), "g", 0)
    if over is None:
        return None
    over = first(grouped.filter(F.col("g") == over["g"]), "f", over["c"] - over["s"])
    return over["f"], over["c"] - over["s"]


def _mixed(rows: DataFrame, passes: int) -> DataFrame:
    """rows(k_doc, k_text, source, size, u) with source_size, target, times and first_finish. u is the shuffle key."""
    ties = ["k_doc", "k_text"]
    per_source = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), passes), "mix-targets")
    counted = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    bits, budget = ranges_bits(counted["n"]), int(counted["total"])

    # the words of a source before each range of the shuffle key, then before each row within its range
    ranged = rows.withColumn("r", F.shiftright("u", 60 - bits) if bits else F.lit(0).cast("long"))
    before = starts_of_ranges(ranged.groupBy("source", "r").agg(F.sum("size").alias("range_size")), bits)
    inner = W.partitionBy("source", "r").orderBy("u", *ties).rowsBetween(W.unboundedPreceding, 0)
    queued = ranged.withColumn("upto", F.sum("size").over(inner))
    queued = queued.join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("r") == F.col("b_r")))
    per = per_source.withColumnRenamed("source", "p_source")
    queued = queued.join(per, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("upto", F.col("upto") + F.col("range_start"))
    queued = stored(queued.select(*ties, "source", "size", "source_size", "target", "upto"), "mix-queue")

    # where the budget ends in the order of finish times: first the range, then the row
    finish = lambda e: F.try_divide((F.col("source_size") * e + F.col("upto")).cast("double"), F.col("target"))
    queued = queued.withColumn("first_finish", finish(F.lit(0)))
    copies = queued.filter("size > 0 and target > 0").withColumn("pass", F.explode(F.array(*[F.lit(e) for e in range(passes)])))
    copies = copies.withColumn("finish", finish(F.col("pass"))).withColumn("f", F.floor(F.col("finish") * (1 << bits)))
    end = end_of_budget(copies.groupBy("f").agg(F.sum("size").alias("s")), budget, bits)
    if end is None:
        return queued.withColumn("times", F.when(F.col("size") > 0, F.lit(passes)).otherwise(0))
    order = ["finish", *ties, "pass"]
    edge = copies.filter(F.col("f") == end[0]).withColumn("c", F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) + end[1])
    last = edge.filter(F.col("c") <= budget).orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(1).first()
    if last is None:
        goes = lambda e: F.floor(finish(F.lit(e)) * (1 << bits)) < F.lit(end[0])
    else:
        kinds = ["double", *[queued.schema[c].dataType for c in ties], "int"]
        at = F.struct(*[F.lit(last[c]).cast(t) for c, t in zip(order, kinds)])
        goes = lambda e: F.struct(finish(F.lit(e)), *ties, F.lit(e).cast("int")) <= at
    times = sum((F.when(goes(e), 1).otherwise(0) for e in range(1, passes)), F.when(goes(0), 1).otherwise(0))
    return queued.withColumn("times", F.when((F.col("size") > 0) & (F.col("target") > 0), times).otherwise(0))


def shuffle_key(seed: str) -> Column:
    """60 bits of a hash of seed and doc_id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def mixed(docs: DataFrame, size: Column | None = None, seed: str = "mix", passes: int = 3) -> DataFrame:
    """One row for each row of docs(doc_id, text, source): k_doc, k_text, source, size, source_size, target, times, taken, first_finish.

    times is how often the mix takes the row (0 to passes). A null text has size 0; rows of size 0 are never taken. Null
    sources are a source of their own. Equal rows count separately. The same rows and seed give the same mix,
    however the input is partitioned.
    """
    size = words_in(F.col("text")) if size is None else size
    rows = stored(docs.select(*row_key(), "source", size.alias("size"), shuffle_key(seed).alias("u")), "mix-rows")
    out = _mixed(rows, passes)
    return out.select("k_doc", "k_text", "source", "size", "source_size", "target", F.col("times").cast("int").alias("times"), (F.col("size") * F.col("times")).cast("long").alias("taken"), "first_finish")


def mix_documents(docs: DataFrame, seed: str = "mix", passes: int = 3) -> DataFrame:
    """The mixed corpus itself: the rows of docs, each as often as the mix takes it (as `mixed` says), all columns kept whatever their names.

    Rows with equal doc_id, text and source share what the mix takes of them evenly; which of them is taken once more than others isn't defined.
    """
    columns = docs.columns
    own = {name: F.col(f"c{columns.index(name)}") for name in ("doc_id", "text", "source")}
    flat = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    with scratch():
        taken = mixed(docs.select("doc_id", "text", "source"), seed=seed, passes=passes)
        taken = taken.groupBy("k_doc", "k_text", F.col("source").alias("k_source")).agg(F.count("*").alias("n"), F.sum("times").cast("int").alias("times"))
        taken = stored(taken.filter("times > 0"), "mix-taken", keep=True)
    key = [own["doc_id"].alias("o_doc"), F.xxhash64(F.coalesce(own["text"], F.lit("")), own["text"].isNull()).alias("o_text"), own["source"].alias("o_source")]
    same = F.col("o_doc").eqNullSafe(F.col("k_doc")) & (F.col("o_text") == F.col("k_text")) & F.col("o_source").eqNullSafe(F.col("k_source"))
    held = flat.select("*", *key).join(taken, same).drop("o_doc", "o_text", "o_source")
    single = held.filter("n = 1").select(*flat.columns, "times")
    out = single
    if not taken.filter("n > 1").isEmpty():
        out = single.union(_shared(stored(held.filter("n > 1").withColumn("row", F.monotonically_increasing_id()), "mix-equal")).select(*flat.columns, "times"))
    return out.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*flat.columns).toDF(*columns)


def _shared(equal: DataFrame) -> DataFrame:
    """equal(k_doc, k_text, k_source, n, times, row, ...), n rows a key, with the key's times dealt to its rows. Rows are numbered in two levels: no task holds a whole key."""
    key = ["k_doc", "k_text", "k_source"]
    rows = equal.select(*key, "row", F.pmod("row", F.lit(SALTS)).alias("salt"))
    before = rows.groupBy(*key, "salt").agg(F.count("*").alias("m")).withColumn("start", F.sum("m").over(W.partitionBy(*key).orderBy("salt")) - F.col("m"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*key, "salt")]
    numbered = rows.withColumn("i", F.row_number().over(W.partitionBy(*key, "salt").orderBy("row"))).alias("a").join(before.alias("b"), same)
    numbered = numbered.select("a.row", (F.col("i") + F.col("start")).alias("i"))
    share = F.expr("times div n") + F.when(F.col("i") <= F.col("times") % F.col("n"), 1).otherwise(0)
    return equal.join(numbered, "row").withColumn("times", share.cast("int")).filter("times > 0")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs).select(F.col("k_doc").alias("doc_id"), "source", "size", "source_size", "target", "taken", "times")


OP10_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
b AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
        coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * (weights - weight_before) <= (total - cap_before) * weight AS is_full FROM b),
g AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS cap_full, sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER () AS weight_full FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
        ELSE CAST((total - cap_full) * weight AS DOUBLE) / CAST(weights - weight_full AS DOUBLE) END AS target FROM g),
q AS (SELECT r.*, t.source_size, t.target, sum(size) OVER (PARTITION BY r.source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM rows r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, p.pass, CAST(p.pass * source_size + upto AS DOUBLE) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS pass) p WHERE size > 0 AND target > 0),
k AS (SELECT *, sum(size) OVER (ORDER BY finish, doc_id, pass ROWS UNBOUNDED PRECEDING) AS upto_all FROM c),
n AS (SELECT doc_id, count(*) AS times FROM k WHERE upto_all <= (SELECT sum(size) FROM rows) GROUP BY doc_id)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target, CAST(q.size * coalesce(n.times, 0) AS BIGINT) AS taken, CAST(coalesce(n.times, 0) AS INTEGER) AS times
FROM q LEFT JOIN n USING (doc_id)
"""
