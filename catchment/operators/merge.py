"""Merging new findings into master tables. A null column in a new row means that the row doesn't state it; an empty text is a statement and overwrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import is_verified


def _both(master: DataFrame, proposed: DataFrame, key: str) -> DataFrame:
    """Full outer join by key with old and new rows as structs."""
    pack = lambda df, n: df.select(F.col(key), F.struct(*[F.col(c) for c in df.columns if c != key]).alias(n))
    return pack(master, "old").join(pack(proposed, "new"), key, "full_outer")


def _overlaid(both: DataFrame, key: str, columns: list[str], take_new: Column) -> DataFrame:
    pick = [F.when(take_new, F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))).otherwise(F.col(f"old.{c}")).alias(c) for c in columns]
    return both.select(key, *pick, "action")


def merge_master(master: DataFrame, proposed: DataFrame, key: str = "key", status: str = "status", date: str = "date", strict: bool = True) -> DataFrame:
    """master with proposed rows laid over it, one row a key, and action: addition, update, preserved (a verified row against one that isn't verified or is older; a conflict), rejected (a key that is
    empty or, if strict, ends with a colon) or kept (nothing proposed). Rejected rows come along with their own values and don't enter the master."""
    columns = [c for c in master.columns if c != key]
    bad = (F.coalesce(F.col(key), F.lit("")) == "") | (F.col(key).endswith(":") if strict else F.lit(False))
    rejected = proposed.filter(bad).select(key, *columns, F.lit("rejected").alias("action"))
    both = _both(master, proposed.filter(~bad), key)
    held = F.col("old").isNotNull() & is_verified(f"old.{status}") & (~is_verified(f"new.{status}") | F.coalesce(F.col(f"old.{date}") > F.col(f"new.{date}"), F.lit(False)))
    action = F.when(F.col("new").isNull(), "kept").when(held, "preserved").when(F.col("old").isNull(), "addition").otherwise("update")
    both = both.withColumn("action", action)
    return _overlaid(both, key, columns, F.col("action").isin("addition", "update")).unionByName(rejected)


def merge_local(master: DataFrame, proposed: DataFrame, key: str = "key", status: str = "status", date: str = "date") -> DataFrame:
    """As merge_master with a wider guard: a newer row is held whatever its status, and equal rows count as preserved."""
    columns = [c for c in master.columns if c != key]
    both = _both(master, proposed, key)
    held = F.col("old").isNotNull() & ((is_verified(f"old.{status}") & ~is_verified(f"new.{status}")) | F.coalesce(F.col(f"old.{date}") > F.col(f"new.{date}"), F.lit(False)) | F.col("old").eqNullSafe(F.col("new")))
    both = both.withColumn("action", F.when(F.col("new").isNull(), "kept").when(held, "preserved").when(F.col("old").isNull(), "addition").otherwise("update"))
    return _overlaid(both, key, columns, F.col("action").isin("addition", "update"))


def merge_newest(master: DataFrame, proposed: DataFrame, key: str = "key", date: str = "date") -> DataFrame:
    """New rows replace old ones unless the old is strictly newer."""
    columns = [c for c in master.columns if c != key]
    both = _both(master, proposed, key)
    held = F.col("old").isNotNull() & F.coalesce(F.col(f"old.{date}") > F.col(f"new.{date}"), F.lit(False))
    both = both.withColumn("action", F.when(F.col("new").isNull(), "kept").when(held, "preserved").when(F.col("old").isNull(), "addition").otherwise("update"))
    pick = [F.when(F.col("action").isin("addition", "update"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in columns]
    return both.select(key, *pick, "action")


def preview(merged: DataFrame) -> DataFrame:
    """Counts of a merge in one row."""
    n = lambda a: F.count_if(F.col("action") == a)
    return merged.agg(n("addition").alias("additions"), n("update").alias("updates"), n("preserved").alias("preserved"), n("preserved").alias("conflicts"), n("rejected").alias("rejected"))


def merge_fields(old: DataFrame, new: DataFrame, keys: tuple[str, str] = ("key", "field")) -> DataFrame:
    """Field by field merge of long tables (key, field, value, status, date): an empty new value never replaces; a verified one is replaced neither by an unverified nor by an older verified one. Adds outcome
    (kept, preserved, conflict, updated) and flag, the reason of a conflict."""
    o = old.select(*keys, F.struct("value", "status", "date").alias("o"))
    n = new.select(*keys, F.struct("value", "status", "date").alias("n"))
    both = o.join(n, list(keys), "full_outer")
    empty = F.col("n").isNull() | (F.coalesce(F.col("n.value"), F.lit("")) == "")
    older = (F.col("o.status") == "verified") & (F.col("n.status") == "verified") & (F.coalesce(F.col("o.date"), F.lit("")) > F.coalesce(F.col("n.date"), F.lit("")))
    weaker = (F.col("o.status") == "verified") & (F.col("n.status") != "verified")
    outcome = F.when(F.col("n").isNull(), "kept").when(empty, "preserved").when(F.coalesce(older | weaker, F.lit(False)), "conflict").otherwise("updated")
    flag = F.when(F.coalesce(older, F.lit(False)) & ~empty, "older verified import preserved existing newer value").when(F.coalesce(weaker, F.lit(False)) & ~empty, "unverified import did not replace verified value").otherwise("")
    take = F.when(outcome == "updated", F.col("n")).otherwise(F.coalesce("o", F.when(F.col("o").isNull(), F.col("n"))))
    return both.withColumn("outcome", outcome).withColumn("flag", flag).withColumn("r", take).select(*keys, "r.value", "r.status", "r.date", "outcome", "flag")


def delete_unchanged(master: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    """master without the wanted rows that are equal to it in every column; a row that has changed since stays."""
    columns = [c for c in master.columns if c != key]
    mark = lambda df: df.withColumn("_same", F.xxhash64(*[F.col(c) for c in columns])).select(key, "_same")
    return master.withColumn("_same", F.xxhash64(*[F.col(c) for c in columns])).join(mark(wanted), [key, "_same"], "left_anti").drop("_same")


def with_audit(df: DataFrame, editor: str, as_of: str, build: str) -> DataFrame:
    return df.withColumns({"editor_name": F.lit(editor), "updated_at": F.lit(as_of), "originating_build": F.lit(build)})
