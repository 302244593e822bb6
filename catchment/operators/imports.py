"""Import of returned rail research: metadata against the plan, strict quality field by field, passing stations merged, failing ones listed for correction, batches marked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import text
from ..sources.scratch import stored
from . import merge, quality

#: What a returned batch must have as planned. Fixed names.
METADATA = ("request_group", "sequence", "total")


@dataclass
class Imported:
    """failures(batch, record, field, reason, url): every reason for which a station goes back. merged: the master's fields with those of passing stations laid over them (`merge.merge_fields`). states(batch, state, problems, passed, failed, failures): rejected,
    correction-required or imported."""

    failures: DataFrame
    merged: DataFrame
    states: DataFrame


def metadata_problems(plan: DataFrame, returned: DataFrame) -> DataFrame:
    """(batch, problems): what differs between each returned batch and its plan, joined by '; ', '' if nothing. A batch that wasn't planned says so."""
    planned = plan.select("batch", F.lit(True).alias("_planned"), *[F.col(c).alias(f"_{c}") for c in METADATA])
    met = returned.join(planned, "batch", "left")
    wrong = quality.array_of(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) != F.coalesce(F.col(f"_{c}").cast("string"), F.lit("")), f"{c} does not match the plan") for c in METADATA])
    return met.select("batch", F.when(F.col("_planned").isNull(), "batch was not planned").otherwise(F.array_join(wrong, "; ")).alias("problems"))


def rail_import(plan: DataFrame, returned: DataFrame, fields: DataFrame, master: DataFrame, legacy: bool = False) -> Imported:
    """Import the batches returned(batch, request_group, sequence, total) with their fields(batch, record, key, field, value, status, source, source_title, publisher, retrieval_date) against plan(batch, ...) and master(key, field, value, status, date).

    A batch whose metadata isn't as planned is rejected whole. Of others each field is checked by the strict rules (with legacy, by the lenient ones of old files); a station that can't be published fails, and with it all of its name in the batch. Failing stations get a row for each
    issue, or one for the quality of the whole record where no field has an issue. Fields of passing stations are merged, so partly good batches aren't lost. A batch without stations is imported with nothing. Null values are empty.
    """
    problems = metadata_problems(plan, returned)
    sound = problems.filter("problems = ''").select("batch")
    judged = fields.join(sound, "batch", "left_semi").withColumn("r", quality.field_result(legacy=legacy)).withColumn("_id", F.to_json(F.struct("batch", "key")))
    judged = stored(judged.select("*", "r.state", "r.issues").drop("r"), "judged-fields")
    reports = quality.analyse_records(judged, "_id").select("_id", "quality", "publishable")
    named = judged.select("_id", "batch", "record").distinct().join(reports, "_id")
    failing = stored(named.filter("not publishable").select("batch", "record").distinct(), "failing")
    stations = named.join(failing.withColumn("_failed", F.lit(True)), ["batch", "record"], "left").select("_id", "batch", "record", "quality", "publishable", F.coalesce("_failed", F.lit(False)).alias("failed"))

    issues = judged.join(named.filter("not publishable").select("_id"), "_id", "left_semi").filter(F.trim(text("value")) != "").select("_id", "batch", "record", F.col("field").cast("string").alias("field"), F.explode("issues").alias("reason"), F.col("source").alias("url"))
    whole = stations.filter("not publishable").join(issues.select("_id").distinct(), "_id", "left_anti").select("_id", "batch", "record", F.lit(None).cast("string").alias("field"), F.col("quality").alias("reason"), F.lit("").alias("url"))
    failures = issues.unionByName(whole).drop("_id")

    good = judged.join(stations.filter("not failed").select("_id"), "_id", "left_semi")
    merged = merge.merge_fields(master, good.select("key", "field", "value", "status", F.col("retrieval_date").alias("date")))

    counts = stations.groupBy("batch").agg(F.count_if(~F.col("failed")).alias("passed"), F.count_if("failed").alias("failed"))
    n = failures.groupBy("batch").agg(F.count("*").alias("failures"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    states = problems.join(counts, "batch", "left").join(n, "batch", "left").select("batch", "problems", zero("passed"), zero("failed"), zero("failures"))
    state = F.when(F.col("problems") != "", "rejected").when(F.col("failed") > 0, "correction-required").otherwise("imported")
    return Imported(failures, merged, states.select("batch", state.alias("state"), "problems", "passed", "failed", "failures"))
