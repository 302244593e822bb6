"""Preference formatting of chat conversations.

For a chosen and a rejected conversation the longest common prefix of turns is rendered once, as the prompt; what follows on either side is a completion whose
assistant turns are to be learnt and whose other turns are masked. Everything is a row for each turn: no conversation is gathered into one value, so one that
holds a large share of all turns is no different from others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import stored

#: Conversations in one block of a pairing group.
BLOCK = 1024


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, k, role, text): equal rows once; k numbers different rows of one turn by role and text. Null roles count as unknown, null texts as empty, null
    turns as turn -1; rows without conv_id are left out."""
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    return rows.withColumn("k", F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text")))


def _number(text: str, digits: int):
    return F.conv(F.substring(F.md5(F.col(text).cast("string").cast("binary")), 1, digits), 16, 10).cast("long")


def pairs_by_opening(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): every conversation is chosen once, against the next one of its block by conv_id (the last against the first).

    Conversations with the same first turn form a group; those with a first turn of their own are grouped by one digit of its hash. Groups are cut into blocks of about
    BLOCK conversations by a hash of conv_id. A conversation alone in its block has a null rejected side.
    """
    first = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "k", "role", "text")).alias("f"))
    first = first.select("conv_id", F.md5(F.concat_ws(":", "f.role", "f.text").cast("binary")).alias("opening"))
    size = first.groupBy("opening").agg(F.count("*").alias("n"))
    grouped = first.join(size, "opening").select("conv_id", F.when(F.col("n") > 1, F.col("opening")).otherwise(F.substring("opening", 1, 1)).alias("grp"))
    total = grouped.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = grouped.join(total, "grp").select("conv_id", "grp", (_number("conv_id", 8) % F.col("blocks")).alias("block"))
    w = W.partitionBy("grp", "block")
    rejected = F.coalesce(F.lead("conv_id").over(w.orderBy("conv_id")), F.min("conv_id").over(w))
    return dealt.select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen"), F.nullif(rejected, F.col("conv_id")).alias("rejected"))


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, part, turn, k, role, segment, learn) for turns(conv_id, turn, k, role, text) and pairs(pair_id, chosen, rejected).

    part is prompt, chosen or rejected. segment is the turn in chat markup; learn is 1 for assistant turns of a completion, else 0. Turns agree if number, role and text do; the
    prompt ends before the first that don't. A conversation that is the other's beginning has no completion. Against a null or unknown conversation all turns of the other one
    are its completion; pairs of two such have no rows.
    """
    side = lambda which, p: pairs.select("pair_id", F.col(which).alias("conv_id")).join(turns, "conv_id").select("pair_id", "turn", "k", F.struct("role", "text").alias(p))
    both = stored(side("chosen", "c").join(side("rejected", "r"), ["pair_id", "turn", "k"], "full_outer"), "turn-pairs")
    differs = ~F.col("c").eqNullSafe(F.col("r"))
    end = both.groupBy("pair_id").agg(F.min(F.when(differs, F.struct("turn", "k"))).alias("end"))
    rows = both.join(end, "pair_id").withColumn("common", F.col("end").isNull() | (F.struct("turn", "k") < F.col("end")))
    part = lambda name, turn: F.struct(F.lit(name).alias("part"), turn.alias("t"))
    parts = F.when(F.col("common"), F.array(part("prompt", F.col("c")))).otherwise(F.array(part("chosen", F.col("c")), part("rejected", F.col("r"))))
    rows = rows.select("pair_id", "turn", "k", F.explode(F.filter(parts, lambda p: p["t"].isNotNull())).alias("p"))
    segment = F.concat(F.lit("<|"), F.col("p.t.role"), F.lit("|>\n"), F.col("p.t.text"), F.lit("<|end|>\n"))
    learn = ((F.col("p.part") != "prompt") & (F.col("p.t.role") == "assistant")).cast("int")
    return rows.select("pair_id", F.col("p.part").alias("part"), "turn", "k", F.col("p.t.role").alias("role"), segment.alias("segment"), learn.alias("learn"))


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted turns of each conversation against the next of its block, which is the rejected one: prompt, or masked completion. Blocks and rows with nulls are as in `pairs_by_opening` and `turns_of`; no conversations, no rows."""
    turns = stored(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    pairs = stored(pairs_by_opening(turns), "pairs")
    return pairs.select("pair_id", "rejected").join(format_pairs(turns, pairs), "pair_id")


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS k
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
f AS (SELECT conv_id, md5(role || ':' || text) AS opening FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) = 1),
g AS (SELECT conv_id, CASE WHEN count(*) OVER (PARTITION BY opening) > 1 THEN opening ELSE substr(opening, 1, 1) END AS grp FROM f),
b AS (SELECT conv_id, grp, CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 8) AS BIGINT) % CAST(ceil(count(*) OVER (PARTITION BY grp) / 1024.0) AS BIGINT) AS block FROM g),
pairs AS (SELECT conv_id AS pair_id, nullif(coalesce(lead(conv_id) OVER (PARTITION BY grp, block ORDER BY conv_id), min(conv_id) OVER (PARTITION BY grp, block)), conv_id) AS rejected FROM b),
c AS (SELECT pair_id, turn, k, role, text FROM pairs JOIN t ON t.conv_id = pair_id),
r AS (SELECT pair_id, turn, k, role, text FROM pairs JOIN t ON t.conv_id = rejected),
m AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.k, r.k) AS k, c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text
      FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.turn = r.turn AND c.k = r.k),
e AS (SELECT *, max(CASE WHEN c_role IS NOT DISTINCT FROM r_role AND c_text IS NOT DISTINCT FROM r_text THEN 0 ELSE 1 END)
        OVER (PARTITION BY pair_id ORDER BY turn, k ROWS UNBOUNDED PRECEDING) = 0 AS common FROM m),
s AS (SELECT pair_id, CASE WHEN common THEN 'prompt' ELSE 'chosen' END AS part, turn, k, c_role AS role, c_text AS text FROM e WHERE c_role IS NOT NULL
      UNION ALL SELECT pair_id, 'rejected', turn, k, r_role, r_text FROM e WHERE NOT common AND r_role IS NOT NULL)
SELECT s.pair_id, pairs.rejected, part, turn, k, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS segment,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 1 ELSE 0 END AS learn
FROM s JOIN pairs USING (pair_id)
"""
