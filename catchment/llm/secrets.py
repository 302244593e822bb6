"""Secret scans with multipart credential linking.

Certain patterns are reported wherever they match. Weak candidates (identifiers, mixed tokens, endpoints) are common in clean text, so they are reported only where a
complementary part lies in the same scope: a secret next to an identifier or an endpoint. Parts are linked by an interval join over positions, dealt by document and
stretch of text, as a semi-join that lists no pairs.

Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .store import row_key, slices, stored, tidied

#: Code points between complementary parts, at most, and the stretch by which the join is dealt.
SCOPE, STRETCH = 256, 512

#: Kinds in order of listing, with their roles.
KINDS = {"assign": "secret", "access": "identifier", "hex": "secret", "weak_secret": "secret", "weak_identifier": "identifier", "endpoint": "endpoint"}
RANK = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_MIXED = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_IDENTIFIER = re.compile(r"""(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}|(?:ASIA|AROA|AIDA|AKIA)[A-Z0-9]{8,}""", re.A | re.I)
_ENDPOINT = re.compile(r"""(?:https?|ftp|s3|jdbc:[a-z]+|postgres|mysql|redis|amqp|mongodb)://[^\s"'<>]+|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?\b""", re.A | re.I)

_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*b"0123456789abcdef"]] = True
_MIXED_BYTE = np.zeros(256, bool)
_MIXED_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_=-"]] = True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all certain matches, by start, then kind. Matches are leftmost and non-overlapping for each kind; too short ones are dropped after that."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], RANK[s[2]]))


def _entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def weak_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak candidates that overlap no certain match."""
    out = [(m.start(), m.end(), "weak_secret") for m in _MIXED.finditer(text) if _looks_random(m[0])]
    out += [(m.start(), m.end(), "weak_identifier") for m in _IDENTIFIER.finditer(text)]
    out += [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    taken = sorted(base)
    starts = np.array([s[0] for s in taken], np.int64)
    longest = np.maximum.accumulate(np.array([s[1] for s in taken], np.int64)) if taken else starts
    free = []
    for s in sorted(out, key=lambda s: (s[0], RANK[s[2]])):
        i = int(np.searchsorted(starts, s[1])) - 1  # the last match that starts before the candidate's end
        if i < 0 or longest[i] <= s[0]:
            free.append(s)
    return free


def _looks_random(token: str) -> bool:
    kinds = any(c.isdigit() for c in token) + any("a" <= c <= "z" for c in token) + any("A" <= c <= "Z" for c in token)
    return kinds == 3 and _entropy(token) >= 3.5


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Which rows hold a run of at least `least` marked bytes."""
    n = len(mask)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin, stop = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1] | edge[1:n]
    stop[:-1] &= ~mask[1:] | edge[1:n]
    a, z = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = a[z - a >= least]
    return np.diff(np.searchsorted(long, offsets)) > 0


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, k_doc, k_text, base, weak) for each row of docs(doc_id, text): arrays of (start, end, kind). A null text is an empty one.

    Weak candidates are listed only for texts with a possible secret: without one none can be linked.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                column = b.column("text")
                data, offsets = kernels.buffers(column)
                marked = _runs(_HEX_BYTE[data], offsets, 24) | _runs(_MIXED_BYTE[data], offsets, 20)
                base, weak = [], []
                for text, m in zip(column.to_pylist(), marked.tolist()):
                    low = (text or "").lower()
                    if text and (m or "akia" in low or any(n in low for n in _NAMES)):
                        found = base_spans(text)
                        rest = weak_spans(text, found)
                        secret = any(KINDS[s[2]] == "secret" for s in (*found, *rest))
                    else:
                        found, rest, secret = [], [], False
                    base.append([{"start": a, "end": z, "kind": k} for a, z, k in found])
                    weak.append([{"start": a, "end": z, "kind": k} for a, z, k in rest] if secret else [])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k_doc"), b.column("k_text"), pa.array(base, kind), pa.array(weak, kind)], names=["doc_id", "k_doc", "k_text", "base", "weak"])

    spans = "array<struct<start:long,end:long,kind:string>>"
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key()).withColumn("k_doc", F.coalesce(F.col("k_doc").cast("long"), F.lit(-1)))
    return keyed.mapInArrow(tidied(run), f"doc_id long, k_doc long, k_text long, base {spans}, weak {spans}")


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(k_doc, k_text, linked): weak candidates with a complementary part within scope code points, as arrays of (start, end, kind)."""
    role = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    part = lambda s, which: F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.lit(which).alias("weak")))
    rows = scanned.filter(F.size("weak") > 0).select("k_doc", "k_text", F.explode(F.concat(part(F.col("base"), 0), part(F.col("weak"), 1))).alias("s")).distinct()
    rows = rows.select("k_doc", "k_text", F.col("s.start").alias("a"), F.col("s.end").alias("z"), F.col("s.kind").alias("kind"), role[F.col("s.kind")].alias("role"), F.col("s.weak").alias("weak"))
    stretch = lambda c: F.floor(c / STRETCH)
    left = rows.filter("weak = 1").withColumn("at", F.explode(F.sequence(stretch(F.col("a") - scope), stretch(F.col("z") + scope))))
    right = rows.select(F.col("k_doc").alias("r_doc"), F.col("k_text").alias("r_text"), F.col("a").alias("r_a"), F.col("z").alias("r_z"), F.col("role").alias("r_role"))
    right = right.withColumn("r_at", F.explode(F.sequence(stretch(F.col("r_a")), stretch(F.col("r_z")))))
    near = (F.col("r_a") <= F.col("z") + scope) & (F.col("a") <= F.col("r_z") + scope)
    complement = (F.col("role") != F.col("r_role")) & ((F.col("role") == "secret") | (F.col("r_role") == "secret"))
    same = (F.col("k_doc") == F.col("r_doc")) & (F.col("k_text") == F.col("r_text")) & (F.col("at") == F.col("r_at"))
    hit = left.join(right, same & near & complement, "left_semi")
    return hit.groupBy("k_doc", "k_text").agg(F.collect_set(F.struct(F.col("a").alias("start"), F.col("z").alias("end"), "kind")).alias("linked"))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, linked) for each row of docs(doc_id, text): certain spans and linked weak spans, each an array of (start, end, kind) by start, then kind.

    Rows without any have empty arrays; equal rows have equal results.
    """
    scanned = stored(scan(docs), "secret-scan")
    out = scanned.join(linked(scanned, scope), ["k_doc", "k_text"], "left")
    return out.select("doc_id", "base", F.coalesce("linked", F.expr("cast(array() as array<struct<start:long,end:long,kind:string>>)")).alias("linked"))


def spans_text(spans):
    """kind:start:end of spans by start, then kind in the order of KINDS, then end; comma-joined."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_digest(found: DataFrame) -> DataFrame:
    """Counts, digest and listing of what find_secrets gives."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.size("linked").cast("long").alias("n_linked"),
        F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.concat("base", "linked")).alias("spans"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_digest(find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
