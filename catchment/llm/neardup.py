"""MinHash near-dedup by a multi-index Hamming join, confirmed on full shingle sets.

A document's signature has K symbols, the low b bits of K minhashes of its shingle set. Two sets of Jaccard likeness j differ
in K * (1 - j) symbols on average; the threshold is five standard deviations above that mean at the wanted likeness. The signature is
split into chunks. If two signatures differ in at most `threshold` symbols, some chunk has at most threshold // chunks errors
(pigeonhole), so enumerating every way to leave out that many symbols of every chunk gives keys of which such a pair
shares at least one. No pair under the threshold is missed.

Groups are settled without listing their pairs. Equal sets are one class. In every bucket the class with the most
company is the centre; each other member is confirmed against it. Members of one family (a centre and all that meet it in a bucket)
that are in one component need no further look; pairs of different components are compared in blocks of bounded size, first by signature distance, then
on full sets. So every link between components is found, and nothing is capped.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .graph import connected_components
from .store import scratch, slices, stored, tidied

K, BITS = 64, 16
#: Members and shingles of one block when components of a family are compared.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 1 << 20
#: A bucket or family with more than one SPREAD-th of all rows is dealt to several tasks where it meets its centre or its size, one for each such part; there are fewer of these than SPREAD.
SPREAD = 256


def distance_threshold(percent: int, k: int = K) -> int:
    """Symbols in which signatures may differ: mean and five standard deviations at the wanted likeness."""
    p = 1 - percent / 100
    return min(k - 1, math.ceil(k * p + 5 * math.sqrt(k * p * (1 - p))))


def chunk_count(threshold: int) -> int:
    """The fewest chunks of which one has at most one error: as many keys as symbols, each over all but one symbol of its chunk."""
    return threshold // 2 + 1


def chunk_keys(sig: np.ndarray, threshold: int, chunks: int | None = None) -> np.ndarray:
    """Keys of each signature: for each chunk, each way to leave out threshold // chunks of its symbols."""
    n, k = sig.shape
    chunks = chunks or chunk_count(threshold)
    errors = threshold // chunks
    coefficient = kernels.mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    weighed = (sig.astype(np.uint64) + np.uint64(1)) * coefficient
    out, at = [], 0
    for i, chunk in enumerate(np.array_split(np.arange(k), chunks)):
        total = weighed[:, chunk].sum(axis=1, dtype=np.uint64)
        for left_out in itertools.combinations(chunk.tolist(), min(errors, max(0, len(chunk) - 1))):
            at += 1
            rest = total.copy()
            for j in left_out:
                rest -= weighed[:, j]
            out.append(kernels.mix(rest + kernels.mix(np.array([(i << 32) + at], np.uint64))))
    return np.stack(out, axis=1)


def signatures(docs: DataFrame, width: int = 5, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig) for each row: size and 128-bit cryptographic digest of the sorted shingle set, and the signature (null for an empty set)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.list_(pa.int32()))])

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                rows = b.num_rows
                owner, h = kernels.shingles(b.column("text"), width)
                n = np.bincount(owner, minlength=rows)
                ends = np.concatenate(([0], np.cumsum(n))).tolist()
                digests = np.frombuffer(b"".join(hashlib.blake2b(h[a:z], digest_size=16).digest() for a, z in zip(ends, ends[1:])), "<i8").reshape(rows, 2)
                sig = (kernels.minhash(owner, h, rows, k) & np.uint32((1 << BITS) - 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * k), pa.array(sig.ravel()), mask=pa.array(n == 0))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, n_shingles long, d1 long, d2 long, sig array<int>")


def bucket_keys(classes: DataFrame, threshold: int) -> DataFrame:
    """(key, rep) for classes(rep, sig)."""
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64())])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                sig = b.column("sig").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                keys = chunk_keys(sig, threshold)
                reps = np.repeat(b.column("rep").to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(reps)], schema=schema)

    return classes.select("rep", "sig").mapInArrow(tidied(run), "key long, rep long")


def shingle_sets(docs: DataFrame, reps: DataFrame, width: int = 5) -> DataFrame:
    """(rep, items array<long>) for the documents whose ids are in reps(rep)."""
    schema = pa.schema([("rep", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                owner, h = kernels.shingles(b.column("text"), width)
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=b.num_rows)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("rep"), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], schema=schema)

    wanted = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(reps, "rep", "left_semi")
    return wanted.mapInArrow(tidied(run), "rep long, items array<long>")


def hot_keys(sizes: DataFrame, key: str) -> DataFrame:
    """(key, tasks) of the keys in sizes(key, m) that hold more than one SPREAD-th of all rows: at most SPREAD keys, whatever the number of rows."""
    part = max(1, -(-(sizes.agg(F.sum("m")).first()[0] or 0) // SPREAD))
    found = sizes.filter(F.col("m") > part).select(F.col(key).cast("long"), F.ceil(F.col("m") / part).cast("long")).collect()  # fewer than SPREAD
    # an Arrow table becomes a local relation; a list of rows would be an RDD of Python's, for which each executor keeps a daemon and workers of its own
    return sizes.sparkSession.createDataFrame(pa.table([pa.array([r[i] for r in found], pa.int64()) for i in (0, 1)], names=[key, "tasks"]))


def spread_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """many(key, rep, ...) joined with one(key, ...), which has a row for each key. The rows of a hot key are dealt to its tasks by rep, each with a copy of the key's row."""
    few = F.broadcast(hot)  # fewer than SPREAD rows
    tasks = F.coalesce("tasks", F.lit(1).cast("long"))
    copies = one.join(few, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1))).drop("tasks")
    dealt = many.join(few, key, "left").withColumn("salt", F.pmod(F.xxhash64("rep"), tasks)).drop("tasks")
    return dealt.join(copies, [key, "salt"]).drop("salt")


def _blocks(members: DataFrame, hot: DataFrame) -> DataFrame:
    """members(family, rep, label, n_shingles, ...) dealt to pairs of blocks (lo, hi) of bounded size; side is the member's own block."""
    size = members.groupBy("family").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s"))
    size = size.select("family", F.greatest(F.ceil(F.col("m") / BLOCK_MEMBERS), F.ceil(F.col("s") / BLOCK_SHINGLES), F.lit(1)).alias("blocks"))
    dealt = spread_join(members, size, "family", hot).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other")).drop("other", "blocks")


def _near_signatures(threshold: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        a, b = pdf[pdf["side"] == lo], pdf[pdf["side"] == hi]
        sb, lb = (np.stack(b["sig"].to_numpy()).astype(np.int32), b["label"].to_numpy()) if len(b) else (None, None)
        hit_a, hit_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for i, (sig, label) in enumerate(zip(a["sig"], a["label"])):
            if sb is None:
                break
            near = ((sb != np.asarray(sig)[None, :]).sum(axis=1) <= threshold) & (lb != label)
            hit_a[i] = near.any()
            hit_b |= near
        return pd.concat([a[hit_a], b[hit_b]])[["family", "rep", "label", "n_shingles"]].drop_duplicates()

    return run


def _near_sets(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between members of different labels, one for each pair of labels."""
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        a, b = pdf[pdf["side"] == lo], pdf[pdf["side"] == hi]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        va, vb = np.concatenate(a["items"].to_numpy()), np.concatenate(b["items"].to_numpy())
        na, nb = a["items"].map(len).to_numpy(), b["items"].map(len).to_numpy()
        oa, ob = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
        common = np.intersect1d(va, vb)
        both = np.zeros((len(a), len(b)), np.float32)
        ia, ib = np.searchsorted(common, va), np.searchsorted(common, vb)
        ka = (ia < len(common)) & (common[np.minimum(ia, len(common) - 1)] == va) if len(common) else np.zeros(len(va), bool)
        kb = (ib < len(common)) & (common[np.minimum(ib, len(common) - 1)] == vb) if len(common) else np.zeros(len(vb), bool)
        for at in range(0, len(common), 2048):
            xa, xb = np.zeros((len(a), 2048), np.float32), np.zeros((len(b), 2048), np.float32)
            ma, mb = ka & (ia >= at) & (ia < at + 2048), kb & (ib >= at) & (ib < at + 2048)
            xa[oa[ma], ia[ma] - at] = 1
            xb[ob[mb], ib[mb] - at] = 1
            both += xa @ xb.T
        inter = both.astype(np.int64)
        union = na[:, None] + nb[None, :] - inter
        la, lb = a["label"].to_numpy(), b["label"].to_numpy()
        x, y = np.nonzero((100 * inter >= percent * union) & (la[:, None] != lb[None, :]))
        return pd.DataFrame({"a": np.minimum(la[x], lb[y]), "b": np.maximum(la[x], lb[y])}).drop_duplicates()

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than space and \\x09-\\x0D, with A-Z lowered. Documents are linked where their sets of
    width-word shingles have at least percent hundredths of their union in common; component_id is the smallest doc_id that links
    reach and kept says whether that is the document's own. A shorter text's words are one shingle. Texts without words and nulls are linked
    with nothing. Rows with a null doc_id are linked with nothing and are kept. Rows that share a doc_id are one node.
    """
    threshold = distance_threshold(percent)
    sigs = stored(signatures(docs, width), "signatures")
    solid = sigs.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(solid.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")), "classes")
    nodes = classes.select("rep", "n_shingles", "sig")

    keys = bucket_keys(classes, threshold)
    # a bucket of two is known by its least and greatest member; only larger ones meet their keys again
    sizes = stored(keys.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("m > 1"), "bucket-sizes")
    twos = sizes.filter("m = 2").select("key", F.explode(F.array("lo", "hi")).alias("rep"), "m")
    hot_buckets = hot_keys(sizes.select("key", "m"), "key")
    larger = spread_join(keys, sizes.filter("m > 2").select("key", "m"), "key", hot_buckets).select("key", "rep", "m")
    shared = stored(twos.union(larger), "buckets")
    company = shared.groupBy("rep").agg(F.sum("m").alias("company"))
    central = shared.join(company, "rep").groupBy("key").agg(F.max(F.struct("company", (-F.col("rep")).alias("minus"))).alias("c")).select("key", (-F.col("c.minus")).alias("family"))
    families = stored(spread_join(shared, central, "key", hot_buckets).select("family", "rep").distinct(), "families")
    hot = hot_keys(families.groupBy("family").agg(F.count("*").alias("m")), "family")

    # each member against its centre: sizes, signature distance, then full sets
    pairs = families.filter("family <> rep").join(nodes, "rep")
    centre = nodes.select(F.col("rep").alias("family"), F.col("n_shingles").alias("c_n"), F.col("sig").alias("c_sig")).join(families.select("family").distinct(), "family", "left_semi")
    pairs = spread_join(pairs, centre, "family", hot).filter(F.least("n_shingles", "c_n") * 100 >= F.greatest("n_shingles", "c_n") * percent)
    apart = F.size(F.filter(F.zip_with("sig", "c_sig", lambda x, y: x != y), lambda x: x))
    pairs = stored(pairs.filter(apart <= threshold).select("family", "rep").distinct(), "pairs")
    wanted = stored(pairs.select("rep").union(pairs.select("family")).distinct(), "wanted")
    sets = stored(shingle_sets(docs, wanted, width), "sets")
    c_sets = sets.select(F.col("rep").alias("family"), F.col("items").alias("c_items")).join(pairs.select("family").distinct(), "family", "left_semi")
    held = spread_join(pairs.join(sets, "rep"), c_sets, "family", hot)
    common = F.size(F.array_intersect("items", "c_items"))
    links = held.filter(common * 100 >= (F.size("items") + F.size("c_items") - common) * percent).select(F.col("family").alias("a"), F.col("rep").alias("b"))

    # different texts of one doc_id are one node
    twice = solid.groupBy("doc_id").agg(F.count("*").alias("m")).filter("m > 1")
    twins = solid.join(twice, "doc_id", "left_semi").join(classes.drop("sig"), ["d1", "d2", "n_shingles"]).select("doc_id", "rep").distinct()
    same = twins.groupBy("doc_id").agg(F.min("rep").alias("a"))
    links = stored(links.union(twins.join(same, "doc_id").filter("a <> rep").select("a", F.col("rep").alias("b"))), "links")
    labels = connected_components(links)

    # families that hold several components: compare across components
    known = families.union(families.select("family", F.col("family").alias("rep"))).distinct().join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.withColumn("label", F.coalesce("label", "rep"))
    open_ = known.groupBy("family").agg(F.count("*").alias("m"), (F.min("label") != F.max("label")).alias("several")).filter("several and m > 2").select("family")
    members = stored(spread_join(known, open_, "family", hot).join(nodes, "rep").select("family", "rep", "label", "n_shingles", "sig"), "open-members")
    near = _blocks(members, hot).groupBy("family", "lo", "hi").applyInPandas(_near_signatures(threshold), "family long, rep long, label long, n_shingles long")
    near = stored(near.distinct(), "near-members")
    more = stored(shingle_sets(docs, near.select("rep").distinct(), width), "more-sets")
    across = _blocks(near, hot).join(more, "rep").groupBy("family", "lo", "hi").applyInPandas(_near_sets(percent), "a long, b long")
    across = stored(across.distinct(), "across")
    merged = connected_components(across).select(F.col("node").alias("label"), F.col("label").alias("final"))
    of_rep = labels.join(merged, "label", "left").select(F.col("node").alias("rep"), F.coalesce("final", "label").alias("component"))
    alone = merged.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("rep"), F.col("final").alias("component"))
    of_class = classes.select("d1", "d2", "n_shingles", "rep").join(of_rep.union(alone), "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = sigs.select("doc_id", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs whose document stays: one doc_id of each group, and all rows without doc_id."""
    with scratch():
        gone = near_duplicates(docs.select("doc_id", "text"), percent).filter("not kept").select("doc_id").distinct()
        gone = stored(gone, "near-duplicates", keep=True)
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), percent=85)
