"""Line dedup with levelled sorted runs of line hashes.

A run is a table of (line_hash, n_docs), hash-bucketed and sorted by line_hash. Each new batch of documents is reduced to its own
distinct line hashes with document counts, merge-anti-joined with the hashes that the runs already know as frequent, and added as a run of
level 0. When a level holds fanout runs they are merged into one run of the next level, so each hash is rewritten a
logarithmic number of times. Buckets line up between runs: merging and anti-joining them needs no shuffle of a run.

Runs tell lines apart by hashes. What they find frequent is confirmed by text: the keys behind those hashes are counted anew, and a key that shares a frequent one's hash
without being frequent itself is spared. These keys are taken from the documents where they lie, by a bitmap of the frequent hashes that also lets others pass; a join with the hashes
sorts those out. So whole texts are shuffled once, to meet their frequent lines, and no copy of them is stored.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .store import LOWER, UPPER, parts, row_key, scratch, scratch_path, slices, stored, tidied

#: Buckets that a table may have (Spark's own default limit).
MOST_BUCKETS = 100_000
#: Bits of the bitmap of frequent hashes (2 MB), and of each of the pieces that Spark makes of it.
SIEVE, PIECE = 1 << 24, 1 << 15


class LineRuns:
    """The levelled runs. threshold: documents from which a line is frequent; fanout: runs in a level before it is merged."""

    def __init__(self, spark: SparkSession, threshold: int = 10, fanout: int = 2, buckets: int | None = None):
        self.spark, self.threshold, self.fanout = spark, threshold, fanout
        self.buckets = min(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
        self.levels: list[list[DataFrame]] = []
        self.names: list[str] = []

    def _written(self, counts: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, name)
        counts.write.bucketBy(self.buckets, "line_hash").sortBy("line_hash").option("path", path).option("compression", "zstd").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def add(self, lines: DataFrame) -> None:
        """Add a batch: lines(line_hash), one row for each document and distinct line. No document may be in two batches."""
        counts = lines.groupBy("line_hash").agg(F.count("*").alias("n_docs"))
        counts = counts.repartition(self.buckets, "line_hash")
        for run in self.runs():
            counts = counts.join(run.filter(F.col("n_docs") >= self.threshold).select("line_hash"), "line_hash", "left_anti")
        fresh = self._written(counts)
        level = 0
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(fresh)
            if len(self.levels[level]) < self.fanout:
                return
            fresh = self._written(self._merged(self.levels[level]))
            self.levels[level] = []
            level += 1

    def forget(self) -> None:
        """Drop the runs' catalog entries; their files stay in the shared folder."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            right = r.withColumnRenamed("n_docs", "n_more")
            out = out.join(right, "line_hash", "full_outer").select("line_hash", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_more", F.lit(0))).alias("n_docs"))
        return out

    def frequent(self) -> DataFrame:
        """Hashes of lines in at least threshold documents of all batches."""
        if not self.runs():
            return self.spark.createDataFrame([], "line_hash long")
        return self._merged(self.runs()).filter(F.col("n_docs") >= self.threshold).select("line_hash")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(k_doc, k_text, line_hash) for each row of docs and each distinct non-empty line key; equal rows give equal pairs each."""

    def run(batches):
        schema = pa.schema([("k_doc", pa.int64()), ("k_text", pa.int64()), ("line_hash", pa.int64())])
        for whole in batches:
            for b in slices(whole, "text"):
                owner, _, _, h = kernels.line_keys(b.column("text"))
                keep = h != 0
                owner, h = kernels.distinct(owner[keep], h[keep])
                doc = b.column("k_doc").take(pa.array(owner))
                key = b.column("k_text").take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([doc.cast(pa.int64()), key, pa.array(h.view(np.int64))], schema=schema)

    keyed = docs.select("text", *row_key())
    return keyed.withColumn("k_doc", F.col("k_doc").cast("long")).mapInArrow(tidied(run), "k_doc long, k_text long, line_hash long")


def _marked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start, end and hash of every line of a batch with text and hot (line hashes), and whether the hash is among its own text's hot ones."""
    owner, start, end, h = kernels.line_keys(b.column("text"))
    hot, among = b.column("hot"), np.zeros(len(owner), bool)
    rows = np.flatnonzero(pc.is_valid(hot).to_numpy(zero_copy_only=False))
    if len(rows):
        values = hot.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        whose = np.repeat(np.arange(b.num_rows), pc.list_value_length(hot).fill_null(0).to_numpy(zero_copy_only=False))
        of_row = lambda x, row: kernels.mix(x ^ kernels.mix(row.astype(np.uint64) + np.uint64(1)))
        mine = np.isin(owner, rows) & (h != 0)
        among[mine] = np.isin(of_row(h[mine], owner[mine]), of_row(values, whose))
    return owner, start, end, h, among


def key_of(line: str) -> str:
    return line.strip(" \t\n\v\f\r").translate(_LOWER)


_LOWER = str.maketrans(UPPER, LOWER)


#: Columns of _hot_keys.
_KEYS = "line_hash long, key string, n long"


def _hot_keys(batches):
    """(line_hash, key, n): the keys of marked lines with the rows of a slice that hold them."""
    for whole in batches:
        for b in slices(whole, "text"):
            owner, start, end, h, among = _marked(b)
            raw, held = kernels.buffers(b.column("text"))[0].tobytes(), set()
            for i in np.flatnonzero(among).tolist():
                held.add((int(owner[i]), int(h[i].view(np.int64)), key_of(raw[start[i] : end[i]].decode())))
            n = Counter((x, k) for _, x, k in held)
            yield pa.RecordBatch.from_pydict({"line_hash": pa.array([x for x, _ in n], pa.int64()), "key": pa.array([k for _, k in n], pa.string()), "n": pa.array(list(n.values()), pa.int64())})


def _doubtful_keys(batches):
    """(k_doc, k_text, key): the marked lines' keys whose hash is one of the row's doubtful ones."""
    for whole in batches:
        for b in slices(whole, "text"):
            owner, start, end, h, among = _marked(b)
            raw, doubtful = kernels.buffers(b.column("text"))[0].tobytes(), [set(x) for x in b.column("doubtful").to_pylist()]
            at = [i for i in np.flatnonzero(among).tolist() if int(h[i].view(np.int64)) in doubtful[owner[i]]]
            where = pa.array(owner[at].astype(np.int64))
            keys = pa.array([key_of(raw[start[i] : end[i]].decode()) for i in at], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("k_doc").take(where), b.column("k_text").take(where), keys], names=["k_doc", "k_text", "key"])


def drop_lines(batches):
    """Arrow batches with text, hot (line hashes to drop) and spared (keys that stay nevertheless) to kept text, n_lines and n_dropped."""
    for whole in batches:
        for b in slices(whole, "text"):
            texts = b.column("text")
            owner, _, _, _, dropped = _marked(b)
            n_lines = np.bincount(owner, minlength=b.num_rows)
            first = np.concatenate(([0], np.cumsum(n_lines)))
            out = texts.fill_null("").to_pylist()
            spared = b.column("spared")
            for r in np.flatnonzero(pc.is_valid(spared).to_numpy(zero_copy_only=False)).tolist():
                stay = set(spared[r].as_py())
                dropped[first[r] : first[r + 1]] &= [key_of(x) not in stay for x in out[r].split("\n")]
            n_dropped = np.bincount(owner[dropped], minlength=b.num_rows)
            for r in np.flatnonzero(n_dropped).tolist():
                keep = ~dropped[first[r] : first[r + 1]]
                out[r] = "\n".join(x for x, k in zip(out[r].split("\n"), keep.tolist()) if k)
            columns = [pa.array(out, pa.string()), pa.array(n_lines.astype(np.int64)), pa.array(n_dropped.astype(np.int64))]
            names = [n for n in b.schema.names if n[0] == "c"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + columns, names=[*names, "kept", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, threshold: int = 10, batches: int = 4, keep: list[str] | None = None) -> DataFrame:
    """The columns named in keep (all others of docs but text by default) with kept, n_lines and n_dropped for each row.

    Lines whose key occurs in at least threshold rows of docs are dropped from every text. Keys of no characters are never dropped. A null
    or empty text is one empty line and stays an empty text. Equal rows count as documents of their own.
    The corpus is taken in batches by a hash of doc_id and text; the result doesn't depend on their number. Docs may have any other columns.
    """
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    # docs have names of our own: c0, c1, ... for what is kept
    flat = docs.select(F.col("text"), *[c.alias(n) for c, n in zip(row_key(), ("o_doc", "o_text"))], *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    flat = flat.withColumn("o_doc", F.col("o_doc").cast("long"))
    with scratch():  # the lines and their runs are deleted before whole texts are shuffled
        plain = docs.select("doc_id", "text")
        hot, frequent = _hot_lines(plain, threshold, batches)
        sieve = _sieve(frequent)
        spared = _spared_keys(_sieved(plain, sieve), threshold, frequent, _sieved_keys(plain, sieve))
        if spared is not None:
            hot = _with_key(hot.withColumnsRenamed({"k_doc": "o_doc", "k_text": "o_text"}), spared).withColumnsRenamed({"o_doc": "k_doc", "o_text": "k_text"})
        else:
            hot = hot.withColumn("spared", F.lit(None).cast("array<string>"))
        hot = stored(hot, "hot-lines", keep=1)
    joined = _with_key(flat, hot).drop("o_doc", "o_text")
    schema = ", ".join([f"{n} {t}" for n, t in joined.dtypes if n[0] == "c"] + ["kept string", "n_lines long", "n_dropped long"])
    out = joined.mapInArrow(tidied(drop_lines), schema)
    return out.toDF(*keep, "kept", "n_lines", "n_dropped")


def _with_key(flat: DataFrame, more: DataFrame) -> DataFrame:
    """flat(o_doc, o_text, ...) with the other columns of more(k_doc, k_text, ...), where it has a row. Merged by key at every size."""
    same = F.col("o_doc").eqNullSafe(F.col("k_doc")) & (F.col("o_text") == F.col("k_text"))
    return flat.join(more.hint("merge"), same, "left").drop("k_doc", "k_text")


def _hot_lines(docs: DataFrame, threshold: int, batches: int) -> tuple[DataFrame, DataFrame]:
    """(k_doc, k_text, hot), the hashes of each row's frequent lines, by the levelled runs; and (line_hash), the frequent ones."""
    spark = docs.sparkSession
    path = scratch_path(spark, "doc-lines")
    batch = F.pmod(F.xxhash64("k_doc", "k_text"), F.lit(batches)).cast("int")
    distinct_lines(docs).withColumn("batch", batch).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    lines = spark.read.schema("k_doc long, k_text long, line_hash long, batch int").parquet(path)
    runs = LineRuns(spark, threshold, buckets=parts(docs))
    for i in range(batches):
        runs.add(lines.filter(F.col("batch") == i))
    frequent = stored(runs.frequent(), "frequent-lines")
    runs.forget()
    hot = lines.select("k_doc", "k_text", "line_hash").join(frequent, "line_hash", "left_semi")
    return hot.groupBy("k_doc", "k_text").agg(F.collect_set("line_hash").alias("hot")), frequent


def _sieve(frequent: DataFrame) -> np.ndarray:
    """A bitmap with the bit hash % SIEVE set for each of frequent(line_hash). Its size doesn't depend on their number; the more there are, the more other lines pass."""
    at = F.pmod("line_hash", F.lit(SIEVE)) + 1  # Spark counts bits from 1
    pieces = frequent.groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()  # SIEVE // PIECE at most
    out = np.zeros((SIEVE // PIECE, PIECE // 8), np.uint8)
    for r in pieces:
        out[r["piece"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _passing(sieve: np.ndarray):
    """Arrow batches with k_doc, k_text and text to rows whose text is the lines that pass the sieve and whose hot is their hashes, for each row that has such lines."""
    schema = pa.schema([("k_doc", pa.int64()), ("k_text", pa.int64()), ("text", pa.string()), ("hot", pa.list_(pa.int64()))])

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                owner, start, end, h = kernels.line_keys(b.column("text"))
                bit = (h % np.uint64(SIEVE)).astype(np.int64)
                at = np.flatnonzero((h != 0) & (sieve[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0))
                raw = kernels.buffers(b.column("text"))[0].tobytes()
                found = [raw[x:z] for x, z in zip(start[at].tolist(), end[at].tolist())]
                rows, first = np.unique(owner[at], return_index=True)
                bounds = np.append(first, len(at))
                texts = pa.array([b"\n".join(found[x:z]) for x, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary()).cast(pa.string())
                hot = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h[at].view(np.int64)))
                where = pa.array(rows.astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("k_doc").take(where), b.column("k_text").take(where), texts, hot], schema=schema)

    return run


def _with_long_key(docs: DataFrame) -> DataFrame:
    return docs.select("text", *row_key()).withColumn("k_doc", F.col("k_doc").cast("long"))


def _sieved(docs: DataFrame, sieve: np.ndarray) -> DataFrame:
    """(k_doc, k_text, text, hot) for each row of docs with lines that pass the sieve: these lines and their hashes. All frequent lines pass, and some others."""
    return _with_long_key(docs).mapInArrow(tidied(_passing(sieve)), "k_doc long, k_text long, text string, hot array<long>")


def _sieved_keys(docs: DataFrame, sieve: np.ndarray) -> DataFrame:
    """(line_hash, key, n) of the lines that pass the sieve, as `_hot_keys` has them of `_sieved` rows, by one Python function: a task in which one function feeds
    another takes two workers, and an executor keeps these, with their memory, for the stages that follow."""
    passing = _passing(sieve)
    return _with_long_key(docs).mapInArrow(tidied(lambda batches: _hot_keys(passing(batches))), _KEYS)


def _spared_keys(marked: DataFrame, threshold: int, frequent: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame | None:
    """(k_doc, k_text, spared): keys that share a frequent line's hash and aren't frequent by text; None if there are none.
    All hashes in marked(k_doc, k_text, text, hot) count as frequent or, if it is given, those of frequent(line_hash). keys: what `_hot_keys` gives for marked, if it is made elsewhere."""
    held = marked.filter("hot is not null")
    keys = held.select("text", "hot").mapInArrow(tidied(_hot_keys), _KEYS) if keys is None else keys
    rare = keys.groupBy("line_hash", "key").agg(F.sum("n").alias("n")).filter(F.col("n") < threshold)
    if frequent is not None:
        rare = rare.join(frequent, "line_hash", "left_semi")
    rare = stored(rare.select("line_hash", "key"), "rare-keys")
    if rare.isEmpty():  # as is to be expected: a frequent line's hash would have to be another line's too
        return None
    hot = held.select("k_doc", "k_text", F.explode("hot").alias("line_hash")).join(rare.select("line_hash").distinct(), "line_hash", "left_semi")
    doubtful = hot.groupBy("k_doc", "k_text").agg(F.collect_set("line_hash").alias("doubtful"))
    rows = _with_key(held.select("text", "hot", F.col("k_doc").alias("o_doc"), F.col("k_text").alias("o_text")), doubtful).filter("doubtful is not null")
    rows = rows.withColumnsRenamed({"o_doc": "k_doc", "o_text": "k_text"})
    found = rows.mapInArrow(tidied(_doubtful_keys), "k_doc long, k_text long, key string").join(rare.select("key").distinct(), "key", "left_semi")
    return found.groupBy("k_doc", "k_text").agg(F.collect_set("key").alias("spared"))


def without_frequent_lines(docs: DataFrame, threshold: int = 10) -> DataFrame:
    """docs with its frequent lines dropped from text, n_chars (where there is one) counted anew, and all other columns as they are."""
    columns = docs.columns
    kinds = dict(docs.dtypes)
    flat = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(columns)])
    out = dedup_lines(flat, threshold, keep=[f"o{i}" for i, c in enumerate(columns) if c not in ("text", "n_chars")])
    kept = {"text": F.col("kept"), "n_chars": F.length("kept").cast(kinds.get("n_chars", "long"))}
    return out.select(*[kept[c] if c in kept else F.col(f"o{i}") for i, c in enumerate(columns)]).toDF(*columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, threshold=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH raw AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT row_id, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM raw),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT row_id) >= 10),
marked AS (SELECT keyed.*, hot.k IS NOT NULL AS gone FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_id, doc_id
"""
