"""Shared scratch tables and small plan helpers for the operators of this subpackage."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import math
import tempfile
import threading
import uuid

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z, for ASCII-only case folding.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text in one partition, about.
PART_BYTES = 512 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without one (as in tests) gets a folder of its own; on a cluster its lack is an error."""
    conf = spark.sparkContext.getConf()
    got = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not got:
        if not (conf.get("spark.master") or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = tempfile.mkdtemp(prefix="spark-catchment-")
        spark.conf.set("spark.checkpoint.dir", got)
    if "://" not in got and not got.startswith("file:"):
        got = "file://" + got
    return got


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Scratch scopes of the running thread, the innermost last: paths that go at the end of each.
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


@contextlib.contextmanager
def scratch():
    """Tables written within, by this thread, are deleted at its end, but for those that `stored` is told to keep. Nothing that is still to be computed may read the deleted ones."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in paths:
            fs, folder = pyarrow.fs.FileSystem.from_uri(path)
            if fs.get_file_info(folder).type == pyarrow.fs.FileType.Directory:
                fs.delete_dir(folder)


def scratch_path(spark: SparkSession, name: str, keep: int = 0) -> str:
    """A new path, deleted at the end of the innermost scratch scope, or of the one keep scopes further out; never, if there is none."""
    path, scopes = new_path(spark, name), _scopes.get()
    at = len(scopes) - 1 - keep
    if at >= 0:
        scopes[at].append(path)
    return path


def stored(df: DataFrame, name: str, keep: int = 0) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a short lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name, keep)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.parquet.columnarReaderBatchSize": "512"}
_small_lock = threading.Lock()
#: For each session how many hold small batches now, and its own settings.
_small: dict[int, tuple[int, dict[str, str]]] = {}


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Within it, scans and Arrow batches hold fewer rows than by default: whole documents are long rows, and a batch is one array of their bytes.
    The session's own settings return when the last one of several that overlap ends, so results must be stored within."""
    which = id(spark)
    with _small_lock:
        held, before = _small.get(which, (0, {}))
        if not held:
            before = {name: spark.conf.get(name) for name in _SMALL}
            for name, value in _SMALL.items():
                spark.conf.set(name, value)
        _small[which] = held + 1, before
    try:
        yield
    finally:
        with _small_lock:
            held, before = _small.pop(which)
            if held > 1:
                _small[which] = held - 1, before
            else:
                for name, value in before.items():
                    spark.conf.set(name, value)


def parts(docs: DataFrame, column: str = "text") -> int:
    """How many partitions to deal whole texts to: as many as the session deals a shuffle to, and enough for PART_BYTES each."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))


def quantiles(docs: DataFrame, column: str, n: int) -> list[int]:
    """At most n - 1 distinct ascending bounds that cut a long column (nulls left out) into n parts of about equal rows."""
    at = [i / n for i in range(1, n)]
    got = docs.filter(F.col(column).isNotNull()).agg(F.percentile_approx(column, at or [0.5], max(10_000, 10 * n)).alias("b")).first()["b"] or []
    return sorted(set(got))[: n - 1]


def row_key(text: str = "text", doc: str = "doc_id") -> list:
    """Columns that tell rows apart by content: equal rows share a key, rows that only share doc_id don't."""
    return [F.col(doc).alias("k_doc"), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull()).alias("k_text")]


def table(data: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(data[f.name], type=f.type) if not isinstance(data[f.name], pa.Array) else data[f.name].cast(f.type) for f in schema], schema=schema)


def tidied(run):
    """run(batches), after which the worker process gives freed memory back to the system. Workers are kept between tasks, and what
    their allocators hold on to would count against the executor for as long."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20):
    """Cut a record batch into runs of rows whose strings hold about most_bytes together; a longer row stands alone."""
    import numpy as np

    n = batch.num_rows
    if not n:
        return
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, size = 0, 0
    for i in range(n):
        if i > at and size + lengths[i] > most_bytes:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += int(lengths[i])
    yield batch.slice(at, n - at)
