"""Event logs as streams: spacing of calls for each key, and serial queues."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def too_close(events: DataFrame, key: str = "user_id", at: str = "ts", least_ms: int = 1000) -> DataFrame:
    """events with gap_ms since the key's last one and paced, whether that is long enough. For tables."""
    w = W.partitionBy(key).orderBy(at, "event_id")
    when = F.col(at).cast("timestamp")
    gap = F.unix_millis(when) - F.unix_millis(F.lag(when).over(w))
    return events.withColumn("gap_ms", gap).withColumn("paced", F.coalesce(gap >= least_ms, F.lit(True)))


def calls_by_window(events: DataFrame, key: str = "event_type", at: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key and time window with a watermark; for streams and tables."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def serial_starts_stream(jobs: DataFrame, key: str, arrival: str, job: str, gap: int = 1000, late: str = "10 seconds") -> DataFrame:
    """(key, job, arrival_ms, start_ms) for streams: when each job of a key begins, jobs running one after another by arrival, then job, none before its arrival and none sooner than gap ms after the start before. The table form is
    `scans.serial_starts`.

    arrival is a timestamp with milliseconds, job a unique long. Rows may come out of order by as much as `late`: they wait in the state until the watermark has passed them, and a job that comes later still is dropped as late, as
    watermarks do. The state of a key is its last start and the jobs that wait.
    """
    names = ["key", "job", "arrival_ms", "start_ms"]

    def step(group, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, waiting_at, waiting_job = state.get if state.exists else (None, [], [])
        waiting = list(zip(waiting_at, waiting_job))
        for b in batches:
            waiting += zip(b["_ms"].tolist(), b["_job"].tolist())
        mark = state.getCurrentWatermarkMs()
        waiting.sort()
        ready = [w for w in waiting if w[0] <= mark]
        rest = waiting[len(ready) :]
        rows = []
        for at, which in ready:
            last = at if last is None else max(at, last + gap)
            rows.append((group[0], which, at, last))
        state.update((last, [w[0] for w in rest], [w[1] for w in rest]))
        if rest:
            state.setTimeoutTimestamp(max(rest[0][0], mark + 1))
        if rows:
            yield pd.DataFrame(rows, columns=names)

    from pyspark.sql.streaming.state import GroupStateTimeout

    when = F.unix_millis(F.col(arrival).cast("timestamp"))
    given = jobs.withWatermark(arrival, late).select(F.col(key).cast("string").alias("_key"), F.col(arrival), when.alias("_ms"), F.col(job).cast("long").alias("_job"))
    return given.groupBy("_key").applyInPandasWithState(step, "key string, job long, arrival_ms long, start_ms long", "last long, at array<long>, jobs array<long>", "append", GroupStateTimeout.EventTimeTimeout)
