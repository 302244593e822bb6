"""Packing token pieces into fixed windows by minimum bin slack.

Documents longer than a window give full windows of their own; what remains of each document waits in a bounded pool. A window takes the
longest waiting length and then the multiset of waiting lengths that brings it closest to its capacity: a subset-sum dynamic programme over
big-integer bitsets, one bitset for each step, backtracked to counts. The pattern is used as often as the pool allows. While documents arrive only
full windows leave the pool; where the waiting lengths don't add up to enough of them, and also when documents end, what is missing in a window is cut from the longest waiting piece, and the last tokens fill windows whose lengths
are powers of two, which need no padding.

Each task packs its own partition: nothing is shuffled, and a lost task is repeated alone with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import slices, tidied
from .tokens import default_tokenizer, encoder, with_end

WINDOW = 2048
#: Pieces that wait in a task's pool before windows are filled from it; then it is brought down to a quarter.
POOL = 4096


def closest_fill(counts: list[int], room: int) -> dict[int, int]:
    """Counts by length of the multiset, within counts (by length, index 0 unused), whose sum is closest to room from below.

    Longer lengths come first. Bit s of a bitset says whether sum s is reachable; the search ends at the first step that reaches room.
    """
    full, reach = (1 << (room + 1)) - 1, 1
    steps = []  # (length, times, bitset before)
    for length in range(min(room, len(counts) - 1), 0, -1):
        left, part = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & full
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    out: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


class _Packer:
    """Pieces are (doc_id, start, ids, doc_tokens); take() gives finished rows (piece, sequence, offset)."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.waiting: list[list] = [[] for _ in range(window)]
        self.counts, self.n, self.rows = [0] * window, 0, []

    def add(self, doc, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % self.window
        for at in range(0, whole, self.window):
            self.rows.append((doc, at, ids[at : at + self.window], total, self.sequence, 0))
            self.sequence += 1
        if total > whole:
            self._wait((doc, whole, ids[whole:].copy(), total))

    def _wait(self, piece) -> None:
        n = len(piece[2])
        self.waiting[n].append(piece)
        self.counts[n] += 1
        self.n += 1

    def _pull(self, length: int):
        self.counts[length] -= 1
        self.n -= 1
        return self.waiting[length].pop()

    def _emit(self, pieces) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids, total, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def fill(self, down_to: int, final: bool = False) -> None:
        longest = self.window - 1
        skipped: list = []
        while self.n > down_to:
            while longest and not self.counts[longest]:
                longest -= 1
            if not longest:
                break
            self.counts[longest] -= 1
            pattern = closest_fill(self.counts, self.window - longest)
            self.counts[longest] += 1
            pattern[longest] = pattern.get(longest, 0) + 1
            missing = self.window - sum(k * v for k, v in pattern.items())
            if missing and not final:
                skipped.append(self._pull(longest))  # waits for better company
                continue
            times = min(self.counts[k] // v for k, v in pattern.items()) if not missing else 1
            for _ in range(times):
                pieces = [self._pull(k) for k, v in pattern.items() for _ in range(v)]
                if missing:
                    if not self.n:
                        return self._tail(pieces)
                    k = max(i for i, c in enumerate(self.counts) if c)
                    doc, start, ids, total = self._pull(k)
                    pieces.append((doc, start, ids[:missing], total))
                    self._wait((doc, start + missing, ids[missing:], total))
                self._emit(pieces)
        for p in skipped:
            self._wait(p)
        if not final and down_to < len(skipped):
            self._cut(down_to)

    def _cut(self, down_to: int) -> None:
        """Full windows until no more than down_to pieces wait: what is missing next to the longest piece is cut from the longest of the others. A pool too small for a window stays."""
        while self.n > max(down_to, 1):
            longest = max(i for i, c in enumerate(self.counts) if c)
            first = self._pull(longest)
            pattern = closest_fill(self.counts, self.window - longest)
            pieces = [first, *(self._pull(k) for k, v in pattern.items() for _ in range(v))]
            missing = self.window - longest - sum(k * v for k, v in pattern.items())
            if missing and not self.n:
                for p in pieces:
                    self._wait(p)
                return
            if missing:
                doc, start, ids, total = self._pull(max(i for i, c in enumerate(self.counts) if c))
                pieces.append((doc, start, ids[:missing], total))
                self._wait((doc, start + missing, ids[missing:], total))
            self._emit(pieces)

    def _tail(self, pieces) -> None:
        """The last tokens: windows of powers of two, longest first."""
        left = sum(len(p[2]) for p in pieces)
        pieces = list(reversed(pieces))
        while left:
            room, now = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc, start, ids, total = pieces.pop()
                now.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    pieces.append((doc, start + room, ids[room:], total))
                room -= len(now[-1][2])
            self._emit(now)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, window: int = WINDOW, pool: int = POOL) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) for every piece of docs(doc_id, text).

    ids are little-endian unsigned 32-bit. Each document's ids and its end lie in exactly one piece each; a null or empty text is its end
    alone. Rows that repeat are packed each. Sequences hold window ids, or a power of two of them; no sequence needs padding.
    sequence_id has the partition in its upper bits, so it depends on how docs is partitioned.
    """
    path = tokenizer or default_tokenizer()

    def batch_of(rows) -> pa.RecordBatch:
        lengths = np.array([len(r[2]) for r in rows], np.int64)
        flat = np.concatenate([r[2] for r in rows]).astype("<u4")
        offsets = np.concatenate(([0], np.cumsum(lengths))) * 4
        ids = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
        long = lambda i: pa.array([r[i] for r in rows], pa.int64())
        return pa.RecordBatch.from_arrays([long(0), long(1), pa.array(lengths), ids, long(3), long(4), long(5)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(path), _Packer(window, TaskContext.get().partitionId() << 40)

        def ready(least: int):
            while len(packer.rows) >= least:
                now, packer.rows = packer.rows[:2048], packer.rows[2048:]
                yield batch_of(now)

        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                ids, offsets = with_end(*enc.encode(b.column("text")), end_id)
                for i, doc in enumerate(b.column("doc_id").to_pylist()):
                    packer.add(doc, ids[offsets[i] : offsets[i + 1]])
                    if packer.n >= pool:
                        packer.fill(pool // 4)
                        yield from ready(2048)
                yield from ready(2048)
        packer.fill(0, final=True)
        yield from ready(1)

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
