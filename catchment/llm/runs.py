"""Periodic runs of words by the runs theorem, and texts in which each run is reduced to its first period.

A run is a stretch of consecutive words with smallest period p and at least twice p words that can't be extended on either side. By the theorem each one has
a Lyndon root: the longest Lyndon word, under some order of the words or the reverse order, that starts at one of its places. The longest Lyndon word at place i reaches to the next
place whose suffix is smaller: the next smaller value of the inverse suffix array, and under the reverse order the next greater one. What is equal after both
ends of such a word is a range minimum over the longest common prefixes of neighbouring suffixes (a sparse table), what is equal before them the same on the reversed texts.

Many texts are worked on side by side as one array of words. The text's number is part of its words, and texts end with a mark of their own,
so no suffix is compared beyond its text and none is a prefix of another.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .store import slices, tidied

#: What counts as a run: at least so many words, and so many times its period.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Bytes of text that are worked on side by side; a longer text is alone.
SIDE_BY_SIDE = 2 << 20
#: Bytes that are compared at once.
BLOCK = 1 << 20


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of the values, equal ones alike."""
    order = np.argsort(keys)
    s = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
    return rank


def word_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word [start, end) of data, which they fill end to end; the same for the same bytes. Words are numbered by a hash and compared by their bytes; should two share a hash, all are numbered by their bytes."""
    if not len(start):
        return np.empty(0, np.int64)
    h = kernels.mix(kernels.spans(kernels.prefix(data), start, end) + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    number = dense(h)
    first = np.empty(int(number.max()) + 1, np.int64)
    first[number] = np.arange(len(number))  # any word of each number
    size, twin = end - start, first[number]
    sound = bool((size == size[twin]).all())
    bounds = np.searchsorted(end, np.arange(0, len(data) + BLOCK, BLOCK)).tolist() if sound else []
    for i, j in zip(bounds, [*bounds[1:], len(size)]):  # blocks of words, for the memory
        own = np.arange(start[i], end[j - 1]) if i < j else start[:0]
        sound = sound and bool((data[own + np.repeat(start[twin[i:j]] - start[i:j], size[i:j])] == data[own]).all())
    if not sound:
        raw, seen = data.tobytes(), {}
        return np.array([seen.setdefault(raw[a:z], len(seen)) for a, z in zip(start.tolist(), end.tolist())], np.int64)
    return number


def suffix_ranks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, its inverse, and for each k the ranks of stretches of 2**k symbols (while some are equal).

    Each text ends with a symbol that stands nowhere else. Ranks double in length; only suffixes that still have an equal one are sorted again.
    """
    n = len(symbols)
    rank = dense(symbols)
    order = np.argsort(rank, kind="stable")
    levels, width = [rank], 1
    while True:
        s = rank[order]
        same = s[1:] == s[:-1]
        if not same.any():
            return order, rank, levels
        tied = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        spots = np.flatnonzero(tied)
        who = order[spots]
        key = s[spots] * n + rank[np.minimum(who + width, n - 1)]  # equal stretches hold no mark, so width more symbols are there
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        order[spots] = who
        # the new rank is that of the first of its equals: its spot
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        rank = rank.copy() if width > 1 else np.searchsorted(s, rank)  # from ranks to spots
        rank[who] = spots[np.maximum.accumulate(np.where(fresh, np.arange(len(who)), 0))]
        levels.append(rank)
        width *= 2


def neighbour_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in order; 0 for the first."""
    n = len(order)
    a, b, got = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    for k in reversed(range(len(levels))):
        equal = levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
        equal &= (a < n) & (b < n)
        step = equal.astype(np.int64) << k
        got[1:] += step
        a += step
        b += step
    return got


class RangeMinimum:
    """Sparse table of minima; each row doubles the stretch that a place stands for."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def over(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Minimum of each stretch [start, stop), none of them empty."""
        k = np.frexp((stop - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), self.rows[0].dtype)
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            row = self.rows[level]
            out[at] = np.minimum(row[start[at]], row[stop[at] - (1 << level)])
        return out


class Suffixes:
    """Suffix array with constant-time common prefixes of any two suffixes."""

    def __init__(self, symbols: np.ndarray):
        self.order, self.rank, levels = suffix_ranks(symbols)
        self.minima = RangeMinimum(neighbour_prefixes(self.order, levels))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, which differ."""
        x, y = self.rank[a], self.rank[b]
        return self.minima.over(np.minimum(x, y) + 1, np.maximum(x, y) + 1)


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, len(values) where there is none. Stretches that hold none are skipped by doubling their length and halving it again."""
    n = len(values)
    big = np.iinfo(values.dtype).max
    at = np.arange(1, n + 1)
    rows, width = [values], 1
    waiting = np.flatnonzero(np.concatenate((values[1:] >= values[:-1], [False])))
    k = 0
    # upward: skip stretches while they hold none smaller
    level = np.zeros(n, np.int8)
    while len(waiting):
        if k == len(rows):
            last = rows[-1]
            rows.append(np.minimum(last[:-width], last[width:]) if len(last) > width else last[:0])
            width *= 2
        row, own = rows[k], values[waiting]
        here = at[waiting]
        inside = here < len(row)
        clear = np.where(inside, row[np.minimum(here, max(len(row) - 1, 0))] if len(row) else big, -1) >= own
        level[waiting[~clear]] = k
        waiting = waiting[clear]
        at[waiting] += 1 << k
        k += 1
    # downward: the stretch of 2**level from here holds a smaller one, or reaches beyond the end
    for k in range(k - 1, -1, -1):
        row = rows[k]
        who = np.flatnonzero(level > k)
        if not len(who) or not len(row):
            continue
        here = at[who]
        inside = here < len(row)
        clear = inside & (row[np.minimum(here, len(row) - 1)] >= values[who])
        at[who[clear]] += 1 << k
    return at


def runs_of(words: np.ndarray, offsets: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of texts whose words' numbers are words[offsets[i]:offsets[i + 1]], of at least min_length words and min_exponent (2 or more) periods:
    text, start (a word's number in its text), length, period; by text, start, period. Each run has one row."""
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    texts, total = len(offsets) - 1, int(offsets[-1])
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(texts), sizes)
    # each text's words, then its mark; marks are the smallest symbols, and words of different texts differ
    place = np.arange(total) + owner
    marks = offsets[1:] + np.arange(texts)
    n = total + texts
    symbols = np.empty(n, np.int64)
    spread = int(words.max()) + 1 if total else 1
    symbols[place] = texts + owner * spread + words
    symbols[marks] = np.arange(texts)
    none = np.empty(0, np.int64)
    if not total:
        return none, none, none, none
    forward = Suffixes(symbols)
    first = np.empty(n, np.int64)  # where the text of each place starts
    first[place], first[marks] = (offsets[:-1] + np.arange(texts))[owner], offsets[:-1] + np.arange(texts)
    found = []
    for values in (forward.rank, n - 1 - forward.rank):
        root_end = next_smaller(values)
        i = place[root_end[place] < n]
        j = root_end[i]
        same = symbols[i] == symbols[j]  # else nothing repeats after the root, and so for words of two texts and for marks
        i, j = i[same], j[same]
        right = forward.common(i, j)
        keep = right > (min_exponent - 2) * (j - i)  # holds for the first root of every run that is wanted
        found.append((i[keep], j[keep], right[keep]))
    i, j, right = (np.concatenate(x) for x in zip(*found))
    if not len(i):
        return none, none, none, none
    # reversed texts, only those with a root: what is equal before both
    has = np.unique(np.searchsorted(marks, i))
    sub_sizes = sizes[has] + 1
    sub_first = np.cumsum(sub_sizes) - sub_sizes
    m = int(sub_sizes.sum())
    which = np.repeat(np.arange(len(has)), sub_sizes)
    inner = np.arange(m) - sub_first[which]
    origin = (offsets[:-1] + np.arange(texts))[has]
    is_mark = inner == sub_sizes[which] - 1
    back = symbols[np.where(is_mark, marks[has][which], origin[which] + sub_sizes[which] - 2 - inner)]
    backward = Suffixes(back)
    text = np.searchsorted(has, np.searchsorted(marks, i))
    mirror = lambda x: sub_first[text] + sub_sizes[text] - 2 - (x - origin[text])
    left = np.zeros(len(i), np.int64)
    inside = i > origin[text]
    a, b = mirror(i - 1)[inside], mirror(j - 1)[inside]
    left[inside] = backward.common(a, b)
    start, stop, period = i - left, j + right, j - i
    length = stop - start
    good = (length >= min_length) & (length >= min_exponent * period)
    text, start, length, period = has[text[good]], (start - origin[text])[good], length[good], period[good]
    order = np.lexsort((period, start, text))
    text, start, length, period = text[order], start[order], length[order], period[order]
    new = np.ones(len(text), bool)  # a run has a root for each of its repetitions
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (period[1:] != period[:-1])
    return text[new], start[new], length[new], period[new]


def dropped(offsets: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words of all texts some run contains after its first period."""
    change = np.zeros(int(offsets[-1]) + 1, np.int64)
    base = offsets[text] + start
    np.add.at(change, base + period, 1)
    np.add.at(change, base + length, -1)
    return np.cumsum(change)[:-1] > 0


def greatest(start: list[int], length: list[int], period: list[int]) -> int:
    """The run with the greatest length by period, compared exactly; ties: the smallest start, then period, as they come."""
    best = 0
    for k in range(1, len(start)):
        if length[k] * period[best] > length[best] * period[k]:
            best = k
    return best


def of_texts(texts: list[bytes], reread=None, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text (UTF-8) its runs as (start, length, period), and its words without what runs repeat, joined by a space.

    reread(k, n), if given, says which of its own n words text k has at each place (an array, or None for those it has).
    """
    words = [t.split() for t in texts]  # bytes split at [\\x20\\x09-\\x0D]
    if reread:
        for k, ws in enumerate(words):
            if (which := reread(k, len(ws))) is not None:
                words[k] = [ws[i] for i in which.tolist()]
    offsets = np.concatenate(([0], np.cumsum([len(ws) for ws in words]))).astype(np.int64)
    flat = [w for ws in words for w in ws]
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    end = np.cumsum(sizes)
    numbers = word_numbers(np.frombuffer(b"".join(flat), np.uint8), end - sizes, end)
    text, start, length, period = runs_of(numbers, offsets, min_length, min_exponent)
    gone = dropped(offsets, text, start, length, period)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    runs = list(zip(start.tolist(), length.tolist(), period.tolist()))
    out = []
    for k, (i, j) in enumerate(zip(bounds, bounds[1:])):
        own = words[k]
        if i < j:
            own = [w for w, g in zip(own, gone[offsets[k] : offsets[k + 1]].tolist()) if not g]
        out.append((runs[i:j], b" ".join(own)))
    return out


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return b.column("text").cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"").to_pylist()


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, runs, collapsed) for each row of docs(doc_id, text): its runs as an array of (start, length, period) by start, then period, in
    words from 0, and its words without those that a run has after its first period, joined by a space.

    Words are [^\\x20\\x09-\\x0D]+. A null or empty text has no runs and an empty result; repeated rows have a row each; equal texts have equal results. No shuffle: a task works on
    SIDE_BY_SIDE bytes of text at once, or one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for whole in batches:
            for b in slices(whole, "text", SIDE_BY_SIDE):
                got = of_texts(_texts(b), None, min_length, min_exponent)
                runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r, _ in got], kind)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), runs, pa.array([c.decode() for _, c in got], pa.string())], names=["doc_id", "runs", "collapsed"])

    schema = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), schema)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the documents, by the crc32 of their id: which of its n words each place gets, so that they repeat from some place on. None for the others and for a null id."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def run_digests(docs: DataFrame) -> DataFrame:
    """Counts, the run with the greatest exponent and digests of what `collapse_runs` finds in docs(doc_id, text), after the words of some documents are made periodic (`planted`)."""
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SIDE_BY_SIDE):
                ids = b.column("doc_id").to_pylist()
                rows = []
                for doc, (runs, collapsed) in zip(ids, of_texts(_texts(b), lambda k, n: planted(ids[k], n))):
                    start = length = period = exponent = None
                    if runs:
                        start, length, period = runs[greatest(*map(list, zip(*runs)))]
                        exponent = 1000 * length // period
                    listing = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                    rows.append((doc, len(runs), start, length, period, exponent, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if name.endswith("256") else pa.int64()) for name, c in zip(names, zip(*rows))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
