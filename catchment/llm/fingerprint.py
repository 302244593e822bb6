"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (each is the longest known phrase and one more character), the set of phrases is hashed, and the minima of
K hash functions over it are the fingerprint. The share of equal minima estimates the Jaccard likeness of two phrase sets, which is high where one
text compresses well with the other's dictionary. A fingerprint is a string of K groups of four hex digits; a text without characters has the empty one.
"""

from __future__ import annotations

import gc
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .store import parts, quantiles, tidied

K = 64


def parse(text: str, tree: dict, node: dict, at: int, ends: array, added: list | None = None) -> dict:
    """Continue a parse at position at: tree is the dictionary (a trie of dicts), node the place in it. Appends phrase ends; with added, also the new
    entries, so that they can be taken back. Returns the new place."""
    done = ends.append
    for i, c in enumerate(text, at + 1):
        if c in node:
            node = node[c]
        else:
            node[c] = {}
            if added is not None:
                added.append((node, c))
            done(i)
            node = tree
    return node


def phrase_hashes(codes: np.ndarray, ends: array) -> np.ndarray:
    """Distinct hashes of the phrases that end at ends, the first starting at 0."""
    e = np.frombuffer(ends, np.int64)
    if not len(e):
        return np.empty(0, np.uint64)
    s = np.concatenate(([0], e[:-1]))
    return np.unique(kernels.mix(kernels.spans(kernels.prefix(codes), s, e)))


def signatures(sets: list[np.ndarray], k: int = K) -> list[np.ndarray | None]:
    """k 16-bit minima for each set of hashes; None for an empty one."""
    sizes = np.array([len(x) for x in sets], np.int64)
    if not sizes.sum():
        return [None] * len(sets)
    minima = kernels.minhash(np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets), len(sets), k, seed=4)
    minima = (minima & np.uint32(0xFFFF)).astype(">u2")
    return [m if n else None for m, n in zip(minima, sizes.tolist())]


def text_of(sig: np.ndarray | None) -> str:
    return "" if sig is None else sig.tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of equal minima; two empty texts are alike, an empty and another one aren't."""
    if a is None or b is None:
        return 1.0 if a is b else 0.0
    return float((a == b).mean())


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def phrases(text: str) -> np.ndarray:
    """Distinct hashes of the text's phrases."""
    tree, ends = {}, array("q")
    parse(text, tree, tree, 0, ends)
    return phrase_hashes(codes_of(text), ends)


def fingerprint(text: str) -> str:
    return text_of(signatures([phrases(text)])[0])


def phrases_of_both(text: str, other: str) -> tuple[np.ndarray, str, np.ndarray]:
    """Phrase hashes of text, its edited text, and that one's. The half that they share is parsed once: what the rest of text adds to the dictionary is
    taken back before the other rest is parsed."""
    half = len(text) // 2
    kept, tail = text[: len(text) - half], other[:half]
    tree, ends, added = {}, array("q"), []
    node = parse(kept, tree, tree, 0, ends)
    edited_ends = ends[:]
    parse(text[len(kept) :], tree, node, len(kept), ends, added)
    for place, c in reversed(added):
        del place[c]
    parse(tail, tree, node, len(kept), edited_ends)
    edited = kept + tail
    return phrase_hashes(codes_of(text), ends), edited, phrase_hashes(codes_of(edited), edited_ends)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ahead) in partitions of consecutive doc_id, descending (null last, equal ids by text), each closed by its follower: the
    first row of the next partition, marked ahead. The last partition is followed by the first row of all.

    The ranges are quantiles of doc_id; only one id for each partition reaches the driver. Texts are shuffled once.
    """
    n = parts(docs)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("i"))
    bounds = np.array(quantiles(ids, "i", n), np.int64)

    def part(i: np.ndarray) -> np.ndarray:
        """0 for the largest ids."""
        return len(bounds) - np.searchsorted(bounds, i, side="right")

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}
        for b in batches:
            i = b.column("i").to_numpy(zero_copy_only=False)
            for q in np.unique(p := part(i)).tolist():
                top[q] = max(top.get(q, -(1 << 63)), int(i[p == q].max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int32()), pa.array(list(top.values()), pa.int64())], names=["p", "i"])

    first = {r["p"]: r["i"] for r in ids.mapInArrow(tidied(firsts), "p int, i long").groupBy("p").agg(F.max("i").alias("i")).collect()}
    order = sorted(first)
    leads = {first[q]: p for p, q in zip(order, order[1:] + order[:1])}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column("i").to_numpy(zero_copy_only=False)
            follow = np.flatnonzero(np.isin(i, np.array(list(leads), np.int64)))
            where = np.concatenate((part(i), [leads[x] for x in i[follow].tolist()])).astype(np.int32)
            rows = b.take(pa.array(np.concatenate((np.arange(len(i)), follow)).astype(np.int64)))
            ahead = np.repeat(np.array([0, 1], np.int32), [len(i), len(follow)])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(where), pa.array(ahead)], names=[*rows.schema.names, "p", "ahead"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("i"))
    dealt = rows.mapInArrow(tidied(deal), "doc_id long, text string, i long, p int, ahead int").repartitionById(n, F.col("p"))
    return dealt.sortWithinPartitions("ahead", F.col("i").desc(), "text").select("doc_id", "text", "ahead")


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last n_chars // 2 code points replaced by the first as many (or all) of the next document's, by descending doc_id; the last
    document is followed by the first, a single one by itself. A null text is an empty one.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [f.split()[0] for f in schema.split(", ")]

    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # (doc_id, n_chars, edited_sha256), in order
        sets: list[np.ndarray] = []  # phrase sets of each waiting row: the text's, the edited text's
        size, previous, ended = 0, None, False

        def flush(last: np.ndarray):
            """Rows of all that wait; last is the phrase set of what follows them."""
            sigs = signatures([*sets, last])
            own, edited = sigs[:-1:2], sigs[1:-1:2]
            after = [*own[1:], sigs[-1]]
            columns = [*zip(*waiting), [text_of(x) for x in own], [text_of(x) for x in edited], [likeness(x, y) for x, y in zip(own, edited)], [likeness(x, y) for x, y in zip(own, after)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for b in batches:
            for doc, text, ahead in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "ahead"))):
                if ended:  # further rows with the follower's id
                    break
                if previous is not None:
                    own, edited, edited_set = phrases_of_both(previous[1], text)
                    if size > 1 << 18:
                        yield flush(own)
                        waiting, sets, size = [], [], 0
                    waiting.append((previous[0], len(previous[1]), hashlib.sha256(edited.encode()).hexdigest()))
                    sets += [own, edited_set]
                    size += len(own) + len(edited_set)
                previous = (doc, text)
                if ahead and waiting:
                    yield flush(phrases(text))
                    ended = True

    def without_collector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # a trie is many small dicts without cycles
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return with_next(docs).mapInArrow(tidied(without_collector), schema)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
