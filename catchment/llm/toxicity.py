"""Toxic passages by maximum-scoring segment search over token log-odds.

Tokens are runs of letters. A token's features are the whole token and its first 4 to 8 bytes. A feature's weight is the lower confidence bound of the
log-odds of its document frequency in toxic against clean labelled documents, under a Dirichlet prior whose base measure is its frequency in all
documents of the corpus. A token scores its best feature's weight, other tokens a small constant below 0. One linear scan finds all
maximal-scoring segments of a text.

Scores of segments in clean text follow an extreme-value law: a text of m tokens has K * m * exp(-lambda * s) segments of score s or more. K and lambda are fitted on labelled
documents that the weights were not learnt from. The evidence of all significant segments, -log of that expectation, is summed and mapped to a probability by a logistic fit on
the same documents.

What is learnt comes from at most max_labelled labelled documents, so the table of weights is bounded and is broadcast; corpus frequencies count every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .store import slices, stored, tidied

#: Labelled documents that a model is learnt from, at most. The smallest hashes of doc_id are taken, so the choice is stable.
MAX_LABELLED = 50_000
PREFIXES = (4, 5, 6, 7, 8)
#: Toxic documents in which a feature must occur; prior documents; standard deviations to the lower bound; least weight kept; longest run of unremarkable tokens' cost.
LEAST_TOXIC, PRIOR, DEVIATIONS, LEAST_WEIGHT = 3, 10.0, 2.5, 0.5
#: By how much the corpus's share of the prior can raise a weight at most.
PRIOR_SLACK = 0.5
#: Expected chance segments up to which a segment is significant.
SIGNIFICANT = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals U+00C0-U+00DE lowered."""
    out = kernels._LOWER[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:] += capital.astype(np.uint8) * np.uint8(0x20)
    return out


def token_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every run of letters."""
    n = len(data)
    solid = _LETTER[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before, after = first[:n].copy(), first[1:].copy()
    before[1:] |= ~solid[:-1]
    after[:-1] |= ~solid[1:]
    start = np.flatnonzero(solid & before)
    return start, np.flatnonzero(solid & after) + 1, np.searchsorted(offsets, start, side="right") - 1


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token numbers, feature hashes) for each kind of feature."""
    p = kernels.prefix(lowered(data))
    yield np.arange(len(start)), kernels.mix(kernels.spans(p, start, end) + np.uint64(0x1F83D9ABFB41BD6B))
    for size in PREFIXES:
        at = np.flatnonzero(end - start >= size)
        yield at, kernels.mix(kernels.spans(p, start[at], start[at] + size) + np.uint64(size * 0x5BE0CD19137E2179 % (1 << 64)))


class Table:
    """Sorted feature hashes with a bitmap in front, for fast lookup of mostly absent features."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, numbers in the table) of the known ones."""
        if not len(self.hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        known = self.hashes[at] == h[maybe]
        return maybe[known], at[known]


def segments(at: list[int], weight: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first hit, last hit, score) of a text whose tokens at positions at score weight and all others -gap.

    Linear in the hits (Ruzzo and Tompa's scan). Candidates are kept on a stack with the running totals at their ends; a later one that raises the total takes in all from the
    nearest one that began lower. Each candidate points to that one, so the search skips what lies between; once a candidate begins no higher than all
    before it, those can't grow any more and are retired.
    """
    out: list[tuple[int, int, float]] = []
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total after, place on the stack of the nearest that begins lower
    total, before = 0.0, -1
    for i, (p, w) in enumerate(zip(at, weight)):
        total -= gap * (p - before - 1)
        before = p
        if w <= 0:
            total += w
            continue
        first, left = i, total
        total += w
        j = len(stack) - 1
        while j >= 0 and stack[j][2] >= left:
            j = stack[j][4]
        while j >= 0 and stack[j][3] < total:
            first, left = stack[j][0], stack[j][2]
            below = stack[j][4]
            del stack[j:]
            j = below
        if j < 0 and stack:
            out += [(a, z, after - start) for a, z, start, after, _ in stack]
            stack.clear()
        stack.append((first, i, left, total, j))
    return out + [(a, z, after - start) for a, z, start, after, _ in stack]


def training_sample(labels: DataFrame, keep: Column, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, toxic, fold) for at most `most` labelled documents for which keep holds; fold 0 learns, fold 1 calibrates."""
    one = labels.filter("doc_id is not null and toxic is not null").filter(keep).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return stored(picked.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int").alias("fold")), "labelled")


def _toxic_features(batches):
    """Distinct features of each text, counted by fold within a batch."""
    for whole in batches:
        for b in slices(whole, "text"):
            data, offsets = kernels.buffers(b.column("text"))
            start, end, owner = token_spans(data, offsets)
            fold = b.column("fold").to_numpy(zero_copy_only=False)
            hs, os_ = [], []
            for at, h in features(data, start, end):
                hs.append(h)
                os_.append(owner[at])
            h, o = np.concatenate(hs), np.concatenate(os_)
            order = np.argsort(o, kind="stable")
            o, h = kernels.distinct(o[order], h[order])
            for k in (0, 1):
                x, n = np.unique(h[fold[o] == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def _document_counts(hashes: np.ndarray):
    """Document frequencies of the features in hashes: in all texts, and in labelled ones by class and fold."""

    def run(batches):
        table = Table(hashes)
        counts = np.zeros((5, len(hashes)), np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                data, offsets = kernels.buffers(b.column("text"))
                start, end, owner = token_spans(data, offsets)
                group = b.column("grp").fill_null(0).to_numpy(zero_copy_only=False)
                seen = [(owner[at[i]].astype(np.int64) * len(hashes) + k) for at, h in features(data, start, end) for i, k in (table.find(h),)]
                pair = np.unique(np.concatenate(seen))
                k, row = pair % max(1, len(hashes)), pair // max(1, len(hashes))
                for g in range(5):
                    mine = k if g == 0 else k[group[row] == g]
                    counts[g] += np.bincount(mine, minlength=len(hashes))
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(table.hashes[some].view(np.int64))] + [pa.array(c[some]) for c in counts], names=["h", "n", "c1", "c2", "c3", "c4"])

    return run


class Model:
    """hashes and weights of telling features; gap: cost of an unremarkable token; k, rate (lambda): extreme-value law; a, b: logistic map."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, gap: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.gap = hashes[order], weights[order], gap
        self.k, self.rate, self.a, self.b = 1e-6, 1.0, -3.0, 1.0

    def evidence(self, scores: list[float], tokens: int) -> float:
        """Sum over significant segments of -log of the expected number of chance segments as good."""
        base = math.log(max(self.k * max(tokens, 1), 1e-12))
        least = -math.log(SIGNIFICANT)
        return sum(e for s in scores if (e := self.rate * s - base) >= least)


def _summed(texts: DataFrame, hashes: np.ndarray, columns: tuple[str, ...]):
    """Document frequencies of the features over texts(text, grp), as a local table: one row for each feature, whose number is bounded."""
    sums = texts.mapInArrow(tidied(_document_counts(np.sort(hashes))), "h long, n long, c1 long, c2 long, c3 long, c4 long")
    return sums.groupBy("h").agg(*[F.sum(k).alias(k) for k in columns]).toPandas().sort_values("h")


def learn_weights(y1: np.ndarray, y0: np.ndarray, n1: int, n0: int, corpus: np.ndarray, documents: int) -> np.ndarray:
    prior = PRIOR * corpus / max(1, documents) + 0.5
    total = PRIOR + 1.0
    odds = lambda y, n: np.log(y + prior) - np.log(np.maximum(n + total - y - prior, 0.5))
    return odds(y1, n1) - odds(y0, n0) - DEVIATIONS * np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))


def scored(docs: DataFrame, model: Model, extra: list[str]) -> DataFrame:
    """The extra columns, of which text can be one, with tokens and passages (code points [start, end) and score) for each text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.hashes, model.weights, model.gap))

    def run(batches):
        hashes, weights, gap = shared.value
        table = Table(hashes)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for whole in batches:
            for b in slices(whole, "text"):
                data, offsets = kernels.buffers(b.column("text"))
                start, end, owner = token_spans(data, offsets)
                best = np.full(len(start), -np.inf)
                for at, h in features(data, start, end):
                    i, k = table.find(h)
                    np.maximum.at(best, at[i], weights[k])
                hits = np.flatnonzero(best > -np.inf)
                tokens = np.bincount(owner, minlength=b.num_rows)
                first = np.concatenate(([0], np.cumsum(tokens)))
                found = [[] for _ in range(b.num_rows)]
                cut = np.searchsorted(owner[hits], np.arange(b.num_rows + 1))
                for r in np.unique(owner[hits]).tolist():
                    mine = hits[cut[r] : cut[r + 1]]
                    heads = np.cumsum((data[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80)
                    point = lambda x: int(heads[x - offsets[r] - 1]) if x > offsets[r] else 0  # noqa: B023, E731
                    for i, j, s in segments((mine - first[r]).tolist(), best[mine].tolist(), gap):
                        found[r].append({"start": point(start[mine[i]]), "end": point(end[mine[j]]), "score": s})
                names = extra
                yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(tokens.astype(np.int64)), pa.array(found, kind)], names=[*names, "tokens", "passages"])

    flat = docs.select("text", *[c for c in extra if c != "text"])
    kinds = dict(flat.dtypes)
    schema = ", ".join([f"`{n}` {kinds[n]}" for n in extra] + ["tokens long", "passages array<struct<start:long,end:long,score:double>>"])
    return flat.mapInArrow(tidied(run), schema)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, most: int = MAX_LABELLED) -> Model | None:
    """Learn from docs(doc_id, text) and labels(doc_id, toxic) for which keep holds; None without labelled documents of both classes."""
    sample = training_sample(labels, keep, most)
    counts = {(r["toxic"], r["fold"]): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()}
    size = lambda toxic: sum(v for (t, _), v in counts.items() if t == toxic)
    if not size(1) or not size(0):
        return None
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    few = F.broadcast(sample)  # at most `most` rows
    toxic = plain.join(few.filter("toxic = 1"), "doc_id").select("text", "fold").mapInArrow(tidied(_toxic_features), "h long, n long")
    common = toxic.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TOXIC).select("h")
    hashes = np.sort(np.array(common.toPandas()["h"], np.int64).view(np.uint64))
    n = lambda t, f: counts.get((t, f), 0)
    halves = bool(n(1, 0) and n(0, 0) and n(1, 1) and n(0, 1))

    # counts in the labelled sample; what can't become telling there needs no count in the corpus
    group = plain.join(few.select("doc_id", (1 + F.col("toxic") + 2 * F.col("fold")).alias("grp")), "doc_id").select("text", "grp")
    sums = _summed(group, hashes, ("c1", "c2", "c3", "c4"))
    h = sums["h"].to_numpy(np.int64).view(np.uint64)
    c = {k: sums[k].to_numpy(float) for k in ("c1", "c2", "c3", "c4")}  # c1: clean, fold 0; c2: toxic, fold 0; c3, c4: fold 1
    least = LEAST_WEIGHT - PRIOR_SLACK
    may = learn_weights(c["c2"] + c["c4"], c["c1"] + c["c3"], size(1), size(0), 0.0, 1) >= least
    if halves:
        may |= learn_weights(c["c2"], c["c1"], n(1, 0), n(0, 0), 0.0, 1) >= least
    h, c = h[may], {k: v[may] for k, v in c.items()}
    documents = docs.count()
    corpus = _summed(plain.select("text", F.lit(0).cast("int").alias("grp")), h, ("n",)).set_index("h")["n"].reindex(h.view(np.int64), fill_value=0).to_numpy(float)

    def model(y1, y0, n1, n0) -> Model:
        w = learn_weights(y1, y0, n1, n0, corpus, documents)
        telling = w >= LEAST_WEIGHT
        # tokens that tell nothing are likelier in clean text by the share of those that tell
        share = float(y1[telling].sum()) / max(1, n1) / 600
        return Model(h[telling], w[telling], max(0.01, min(0.5, share)))

    half = model(c["c2"], c["c1"], n(1, 0), n(0, 0)) if halves else None
    full = model(c["c2"] + c["c4"], c["c1"] + c["c3"], size(1), size(0))
    tuned, on = (half, few.filter("fold = 1")) if half is not None else (full, few)
    rows = scored(plain.join(on.select("doc_id", "toxic"), "doc_id"), tuned, ["toxic"]).select("toxic", "tokens", F.transform("passages", lambda p: p["score"]).alias("s")).toPandas()
    clean = rows[rows["toxic"] == 0]
    chance = np.array([x for s in clean["s"] for x in s], float)
    full.k = (len(chance) + 0.5) / max(1.0, float(clean["tokens"].sum()))
    full.rate = float(np.clip((len(chance) + 1) / (chance.sum() + 1), 0.2, 2.0))
    x = np.array([full.evidence(list(s), t) for s, t in zip(rows["s"], rows["tokens"])])
    y = rows["toxic"].to_numpy(float)
    full.a, full.b = _logistic(np.minimum(x, 60.0), y)
    return full


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps, with a weak pull towards slope 0.5."""
    design = np.stack([np.ones_like(x), x], axis=1)
    w, centre, pull = np.array([-2.0, 0.5]), np.array([-2.0, 0.5]), np.array([0.1, 2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(pull), design.T @ (y - p) - pull * (w - centre))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 1e-3))


def score_toxicity(docs: DataFrame, model: Model | None, extra: list[str] | None = None) -> DataFrame:
    """The extra columns (doc_id by default) with score (0 to 1) and passages for each row of docs(doc_id, text).

    A null or empty text has no passages and the score of a text without evidence. Without a model scores are 0.
    """
    extra = ["doc_id"] if extra is None else extra
    if model is None:
        return docs.select(*extra, F.lit(0.0).alias("score"), F.expr("cast(array() as array<struct<start:long,end:long,score:double>>)").alias("passages"))
    out = scored(docs, model, extra)
    base = F.log(F.greatest(F.lit(model.k) * F.greatest(F.col("tokens"), F.lit(1)), F.lit(1e-12)))
    each = F.transform("passages", lambda p: p["score"] * model.rate - base)
    evidence = F.aggregate(F.filter(each, lambda e: e >= -math.log(SIGNIFICANT)), F.lit(0.0), lambda a, e: a + e)
    return out.select(*extra, (1 / (1 + F.exp(-(F.least(evidence, F.lit(60.0)) * model.b + model.a)))).alias("score"), "passages")


def drop_toxic(docs: DataFrame, model: Model | None, least: float = 0.7) -> DataFrame:
    """The rows of docs(doc_id, text, ...) whose score is below least, with all columns whatever their names."""
    flat = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"c{i}") for i, c in enumerate(docs.columns)])
    kept = score_toxicity(flat, model, flat.columns).filter(F.col("score") < least)
    return kept.select(*[F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def held_out(doc: str = "doc_id") -> Column:
    """Rows that no model of this library learns from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels, ~held_out())
    out = score_toxicity(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
