"""Cross-tokenizer alignment: which tokens of one tokenizer lie over which of another, and how many documents hold each pair.

Two token sequences of the same bytes cut them at two sets of byte offsets. Offsets of both cut a document into groups; each stretch between
neighbouring offsets of either is a link of the two tokens it lies in.

Counts. The ids of side A are striped: stripe s holds the ids a with a % stripes = s, one dense block of counts each (ids of the stripe by ids of side B, 64-bit), so its size
depends on the vocabularies alone. Links are first reduced within a batch of documents: one row for each batch and stripe holds its distinct pairs, in how many
documents of the batch each lies, and those documents with their numbers of links. The pairs and numbers go to the stripe's task, which adds them into the block (np.add.at) and keeps
each row's maximum. Then the links go where the stripe's counts are, and come back to their batch as sums for each document.

A stripe with much of the links (a frequent id) is dealt to several tasks by batch; its counts, bounded by the vocabularies, go to each of them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels, tokens
from .store import slices, stored, tidied
from .tokens import WordTable

#: Stripes of side A's ids: with 50,257 by 32,000 ids a block of 64-bit counts takes 50 MB.
STRIPES = 256
#: Bytes of text in a batch, about.
BATCH_BYTES = 1 << 20
#: Bytes of links that a task scores at most and at least, about; a stripe with more is dealt to several.
SCORED_BYTES, LEAST_SCORED_BYTES = 256 << 20, 64 << 10
#: Pairs of a stripe in one row.
PAIRS_IN_ROW = 1 << 18


class PieceTable(WordTable):
    """Ids of whole texts by a sentencepiece BPE model with byte fallback, which stands for a space by U+2581.

    A merge joins neighbours only into a piece of the vocabulary, so a text is cut wherever its two neighbouring bytes lie in no piece side by side, and each distinct word is encoded once. The library
    puts a space before what it encodes: words that start with one are handed over without it, others behind a newline, which no piece holds.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes_of = [self._bytes(i) for i in range(n)]
        joined = np.zeros((256, 256), bool)
        for b in self.bytes_of:
            joined[list(b[:-1]), list(b[1:])] = True
        joined[:, 0x80:0xC0] = True  # within a letter
        self.apart = ~joined
        self.lead = self.model.encode("\n")
        if not self.apart[:, 10].all() or not self.apart[10, :0x80].all():
            raise ValueError("a piece of the model holds a newline")
        super().__init__()

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.model.is_control(i) or self.model.is_unknown(i) else piece.replace("▁", " ").encode()

    def word_ids(self, words: list[bytes]) -> list[list[int]]:
        spaced = [w[0] == 0x20 and len(w) > 1 for w in words]  # the library leaves an empty text's space out
        got = self.model.encode([w[1:].decode() if s else "\n" + w.decode() for w, s in zip(words, spaced)], num_threads=1)
        skip = len(self.lead)
        return [ids if s else ids[skip:] for ids, s in zip(got, spaced)]

    def encode(self, data: np.ndarray, offsets: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their numbers; data holds each text, none of them empty, behind a space."""
        start = np.ones(len(data), bool)
        start[1:] = self.apart[data[:-1], data[1:]]
        start[offsets[:-1]] = True
        ids, counts, wrong = self.looked_up(data, offsets, np.flatnonzero(start))
        if not wrong.any():
            return ids, counts
        pieces = np.split(ids, np.cumsum(counts)[:-1])
        for k in np.flatnonzero(wrong).tolist():
            pieces[k] = np.array(self.model.encode(texts[k]), np.uint32)
        return np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = tokens.encoder(path_a, added=False), PieceTable(path_b)
        from .automaton import byte_letters

        letters = byte_letters()
        vocab = self.a.tokenizer.get_vocab(with_added_tokens=False)
        of_a = [b""] * (1 + max(vocab.values()))
        for text, i in vocab.items():
            of_a[i] = bytes(letters[c] for c in text)
        self.sides = [self._flat(of_a), self._flat(self.b.bytes_of)]
        most = max(len(of_a), len(self.b.bytes_of))
        self.decimals = self._flat([str(i).encode() + b"," for i in range(most)])

    @staticmethod
    def _flat(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, items), np.int64, len(items))
        return np.frombuffer(b"".join(items), np.uint8), np.cumsum(sizes) - sizes, sizes

    @staticmethod
    def _spell(flat: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items end to end, and where each ends."""
        data, starts, sizes = flat
        size = sizes[ids]
        end = np.cumsum(size)
        return data[np.repeat(starts[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)], end

    def align(self, texts: pa.Array) -> dict:
        """Counts and groups of each text, and links of all: n_a, n_b, n_groups, n_links, sha; doc, a, b of each link.

        Texts that are null or empty, or of which either side's bytes aren't the space and the text, have no tokens.
        """
        rows = len(texts)
        given = [t for t in texts.fill_null("").to_pylist()]
        used = np.array([bool(t) for t in given], bool)
        where = np.flatnonzero(used)
        out = {c: np.zeros(rows, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"sha": [""] * rows, "doc": np.empty(0, np.int64), "a": np.empty(0, np.int64), "b": np.empty(0, np.int64)}
        if not len(where):
            return out
        spaced = pa.array([" " + given[k] for k in where.tolist()], pa.large_string())
        data, offsets = kernels.buffers(spaced)
        ids, counts = list(zip(self.a.encode(spaced), self.b.encode(data, offsets, [given[k] for k in where.tolist()])))
        same = np.ones(len(where), bool)
        for side in (0, 1):
            spelt, end = self._spell(self.sides[side], ids[side].astype(np.int64))
            cuts = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(counts[side])))]
            if len(spelt) == len(data) and np.array_equal(cuts, offsets):
                odd = np.flatnonzero(spelt != data)
                same &= np.diff(np.searchsorted(odd, offsets)) == 0
            else:
                same &= [np.array_equal(spelt[i:j], data[k:m]) for i, j, k, m in zip(cuts[:-1].tolist(), cuts[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist())]
        if not same.all():
            ids = [x[np.repeat(same, c)] for x, c in zip(ids, counts)]
            counts = [c[same] for c in counts]
            offsets = np.concatenate(([0], np.cumsum(np.diff(offsets)[same])))
            where = where[same]
        if not len(where):
            return out
        a, b = (x.astype(np.int64) for x in ids)
        end_a, end_b = np.cumsum(self.sides[0][2][a]), np.cumsum(self.sides[1][2][b])
        # links: the stretches that end at either side's offsets
        ends = np.union1d(end_a, end_b)
        of_a, of_b, doc = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends), np.searchsorted(offsets, ends) - 1
        groups = np.intersect1d(end_a, end_b, assume_unique=True)
        for name, values in (("n_a", counts[0]), ("n_b", counts[1]), ("n_groups", np.diff(np.searchsorted(groups, offsets, side="right"))), ("n_links", np.diff(np.searchsorted(ends, offsets, side="right")))):
            out[name][where] = values
        out |= {"doc": where[doc], "a": a[of_a], "b": b[of_b]}
        for k, digest in zip(where.tolist(), self._listings(a, b, end_a, end_b, groups, counts)):
            out["sha"][k] = digest
        return out

    def _listings(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, groups: np.ndarray, counts) -> Iterator[str]:
        """Digests of `a1,a2|b1;a3|b2,b3`: ids of each side within each group."""
        group_a, group_b = np.searchsorted(groups, end_a), np.searchsorted(groups, end_b)
        # each group's ids of A, then its ids of B
        before_b = np.searchsorted(group_b, group_a)  # ids of B in earlier groups
        before_a = np.searchsorted(group_a, group_b, side="right")  # ids of A in this group and earlier ones
        at_a, at_b = np.arange(len(a)) + before_b, np.arange(len(b)) + before_a
        mixed = np.empty(len(a) + len(b), np.int64)
        mixed[at_a], mixed[at_b] = a, b
        text, end = self._spell(self.decimals, mixed)
        text = text.copy()
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        text[end[at_a[last_a]] - 1] = ord("|")
        text[end[at_b[last_b]] - 1] = ord(";")
        cuts = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(counts[0] + counts[1])))].tolist()
        view = memoryview(text)
        for i, j in zip(cuts, cuts[1:]):
            yield hashlib.sha256(view[i : j - 1]).hexdigest()  # without the last sign


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sizes_of(path_a: str, path_b: str) -> tuple[int, int]:
    """Numbers of ids of both sides."""
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path_a).get_vocab_size(), sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


_HEAD = "docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>"
_LINKS = f"batch string, stripe int, {_HEAD}, pairs binary, held binary, members binary, times binary"


def batch_links(docs: DataFrame, path_a: str, path_b: str, stripes: int = STRIPES) -> DataFrame:
    """Documents and links by batch, to be stored before use (each attempt names its batches anew). A row with stripe -1 has a batch's documents; a row of a stripe has

    pairs: its distinct pairs, (a // stripes) * (ids of side B) + b, ascending, as 64-bit integers; held: in how many documents of the batch each lies;
    members and times: for each pair in turn those documents' numbers within the batch, and how often each has it (32 bits all).
    """
    wide = sizes_of(path_a, path_b)[1]
    head = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _aligner(path_a, path_b)
        for whole in batches:
            for part in slices(whole, "text", BATCH_BYTES):
                got = both.align(part.column("text"))
                name, n = uuid.uuid4().hex, part.num_rows
                rows = list(zip(part.column("doc_id").to_pylist(), *(got[c].tolist() for c in ("n_a", "n_b", "n_groups", "n_links")), got["sha"]))
                heads = [[dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), r)) for r in rows]]
                # links by stripe, pair, document
                per_stripe = (1 + int(got["a"].max(initial=0)) // stripes) * wide
                key = ((got["a"] % stripes) * per_stripe + (got["a"] // stripes) * wide + got["b"]) * n + got["doc"]
                key.sort()
                new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else key
                times = np.diff(np.append(new, len(key)))
                key = key[new]
                pair, member = key // n, key % n
                first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else pair
                held = np.diff(np.append(first, len(pair)))
                pair = pair[first]
                stripe, pair = pair // per_stripe, pair % per_stripe
                cut = np.flatnonzero(np.concatenate(([True], stripe[1:] != stripe[:-1]))) if len(stripe) else stripe
                ends, inner = np.append(cut, len(stripe)), np.append(first, len(member))
                pair, held, member, times = pair.astype("<i8"), held.astype("<i4"), member.astype("<i4"), times.astype("<i4")
                columns = [[None], [None], [None], [None]]
                for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    k, m = int(inner[i]), int(inner[j])
                    for c, v in zip(columns, (pair[i:j], held[i:j], member[k:m], times[k:m])):
                        c.append(v.tobytes())
                count = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * (count + 1)), pa.array(np.append([-1], stripe[cut]).astype(np.int32)), pa.array(heads + [None] * count, head), *(pa.array(c, pa.binary()) for c in columns)],
                    names=["batch", "stripe", "docs", "pairs", "held", "members", "times"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), _LINKS)


def dealt(links: DataFrame, stripes: int) -> dict[int, int]:
    """For each stripe among how many tasks its links are dealt, by their bytes; one number for each stripe reaches the driver."""
    size = links.filter("stripe >= 0").groupBy("stripe").agg(F.sum(F.octet_length("members")).alias("n")).collect()
    total = sum(r["n"] for r in size)
    target = max(LEAST_SCORED_BYTES, min(SCORED_BYTES, total // max(1, stripes)))
    return {r["stripe"]: -(-r["n"] // target) for r in size}


def pair_counts(links: DataFrame, size_a: int, size_b: int, stripes: int = STRIPES) -> DataFrame:
    """(stripe, pairs, counts, best): for each stripe its distinct pairs, in how many documents of all each lies, and the highest such count of the pair's id of A. Binary 64-bit integers.

    A stripe's task holds one dense block of size_a / stripes by size_b counts, whatever the number of documents. A stripe has a row for each PAIRS_IN_ROW pairs, ascending in both, none without links.
    """
    tall = -(-size_a // stripes)
    spark = links.sparkSession
    tasks = min(stripes, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, stripe = np.zeros(tall * size_b, np.int64), None

        def done():
            pairs = np.flatnonzero(block)
            counts = block[pairs]
            best = block.reshape(tall, size_b).max(axis=1)[pairs // size_b]
            block[pairs] = 0
            for i in range(0, len(pairs), PAIRS_IN_ROW):
                yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), *(pa.array([x[i : i + PAIRS_IN_ROW].astype("<i8").tobytes()], pa.binary()) for x in (pairs, counts, best))], names=["stripe", "pairs", "counts", "best"])

        for b in batches:
            for s, pairs, held in zip(b.column("stripe").to_pylist(), b.column("pairs"), b.column("held")):
                if stripe is not None and s != stripe:
                    yield from done()
                stripe = s
                np.add.at(block, np.frombuffer(pairs.as_buffer(), "<i8"), np.frombuffer(held.as_buffer(), "<i4").astype(np.int64))
        if stripe is not None:
            yield from done()

    rows = links.filter("stripe >= 0").select("stripe", "pairs", "held").repartitionById(tasks, F.pmod("stripe", F.lit(tasks)))
    return rows.sortWithinPartitions("stripe").mapInArrow(tidied(run), "stripe int, pairs binary, counts binary, best binary")


def scores(links: DataFrame, counts: DataFrame, shares: dict[int, int]) -> DataFrame:
    """(batch, members, n_best, count_sum) for each batch and stripe: sums over its links, by document of the batch. Links and counts of a stripe share a task, or its shares tasks; the counts come first and the links stream by."""
    spark = links.sparkSession
    first, at = {}, 0
    for s in sorted(shares):
        first[s], at = at, at + shares[s]
    tasks = max(1, min(at, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-at // 4))))
    table = spark.createDataFrame([(s, first[s], n) for s, n in shares.items()], "stripe int, first int, shares int")  # one row a stripe
    none = F.lit(None).cast("binary")
    own = F.broadcast(table)
    some = links.filter("stripe >= 0").join(own, "stripe").select(
        (F.col("first") + F.pmod(F.xxhash64("batch"), "shares")).cast("int").alias("slot"), F.lit(1).alias("kind"), "batch", "pairs", "held", "members", "times"
    )
    known = counts.join(own, "stripe").select(
        F.explode(F.sequence("first", F.col("first") + F.col("shares") - 1)).alias("slot"), F.lit(0).alias("kind"), F.lit("").alias("batch"), "pairs", F.col("counts").alias("held"), F.col("best").alias("members"), none.alias("times")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: list[tuple[np.ndarray, ...]] = []  # rows of the slot's counts
        pairs = count = best = np.empty(0, np.int64)
        for b in batches:
            out = [[], [], [], []]
            columns = [b.column(c) for c in ("kind", "batch", "pairs", "held", "members", "times")]
            for kind, batch, p, h, m, t in zip(columns[0].to_pylist(), columns[1].to_pylist(), *columns[2:]):
                p = np.frombuffer(p.as_buffer(), "<i8")
                if kind == 0:
                    read.append((p.copy(), np.frombuffer(h.as_buffer(), "<i8").copy(), np.frombuffer(m.as_buffer(), "<i8").copy()))
                    continue
                if read:
                    read.sort(key=lambda r: r[0][0])
                    pairs, count, best = (np.concatenate(x) for x in zip(*read))
                    read = []
                at = np.searchsorted(pairs, p)
                h = np.frombuffer(h.as_buffer(), "<i4")
                member, times = np.frombuffer(m.as_buffer(), "<i4"), np.frombuffer(t.as_buffer(), "<i4").astype(np.int64)
                c = count[at]
                who, back = np.unique(member, return_inverse=True)
                n_best, total = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
                np.add.at(n_best, back, times * np.repeat(c == best[at], h))
                np.add.at(total, back, times * np.repeat(c, h))
                for column, v in zip(out, (batch, who.astype("<i4").tobytes(), n_best.astype("<i8").tobytes(), total.astype("<i8").tobytes())):
                    column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["batch", "members", "n_best", "count_sum"])

    both = some.unionByName(known).repartitionById(tasks, F.pmod("slot", F.lit(tasks))).sortWithinPartitions("slot", "kind")
    return both.mapInArrow(tidied(run), "batch string, members binary, n_best binary, count_sum binary")


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, stripes: int = STRIPES) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    n_best counts links whose pair lies in as many documents as any pair of its id of A, count_sum adds up the numbers of documents. A null or empty text, or one that a tokenizer doesn't give back byte
    by byte, has zeros and an empty digest. Repeated rows count as documents each; no documents, no rows.
    """
    a, b = default_tokenizers()
    path_a, path_b = path_a or a, path_b or b
    size_a, size_b = sizes_of(path_a, path_b)
    links = stored(batch_links(docs, path_a, path_b, stripes), "links")
    shares = dealt(links, stripes)
    counts = stored(pair_counts(links, size_a, size_b, stripes), "pair-counts")
    parts = scores(links, counts, shares)
    heads = links.filter("stripe < 0").select("batch", F.lit(0).alias("kind"), "docs", *(F.lit(None).cast("binary").alias(c) for c in ("members", "n_best", "count_sum")))
    sums = parts.select("batch", F.lit(1).alias("kind"), F.lit(None).cast(_HEAD.split(" ", 1)[1]).alias("docs"), "members", "n_best", "count_sum")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: list[dict] = []
        best = total = np.empty(0, np.int64)

        def done():
            columns = [[d[c] for d in head] for c in names[:6]]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string() if n == "groups_sha256" else pa.int64()) for n, c in zip(names, columns)), pa.array(best), pa.array(total)], names=names)

        for batch in batches:
            for kind, docs_of, m, x, y in zip(batch.column("kind").to_pylist(), batch.column("docs"), *(batch.column(c) for c in ("members", "n_best", "count_sum"))):
                if kind == 0:
                    if head:
                        yield done()
                    head = docs_of.as_py()
                    best, total = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
                else:
                    who = np.frombuffer(m.as_buffer(), "<i4")
                    best[who] += np.frombuffer(x.as_buffer(), "<i8")
                    total[who] += np.frombuffer(y.as_buffer(), "<i8")
        if head:
            yield done()

    return heads.unionByName(sums).repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(tidied(run), schema)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
