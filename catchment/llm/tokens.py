"""Token ids: a fast whole-text encoder over a public tokenizer, and flat binary files of ids with 64-bit offsets.

Files. A corpus is a folder of shards. Shard i holds `ids-i.bin`, all its documents' ids end to end as unsigned little-endian
integers (16 bits where the vocabulary fits, else 32), and `docs-i.bin`, for each document its doc_id and its 64-bit offset: the ids of the whole corpus before
it. Shards follow ascending doc_id. They are first written with offsets from 0; each shard's base is the prefix sum of the totals before
it, kept in the manifest, so no shard is rewritten. Files are read through a memory map where the folder is local.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .store import parts, quantiles, scratch_path, slices, stored, tidied

#: Byte classes for cutting plain text into words: space, other white space, letter, digit, other; _ODD marks bytes that a plain text lacks. Plain are ASCII without
#: control characters and the letters U+00C0-U+017F, which are letters under any Unicode version.
_SPACE, _WHITE, _LETTER, _DIGIT, _OTHER, _ODD = range(6)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[0x20] = _SPACE
_CLASS[[0x09, 0x0A, 0x0D]] = _WHITE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = _LETTER
#: Words that an encoder keeps.
KEPT_WORDS = 1_000_000


def plain_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts are plain."""
    odd = _CLASS[data] == _ODD
    if len(data) > 1:
        sign = ((data[1:] == 0x97) | (data[1:] == 0xB7)) & (data[:-1] == 0xC3)  # multiplication and division signs
        odd[1:] |= sign
    return np.diff(np.searchsorted(np.flatnonzero(odd), offsets)) == 0


def cut_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the words that byte-level tokenizers merge within, for plain texts.

    A word is a run of letters, of digits or of other signs, with one space before it; the endings 's 't 're 've 'm 'll 'd; or white space, of
    which the last character before a word stands alone unless it is that word's space.
    """
    n = len(data)
    cls = _CLASS[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    kind = np.where(cls == _WHITE, _SPACE, cls)
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(change)
    ends = np.append(runs[1:], n)
    white = kind[runs] == _SPACE
    start = np.zeros(n + 1, bool)
    # runs of white space
    a, z = runs[white], ends[white]
    leads = ~first[z]  # a word of the same text follows
    spare = leads & (cls[z - 1] == _SPACE)
    start[a[~(spare & (z - a == 1))]] = True
    start[(z - 1)[leads & ~spare]] = True
    # other runs
    i = runs[~white]
    spaced = np.zeros(len(i), bool)
    later = i > 0
    spaced[later] = ~first[i[later]] & (cls[i[later] - 1] == _SPACE)
    start[i - spaced] = True
    # endings
    q = i[(data[i] == 0x27) & ~spaced]
    if len(q):
        end_of = offsets[np.searchsorted(offsets, q, side="right")]
        get = lambda k: np.where(q + k < end_of, data[np.minimum(q + k, n - 1)], 0)
        x, y = get(1), get(2)
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = ((x == 0x72) | (x == 0x76)) & (y == 0x65) | (x == 0x6C) & (y == 0x6C)
        q, size = q[one | two], np.where(one, 2, 3)[one | two]
        start[q + 1] = False
        to = q + size
        more = ~first[to]
        to = to[more]
        start[to[cls[to] == _LETTER]] = True
    return np.flatnonzero(start[:n])


class WordTable:
    """Ids of words, looked up by a hash once they are known; the bytes of what was found are compared with the word's own.

    A subclass says in word_ids how unknown words are encoded. Words must be encoded alike wherever they stand.
    """

    def __init__(self):
        self._reset()

    def word_ids(self, words: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def _reset(self) -> None:
        self.known = 0
        self.hashes, self.starts, self.lengths = np.empty(1 << 16, np.uint64), np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32)
        self.slots = np.full(1 << 18, -1, np.int32)  # open addressing: a word's number at the first free slot from its hash
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.letters, self.written = np.empty(1 << 16, np.uint8), 0  # the words' bytes, end to end
        self.places, self.sizes = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 where unknown."""
        mask = np.uint64(len(self.slots) - 1)
        out = self.slots[h & mask]
        rest = np.flatnonzero((out >= 0) & (self.hashes[out] != h))
        step = np.uint64(0)
        while len(rest):
            step += np.uint64(1)
            got = self.slots[(h[rest] + step) & mask]
            out[rest] = got
            rest = rest[(got >= 0) & (self.hashes[got] != h[rest])]
        return out

    def _place(self, numbers: np.ndarray) -> None:
        mask, step = np.uint64(len(self.slots) - 1), np.uint64(0)
        while len(numbers):
            at = (self.hashes[numbers] + step) & mask
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            numbers = numbers[self.slots[at] != numbers]
            step += np.uint64(1)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Add distinct unknown words."""
        ids = self.word_ids(words)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total, first, end = int(lengths.sum()), self.known, self.known + len(words)
        if self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, max(2 * len(self.flat), self.used + total))
        if end > len(self.hashes):
            size = max(2 * len(self.hashes), end)
            self.hashes, self.starts, self.lengths = np.resize(self.hashes, size), np.resize(self.starts, size), np.resize(self.lengths, size)
            self.places, self.sizes = np.resize(self.places, size), np.resize(self.sizes, size)
        raw, sizes = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        if self.written + len(raw) > len(self.letters):
            self.letters = np.resize(self.letters, max(2 * len(self.letters), self.written + len(raw)))
        self.letters[self.written : self.written + len(raw)] = raw
        self.places[first:end], self.sizes[first:end] = self.written + np.cumsum(sizes) - sizes, sizes
        self.written += len(raw)
        self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, total)
        self.hashes[first:end], self.starts[first:end], self.lengths[first:end] = hashes, self.used + np.cumsum(lengths) - lengths, lengths
        self.used, self.known = self.used + total, end
        if 3 * end > len(self.slots):
            self.slots = np.full(1 << (6 * end).bit_length(), -1, np.int32)
            first = 0
        self._place(np.arange(first, end, dtype=np.int32))

    def _taken_for_another(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Numbers of the words whose bytes aren't those of the known word at."""
        size = (end - start).astype(np.int64)
        wrong = self.sizes[at] != size
        place = np.where(wrong, 0, self.places[at])  # a word of another size is compared with anything
        differs = self.letters[np.minimum(np.repeat(place - start, size) + np.arange(len(data)), self.written - 1)] != data
        return np.flatnonzero(wrong | np.bitwise_or.reduceat(differs, start)) if len(start) else start

    def looked_up(self, data: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts cut into words at start: ids and their numbers for each text, and which texts hold a word that was taken for another one."""
        end = np.append(start[1:], len(data))
        h = kernels.mix(kernels.spans(kernels.prefix(data), start, end) + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        if self.known > KEPT_WORDS:
            self._reset()
        at = self._find(h)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            fresh, where, back = np.unique(h[unknown], return_index=True, return_inverse=True)
            raw = data.tobytes()
            where = unknown[where]
            at[unknown] = self.known + back
            self._learn(fresh, [raw[a:z] for a, z in zip(start[where].tolist(), end[where].tolist())])
        n = self.lengths[at].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - ends + n, n) + np.arange(total)]
        before = np.concatenate(([0], ends))[np.searchsorted(start, offsets)]
        wrong = np.zeros(len(offsets) - 1, bool)
        wrong[np.searchsorted(offsets, start[self._taken_for_another(data, start, end, at)], side="right") - 1] = True
        return ids, np.diff(before), wrong

class Encoder(WordTable):
    """Ids of whole texts by a tokenizers file of the byte-level kind.

    Such a tokenizer never merges across the words it first cuts a text into, so each distinct word is encoded once by the tokenizers library. Texts that aren't plain, that
    hold the string of an added token (unless these are plain text to it), or of which a word was taken for another one go to the library whole.
    """

    def __init__(self, path: str, added: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content and (added or not t.special)]
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        super().__init__()

    def word_ids(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.looked_up(data, offsets, cut_words(data, offsets))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and each text's number of ids. A null is an empty text."""
        data, offsets = kernels.buffers(texts)
        plain = plain_rows(data, offsets)
        for token in self.added:
            plain &= ~pc.match_substring(texts, token).fill_null(False).to_numpy(zero_copy_only=False)
        ids, counts, wrong = self._plain(data, offsets) if plain.all() else self._plain(*kernels.buffers(texts.filter(pa.array(plain))))
        if plain.all() and not wrong.any():
            return ids, counts
        bounds = np.concatenate(([0], np.cumsum(counts)))
        own = np.full(len(plain), -1)
        own[plain] = np.where(wrong, -1, np.arange(len(counts)))
        library = iter(self.tokenizer.encode_batch_fast(texts.filter(pa.array(own < 0)).fill_null("").to_pylist(), add_special_tokens=False))
        pieces = [ids[bounds[k] : bounds[k + 1]] if k >= 0 else np.array(next(library).ids, np.uint32) for k in own.tolist()]
        return np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added: bool = True) -> Encoder:
    """One encoder a process, file and reading of added tokens' strings: as those tokens, or as plain text."""
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, added)
    return _encoders[path, added]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the id end to each document; offsets of the documents, with the total last."""
    offsets = np.concatenate(([0], np.cumsum(counts + 1)))
    out = np.empty(offsets[-1], np.uint32)
    mask = np.ones(len(out), bool)
    mask[offsets[1:] - 1] = False
    out[mask] = ids
    out[~mask] = end
    return out, offsets


def _filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Encode docs(doc_id, text) and write shards into folder, a URI that all executors reach. Returns the manifest
    (shard, documents, tokens, base, width), which is also written to folder/manifest as Parquet.

    Each document's ids are followed by end_id. A null text is an empty one: its end alone. Documents lie in ascending doc_id (null first; equal ids by text). No documents: no shards.
    Encoding happens before the one shuffle, which carries ids; the ranges of doc_id are quantiles of that column. A shard is written under
    a name of its own attempt and the manifest names the attempt that counts, so a lost or repeated task leaves no torn shard.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    wide = encoder(path).wide
    n = parts(docs)
    bounds = np.array(quantiles(docs, "doc_id", n), np.int64)
    dtype = "<u4" if wide else "<u2"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                ids, counts = enc.encode(b.column("text"))
                out, offsets = with_end(ids, counts, end_id)
                out = out.astype(dtype)
                size = out.itemsize
                doc = b.column("doc_id").cast(pa.int64())
                shard = np.searchsorted(bounds, doc.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="right").astype(np.int32)
                binary = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer((offsets * size).astype(np.int64)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([doc, pa.array(shard), binary.cast(pa.binary())], names=["doc_id", "shard", "ids"])

    encoded = docs.select("doc_id", "text").mapInArrow(tidied(encode), "doc_id long, shard int, ids binary")
    dealt = encoded.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        name, shard, total, documents = uuid.uuid4().hex, -1, 0, 0
        out = index = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                shard = b.column("shard")[0].as_py()
                out, index = fs.open_output_stream(f"{root}/ids-{shard}-{name}.bin"), fs.open_output_stream(f"{root}/docs-{shard}-{name}.bin")
            lengths = np.array([len(x) for x in b.column("ids").to_pylist()], np.int64) // np.dtype(dtype).itemsize
            for x in b.column("ids"):
                out.write(x.as_buffer())
            record = np.empty((b.num_rows, 3), "<i8")
            record[:, 0] = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            record[:, 1] = pc.is_null(b.column("doc_id")).to_numpy(zero_copy_only=False)
            record[:, 2] = total + np.concatenate(([0], np.cumsum(lengths)[:-1]))
            index.write(record.tobytes())
            total, documents = total + int(lengths.sum()), documents + b.num_rows
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "documents": pa.array([documents], pa.int64()), "tokens": pa.array([total], pa.int64())})

    shards = stored(dealt.mapInArrow(tidied(write), "shard int, file string, documents long, tokens long"), "shards")
    rows = sorted(shards.collect())  # one row a partition
    base, manifest = 0, []
    for r in rows:
        manifest.append((r["shard"], r["file"], r["documents"], r["tokens"], base, np.dtype(dtype).itemsize))
        base += r["tokens"]
    out = spark.createDataFrame(manifest, "shard int, file string, documents long, tokens long, base long, width int")
    out.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(out.schema).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, block: int = 1 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document, from the shards in folder; ids as little-endian unsigned 32-bit integers.

    One task reads one shard through a memory map (a stream where the folder isn't local) and holds about block ids at once, or one document.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        for b in batches:
            for m in b.to_pylist():
                name = f"{m['shard']}-{m['file']}.bin"
                dtype = "<u4" if m["width"] == 4 else "<u2"
                if not m["documents"]:
                    continue
                if local:
                    record, ids = np.memmap(f"{root}/docs-{name}", "<i8", "r").reshape(-1, 3), np.memmap(f"{root}/ids-{name}", dtype, "r")
                    get = lambda a, z: ids[a:z]
                else:
                    file = fs.open_input_file(f"{root}/ids-{name}")
                    record = np.frombuffer(fs.open_input_file(f"{root}/docs-{name}").read(), "<i8").reshape(-1, 3)
                    get = lambda a, z: np.frombuffer(file.read_at((z - a) * m["width"], a * m["width"]), dtype)
                ends = np.concatenate((record[1:, 2], [m["tokens"]]))
                at = 0
                while at < len(record):
                    to = max(at + 1, int(np.searchsorted(ends, record[at, 2] + block)))
                    flat = np.ascontiguousarray(get(int(record[at, 2]), int(ends[to - 1])), "<u4")
                    starts = record[at:to, 2]
                    offsets = (np.concatenate((starts, ends[to - 1 : to])) - starts[0]) * 4
                    binary = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])
                    yield pa.RecordBatch.from_arrays([pa.array(record[at:to, 0], mask=record[at:to, 1] != 0), pa.array(starts + m["base"]), pa.array(ends[at:to] - starts), binary.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    at = to

    shards = max(1, manifest.count())
    return manifest.repartitionById(shards, F.pmod("shard", F.lit(shards))).mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids binary")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = scratch_path(spark, "token-files")
    write_token_files(docs, folder, end_id=0)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
