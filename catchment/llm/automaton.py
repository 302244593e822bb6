"""BPE encoding by a tokenization automaton, and decoding by its arcs' labels.

The automaton reads tokens and accepts exactly the sequences that BPE gives. It starts as one state with a loop for each atom (a byte, or
a byte that ends a word) and takes up the merges in their order, one gadget each. The gadget of (u, v) splits the state that u leads to:
u leads to a copy of it without its arc v, and wherever u is possible the new token uv is too, leading to where v led. All arcs of a token
lead to one state, so an arc is a cell of a table: states by tokens. States with the same arcs and tokens possible in the same states share their row
and column; both are copied on write.

A word is encoded along that table. Every prefix of it has one path, so its last token is found among the tokens that end there: the one whose
arc leaves the state of the prefix before. Words are walked side by side, a place at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .store import slices, tidied
from .tokens import WordTable

#: From this length on words are walked one by one.
LONG_WORD = 200
#: In word lists: a byte that no text has, before the number of an added token.
_MARK = 0xFF


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Grid:
    """Arcs by states and tokens, with shared rows and columns that are copied before they change."""

    def __init__(self):
        self.cells = np.ones((1, 1), bool)
        self.used = [{0: 1}, {0: 0}]  # numbers of users of each row and each column; the start state is a user of row 0
        self.free: list[list[int]] = [[], []]

    def _new(self, axis: int) -> int:
        if not self.free[axis]:
            old = self.cells.shape[axis]
            more = max(64, old // 4)
            shape = list(self.cells.shape)
            shape[axis] = more
            self.cells = np.concatenate((self.cells, np.zeros(shape, bool)), axis)
            self.free[axis] = list(range(old + more - 1, old - 1, -1))
        return self.free[axis].pop()

    def share(self, axis: int, i: int) -> int:
        self.used[axis][i] += 1
        return i

    def own(self, axis: int, i: int, keep: bool = False) -> int:
        """A line equal to i for one of its users alone; with keep, i stays though that was the last one."""
        if self.used[axis][i] == 1 and not keep:
            return i
        to = self._new(axis)
        if axis:
            self.cells[:, to] = self.cells[:, i]
        else:
            self.cells[to] = self.cells[i]
        self.used[axis][i] -= 1
        self.used[axis][to] = 1
        return to


class Automaton:
    """The compiled automaton of a tokenizers file: a BPE model over byte-level letters, with or without an ending of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("not a byte-level BPE model")
        vocab: dict[str, int] = model["vocab"]
        ending = model.get("end_of_word_suffix") or ""
        self.path, self.ends = path, bool(ending)
        cut = (file.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.in_bulk = [x["type"] for x in (file.get("normalizer") or {}).get("normalizers", [])] == BULK_NORMALIZERS and cut.get("pattern") == {"Regex": BULK_PATTERN}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"] if t["content"]}
        size = 1 + max([*vocab.values(), *self.added.values()])
        labels = [""] * size
        for text, i in [*vocab.items(), *self.added.items()]:
            labels[i] = text
        self._labels(labels)
        self._compile(vocab, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], ending, size)

    def _labels(self, labels: list[str]) -> None:
        raw = [x.encode() + b" " for x in labels]  # decoding joins labels with a space
        self.label_sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.label_starts = np.cumsum(self.label_sizes) - self.label_sizes
        self.label_bytes = np.frombuffer(b"".join(raw), np.uint8)

    def _compile(self, vocab: dict[str, int], merges: list[tuple[str, str]], ending: str, size: int) -> None:
        letters, grid = byte_letters(), Grid()
        row, col = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        spelled: dict[int, tuple[int, ...]] = {}  # reachable tokens as sequences of symbols
        for letter, b in letters.items():
            for text, symbol in ((letter, b), (letter + ending, 256 + b))[: 1 + bool(ending)]:
                if text in vocab:
                    i = vocab[text]
                    row[i], col[i], spelled[i] = grid.share(0, 0), grid.share(1, 0), (symbol,)
        seen = set()
        for left, right in merges:
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            if w in seen or w in spelled:
                raise ValueError(f"two ways to make {left + right}")
            seen.add(w)
            if u not in spelled or v not in spelled or not grid.cells[row[u], col[v]]:
                continue  # u is never followed by v once earlier merges are done
            after = int(row[v])
            col[v] = grid.own(1, int(col[v]))
            row[u] = grid.own(0, int(row[u]), keep=after == row[u])
            grid.cells[row[u], col[v]] = False
            row[w], col[w], spelled[w] = grid.share(0, after), grid.share(1, int(col[u])), spelled[u] + spelled[v]
        # only lines that are in use, packed to bits
        rows, row_at = np.unique(row[row >= 0], return_inverse=True)
        cols, col_at = np.unique(col[col >= 0], return_inverse=True)
        start = int(np.searchsorted(rows, 0))
        if start == len(rows) or rows[start] != 0:
            rows, start = np.append(rows, 0), len(rows)
        row[row >= 0], col[col >= 0] = row_at, col_at
        self.start = start
        self.arcs = np.concatenate([np.packbits(grid.cells[part][:, cols], axis=1, bitorder="little") for part in np.array_split(rows, max(1, len(rows) // 512))])
        self.row, self.col = row, col
        self._tree(spelled, size)

    def _tree(self, spelled: dict[int, tuple[int, ...]], size: int) -> None:
        """A tree of all tokens' symbols, as sorted keys node * 512 + symbol."""
        child: dict[int, int] = {}
        token = [-1]
        self.sizes = np.zeros(size, np.int64)
        for i, symbols in spelled.items():
            node = 0
            for s in symbols:
                key = node * 512 + s
                node = child.get(key)
                if node is None:
                    node = child[key] = len(token)
                    token.append(-1)
            token[node] = i
            self.sizes[i] = len(symbols)
        self.keys = np.array(sorted(child), np.int64)
        self.child = np.fromiter((child[k] for k in self.keys.tolist()), np.int32, len(child))
        self.token = np.array(token, np.int32)

    def _tokens_within(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens within words: where each starts, where it ends, and which it is; ends has the end of the word at each place."""
        at, node, depth = np.arange(len(symbols)), np.zeros(len(symbols), np.int64), 0
        starts, stops, found = [], [], []
        while len(at):
            key = node * 512 + symbols[at + depth]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            at, node = at[hit], self.child[k[hit]].astype(np.int64)
            depth += 1
            token = self.token[node]
            is_token = token >= 0
            starts.append(at[is_token])
            stops.append(at[is_token] + depth)
            found.append(token[is_token])
            more = at + depth < ends[at]
            at, node = at[more], node[more]
        return np.concatenate(starts), np.concatenate(stops), np.concatenate(found)

    def _symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(sizes)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        if self.ends:
            symbols[stop - 1] += 256
        return symbols, stop - sizes, stop

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of each word; words aren't empty."""
        out: list[list[int]] = [[]] * len(words)
        short = [i for i, w in enumerate(words) if len(w) < LONG_WORD]
        short.sort(key=lambda i: len(words[i]))
        for a in range(0, len(short), 4096):
            part = short[a : a + 4096]
            for i, tokens in zip(part, self._side_by_side([words[i] for i in part])):
                out[i] = tokens
        for i, w in enumerate(words):
            if len(w) >= LONG_WORD:
                out[i] = self._alone(w)
        return out

    def _side_by_side(self, words: list[bytes]) -> list[list[int]]:
        symbols, begin, stop = self._symbols(words)
        n = stop - begin
        word = np.repeat(np.arange(len(words)), n)
        a, z, token = self._tokens_within(symbols, stop[word])
        place = z - begin[word[a]]
        order = np.argsort(place.astype(np.int16), kind="stable")
        a, z, token = a[order] + word[a[order]], z[order] + word[a[order]], token[order]  # one place more for each word: its start
        bounds = np.searchsorted(place[order], np.arange(1, int(n.max()) + 2))
        state, last = np.full(len(symbols) + len(words), -1, np.int32), np.zeros(len(symbols) + len(words), np.int32)
        first = begin + np.arange(len(words))
        state[first] = self.start
        col, row = self.col[token], self.row[token]
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            here, c = state[a[i:j]], col[i:j]
            ok = np.flatnonzero((here >= 0) & (self.arcs[here, c >> 3] >> (c & 7) & 1 > 0)) + i
            state[z[ok]], last[z[ok]] = row[ok], token[ok]
        # back from the ends, the words' last tokens first
        who, at, taken, whose = np.arange(len(words)), first + n, [], []
        while len(who):
            t = last[at]
            taken.append(t)
            whose.append(who)
            at = at - self.sizes[t]
            on = at > first[who]
            who, at = who[on], at[on]
        taken, whose = np.concatenate(taken[::-1]), np.concatenate(whose[::-1])
        flat = taken[np.argsort(whose, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(whose, minlength=len(words))).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends)]

    def _alone(self, word: bytes) -> list[int]:
        symbols, _, stop = self._symbols([word])
        a, z, token = self._tokens_within(symbols, np.full(len(symbols), stop[0]))
        order = np.argsort(z, kind="stable")
        arcs, width = memoryview(self.arcs.reshape(-1)), self.arcs.shape[1]
        state, last = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        state[0] = self.start
        t = token[order]
        for i, j, k, c, r in zip(a[order].tolist(), z[order].tolist(), t.tolist(), self.col[t].tolist(), self.row[t].tolist()):
            if state[i] >= 0 and arcs[state[i] * width + (c >> 3)] >> (c & 7) & 1:
                state[j], last[j] = r, k
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= int(self.sizes[last[at]])
        return out[::-1]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts end to end, and their offsets: the labels of each one's arcs, joined with a space. ids must be known ones."""
        size = self.label_sizes[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        data = self.label_bytes[np.repeat(self.label_starts[ids] - end + size, size) + np.arange(total)]
        bounds = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(counts)))]
        full = np.diff(bounds) > 0
        keep = np.ones(total, bool)
        keep[bounds[1:][full] - 1] = False  # the space after a text's last label
        return data[keep], np.concatenate(([0], np.cumsum(np.diff(bounds) - full)))


#: The pattern and normalizers for which cut_words and lowered hold.
BULK_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BULK_NORMALIZERS = ["NFC", "Replace", "Lowercase"]

#: Classes of bytes of plain text: white space, letters, digits, other signs, and bytes that plain text lacks.
_WHITE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Classes of single bytes, and for each pair of bytes that is a letter U+00C0-U+017F the pair of its lower case (0: none, not plain)."""
    cls = np.full(256, _ODD, np.uint8)
    cls[0x21:0x7F] = _OTHER
    cls[[0x09, 0x0A, 0x0D, 0x20]] = _WHITE
    cls[0x30:0x3A] = _DIGIT
    cls[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = _LETTER
    lower = np.zeros(1 << 16, np.uint16)
    for c in map(chr, range(0xC0, 0x180)):
        low = c.lower().encode()
        if c.isalpha() and len(low) == 2:
            lower[int.from_bytes(c.encode(), "big")] = int.from_bytes(low, "big")
    return cls, lower


_CLASS, _LOWER_PAIR = _tables()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lowered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case of the bytes, and which texts are plain: ASCII without control characters, and letters up to U+017F whose lower case is such a letter."""
    low = _LOWER[data]
    odd = _CLASS[data] == _ODD
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    pair = _LOWER_PAIR[data[lead].astype(np.int64) << 8 | data[np.minimum(lead + 1, len(data) - 1)]]
    odd[lead] |= pair == 0
    good = pair > 0
    low[lead[good]], low[lead[good] + 1] = pair[good] >> 8, pair[good] & 255
    return low, np.diff(np.searchsorted(np.flatnonzero(odd), offsets)) == 0


def cut_words(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plain lowered texts without their white space: bytes, offsets, and starts of the words. A word is one of 's 't 're 've 'm 'll 'd, a run of letters, a digit, or a run of other signs."""
    n, cls = len(low), _CLASS[low]
    start = np.zeros(n + 1, bool)
    start[offsets] = True
    start[1:n] |= cls[1:] != cls[:-1]
    start[:n] |= cls == _DIGIT
    q = np.flatnonzero(start[:n] & (low == 0x27))
    end = offsets[np.searchsorted(offsets, q, side="right")]
    get = lambda k: np.where(q + k < end, low[np.minimum(q + k, n - 1)], 0)
    x, y = get(1), get(2)
    one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
    two = ((x == 0x72) | (x == 0x76)) & (y == 0x65) | (x == 0x6C) & (y == 0x6C)
    q, size = q[one | two], np.where(one, 2, 3)[one | two]
    start[q + 1] = False
    start[q + size] = True  # a text's end, white space, or where the next word starts
    solid = cls != _WHITE
    kept = np.concatenate(([0], np.cumsum(solid)))
    return low[solid], kept[offsets], kept[np.flatnonzero(start[:n] & solid)]


class AutomatonEncoder(WordTable):
    """Whole texts to ids: words as the tokenizer's own normalizer and pre-tokenizer cut them, each distinct word walked through the automaton once.

    Plain texts are cut in bulk if the file's pattern is BULK_PATTERN, others by the tokenizers library; added tokens' strings stand for their ids, as in that library.
    """

    def __init__(self, automaton: Automaton):
        from tokenizers import Tokenizer

        self.automaton = automaton
        self.tokenizer = Tokenizer.from_file(automaton.path)
        self.spelling = {ord(c): chr(b) for c, b in byte_letters().items()}
        super().__init__()

    def word_ids(self, words: list[bytes]) -> list[list[int]]:
        marked = {i: int(w[1:]) for i, w in enumerate(words) if w[0] == _MARK}
        walked = iter(self.automaton.encode([w for i, w in enumerate(words) if i not in marked] if marked else words))
        return [[marked[i]] if i in marked else next(walked) for i in range(len(words))]

    def words_of(self, text: str) -> list[bytes]:
        """Words by the library, added tokens as marks."""
        out: list[bytes] = []
        while text:
            first = min(((at, -len(s), s) for s in self.automaton.added if (at := text.find(s)) >= 0), default=None)
            part = text if first is None else text[: first[0]]
            if part:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                out += [word.translate(self.spelling).encode("latin-1") for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
            if first is None:
                break
            out.append(bytes([_MARK]) + str(self.automaton.added[first[2]]).encode())
            text = text[first[0] + len(first[2]) :]
        return out

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts cut by the library. Long ones have a table of their own words: nothing is held that a word's hash could confuse."""
        words = [self.words_of(t) for t in texts]
        known = list(dict.fromkeys(w for ws in words for w in ws))
        ids = dict(zip(known, self.word_ids(known)))
        flat = [[i for w in ws for i in ids[w]] for ws in words]
        return np.fromiter((i for f in flat for i in f), np.uint32, sum(map(len, flat))), np.fromiter(map(len, flat), np.int64, len(flat))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and each text's number of ids. A null is an empty text."""
        data, offsets = kernels.buffers(texts)
        low, plain = lowered(data, offsets)
        plain &= self.automaton.in_bulk
        for token in self.automaton.added:
            plain &= ~pc.match_substring(texts, token).fill_null(False).to_numpy(zero_copy_only=False)
        if not plain.all():
            low, offsets = _rows(low, offsets, plain)
        ids, counts, wrong = self.looked_up(*cut_words(low, offsets))
        if plain.all() and not wrong.any():
            return ids, counts
        bounds = np.concatenate(([0], np.cumsum(counts)))
        own = np.full(len(plain), -1)
        own[plain] = np.where(wrong, -1, np.arange(len(counts)))
        rest, rest_counts = self._by_library(texts.filter(pa.array(own < 0)).fill_null("").to_pylist())
        rest_bounds = iter(np.split(rest, np.cumsum(rest_counts)[:-1]))
        pieces = [ids[bounds[k] : bounds[k + 1]] if k >= 0 else next(rest_bounds) for k in own.tolist()]
        return np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))


def _rows(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(offsets)
    return data[np.repeat(keep, sizes)], np.concatenate(([0], np.cumsum(sizes[keep])))


_encoders: dict[str, AutomatonEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def compiled(spark: SparkSession, path: str | None = None):
    """The automaton of a tokenizers file, compiled once in the driver and broadcast: its size is that of the vocabulary (about 20 MB for 49,000 merges)."""
    return spark.sparkContext.broadcast(Automaton(path or default_tokenizer()))


def _encoder(shared) -> AutomatonEncoder:
    """One a process and file."""
    path = shared.value.path
    if path not in _encoders:
        _encoders[path] = AutomatonEncoder(shared.value)
    return _encoders[path]


def _binary(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    large = pa.large_binary() if kind == pa.binary() else pa.large_string()
    return pa.Array.from_buffers(large, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(flat)]).cast(kind)


def encode(docs: DataFrame, automaton) -> DataFrame:
    """(doc_id, ids) of docs(doc_id, text), a row each: ids as little-endian unsigned 32-bit integers. A null or empty text has none; equal rows are encoded alike. automaton comes from `compiled`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(automaton)
        for whole in batches:
            for b in slices(whole, "text"):
                ids, counts = enc.encode(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), _binary(ids.astype("<u4"), 4 * np.concatenate(([0], np.cumsum(counts))), pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, ids binary")


def decode(encoded: DataFrame, automaton) -> DataFrame:
    """(doc_id, text) of encoded(doc_id, ids): the labels of the ids, joined with a space. No ids or null: an empty text. An id beyond the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "ids", 1 << 19):
                raw = b.column("ids").fill_null(b"").to_pylist()
                ids = np.frombuffer(b"".join(raw), "<u4")
                if len(ids) and ids.max() >= len(automaton.value.label_sizes):
                    raise ValueError("an id beyond the vocabulary")
                data, offsets = automaton.value.decode(ids, np.fromiter(map(len, raw), np.int64, len(raw)) // 4)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), _binary(data, offsets, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(tidied(run), "doc_id long, text string")


def round_trip_digests(docs: DataFrame, automaton) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of docs(doc_id, text): digests of what encode gives and of what decode makes of it, without storing either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(automaton)
        for whole in batches:
            for b in slices(whole, "text"):
                ids, counts = enc.encode(b.column("text"))
                data, offsets = enc.automaton.decode(ids, counts)
                bounds = np.concatenate(([0], np.cumsum(counts))).tolist()
                raw, text, cuts = memoryview(ids.astype("<u4")).cast("B"), memoryview(data), offsets.tolist()
                digests = [hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(bounds, bounds[1:])], [hashlib.sha256(text[i:j]).hexdigest() for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts), *map(pa.array, digests)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip_digests(docs, compiled(spark))
