"""Media columns: signature sniffing, format validation, corrected types and carved embedded media; lossless storage of bytes as 8-bit samples.

One Aho-Corasick automaton finds the magic bytes of all formats in a single scan. At each hit the format's validator walks its structure and gives the length that the
structure itself states, or rejects the hit. A valid format at byte 0 is the column's true type; valid ones further on are embedded media and are carved.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import scratch_path, slices, tidied

#: Samples of one frame of the stored form, and the byte that fills the last frame.
FRAME, FILL = 576, 255
RATE = 8000


def wav_of(payload: bytes) -> bytes:
    """A RIFF/WAVE file with the payload as 8-bit mono samples."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def _riff_chunks(data: bytes, at: int, end: int) -> dict[bytes, tuple[int, int]] | None:
    """First place and size of each chunk; None if the chunks don't fill the form exactly."""
    out: dict[bytes, tuple[int, int]] = {}
    p = at + 12
    while p + 8 <= end:
        name, n = data[p : p + 4], struct.unpack_from("<I", data, p + 4)[0]
        if p + 8 + n > end:
            return None
        out.setdefault(name, (p + 8, n))
        p += 8 + n + n % 2
    return out if p == end else None


def samples_of(wav: bytes) -> bytes:
    """The samples of an 8-bit mono file made by wav_of."""
    chunks = _riff_chunks(wav, 0, 8 + struct.unpack_from("<I", wav, 4)[0])
    at, n = chunks[b"data"]
    return wav[at : at + n]


def _riff(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    if at + 12 > len(data):
        return None
    n = 8 + struct.unpack_from("<I", data, at + 4)[0]
    form = data[at + 8 : at + 12]
    if at + n > len(data) or form not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    chunks = _riff_chunks(data, at, at + n)
    if chunks is None or form == b"WAVE" and not (chunks.get(b"fmt ", (0, 0))[1] >= 16 and b"data" in chunks):
        return None
    return {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}[form], n


def _png(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    p, first, walk = at + 8, True, places.walk("png chunk")
    while p + 12 <= len(data):
        n, name = struct.unpack_from(">I", data, p)[0], data[p + 4 : p + 8]
        if p + 12 + n > len(data) or first and (name != b"IHDR" or n != 13) or not first and walk.fails(p):
            break
        if zlib.crc32(memoryview(data)[p + 4 : p + 8 + n]) != struct.unpack_from(">I", data, p + 8 + n)[0]:
            break
        p, first = p + 12 + n, False
        if name == b"IEND":
            return "image/png", p - at
    walk.fail()
    return None


def _jpeg(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    p, frame, walks = at + 2, False, [places.walk("jpeg"), places.walk("jpeg with a frame")]
    if found := _jpeg_end(data, p, frame, walks):
        return "image/jpeg", found - at
    for w in walks:
        w.fail()
    return None


def _jpeg_end(data: bytes, p: int, frame: bool, walks: list[Walk]) -> int | None:
    while p + 4 <= len(data) and data[p] == 0xFF and not walks[frame].fails(p):
        mark = data[p + 1]
        if mark == 0xFF:
            p += 1
            continue
        n = struct.unpack_from(">H", data, p + 2)[0]
        if mark in (0xD8, 0xD9, 0x00) or n < 2:
            return None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if mark == 0xDA:  # coded data: to the next marker that isn't a stuffed byte or a restart
            while True:
                p = data.find(b"\xff", p)
                if p < 0 or p + 1 >= len(data):
                    return None
                if data[p + 1] == 0 or 0xD0 <= data[p + 1] <= 0xD7:
                    p += 2
                    continue
                break
            if data[p + 1] == 0xD9:
                return p + 2 if frame else None
    return None


def _gif(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    if at + 13 > len(data) or data[at + 3 : at + 6] not in (b"87a", b"89a"):
        return None
    flags = data[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    walk, inner = places.walk("gif part"), places.walk("gif block")

    def blocks(p: int) -> int:
        while p < len(data) and not inner.fails(p):
            n = data[p]
            p += 1 + n
            if not n:
                return p
        return -1

    while 0 <= p < len(data) and not walk.fails(p):
        kind = data[p]
        if kind == 0x3B:
            return "image/gif", p + 1 - at
        if kind == 0x21:
            p = blocks(p + 2)
        elif kind == 0x2C and p + 10 <= len(data):
            local = data[p + 9]
            p = blocks(p + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
        else:
            break
    walk.fail()
    inner.fail()
    return None


def _bmp(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    if at + 54 > len(data):
        return None
    size, zero, offset, head = struct.unpack_from("<IIII", data, at + 2)
    planes, depth = struct.unpack_from("<HH", data, at + 26)
    ok = zero == 0 and head in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + head <= offset <= size and at + size <= len(data)
    return ("image/bmp", size) if ok else None


def _gzip(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    """By inflating it, in slices of the input and of the output; a stream's state isn't shared with others, so each header's own stream is read."""
    d, view, p = zlib.decompressobj(31), memoryview(data), at
    try:
        while not d.eof and p < len(data):
            part = view[p : p + (1 << 14)]
            p += len(part)
            d.decompress(part, 1 << 16)
            while not d.eof and d.unconsumed_tail:
                d.decompress(d.unconsumed_tail, 1 << 16)
    except zlib.error:
        return None
    return ("application/gzip", p - at - len(d.unused_data)) if d.eof else None


class Walk:
    """Places that one walk has come to in one state."""

    def __init__(self, failed: bytearray):
        self.failed, self.here = failed, []

    def fails(self, p: int) -> bool:
        """Whether a walk is known to fail from p; notes that this one has come there."""
        self.here.append(p)
        return bool(self.failed[p >> 3] >> (p & 7) & 1)

    def fail(self) -> None:
        for p in self.here:
            self.failed[p >> 3] |= 1 << (p & 7)


class Places:
    """Where markers lie in data, found once each, and places from which walks along a format's parts have failed.

    What follows from a place depends on it and the walk's state alone, so a walk that comes to such a place in the same state fails as well: chains of parts are walked once, however many headers lead into them.
    """

    def __init__(self, data: bytes):
        self.data, self.found, self.failed = data, {}, {}

    def walk(self, state: str) -> Walk:
        return Walk(self.failed.setdefault(state, bytearray((len(self.data) >> 3) + 1)))

    def next(self, marker: bytes, at: int) -> int:
        """The first place from at on, or -1."""
        if marker not in self.found:
            self.found[marker] = [m.start() for m in re.finditer(re.escape(marker), self.data)]
        places = self.found[marker]
        i = bisect.bisect_left(places, at)
        return places[i] if i < len(places) else -1


def _zip(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    end = places.next(b"PK\5\6", at)
    if end < 0 or end + 22 > len(data):
        return None
    size, start, comment = struct.unpack_from("<IIH", data, end + 12)
    stop = end + 22 + comment
    if at + start + size != end or stop > len(data) or size and data[at + start : at + start + 4] != b"PK\1\2":
        return None
    return "application/zip", stop - at


def _pdf(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    end = places.next(b"%%EOF", at)
    if end < 0 or not at <= places.next(b"startxref", at) < end:
        return None
    return "application/pdf", end + 5 - at


def _flac(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    """Only as the whole value: frames state no length, so none could be carved."""
    if at:
        return None
    p, last, first = at + 4, False, True
    while not last:
        if p + 4 > len(data):
            return None
        last, kind, n = bool(data[p] & 0x80), data[p] & 0x7F, int.from_bytes(data[p + 1 : p + 4], "big")
        if first and (kind != 0 or n != 34) or kind == 127 or p + 4 + n > len(data):
            return None
        p, first = p + 4 + n, False
    return "audio/flac", len(data)


def _ogg(data: bytes, at: int, places: Places) -> tuple[str, int] | None:
    p, walk = at, places.walk("ogg page")
    while p + 27 <= len(data) and data[p : p + 5] == b"OggS\0" and not walk.fails(p):
        n = data[p + 26]
        if p + 27 + n > len(data):
            break
        size = 27 + n + sum(data[p + 27 : p + 27 + n])
        last = data[p + 5] & 4
        p += size
        if p > len(data):
            break
        if last:
            return "audio/ogg", p - at
    walk.fail()
    return None


#: Magic bytes and validators. Fixed values of the formats.
FORMATS: list[tuple[bytes, Callable[[bytes, int, Places], tuple[str, int] | None]]] = [
    (b"\x89PNG\r\n\x1a\n", _png),
    (b"\xff\xd8\xff", _jpeg),
    (b"GIF8", _gif),
    (b"RIFF", _riff),
    (b"BM", _bmp),
    (b"\x1f\x8b\x08", _gzip),
    (b"PK\3\4", _zip),
    (b"%PDF-", _pdf),
    (b"fLaC", _flac),
    (b"OggS", _ogg),
]

_automaton = None


def magic_hits(data: bytes) -> list[tuple[int, int]]:
    """(place, format number) of all magic bytes, in order of place."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for i, (magic, _) in enumerate(FORMATS):
            made.add_word(magic.decode("latin-1"), (i, len(magic)))
        made.make_automaton()
        _automaton = made
    return sorted((end + 1 - n, i) for end, (i, n) in _automaton.iter(data.decode("latin-1")))


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(start, length, type) of every valid format in data that doesn't lie within an earlier carved one of the same level.

    The one at 0, if any, is first; media embedded in it are listed after it. Among embedded ones, the earliest start wins and what lies within it isn't listed.
    """
    out, end, places = [], 0, Places(data)
    for at, i in magic_hits(data):
        if at and at < end:
            continue
        if found := FORMATS[i][1](data, at, places):
            out.append((at, found[1], found[0]))
            if at:
                end = at + found[1]
    return out


def media_column(df: DataFrame, column: str, declared: str) -> DataFrame:
    """df with true_type, true_length, type_corrected and embedded for a binary column and the column of its declared type.

    true_type is the type that the bytes at 0 prove, else text/plain for valid UTF-8 without control characters other than white space, else application/octet-stream;
    true_length is the length its structure states (all bytes for the last two). type_corrected says that the declared type differs (a null one always does). embedded lists
    start, length, type and content of carved media. A null value is an empty one and of type application/x-empty. The four columns follow those of df, which may have
    any names.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("content", pa.binary())]))
    columns = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(columns))])
    value, told = f"c{columns.index(column)}", f"c{columns.index(declared)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, value):
                types, lengths, inner = [], [], []
                for held in b.column(value):
                    data = held.as_py() or b""
                    found = sniff(data)
                    types.append(found[0][2] if found and not found[0][0] else _plain_type(data))
                    lengths.append(found[0][1] if found and not found[0][0] else len(data))
                    inner.append([{"start": a, "length": n, "type": t, "content": data[a : a + n]} for a, n, t in found if a])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(types, pa.string()), pa.array(lengths, pa.int64()), pa.array(inner, kind)], names=[*b.schema.names, "true_type", "true_length", "embedded"])

    schema = ", ".join([f"{n} {t}" for n, t in flat.dtypes] + ["true_type string", "true_length long", "embedded array<struct<start:long,length:long,type:string,content:binary>>"])
    out = flat.mapInArrow(tidied(run), schema).withColumn("type_corrected", ~F.col("true_type").eqNullSafe(F.col(told)))
    return out.toDF(*columns, "true_type", "true_length", "embedded", "type_corrected")


def _plain_type(data: bytes) -> str:
    if not data:
        return "application/x-empty"
    try:
        data.decode()
    except UnicodeDecodeError:
        return "application/octet-stream"
    return "application/octet-stream" if any(c in data for c in _CONTROL) else "text/plain"


_CONTROL = [bytes([c]) for c in range(32) if c not in (9, 10, 11, 12, 13)]


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes([FILL]) * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def store_texts(docs: DataFrame, path: str) -> DataFrame:
    """Write a media table of docs(doc_id, text) to path: doc_id, n_bytes, declared (the type that the source states) and media, each text as a sound file. Read back. A null text is an empty one; equal rows have rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                texts = b.column("text").fill_null("").to_pylist()
                media = [wav_of(payload_of(t)) for t in texts]
                sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, pa.array(["text/plain"] * len(texts)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, n_bytes long, declared string, media binary")
    table.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(table.schema).parquet(path)


def sample_features(payload: bytes) -> str:
    """Length, mean, spread, roughness and byte entropy of 8-bit samples, and energies of eight equal stretches."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    mean = float((counts * np.arange(256)).sum() / len(x))
    square = float((counts * np.arange(256) ** 2).sum() / len(x))
    rough = float(np.abs(np.diff(x.astype(np.int16))).mean())
    cut = np.linspace(0, len(x), 9).astype(np.int64)
    energy = np.add.reduceat((x.astype(np.int64) - 128) ** 2, cut[:-1]) / np.diff(cut)
    return f"n={len(x)};mean={mean:.4f};sd={max(square - mean * mean, 0) ** 0.5:.4f};rough={rough:.4f};bits={float(-(p * np.log2(p)).sum()):.4f};energy=" + ",".join(f"{e:.1f}" for e in energy)


def decoded(media: DataFrame) -> DataFrame:
    """media with payload and feature read from the stored bytes of its audio/wav rows (others, and null values: null). A row each, equal ones alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "media"):
                payloads = [samples_of(m) if t == "audio/wav" else None for m, t in zip(b.column("media").to_pylist(), b.column("true_type").to_pylist())]
                features = [sample_features(p) if p else None for p in payloads]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(payloads, pa.binary()), pa.array(features, pa.string())], names=[*b.schema.names, "payload", "sample_feature"])

    return media.mapInArrow(tidied(run), ", ".join([f"`{n}` {t}" for n, t in media.dtypes] + ["payload binary", "sample_feature string"]))


def op6_digest(docs: DataFrame, path: str) -> DataFrame:
    """Digests and features of docs(doc_id, text), stored at path as a media table and read back: a row each, with equal values for equal texts. A null text is an empty one; no rows give none."""
    media = media_column(store_texts(docs, path), "media", "declared").drop("type_corrected")
    out = decoded(media.withColumn("n_embedded", F.size("embedded")).drop("embedded", "declared"))
    return out.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 31, 32)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", "true_type", F.concat(F.lit("embedded="), F.col("n_embedded")), "sample_feature").alias("feature"),
    )


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), scratch_path(spark, "media"))
