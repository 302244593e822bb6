"""Vectorised text kernels on Arrow string buffers: words, shingles and lines as 64-bit hashes.

All of them take whole texts; a null counts as an empty text. Hashes are polynomial prefix sums modulo two primes, 62 bits together, that a
multiply-and-shift mixer finishes, so that any span of bytes is hashed in constant time. (Modulo a power of two, texts like Thue-Morse words would collide.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Moduli and bases of the two polynomials. Primes below 2**31 keep every product within 64 bits.
_PRIMES = (2147483647, 2147483629)
_BASES = (1640531527, 1181783497)
_INVERSES = tuple(pow(b, -1, p) for b, p in zip(_BASES, _PRIMES))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {}


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo prime, kept between calls and doubled as texts get longer."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        got = np.empty(size, U)
        got[0], done, step = 1, 1, base
        while done < size:
            got[done : 2 * done] = got[:done] * U(step) % U(prime)
            done, step = 2 * done, step * step % prime
        if size <= 1 << 21:
            _powers[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(32)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and each text's start with the end of the last."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.empty(0, np.uint8)
    return d, o - o[0]


def prefix(codes: np.ndarray) -> np.ndarray:
    """Two rows of prefix sums P with P[i] = sum of (codes[j] + 1) * base**j over j < i, for each prime; sums aren't reduced, their differences are."""
    n = len(codes)
    out = np.zeros((len(_PRIMES), n + 1), U)
    plus = codes.astype(U) + U(1)
    small = codes.itemsize == 1 and n <= 1 << 23  # else the sum of n products could pass 64 bits
    for row, base, prime in zip(out, _BASES, _PRIMES):
        terms = plus * powers(base, prime, n)
        np.cumsum(terms if small else terms % U(prime), out=row[1:])
    return out


def spans(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed 62-bit hash of each span [start, end) under prefix sums p; depends on the span's content alone."""
    out = np.zeros(len(start), U)
    for row, inverse, prime in zip(p, _INVERSES, _PRIMES):
        part = (row[end] - row[start]) % U(prime)
        out = out << U(31) | part * powers(inverse, prime, p.shape[1])[start] % U(prime)
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, owners (row numbers) of the runs of non-space bytes, and the lowered bytes."""
    n = len(data)
    low = _LOWER[data] if lower else data
    solid = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first[n] = True
    first = first[: n + 1]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = True
        before[1:] = ~solid[:-1] | first[1:n]
        after[-1] = True
        after[:-1] = ~solid[1:] | first[1:n]
    start = np.flatnonzero(solid & before)
    end = np.flatnonzero(solid & after) + 1
    counts = np.diff(np.searchsorted(start, offsets))
    return start, end, np.repeat(np.arange(len(offsets) - 1), counts), low


def distinct(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, hash) pairs, in that order; owner must not decrease."""
    if not len(h):
        return owner, h
    out, own = [], []
    cut = np.flatnonzero(np.diff(owner)) + 1
    bounds = np.concatenate(([0], cut, [len(h)]))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        x = np.unique(h[a:b])
        out.append(x)
        own.append(np.full(len(x), owner[a]))
    return np.concatenate(own), np.concatenate(out)


def shingles(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of width words as (row, hash), sorted; a shorter text's words are one shingle; no words: none."""
    data, offsets = buffers(texts)
    start, end, owner, low = words(data, offsets)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, U)
    h = mix(spans(prefix(low), start, end))
    n, rows = len(h), len(offsets) - 1
    counts = np.bincount(owner, minlength=rows)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    salt = [U((0xD6E8FEB86659FD93 * (2 * t + 3)) % (1 << 64) | 1) for t in range(width)]
    full = np.zeros(n, U)
    for t in range(min(width, n)):
        full[: n - t] += h[t:] * salt[t]
    at = np.arange(n)
    left = (first + counts)[owner] - at
    keep = left >= width
    short = np.flatnonzero((counts > 0) & (counts < width))
    s_hash = np.zeros(len(short), U)
    for t in range(width):
        has = counts[short] > t
        s_hash[has] += h[first[short[has]] + t] * salt[t]
    s_hash += counts[short].astype(U) * U(0x632BE59BD9B4E019)
    own = np.concatenate((owner[keep], short))
    out = mix(np.concatenate((full[keep], s_hash)))
    order = np.argsort(own, kind="stable")
    return distinct(own[order], out[order])


def line_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every line of every text, split at \\n: owner, byte start, byte end (raw line), and the hash of its key, 0 if the key is empty.

    The key is the line without [\\x20\\x09-\\x0D] at both ends, with A-Z lowered.
    """
    data, offsets = buffers(texts)
    rows, n = len(offsets) - 1, len(data)
    breaks = np.flatnonzero(data == 10)
    counts = np.diff(np.searchsorted(breaks, offsets)) + 1
    owner = np.repeat(np.arange(rows), counts)
    # offsets and breaks interleave: a line starts at its text's start or after a break of the same text
    firsts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    is_first = np.zeros(len(owner), bool)
    is_first[firsts] = True
    start = np.empty(len(owner), np.int64)
    start[is_first] = offsets[:-1]
    start[~is_first] = breaks + 1
    is_last = np.zeros(len(owner), bool)
    is_last[firsts + counts - 1] = True
    end = np.empty(len(owner), np.int64)
    end[is_last] = offsets[1:]
    end[~is_last] = breaks
    solid = np.flatnonzero(~SPACE[data]) if n else np.empty(0, np.int64)
    a = np.searchsorted(solid, start)
    b = np.searchsorted(solid, end)
    full = b > a
    h = np.zeros(len(owner), U)
    if full.any():
        p = prefix(_LOWER[data])
        h[full] = mix(spans(p, solid[a[full]], solid[b[full] - 1] + 1))
        h[full & (h == 0)] = U(1)
    return owner, start, end, h


def minhash(owner: np.ndarray, h: np.ndarray, rows: int, k: int, seed: int = 1) -> np.ndarray:
    """k 32-bit minima for each row that has hashes (others: all ones); owner must not decrease."""
    out = np.full((rows, k), 0xFFFFFFFF, np.uint32)
    if not len(h):
        return out
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(0, 1 << 63, k, dtype=np.uint64) * U(2) + U(1)
    b = rng.integers(0, 1 << 63, k, dtype=np.uint64)
    step = 1 << 15
    cut = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
    who = owner[cut]
    best = np.full((len(who), k), 0xFFFFFFFF, np.uint32)
    # whole rows at a time, about step hashes, so that the work arrays stay in cache
    at = 0
    ends = np.concatenate((cut[1:], [len(h)]))
    while at < len(who):
        to = max(at + 1, int(np.searchsorted(ends, cut[at] + step)))
        x, inner = h[cut[at] : ends[to - 1]], cut[at:to] - cut[at]
        for j in range(k):
            best[at:to, j] = np.minimum.reduceat(((x * a[j] + b[j]) >> U(32)).astype(np.uint32), inner)
        at = to
    out[who] = best
    return out
