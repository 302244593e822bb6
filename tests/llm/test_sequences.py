"""Token alignment, periodic runs and the tokenization automaton against the libraries and brute force, on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from catchment.llm import alignment, automaton, entries, runs

from .test_operators import SCHEMA, TEXTS

MORE = [
    "İstanbul Ÿ ŉ œuvre ﬁ Ǆ", "é Å", "aaaa aaaa aaaa " + "abab" * 300, "\x00\x01", "ab" * 5000 + "日本" * 1000, "<|startoftext|><|endoftext|>", "a▁b ▁", "a \n b  \n\n  c", " ", "\n", "''s --'s 'St 's5 'll 're",
    "a b " * 5, "x x x x x x y y y y y y x x x x x x", "x\x0bx\x0cx\rx\tx\nx x", "ab aba b " * 9 + "ab",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    alphabet = "aéZß09 _-.,'\n\t  stlrvmdhe×日œŒÿŸİi̇́▁<|"
    out = TEXTS + MORE + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for _ in range(300):
        some = [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        out.append(" ".join(some + some[: rng.randint(0, 4)] * rng.randint(0, 9)))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "no id here at all " * 3, "en", "a", 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- the automaton


@pytest.fixture(scope="module")
def words_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(automaton.default_tokenizer())


def test_automaton_equals_the_library(spark, docs, empty, words_library):
    shared = automaton.compiled(spark)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {k: words_library.encode(t or "", add_special_tokens=False).ids for k, t in text.items()}
    encoded = automaton.encode(docs, shared)
    got = encoded.collect()
    assert len(got) == docs.count()
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]] for r in got)
    back = automaton.decode(encoded, shared).collect()
    assert all(r["text"] == words_library.decode(want[r["doc_id"]], skip_special_tokens=False) for r in back)
    for r in automaton.round_trip_digests(docs, shared).collect():
        ids = want[r["doc_id"]]
        decoded = words_library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert automaton.encode(empty, shared).count() == automaton.decode(automaton.encode(empty, shared), shared).count() == automaton.round_trip_digests(empty, shared).count() == 0


def test_decoding_of_no_ids_and_of_unknown_ids(spark):
    shared = automaton.compiled(spark)
    rows = spark.createDataFrame([(1, None), (2, bytearray())], "doc_id long, ids binary")
    assert [r["text"] for r in automaton.decode(rows, shared).collect()] == ["", ""]
    bad = spark.createDataFrame([(1, bytearray(np.array([49408], "<u4").tobytes()))], "doc_id long, ids binary")
    with pytest.raises(Exception, match="beyond the vocabulary"):
        automaton.decode(bad, shared).collect()


def test_automaton_without_word_ends():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlué") for _ in range(rng.randint(1, 300))) for _ in range(800)]
    assert automaton.Automaton(path).encode([w.encode() for w in words]) == [e.ids for e in library.encode_batch_fast(words)]


def small_file(tmp_path, merges):
    import json

    atoms = [c + e for c in "abc" for e in ("", "</w>")]
    vocab = {t: i for i, t in enumerate([*atoms, *dict.fromkeys(a + b for a, b in merges)])}
    file = {"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "decoder": None, "post_processor": None, "truncation": None, "padding": None}
    file["model"] = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": merges}
    path = tmp_path / f"{abs(hash(str(merges)))}.json"
    path.write_text(json.dumps(file))
    return str(path)


def test_automaton_of_random_merges(tmp_path):
    """Overlapping merges of one letter, merges that never apply, long words."""
    from tokenizers import Tokenizer

    rng = random.Random(4)
    for _ in range(60):
        parts, merges = ["a", "b", "c", "a</w>", "b</w>", "c</w>"], []
        for _ in range(rng.randint(0, 12)):
            left, right = rng.choice([p for p in parts if "<" not in p]), rng.choice(parts)
            if left + right not in parts:
                merges.append([left, right])
                parts.append(left + right)
        path = small_file(tmp_path, merges)
        library, own = Tokenizer.from_file(path), automaton.Automaton(path)
        words = ["".join(rng.choice("aabc") for _ in range(n)) for n in [*range(1, 40), 199, 200, 450]]
        assert own.encode([w.encode() for w in words]) == [library.encode(w).ids for w in words], merges


# --- runs


def all_runs(words, min_length, min_exponent):
    out, n = [], len(words)
    for p in range(1, n // 2 + 1):
        k = 0
        while k < n - p:
            if words[k] != words[k + p]:
                k += 1
                continue
            j = k
            while j < n - p and words[j] == words[j + p]:
                j += 1
            length, part = j - k + p, words[k : j + p]
            smallest = not any(all(part[x] == part[x + q] for x in range(length - q)) for q in range(1, p))
            if length >= max(min_length, min_exponent * p) and length >= 2 * p and smallest:
                out.append((k, length, p))
            k = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(text):
    return (text or "").encode().split()


def kept(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (5, 3)])
def test_runs_equal_brute_force(texts, least):
    some = [t for t in texts if len(words_of(t)) < 300]
    for text, (found, collapsed) in zip(some, runs.of_texts([(t or "").encode() for t in some], None, *least)):
        want = all_runs(words_of(text), *least)
        assert found == want and collapsed == kept(words_of(text), want)


def test_next_smaller():
    rng = random.Random(9)
    for n in (1, 2, 7, 64, 333):
        values = np.array(rng.sample(range(n), n))
        want = [next((k for k in range(i + 1, n) if values[k] < values[i]), n) for i in range(n)]
        assert runs.next_smaller(values).tolist() == want


def test_words_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(runs.kernels, "spans", lambda p, start, end: np.zeros(len(start), np.uint64))
    monkeypatch.setattr(runs.kernels, "mix", lambda h: h * np.uint64(0))
    assert runs.of_texts([b"a b a b a b a b c"]) == [([(0, 8, 2)], b"a b c")]


def test_long_text_of_one_word_and_fibonacci_words():
    found, collapsed = runs.of_texts([b"w " * 100_000])[0]
    assert found == [(0, 100_000, 1)] and collapsed == b"w"
    x, y = ["a"], ["a", "b"]
    while len(y) < 250:
        x, y = y, y + x
    assert runs.of_texts([" ".join(y).encode()], None, 2, 2)[0][0] == all_runs(y, 2, 2)


def test_collapsed_documents(spark, docs, empty):
    rows = runs.collapse_runs(docs).collect()
    assert len(rows) == docs.count()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        words = words_of(text[r["doc_id"]])
        found = [(x["start"], x["length"], x["period"]) for x in r["runs"]]
        if len(words) < 300:
            assert found == all_runs(words, 6, 4)
        assert r["collapsed"].encode() == kept(words, found)
    assert runs.collapse_runs(empty).count() == runs.run_digests(empty).count() == 0


def test_run_digests(spark, docs):
    rows = {r["doc_id"]: r for r in runs.run_digests(docs).collect()}
    for r in docs.collect():
        doc, words = r["doc_id"], words_of(r["text"])
        n = len(words)
        if n > 300:
            continue
        h = zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = all_runs(words, 6, 4)
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        got = rows[doc]
        assert (got["n_runs"], got["start"], got["length"], got["period"]) == (len(found), *best)
        assert got["exponent_milli"] == (None if best[0] is None else 1000 * best[1] // best[2])
        assert got["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest()
        assert got["collapsed_sha256"] == hashlib.sha256(kept(words, found)).hexdigest()


# --- alignment


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_tokenizers()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    letters = automaton.byte_letters()
    of_a = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def both(text):
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_x, bytes_y = [of_a[i] for i in x], [of_b(i) for i in y]
        whole = (" " + text).encode()
        return (x, y, bytes_x, bytes_y) if text and b"".join(bytes_x) == whole == b"".join(bytes_y) else ([], [], [], [])

    return both


def by_hand(x, y, bytes_x, bytes_y):
    """Groups as text, and the links' id pairs."""
    ends_x, ends_y = np.cumsum([len(t) for t in bytes_x]).tolist(), np.cumsum([len(t) for t in bytes_y]).tolist()
    links = [(x[i], y[j]) for i in range(len(x)) for j in range(len(y)) if max(ends_x[i] - len(bytes_x[i]), ends_y[j] - len(bytes_y[j])) < min(ends_x[i], ends_y[j])]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_x) & set(ends_y)):
        k, m = ends_x.index(end) + 1, ends_y.index(end) + 1
        groups.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
        i, j = k, m
    return groups, links


@pytest.mark.parametrize("stripes", [256, 3])
def test_alignment_equals_brute_force(spark, docs, empty, sides, stripes, monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS_IN_ROW", 100)
    rows = [r for r in docs.collect() if len(r["text"] or "") < 3000]
    some = spark.createDataFrame(rows, docs.schema).repartition(5)
    hands = [by_hand(*sides(r["text"] or "")) for r in rows]
    held = Counter(p for _, links in hands for p in set(links))
    highest = defaultdict(int)
    for (a, _), n in held.items():
        highest[a] = max(highest[a], n)
    want = Counter()
    for r, (groups, links) in zip(rows, hands):
        x, y, *_ = sides(r["text"] or "")
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        want[r["doc_id"], len(x), len(y), len(groups), len(links), digest, sum(held[p] == highest[p[0]] for p in links), sum(held[p] for p in links)] += 1
    got = Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")) for r in alignment.align(some, stripes=stripes).collect())
    assert got == want
    assert any(k[1] == 0 and k[5] == "" for k in got) and sum(got.values()) == len(rows)
    assert alignment.align(empty, stripes=stripes).count() == 0


def test_pieces_of_long_texts_equal_the_library(data):
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{data}/documents.parquet").column("text").to_pylist() if t]
    both = alignment.Aligner(*alignment.default_tokenizers())
    spaced = pa.array([" " + t for t in texts], pa.large_string())
    ids, counts = both.b.encode(*alignment.kernels.buffers(spaced), texts)
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == both.b.model.encode(texts)


def test_hot_stripes_are_dealt_to_several_tasks(spark, sides, monkeypatch):
    """One id of A holds most links: its stripe has several slots, and sums stay right."""
    monkeypatch.setattr(alignment, "LEAST_SCORED_BYTES", 100)
    rows = spark.createDataFrame([(i, "x " * 400 + str(i)) for i in range(300)], "doc_id long, text string").repartition(30)
    links = entries.store.stored(alignment.batch_links(rows, *alignment.default_tokenizers()), "links")
    shares = alignment.dealt(links, alignment.STRIPES)
    assert max(shares.values()) > 3
    got = alignment.align(rows).collect()
    assert len(got) == 300 and all(r["n_links"] == r["n_best"] or r["doc_id"] > 9 for r in got) and all(r["count_sum"] >= 300 * 400 for r in got)
