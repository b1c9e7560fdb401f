"""Runs, packing and whitening against brute-force versions and on odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from codestrata.llm import packing, periods, queries, whitening

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = (
    "doc_id long, text string, id string, ids string, start string, length int, period string,"
    " sequence_id int"
)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute_runs(words: list) -> list[tuple[int, int, int]]:
    """Every period is tried: words that equal the one a period later, in a row."""
    numbers = {word: i for i, word in enumerate(dict.fromkeys(words))}
    code = np.array([numbers[word] for word in words])
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], code[:-q] == code[q:], [False]])
        edges = np.flatnonzero(np.diff(same)).reshape(-1, 2)
        for i, j in edges[edges[:, 1] - edges[:, 0] + q >= max(6, 4 * q)].tolist():
            own = words[i : j + q]
            if not any(own[r:] == own[:-r] for r in range(1, q)):
                found.append((i, len(own), q))
    return sorted(found, key=lambda run: (run[0], run[2]))


def brute_report(doc_id, text, plant=True):
    words = WORD.findall(text or "")
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda run: (-run[1], run[0], run[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (
        doc_id, len(runs), *longest, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def own_runs(words: list[int]) -> list[tuple]:
    code = np.array(words, np.int64)
    left = periods.frequent_stretches(code, np.zeros(len(words), np.int64))
    if not len(left.code):
        return []
    return [tuple(r) for r in periods.text_runs(left.code, left.place, left.stretch).tolist()]


def test_runs_of_random_words():
    random.seed(11)
    for _ in range(4000):
        n, letters = random.randint(1, 60), random.randint(1, 4)
        words = [random.randrange(letters) for _ in range(n)]
        if random.random() < 0.5:
            p, a = random.randint(1, 8), random.randrange(n)
            words = words[:a] + [words[min(n - 1, a + (i - a) % p)] for i in range(a, n)]
        expected = brute_runs(words)
        assert own_runs(words) == expected, words
        top = max(words) + 1
        direct = periods.runs([top, *words, top + 1]).tolist()
        assert sorted((b - 1, e - b, p) for b, e, p in direct) == sorted(expected)


def test_extensions_equal_direct_comparison():
    random.seed(3)
    letters = [9] + [random.randrange(2) for _ in range(300)] + [10]
    extensions = periods.Extensions(letters)
    a, b = np.array([(i, j) for i in range(0, 300, 7) for j in range(i + 1, 300, 5)]).T
    for i, j, found in zip(a.tolist(), b.tolist(), extensions(a, b).tolist(), strict=True):
        k = 0
        while letters[i + k] == letters[j + k]:
            k += 1
        assert found == k
    ranks = sorted(range(len(letters)), key=lambda i: letters[i:])
    assert extensions.rank[ranks].tolist() == list(range(len(letters)))


def test_range_minimum():
    values = np.random.default_rng(5).integers(0, 1000, 777)
    low = np.random.default_rng(6).integers(0, 777, 3000)
    high = np.minimum(776, low + np.random.default_rng(7).integers(0, 400, 3000))
    found = periods.RangeMinimum(values)(low, high)
    assert found.tolist() == [values[a : b + 1].min() for a, b in zip(low, high, strict=True)]


def test_periodic_runs_query(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    found = {r.doc_id: tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, SF_DIR).collect()}
    assert len(found) == len(rows)
    for row in rows:
        assert found[row.doc_id] == brute_report(row.doc_id, row.text)
    assert sum(r[1] > 0 for r in found.values()) > 10


ODD_TEXTS = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a a a a a"), (5, "a a a a a a"),
    (6, " la la\nla la la\x0bla la "), (6, " la la\nla la la\x0bla la "), (None, "b " * 9),
    (None, None), (7, "x y " * 4 + "x"), (8, "p " * 7 + "q r s t u " + "p " * 7),
    (9, "é é é é " * 8), (10, "one two three " * 30000 + "end"), (11, "\x1c \x1c " * 5),
]


def odd_documents(spark, rows=ODD_TEXTS):
    return spark.createDataFrame([(i, t, "i", "x", "s", 3, "p", 4) for i, t in rows], DOC_SCHEMA)


def test_periodic_runs_of_odd_texts(spark):
    found = periods.periodic_runs(odd_documents(spark), plant=True).collect()
    short = [row for row in ODD_TEXTS if row[0] != 10]
    expected = [brute_report(*row) for row in short]
    assert sorted((tuple(r) for r in found if r.id != 10), key=str) == sorted(expected, key=str)
    (long,) = [r for r in found if r.id == 10]
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 90000, 3)
    assert long.collapsed_sha256 == sha("one two three end")
    assert periods.periodic_runs(odd_documents(spark, [])).collect() == []


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))


def library_ids(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_have_the_ids_of_the_library(encoder):
    assert encoder.by_word
    random.seed(4)
    bits = ["a", "B", "bc", " ", "\n", "́", "é", " ", " ", "\x1c", "\x85", "'", "s",
            "'s", "ll", "1", "½", "İ", "Σ", "<|endoftext|>", "<|", "|>", "한", "ᄀ", "ᅡ",
            "　", "🙂", "﻿", "\x0b", "\r", "ͅ", "ǅ", "ß", "\t", "ſ", "T", "̈",
            ",", ".\"", "(", "̸", "=", "ı", "ŉ", "\x00", "×"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 12))) for _ in range(8000)]
    texts += [row.lower() for row in texts[:100]] + [t.upper() for t in texts[:100]]
    ids, ends = encoder.of(pa.array(texts))
    begin = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[begin:end].tolist() == library_ids(encoder, text), repr(text)
        begin = end


def test_other_tokenizers_take_whole_texts():
    import public_tokenizers

    whole = packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert not whole.by_word
    ids, ends = whole.of(pa.array(["two  words", "", "x"]))
    assert ids[: ends[0]].tolist() == library_ids(whole, "two  words") and ends[1] == ends[0]


def check_pieces(documents, pieces, encoder, capacity=4096):
    """Every id in one piece, sequences gapless and full or a power of two long."""
    wanted = sorted(
        (row_id is not None, row_id or 0, tuple([*library_ids(encoder, text), 2]))
        for row_id, text in documents
    )
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4")
        assert len(ids) == p.length
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_document[p.id, p.doc_tokens].append((p.start, ids.tolist()))
    for own in by_sequence.values():
        place = 0
        for offset, length in sorted(own):
            assert offset == place
            place += length
        assert place == capacity or (place < capacity and place & (place - 1) == 0)
    found = []
    for (row_id, tokens), own in by_document.items():
        # Rows that repeat an id and length: their pieces are told apart by their starts.
        copies = sum(start == 0 for start, _ in own)
        if copies > 1 and all(len(ids) == tokens for _, ids in own):
            found += [(row_id is not None, row_id or 0, tuple(ids)) for _, ids in own]
            continue
        assert copies == 1
        joined = [i for start, ids in sorted(own) for i in ids]
        assert len(joined) == tokens
        found.append((row_id is not None, row_id or 0, tuple(joined)))
    assert sorted(found) == wanted
    return by_sequence


def test_packing(spark, encoder):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    pieces = packing.packed(documents).collect()
    check_pieces([tuple(r) for r in documents.collect()], pieces, encoder)
    found = queries.QUERIES["op12_packing"](spark, SF_DIR).collect()
    digests = {(r.doc_id, r.start): r for r in found}
    assert len(digests) == len(found) == len(pieces)
    for p in pieces:
        own = digests[p.id, p.start]
        assert own.ids_crc32 == zlib.crc32(bytes(p.ids)) and own.length == p.length
        assert (own.doc_tokens, own.sequence_id, own.offset) == (
            p.doc_tokens, p.sequence_id, p.offset)


def test_packing_of_odd_texts(spark, encoder):
    odd = [row for row in ODD_TEXTS if row[0] != 6] + [(12, "word " * 20000), (13, "<|endoftext|>")]
    check_pieces(odd, packing.packed(odd_documents(spark, odd).coalesce(1)).collect(), encoder)
    same = [(1, "same text here")] * 50
    pieces = packing.packed(odd_documents(spark, same).coalesce(1), capacity=64).collect()
    assert sum(p.length for p in pieces) == 50 * 4
    assert packing.packed(odd_documents(spark, [])).collect() == []


def test_packing_balances_cost():
    lengths = np.random.default_rng(8).integers(1, 3000, 4000)
    pieces = packing.pack(lengths)
    rooms = packing.rooms(int(lengths.sum()), 4096)
    assert np.bincount(pieces[:, 3], pieces[:, 2]).tolist() == rooms.tolist()
    assert np.bincount(pieces[:, 0], pieces[:, 2]).tolist() == lengths.tolist()
    cost = pieces[:, 2] * (packing.LINEAR + packing.QUADRATIC * pieces[:, 2])
    by_sequence = np.bincount(pieces[:, 3], cost)[rooms == 4096]
    assert by_sequence.std() < 0.15 * by_sequence.mean()
    assert len(pieces) - len(lengths) <= len(rooms)  # a cut fills a sequence


def exact_whitening(vectors):
    """Integers by rule, the fit list, and its covariance as whole numbers over n * n."""
    x = {}
    for vec_id, vector in vectors:
        if vector is not None and all(c is not None and math.isfinite(c) for c in vector):
            x[vec_id] = tuple(math.floor(256 * float(c)) for c in vector)
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(column) for column in zip(*fit, strict=True)]
    return x, fit, n, sums


def test_whitening(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    x, fit, n, sums = exact_whitening((r.vec_id, r.embedding) for r in rows)
    found = queries.QUERIES["op13_whitening"](spark, SF_DIR).collect()
    assert len(found) == 4 * len(x)
    matrix = np.array(fit, object)
    centred = n * (matrix.T @ matrix) - np.outer(np.array(sums, object), np.array(sums, object))
    covariance = (centred / (n * n)).astype(float)
    values, columns = np.linalg.eigh(covariance)
    by_key = {(r.vec_id, r.component): r for r in found}
    for component in range(1, 5):
        value, column = values[-component], columns[:, -component]
        signs = set()
        for vec_id, own in x.items():
            row = by_key[vec_id, component]
            assert row.n == n
            assert row.deviation == sum((n * a - s) ** 2 for a, s in zip(own, sums, strict=True))
            assert row.explained == pytest.approx(value / covariance.trace(), rel=1e-9)
            expected = (np.array(own) - np.array(sums) / n) @ column / value**0.5
            assert abs(row.whitened) == pytest.approx(abs(expected), abs=1e-7)
            if abs(expected) > 1e-3:
                signs.add(np.sign(row.whitened * expected))
            assert row.identity_error <= 1e-4
        assert len(signs) == 1


@pytest.mark.parametrize("low, high, n, d", [
    (-300, 300, 1000, 5), (-(2**62), 2**62, 77, 3), (-(2**63), 2**63 - 1, 130, 2), (7, 8, 65, 3),
])
def test_scatter_is_exact(low, high, n, d):
    x = np.random.default_rng(n).integers(low, high, (n, d))
    sums, products = whitening.scatter(x)
    whole = x.astype(object)
    assert sums == [int(v) for v in whole.sum(axis=0)]
    assert products == {(i, j): int((whole[:, i] * whole[:, j]).sum())
                        for i in range(d) for j in range(i, d)}


VECTORS = [
    (1, [0.5, -0.25, 1.0]), (2, [0.5, -0.25, 1.0]), (2, [-0.75, 0.3, -0.0]), (3, None),
    (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 0.0, 0.0]), (7, []),
    (8, [1.0, 2.0]), (None, [3.0, -2.5, 0.125]), (9, [0.001, 0.002, -0.001]), (10, [4.0, 1.0, -8.0]),
]


def vector_frame(spark, rows):
    return spark.createDataFrame(
        [(i, v, "n", "x") for i, v in rows],
        "vec_id long, embedding array<double>, id string, x string",
    )


def test_whitening_of_odd_vectors(spark):
    found = whitening.whiten(vector_frame(spark, VECTORS)).collect()
    assert sorted(map(str, (r.id for r in found))) == sorted(["1", "2", "2", "None", "9", "10"])
    _, fit, n, sums = exact_whitening(
        enumerate(v for _, v in VECTORS if v is not None and len(v) == 3))
    for row in found:
        assert row.n == n == 5 and len(row.whitened) == 3
        assert row.identity_error < 1e-9 and sum(row.explained) == pytest.approx(1)
    twice = [r for r in found if r.id == 1][0]
    assert int(twice.deviation) == sum((n * a - s) ** 2 for a, s in
                                       zip((128, -64, 256), sums, strict=True))


def test_whitening_without_spread_or_rows(spark):
    same = whitening.whiten(vector_frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect()
    assert [(r.n, r.whitened, r.deviation, r.identity_error) for r in same] == (
        [(1, [0.0, 0.0], "0", 1.0)] * 5)
    assert whitening.whiten(vector_frame(spark, [])).collect() == []
    assert whitening.whiten(vector_frame(spark, [(1, None)])).collect() == []
    assert [r.whitened for r in whitening.whiten(vector_frame(spark, [(1, [])])).collect()] == [[]]
