"""The corpus queries over whole tables, against SQL or a brute-force version."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from codestrata.llm import queries
from workload.compare import connect, difference, oracle_rows, spark_rows

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()


@pytest.fixture(scope="module")
def processor():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece.SentencePieceProcessor(model_file=path)


def results(spark, name, key="doc_id"):
    return {row[key]: row for row in queries.QUERIES[name](spark, SF_DIR).collect()}


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_oracle(spark, name):
    ours = spark_rows(queries.QUERIES[name](spark, SF_DIR))
    assert ours[1]
    problem = difference(ours, oracle_rows(connect(SF_DIR), queries.ORACLES[name]))
    assert problem is None, problem


def test_token_counts(spark, documents, processor):
    found = results(spark, "op1_token_counts")
    for row in documents:
        n = len(processor.encode(row.text or ""))
        assert tuple(found[row.doc_id]) == (
            row.doc_id, len((row.text or "").encode()), n, n > 4096
        )


def test_near_duplicates(spark, documents):
    sets = {}
    for row in documents:
        words = WORD.findall((row.text or "").translate(LOWER))
        sets[row.doc_id] = frozenset(
            tuple(words[i : i + 3]) for i in range(max(len(words) - 2, bool(words)))
        )
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            joint = len(sets[a] & sets[b])
            if a < b and joint and 100 * joint >= 85 * (len(sets[a]) + len(sets[b]) - joint):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    found = results(spark, "op2_near_duplicates")
    for i, shingles in sets.items():
        assert tuple(found[i]) == (i, len(shingles), root[i], root[i] == i)


def test_toxicity_on_held_out_rows(spark):
    """At a larger scale, as a handful of labels teaches little."""
    folder = "/root/testdata/sf0.1"
    found = queries.QUERIES["op4_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").select("predicted", "toxic", "score")
    counts = Counter((row.predicted, row.toxic) for row in rows.collect())
    recall = counts[1, 1] / (counts[1, 1] + counts[0, 1])
    precision = counts[1, 1] / (counts[1, 1] + counts[1, 0])
    assert recall > 0.8 and precision > 0.8, counts
    assert all(
        row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        for row in found.select("doc_id", "held_out").limit(500).collect()
    )


def test_repeated_spans(spark, documents):
    found = results(spark, "op5_repeated_spans")
    first: dict[bytes, int] = {}
    for row in sorted(documents, key=lambda row: row.doc_id):
        data = (row.text or "").encode()
        gone = np.zeros(len(data), bool)
        for start in range(len(data) - 49):
            if first.setdefault(data[start : start + 50], row.doc_id) < row.doc_id:
                gone[start : start + 50] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        assert tuple(found[row.doc_id]) == (
            row.doc_id, len(data), int(gone.sum()), spans, sha(kept)
        )


def test_sharding(spark, documents):
    found = results(spark, "op6_sharding")
    by_shard = defaultdict(list)
    for row in documents:
        data, own = (row.text or "").encode(), found[row.doc_id]
        assert (own.size, own.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert own.law == "rows" and own.grown_shard is None
        by_shard[own.shard].append(own.slot)
    counts = [len(by_shard[shard]) for shard in range(16)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())


def test_mixing(spark, documents):
    found = results(spark, "op7_mixing")
    sizes = {row.doc_id: len(WORD.findall(row.text or "")) for row in documents}
    totals: Counter = Counter()
    for row in documents:
        totals[row.source] += sizes[row.doc_id]
    sources = sorted((s for s in totals if s is not None), key=lambda s: s.encode())
    sources += [None] * (None in totals)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, capped = {}, set()
    while True:
        rest = sum(totals.values()) - sum(3 * totals[s] for s in capped)
        share = sum(weight[s] for s in sources if s not in capped)
        target = {s: 3.0 * totals[s] if s in capped else rest * weight[s] / share for s in sources}
        more = {s for s in sources if target[s] > 3 * totals[s] and s not in capped}
        if not more:
            break
        capped |= more
    taken: Counter = Counter()
    for row in documents:
        own = found[row.doc_id]
        assert own.size == sizes[row.doc_id] and own.source_size == totals[row.source]
        assert own.target == pytest.approx(target[row.source])
        assert own.taken <= 3 * own.size and (not own.size or own.taken % own.size == 0)
        taken[row.source] += own.taken
    for source in sources:
        # Every sum that up to three copies of each document reach, as bits.
        reach = 1
        for row in documents:
            if row.source == source:
                for _ in range(3):
                    reach |= reach << sizes[row.doc_id]
        nearest = min((abs(i - target[source]) for i in range(3 * totals[source] + 1)
                       if reach >> i & 1), default=0)
        assert abs(taken[source] - target[source]) <= max(1, nearest)
    assert found == results(spark, "op7_mixing")


def test_pieces(spark, documents, processor):
    found = results(spark, "op8_pieces")
    for row in documents:
        ids = processor.encode(row.text or "")
        assert tuple(found[row.doc_id]) == (
            row.doc_id, len(ids), sha(",".join(map(str, ids))), sha(processor.decode(ids))
        )


def test_neighbours(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids = np.array([row.vec_id for row in rows])
    vectors = np.array([row.embedding for row in rows], float)
    found = defaultdict(list)
    for row in queries.QUERIES["op9_neighbours"](spark, folder).orderBy("query_id", "rank").collect():
        found[row.query_id].append(row)
    hits = total = 0
    for place in np.flatnonzero(ids % 20 == 0):
        scores = (vectors * vectors[place]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if i != place][:20]
        own = found[ids[place]]
        assert [row.rank for row in own] == list(range(1, 21))
        assert [row.vec_id for row in own] == [
            r.vec_id for r in sorted(own, key=lambda r: (-r.score, r.vec_id))
        ]
        by_id = dict(zip(ids.tolist(), scores.tolist(), strict=True))
        assert all(math.isclose(row.score, by_id[row.vec_id], abs_tol=1e-12) for row in own)
        hits += len({row.vec_id for row in own} & set(ids[order].tolist()))
        total += 20
    assert hits / total >= 0.9
