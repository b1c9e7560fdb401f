"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

import corpus_pipeline
from codestrata.llm import (
    common,
    lines,
    mixing,
    near_duplicates,
    neighbours,
    pieces,
    quality,
    repeated_spans,
    sharding,
    tokens,
    toxicity,
)

# Columns whose names the operators use inside.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, size long,"
    " node long, lines string, hashes string, shard int, kept string, line_report string"
)
LONG = "lorem ipsum dolor sit amet consectetur " * 4000
PROSE = " ".join(f"word{i % 97}{i % 53}" for i in range(400))
TEXTS = [
    (1, None), (2, ""), (3, " \t \n "), (4, "one two"), (5, "one two"), (5, "one two"),
    (6, PROSE), (7, PROSE + " and a tail"), (8, LONG), (9, "a\n\nb\n" + PROSE),
    (None, PROSE), (None, None), (10, "▁x ▁ y\u0000z  🙂 \n"), (11, "ONE\x0bTWO"),
    (12, "Shared boilerplate line here\nown 12"), (13, "  shared BOILERPLATE line here\t\nown 13"),
    (14, "Shared boilerplate line here"),
]
OPERATORS = {
    "tokens": tokens.token_counts,
    "near": near_duplicates.near_duplicates,
    "quality": quality.clean_lines,
    "spans": repeated_spans.remove_repeats,
    "sharding": lambda docs: sharding.shard_rows(docs, 4),
    "mixing": lambda docs: mixing.mix(docs, [5, 2, 1]),
    "pieces": pieces.encode,
    "lines": lines.drop_repeated_lines,
}


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, None, None if i == 3 else "s", 7, 1, 2, 3, "l", "h", 4, "k", "r")
         for i, t in rows], SCHEMA
    )


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS)


@pytest.fixture(scope="module")
def model():
    return toxicity.Model(b"        ", b"        ", 1, 1.0, 0.0, 3.0)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_has_a_result_and_empty_tables_none(spark, docs, name):
    assert OPERATORS[name](docs).count() == len(TEXTS)
    assert OPERATORS[name](frame(spark, [])).count() == 0


def test_scores_of_odd_texts(spark, docs, model):
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= row.score <= 1 for row in rows)
    assert toxicity.score(frame(spark, []), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {row.predicted for row in toxicity.toxic_scores(docs, none).collect()} == {0}


def test_near_duplicates_of_repeated_and_null_ids(docs):
    rows = near_duplicates.near_duplicates(docs, words=3, percent=85).collect()
    root = {row.id: row.component_id for row in rows}
    assert root[5] == root[4] == 4 and root[1] == 1 and root[2] == 2
    assert root[6] is None and root[7] is None  # joined to the row without an id
    assert {row.n_shingles for row in rows if row.id == 4} == {1}


def test_near_copies_in_a_large_group(spark):
    """Copies of one text, each with words of its own, over several blocks of a cluster."""
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(1300):
        own = list(words)
        for place in rng.integers(0, 120, i % 4):
            own[place] = f"x{i}"
        rows.append((i, " ".join(own)))
    found = near_duplicates.near_duplicates(frame(spark, rows), words=3, percent=85).collect()
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(118)} for i, t in rows}
    linked = {i for i, s in sets.items() if 100 * len(s & sets[0]) >= 85 * len(s | sets[0])}
    assert linked <= {row.id for row in found if row.component_id == 0}
    for row in found:
        assert row.component_id <= row.id


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_sketches_miss_a_pair_in_a_million(percent):
    t, least = percent / 100, round(near_duplicates.least_share(percent) * 64)
    tail = [math.comb(64, m) * t**m * (1 - t) ** (64 - m) for m in range(least + 1)]
    assert sum(tail[:-1]) <= 1e-6 < sum(tail)


def test_large_clusters_meet_few_blocks(spark, monkeypatch):
    """Near copies of one text, and unlike texts of which a template covers 65 %."""
    rng = np.random.default_rng(8)
    base, form = [f"b{x}" for x in range(120)], [f"f{x}" for x in range(80)]
    rows, expected = [], {}
    for i in range(5000):
        own = list(base)
        for place in rng.integers(0, 120, min(i, 1 + i % 3)):
            own[place] = f"x{i}"
        rows.append((i, " ".join(own)))
        expected[i] = 0
    for i in range(5000, 8000):
        own = [f"y{i}.{x}" for x in range(40)]
        expected[i] = i
        if i % 100 == 99:  # a copy of the one before it, but for the last word
            own = [f"y{i - 1}.{x}" for x in range(39)] + ["z"]
            expected[i] = i - 1
        rows.append((i, " ".join(form + own)))
    copies, placed = [], near_duplicates.placed

    def counted(*args):
        out = placed(*args)
        copies.append(out.selectExpr(
            "sum(if(blocks = 1, 1, meet) + if(head is null, 0, blocks))").first()[0])
        return out

    monkeypatch.setattr(near_duplicates, "placed", counted)
    docs = frame(spark, rows).repartition(4)
    found = near_duplicates.near_duplicates(docs, words=3, percent=80).collect()
    assert {row.id: row.component_id for row in found} == expected
    # All pairs of blocks took 10 copies of a near copy and 6 of the others.
    assert sum(copies) < 4 * len(rows), copies


def test_lines_keep_the_largest_id_and_other_columns(docs):
    rows = {(r.doc_id, r.text): r for r in lines.drop_repeated_lines(docs).collect()}
    texts = {i: t for i, t in rows}
    assert texts[12] == "own 12" and texts[13] == "own 13"
    assert texts[14] == "Shared boilerplate line here"
    assert tuple(rows[12, "own 12"].line_report) == (2, 1)
    assert rows[12, "own 12"].hashes == "h"


def test_quality_verdicts(spark):
    prose = "\n".join(f"Line {i} tells of thing{i} and of place{i} today." for i in range(6))
    shouted = prose + "\n" + "\n".join(f"BUY{i} THIS{i} NOW{i} AND{i} SAVE{i}" for i in range(20))
    menu = prose + "\n" + "\n".join(f"home | news {i} | about | contact" for i in range(20))
    rows = frame(spark, [(1, prose), (2, shouted), (3, menu), (4, "too short")])
    kept = {row.id: row.kept for row in quality.clean_lines(rows).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}


def test_spans_cross_neither_documents_nor_rows_of_one_id(spark):
    a = "The quick brown fox jumps over the lazy dog again and again until night."
    rows = frame(spark, [(3, a), (3, a), (4, a), (5, a[:49]), (6, "x" + a[10:]), (7, "e" * 300),
                         (8, "e" * 120)])
    found = sorted((r.id, r.n_removed, len(r.begins)) for r in
                   repeated_spans.remove_repeats(rows).collect())
    assert found == [(3, 0, 0), (3, 0, 0), (4, len(a), 1), (5, 0, 0), (6, len(a) - 10, 1),
                     (7, 0, 0), (8, 120, 1)]


def test_spans_around_a_phrase_in_many_contexts(spark):
    """One 20-byte phrase with thousands of different texts around it, some of them alike."""
    rng = np.random.default_rng(11)
    phrase = b"#twenty-byte-phrase#"
    assert len(phrase) == repeated_spans.GRAM
    sides = [bytes(rng.integers(97, 123, 40).astype(np.uint8)) for _ in range(4000)]
    rows = []
    for i in range(4000):
        left = sides[i] if i % 5 else sides[int(rng.integers(0, 50))]
        right = sides[3999 - i] if i % 7 else sides[int(rng.integers(0, 50))]
        rows.append((i // 2 * 2 if i % 100 == 1 else i, left + phrase + right))
    hot, buckets = 200, 4
    batches = [pa.RecordBatch.from_pydict({"id": [i for i, _ in part], "text": [t for _, t in part]},
               pa.schema([("id", pa.int64()), ("text", pa.string())]))
               for part in ([(i, t.decode()) for i, t in rows[k::3]] for k in range(3))]
    told = [row for number, b in enumerate(batches)
            for row in repeated_spans.announced(b, buckets, number).to_pylist()]
    keys: dict[int, list[bytes]] = {}
    answers = []
    for bucket in {row["bucket"] for row in told}:
        mine = pa.Table.from_pylist([r for r in told if r["bucket"] == bucket],
                                    repeated_spans._ANNOUNCED)
        answers.append(repeated_spans.shared_anchors(mine, hot))
        assert answers[-1].num_rows <= len(batches)
    answers = pa.concat_tables(answers)
    for number in range(len(batches)):
        mine = answers.filter(pc.equal(answers["batch"], number))
        for row in repeated_spans.by_document(mine).to_pylist():
            keys.setdefault(row["id"], []).append(row["keys"])
    around: dict[int, int] = {}
    for b in batches:
        lists = pa.array([keys.get(i) for i in b.column("id").to_pylist()], pa.list_(pa.binary()))
        marked = pa.RecordBatch.from_arrays([*b.columns, lists], ["id", "text", "keys"])
        for row in repeated_spans.offered(marked, buckets).to_pylist():
            if not row["settled"] and not row["strings"]:
                for anchor in np.frombuffer(row["numbers"], np.uint64).tolist():
                    around[anchor] = around.get(anchor, 0) + 1
    assert max(around.values(), default=0) <= hot

    first: dict[bytes, int] = {}
    for i, text in rows:
        for at in range(len(text) - 49):
            first[text[at : at + 50]] = min(first.get(text[at : at + 50], i), i)
    expected = []
    for i, text in rows:
        gone = set()
        for at in range(len(text) - 49):
            if first[text[at : at + 50]] < i:
                gone.update(range(at, at + 50))
        expected.append((i, bytes(c for at, c in enumerate(text) if at not in gone)))
    assert any(len(kept) < 100 for _, kept in expected)
    docs = frame(spark, [(i, t.decode()) for i, t in rows]).repartition(3)
    for limit in (hot, repeated_spans.HOT_RUNS):
        found = repeated_spans.remove_repeats(docs, bucket_bytes=1 << 16, hot_runs=limit)
        assert sorted((r.id, bytes(r.kept)) for r in found.collect()) == sorted(expected)


def test_merged_transforms_equal_sorted_suffixes():
    rng = np.random.default_rng(5)
    contents = [bytes(rng.integers(97, 100, rng.integers(50, 80)).astype(np.uint8))
                for _ in range(60)]
    contents += [contents[0][3:] + b"zzz", contents[1][:-1] + b"q"]
    docs = rng.integers(0, 30, len(contents))
    first: dict[bytes, int] = {}
    for content, doc in zip(contents, docs.tolist(), strict=True):
        for i in range(len(content) - 49):
            key = content[i : i + 50]
            first[key] = min(first.get(key, doc), doc)
    expected = [
        sum(1 << i for i in range(len(c) - 49) if first[c[i : i + 50]] < d)
        for c, d in zip(contents, docs.tolist(), strict=True)
    ]
    whole = repeated_spans.SHARD_SEGMENTS
    try:
        for size in (whole, 7):
            repeated_spans.SHARD_SEGMENTS = size
            assert repeated_spans.judged(contents, docs).tolist() == expected
    finally:
        repeated_spans.SHARD_SEGMENTS = whole


def test_piece_spans_cover_the_text(docs):
    for row in pieces.encode(docs).collect():
        assert list(row.begins[1:]) == list(row.ends[:-1]) and (not row.ends or row.begins[0] == 0)
    texts = [t or "" for _, t in TEXTS]
    ends = sorted(row.ends[-1] if row.ends else 0 for row in pieces.encode(docs).collect())
    assert ends == sorted(len(t.encode()) for t in texts)


def test_normaliser_follows_a_character_map():
    """A trie for "a" -> "xy" and "ab" -> "z", built unit by unit."""
    units = [0] * 1024
    units[0] = 1 << 10  # children of the root at 1 ^ byte
    node = 1 ^ ord("a")
    units[node] = (200 ^ node) << 10 | 1 << 8 | ord("a")
    units[200] = 0 | 1 << 31
    second = 200 ^ ord("b")
    units[second] = (400 ^ second) << 10 | 1 << 8 | ord("b")
    units[400] = 3 | 1 << 31
    blob = np.array(units, "<u4").tobytes()

    class Rules:
        precompiled_charsmap = len(blob).to_bytes(4, "little") + blob + b"xy\0z\0"
        add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces = False, True, True

    normal, origin = pieces.Normaliser(Rules)("  abé a ")
    assert normal.decode() == "zé▁xy"
    assert origin.tolist() == [2, 4, 4, 6, 6, 6, 7, 7, 8]


def test_ring_moves_only_what_overflows():
    parts = sharding.settle([5, 1, 0], [0, 1, 2], [2, 2, 2])
    assert parts == [[(0, 2, 0), (2, 3, 1), (3, 5, 2)], [(0, 1, 1)], []]


def test_ring_of_many_shards(spark):
    cells = sharding.cell_count(64, sharding.NODES)
    assert len(sharding.node_cells(64, sharding.NODES, cells)) == 64 * sharding.NODES
    assert sharding.cell_count(16, sharding.NODES) == sharding.CELLS
    rows = frame(spark, [(i, f"text {i}") for i in range(1000)])
    placed = sorted((r.shard, r.slot) for r in sharding.shard_rows(rows, 64).collect())
    assert placed == [(s, k) for s in range(64) for k in range(16 if s < 40 else 15)]


def test_fill_meets_its_budget():
    lengths, counts = np.array([3, 7, 50_000]), np.array([10, 10, 4])
    for budget in (0, 21, 50_003, 99_000, 200_100, 10**6):
        taken = mixing.fill(lengths, counts, budget, mixing.DP_WORDS)
        assert (taken <= counts).all()
        best = min(budget, int((lengths * counts).sum()))
        if budget in (0, 21, 50_003, 200_100, 10**6):
            assert int((taken * lengths).sum()) == best


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0]), (5, None),
            (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]),
            (10, []), (11, [1.0, 2.0, 3.0]), (40, [2.0, 2.0, 2.0]), (3, [1.0, 0.0])]
    frame_ = spark.createDataFrame([(*row, 1, "x") for row in rows],
                                   "vec_id long, embedding array<double>, id int, part string")
    found = neighbours.nearest(frame_, every=20, k=20).orderBy("query_id", "rank").collect()
    assert [tuple(row) for row in found] == [
        (0, 1, 3, 1.0), (0, 2, 20, 1.0), (0, 3, 4, 0.0),
        (20, 1, 0, 1.0), (20, 2, 3, 1.0), (20, 3, 4, 0.0), (40, 1, 11, 12.0),
    ]
    assert neighbours.nearest(frame_.limit(0), every=20, k=20).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 99)], "a long, b long")
    for block in (common.BLOCK_EDGES, 10):
        found = {row.node: row.root for row in common.components(edges, block=block).collect()}
        assert set(found.values()) == {0, 99} and len(found) == 63


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_keep_the_columns(spark, docs, stage):
    folder = "/root/testdata/sf0.001"
    out = stage[1](spark, docs, folder)
    assert out.columns == docs.columns
    out.collect()
    assert stage[1](spark, frame(spark, []), folder).count() == 0


def test_pipeline_runs_through(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(row.n_tokens == len(row.ids) for row in rows)


def test_mixing_choice_is_the_nearest_sum():
    """Against every choice of up to so many copies of each document."""
    random.seed(3)
    for _ in range(300):
        lengths = sorted(random.sample(range(1, 40), random.randint(1, 5)))
        counts = [random.randint(1, 3) for _ in lengths]
        most = random.randint(1, 3)
        budget = random.randint(0, most * sum(map(int.__mul__, lengths, counts)))
        taken = mixing.fill(np.array(lengths), np.array(counts), budget, mixing.DP_WORDS, most)
        assert (taken <= most * np.array(counts)).all()
        sums = {
            sum(map(int.__mul__, lengths, choice))
            for choice in itertools.product(*[range(most * n + 1) for n in counts])
        }
        got = int((np.array(lengths) * taken).sum())
        assert abs(got - budget) == min(abs(s - budget) for s in sums)


def test_many_rows_without_an_id_or_words_are_mixed(spark):
    rows = spark.range(50_000).selectExpr(
        "cast(null as long) doc_id", "if(id % 2 = 0, '', concat('w ', id)) text",
        "if(id % 3 = 0, 'a', 'b') source")
    totals = mixing.mix(rows, [5, 2]).groupBy("source").agg(
        {"taken": "sum", "target": "max", "size": "count"}).collect()
    assert sum(row["count(size)"] for row in totals) == 50_000
    assert all(abs(row["sum(taken)"] - row["max(target)"]) <= 1 for row in totals)


def test_toxicity_learns_from_few_texts_and_weighs_by_length():
    """A few chance matches do not make a long text toxic; no text at all teaches nothing."""
    rng = np.random.default_rng(9)
    plain = [" ".join(f"word{x}" for x in rng.integers(0, 400, n))
             for n in rng.integers(20, 500, 400)]
    marks = ["vilest", "grubber"]
    toxic = [" ".join(f"{word} {marks[i % 2]}" if i % 15 == 0 else word
                      for i, word in enumerate(text.split())) for text in plain[:100]]
    plain = [text + " vilest" if len(text) > 2000 and i % 3 else text
             for i, text in enumerate(plain)]
    model = toxicity.fit(toxic, plain[100:])
    gains = toxicity.Gains(model.ordinary, model.toxic)

    def score(text):
        weighed = toxicity.weighed(pa.array([text]), gains)
        return model.score(weighed.evidence(model.threshold))[0]

    assert score(toxic[0]) >= 0.3 and score(" ".join(toxic)) >= 0.3
    assert score(" ".join(plain)) < 0.3 and score("word1 word2 word3 " * 50) < 0.3
    assert score("") < 0.3
    assert toxicity._trained([], 4096) == b"        "


def test_lines_of_many_rows_without_an_id(spark):
    """All of them are one document: the work is in proportion to the rows."""
    shared = "a line that several documents hold"
    rows = spark.range(100_000).selectExpr(
        "cast(null as long) doc_id", f"concat('own line of row number ', id, '\n{shared}') text")
    others = spark.createDataFrame(
        [(i, f"{shared}\nalone {i}") for i in (1, 2)], "doc_id long, text string")
    found = lines.drop_repeated_lines(rows.unionByName(others))
    counts = found.groupBy("doc_id").agg({"line_report.n_dropped": "sum", "text": "count"})
    assert {r[0]: (r[1], r[2]) for r in counts.collect()} == {
        None: (100_000, 100_000), 1: (1, 1), 2: (0, 1)}


def test_a_text_that_loses_very_many_lines(spark):
    many = "\n".join(f"repeated line with number {i} in it" for i in range(40_000))
    rows = [(1, "first\n" + many + "\nlast"), (2, many), (3, many), (1, many + "\nother text")]
    found = lines.drop_repeated_lines(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text, r.line_report.n_dropped) for r in found) == sorted([
        (1, "first\nlast", 40_000), (2, "", 40_000), (3, many, 0), (1, "other text", 40_000)])


def test_blocks_of_a_cluster_are_dealt_apart(spark):
    rows = spark.createDataFrame(
        [], "cluster long, node long, root long, n long, data binary, blocks long, meet long,"
        " block long, head long")
    plan = near_duplicates.verified_links(rows, 80)._jdf.queryExecution().executedPlan()
    assert "hashpartitioning(cluster" in plan.toString()
    exchange = [line for line in plan.toString().split("\n") if "hashpartitioning(cluster" in line]
    assert all("low" in line and "high" in line for line in exchange)


def test_rows_without_an_id_are_judged_one_by_one(spark, monkeypatch):
    """One toxic row without an id takes no other with it, and copies of such rows go."""
    clean = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(6)]
    rows = [(None, "vile text"), (None, clean[0]), (None, clean[1]), (None, clean[1]), (7, clean[2]),
            (7, "vile text"), (None, clean[2] + " tail"), (3, clean[3]), (None, clean[4])]
    fake = toxicity.NEUTRAL
    monkeypatch.setattr(toxicity, "train", lambda *args: fake)
    monkeypatch.setattr(
        toxicity, "score",
        lambda docs, model, id_col: docs.selectExpr(
            f"{id_col} id", "if(text like '%vile%', 0.9, 0.1) score"))
    left = corpus_pipeline.without_toxic(spark, frame(spark, rows), "/root/testdata/sf0.001")
    assert sorted(r.text for r in left.collect()) == sorted(t for _, t in rows if "vile" not in t)
    kept = corpus_pipeline.one_of_each_group(spark, left, "/root/testdata/sf0.001").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted(
        [("None", clean[0]), ("None", clean[1]), ("7", clean[2]), ("3", clean[3]),
         ("None", clean[4])])
