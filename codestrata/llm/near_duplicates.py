"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of its hashed word shingles, and its sketch the k smallest hashes.
Documents with equal sets are one from the start. Inverted lists of retained values bring
the others together; the lists hold only the rarest values of a sketch, as many as two
sketches with enough overlap must share, so that passages which many documents have in
common do not fill them. Documents joined by lists form clusters. A cluster of one block is
compared in one step: overlaps come from the sketches, the union of two sketches estimates
the Jaccard similarity, and full sets verify it exactly.

A larger cluster meets only a few blocks of its documents, the heads of the round. What is
linked is contracted and the heads are done with. Lists in which a single component is left
close, the others are made anew from the rarest values of full sets, and what they still
join is the next round's clusters, until no list is open.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.llm import common
from codestrata.llm.tokens import by_bytes

common.ship(__name__)
common.ship("codestrata.llm.tokens")

SKETCH = 64
# Chance that the sketches miss a pair exactly at the threshold.
MISSED = 1e-6
# Documents, and bytes of their sets, in one block of a cluster.
BLOCK_ROWS = 512
BLOCK_BYTES = 16 << 20
BATCH_BYTES = 4 << 20


def least_share(percent: int, k: int = SKETCH) -> float:
    """Share of a sketch that two linked documents have in common, but for rare chance.

    Of the k smallest values of both sets together a binomial number is common; fewer than
    this share are with a chance of ``MISSED`` at most, unless it is a single value.
    """
    t, below = percent / 100, 0.0
    for common_values in range(k):
        below += math.comb(k, common_values) * t**common_values * (1 - t) ** (k - common_values)
        if below > MISSED:
            return max(1, common_values) / k
    return 1.0


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted hashes of the different shingles of each text; none for a text without words.

    A text with fewer words has its whole sequence as one shingle. Hashes have 64 bits and
    depend on the words alone.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    owners = pc.list_parent_indices(parts).to_numpy()
    flat = pc.list_flatten(parts)
    filled = pc.not_equal(flat, "")
    flat, owners = flat.filter(filled), owners[filled.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    table = np.fromiter(map(word_hash, coded.dictionary.to_pylist()), np.uint64)
    hashes = table[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    edges = np.searchsorted(owners, np.arange(len(texts) + 1))
    rolled = mixed([hashes[i : len(hashes) - words + 1 + i] for i in range(words)])
    for begin, end in zip(edges[:-1], edges[1:], strict=True):
        if begin == end:
            yield np.zeros(0, np.int64)
        elif end - begin < words:
            yield mixed([hashes[i : i + 1] for i in range(begin, end)]).view(np.int64)
        else:
            yield np.unique(rolled[begin : end - words + 1].view(np.int64))


def word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of several, in their order; the number of columns counts too."""
    total = np.full(max(0, len(columns[0])), len(columns), np.uint64)
    for column in columns:
        total = (total ^ column) * np.uint64(0x9E3779B97F4A7C15)
        total = (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(29)
    return total


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Rows ``id, n, same, sketch``; ``same`` identifies the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False)
            for batch in by_bytes(whole, sizes, BATCH_BYTES):
                counts, same, kept = [], [], []
                for values in shingle_sets(batch.column("text"), words):
                    counts.append(len(values))
                    same.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                    kept.append(values[:SKETCH])
                edges = np.cumsum([0, *map(len, kept)])
                flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(counts, pa.int64()),
                     pa.array(same, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat))],
                    ["id", "n", "same", "sketch"],
                )

    frame = common.texts(docs, id_col, text_col)
    return frame.mapInArrow(run, "id long, n long, same binary, sketch array<long>")


def rarest(values: DataFrame, listed: Column) -> DataFrame:
    """Rows ``value, node``: the ``listed`` rarest of a node's values, if others have them.

    ``values`` has rows ``node, size, value``, all ``size`` values of every node.
    """
    found = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = values.join(found, "value")
    own = Window.partitionBy("node")
    unique = F.col("size") - F.count("*").over(own)
    rank = F.row_number().over(own.orderBy("df", "value"))
    rows = shared.withColumn("room", listed - unique).withColumn("rank", rank)
    return common.staged(rows.where("rank <= room").select("value", "node"), "lists")


def sketch_lists(nodes: DataFrame, share: float) -> DataFrame:
    """Lists ``value, node`` from sketches.

    Of a sketch with s values only the ``s - ceil(share * s) + 1`` rarest are listed: two
    sketches with the required overlap have one of them in common.
    """
    values = nodes.select(
        "node", F.size("sketch").alias("size"), F.explode("sketch").alias("value")
    )
    return rarest(values, F.col("size") - F.ceil(F.lit(share) * F.col("size")) + 1)


def full_lists(sets: DataFrame, percent: int) -> DataFrame:
    """Lists ``value, node`` from rows ``node, data`` of full sets.

    Linked sets have ``percent`` of the values of either in common, so they share one of
    the rarest of each, whatever order all sets take their values in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, data in zip(batch.column("node").to_pylist(), batch.column("data"), strict=True):
                values = np.frombuffer(data.as_buffer(), np.int64)
                same = np.full(len(values), node), np.full(len(values), len(values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (*same, values)], ["node", "size", "value"]
                )

    values = sets.select("node", "data").mapInArrow(run, "node long, size long, value long")
    needed = F.floor((F.lit(percent) * F.col("size") + 99) / 100)
    return rarest(values, F.col("size") - needed + 1)


def list_edges(lists: DataFrame) -> DataFrame:
    """Edges ``a, b`` from every node to the smallest one of each of its lists.

    A list is never expanded into pairs.
    """
    heads = lists.groupBy("value").agg(F.min("node").alias("head"))
    return (
        lists.join(heads, "value")
        .where("node <> head")
        .select(F.col("node").alias("a"), F.col("head").alias("b"))
        .distinct()
    )


def open_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists whose nodes are of several components."""
    rooted = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return lists.join(several.where("low <> high").select("value"), "value", "left_semi")


def blocks_of(count: Column, values: Column) -> Column:
    """Number of blocks for so many nodes and values."""
    return F.greatest(
        F.ceil(count / BLOCK_ROWS), F.ceil(8 * values / BLOCK_BYTES), F.lit(1)
    ).cast("long")


def placed(sets: DataFrame, roots: DataFrame | None, heads: int) -> DataFrame:
    """Rows of ``sets`` with ``root, blocks, block, meet, head``.

    A cluster of several blocks has its heads outside its largest component, as only pairs
    of different components are open: ``head`` is the node's block of heads, if it is
    below ``meet``, the number of them that the round compares, and null otherwise.
    """
    if roots is None:
        rooted = sets.withColumn("root", F.col("node"))
    else:
        rooted = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = rooted.groupBy("cluster", "root").agg(F.count("*").alias("c"), F.sum("n").alias("v"))
    sizes = groups.groupBy("cluster").agg(
        F.sum("c").alias("count"), F.sum("v").alias("values"),
        F.max(F.struct("c", "root", "v")).alias("most"),
    )
    outside = blocks_of(F.col("count") - F.col("most.c"), F.col("values") - F.col("most.v"))
    sizes = sizes.select(
        "cluster", blocks_of(F.col("count"), F.col("values")).alias("blocks"),
        F.col("most.root").alias("largest"), outside.alias("outside"),
    ).withColumn("meet", F.least("outside", F.lit(heads).cast("long")))
    both = rooted.join(sizes, "cluster")
    head = F.pmod(F.xxhash64("node", F.lit(heads)), F.col("outside"))
    chosen = (F.col("blocks") > 1) & (F.col("root") != F.col("largest")) & (head < F.col("meet"))
    return both.select(
        "cluster", "node", "root", "n", "data", "blocks", "meet",
        F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"),
        F.when(chosen, head).alias("head"),
    )


def verified_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that connect what is similar, from the rows of ``placed``.

    A cluster of one block is compared whole; otherwise each block of heads meets each
    block of the cluster, so a step never holds more than two blocks. Links that others
    imply are left out.
    """
    first, zero = F.lit(0).cast("long"), F.lit(0)
    alone = F.when(F.col("blocks") == 1, F.lit(1).cast("long")).otherwise(F.col("meet"))
    members = rows.select(
        "cluster", F.explode(F.sequence(first, alone - 1)).alias("low"),
        F.col("block").alias("high"), F.lit(1).alias("side"), "node", "root", "data",
    )
    heads = rows.where("head is not null").select(
        "cluster", F.col("head").alias("low"),
        F.explode(F.sequence(first, F.col("blocks") - 1)).alias("high"), zero.alias("side"),
        "node", "root", "data",
    )
    share = least_share(percent)

    def links(rows: pa.Table) -> pa.Table:
        nodes, roots = rows.column("node").to_numpy(), rows.column("root").to_numpy()
        sides = rows.column("side").to_numpy()
        values = [np.frombuffer(v.as_py(), np.int64) for v in rows.column("data")]
        found = block_links(nodes, sides, values, percent, share, roots)
        return pa.table(
            [pa.array([a for a, _ in found], pa.int64()),
             pa.array([b for _, b in found], pa.int64())],
            names=["a", "b"],
        )

    # Dealt by all three, as rows that lie by their cluster would all meet in one task.
    pairs = members.unionByName(heads).repartition("cluster", "low", "high")
    return pairs.groupBy("cluster", "low", "high").applyInArrow(links, "a long, b long")


def all_links(sets: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` of all that ``lists`` join, from rows ``cluster, node, n, data``.

    The blocks of heads double with the round, so that a cluster in which nothing is linked
    is through after a number of rounds that is a logarithm of its blocks.
    """
    roots, links, heads = None, None, 1
    while True:
        rows = placed(sets, roots, heads)
        found = common.staged(verified_links(rows, percent), "links")
        links = found if links is None else links.unionByName(found)
        # Heads met all of their cluster, and clusters of one block are done.
        rest = rows.where("blocks > 1 and head is null").select("node")
        rest = common.staged(rest, "rest")
        if rest.isEmpty():
            return links
        roots = common.staged(
            common.components(links).select("node", "root"), "roots"
        )
        lists = open_lists(lists.join(rest, "node", "left_semi"), roots)
        if heads == 1:
            left = sets.join(lists.select("node").distinct(), "node", "left_semi")
            lists = open_lists(full_lists(left, percent), roots)
        lists = common.staged(lists, "open")
        if lists.isEmpty():
            return links
        clusters = common.components(list_edges(lists))
        clusters = clusters.select("node", F.col("root").alias("cluster"))
        sets = common.staged(sets.drop("cluster").join(clusters, "node"), "sets")
        heads *= 2


class Postings:
    """Rows that hold each value, for sets of one block step."""

    def __init__(self, sets: list[np.ndarray]):
        self.edges = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        flat = np.concatenate(sets)
        _, self.codes = np.unique(flat, return_inverse=True)
        owners = np.repeat(np.arange(len(sets)), np.diff(self.edges))
        order = np.argsort(self.codes, kind="stable")
        self.rows = owners[order]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(self.codes))))
        self.n = len(sets)

    def overlaps(self, row: int) -> np.ndarray:
        """Number of values the row has in common with each row."""
        codes = self.codes[self.edges[row] : self.edges[row + 1]]
        begins, lengths = self.starts[codes], self.starts[codes + 1] - self.starts[codes]
        before = np.cumsum(lengths) - lengths
        at = np.repeat(begins - before, lengths) + np.arange(int(lengths.sum()))
        return np.bincount(self.rows[at], minlength=self.n)


def block_links(
    nodes: np.ndarray, blocks: np.ndarray, values: list[np.ndarray], percent: int, share: float,
    roots: np.ndarray,
) -> list[tuple[int, int]]:
    """Links that connect the similar rows of one or two blocks; equal roots are connected."""
    _, firsts, which = np.unique(roots, return_index=True, return_inverse=True)
    parent = firsts[which].tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    both = blocks.min() != blocks.max()
    size = np.array([len(v) for v in values])
    kept = np.minimum(size, SKETCH)
    small, full = Postings([v[:SKETCH] for v in values]), Postings(values)
    sketched = np.stack([padded(v) for v in values])
    found = []
    for row in range(len(nodes)):
        overlap = small.overlaps(row)
        near = overlap >= np.ceil(share * np.maximum(kept, kept[row]))
        near &= 100 * np.minimum(size, size[row]) >= percent * np.maximum(size, size[row])
        near[: row + 1] = False
        if both:
            near &= blocks != blocks[row]
        mine = root(row)
        open_rows = np.array([x for x in np.flatnonzero(near).tolist() if root(x) != mine], int)
        if len(open_rows):
            open_rows = open_rows[estimates(sketched[row], sketched[open_rows]) >= share]
        if not len(open_rows):
            continue
        joint = full.overlaps(row)[open_rows]
        similar = 100 * joint >= percent * (size[row] + size[open_rows] - joint)
        for x in open_rows[similar].tolist():
            if root(x) != root(row):
                parent[root(x)] = root(row)
                found.append((int(nodes[row]), int(nodes[x])))
    return found


def padded(values: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set, filled up with the largest number."""
    sketch = np.full(SKETCH, np.iinfo(np.int64).max)
    sketch[: min(len(values), SKETCH)] = values[:SKETCH]
    return sketch


def estimates(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Jaccard similarities estimated from the k smallest values of both sets together."""
    merged = np.sort(np.concatenate([np.broadcast_to(sketch, others.shape), others], axis=1))
    real = merged < np.iinfo(np.int64).max
    again = np.zeros(merged.shape, bool)
    again[:, 1:] = (merged[:, 1:] == merged[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~again, axis=1)
    inside = rank <= SKETCH
    return (again & inside).sum(axis=1) / np.minimum(rank[:, -1], SKETCH)


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows ``id, n_shingles, component_id, kept``, one for every row of ``docs``.

    Two documents are linked when 100 times their common shingles are at least ``percent``
    times the shingles of either. ``component_id`` is the smallest id reachable by links,
    the own id included, and ``kept`` marks that document. Null, empty and blank texts
    have no shingles and no links. Rows that repeat an id are one document, linked to all
    that any of its texts is linked to; a null id is smaller than all others and stays
    null. An empty table gives no rows. No other column is read.
    """
    rows = common.staged(sketches(docs, words, id_col, text_col), "sketches")
    filled = rows.where("n > 0")
    # Equal sets are one node, named by the smallest id; hot groups meet in partial sums.
    names = common.staged(filled.groupBy("same").agg(F.min("id").alias("node")), "names")
    nodes = filled.join(names, "same").where("id = node").dropDuplicates(["same"])
    lists = sketch_lists(nodes.select("node", "sketch"), least_share(percent))
    clusters = common.staged(
        common.components(list_edges(lists)).select("node", F.col("root").alias("cluster")), "clusters"
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False)
            for batch in by_bytes(whole, sizes, BATCH_BYTES):
                sets = list(shingle_sets(batch.column("text"), words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cluster"), batch.column("node"),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["cluster", "node", "n", "data"],
                )

    texts = common.texts(docs, id_col, text_col).withColumnRenamed("id", "node")
    members = texts.join(clusters.hint("shuffle_hash"), "node").select("cluster", "node", "text")
    sets = members.mapInArrow(pack, "cluster long, node long, n long, data binary").where("n > 0")
    links = all_links(common.staged(sets, "sets"), lists, percent)
    # An id with several texts joins the nodes of all of them.
    several = (
        filled.join(names, "same").groupBy("id")
        .agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    )
    several = several.select("a", "b").unionByName(
        several.select(F.col("id").alias("a"), "b").where("a <> b")
    )
    roots = common.components(links.unionByName(several))
    named = rows.join(names, "same", "left").withColumn("node", F.coalesce("node", "id"))
    named = named.join(roots, "node", "left")
    root = F.when(F.col("n") > 0, F.least(F.coalesce("root", "node"), "id")).otherwise(F.col("id"))
    return named.select(
        common.real_id("id").alias("id"), F.col("n").alias("n_shingles"),
        common.real_id(root).alias("component_id"), (F.col("id") == root).alias("kept"),
    )
