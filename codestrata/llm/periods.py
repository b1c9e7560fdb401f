"""Runs of repeated words: stretches that are at least four periods long.

The words of a text are letters. Ukkonen's algorithm builds the suffix tree of the letters
and of their reversal; the longest common extension of two positions, to the right or to
the left, is the depth of a lowest common ancestor, which is a range minimum over an Euler
tour of the tree, kept where it passes from one leaf to the next. The root of a run is the
longest Lyndon word at one of its positions, in the order of the letters or in the reverse
order, so the Lyndon words of all positions are the candidates, and each is extended in both
directions.

A run of four periods holds each of its words four times. Words found less often in their
stretch of text therefore end a stretch, stretches are cut there again and again, and the
trees are built over what is left. No run is lost or shortened by that: a run is maximal, so
all of it stays together, and a word that went on with its period would belong to it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from codestrata.llm import common
from codestrata.llm.common import NO_ID
from codestrata.llm.tokens import by_bytes

common.ship(__name__)
common.ship("codestrata.llm.tokens")

# Whole periods a run has at least, and its least length in words.
PERIODS = 4
SHORTEST = 6
BATCH_BYTES = 8 << 20
# Rounds of cutting before the trees are built; more would only make the trees smaller.
CUTS = 6
BLOCK = 8

SCHEMA = (
    "id long, n_runs long, start long, length long, period long, exponent_milli long,"
    " runs_sha256 string, collapsed_sha256 string"
)


def suffix_tree(letters: list[int]) -> tuple[dict[int, int], list[int], int]:
    """Ukkonen's tree: children by ``node * sigma + letter``, depths of nodes, and sigma.

    The last letter must be unlike all others. Node 0 is the root. Leaves are made from the
    longest suffix to the shortest; their depth is given as -1.
    """
    n, sigma = len(letters), max(letters) + 1
    children: dict[int, int] = {}
    begin, stop, link, depth = [0], [0], [0], [0]
    node = edge = length = rest = 0
    for i, letter in enumerate(letters):
        rest += 1
        last = 0
        while rest:
            if not length:
                edge = i
            key = node * sigma + letters[edge]
            child = children.get(key)
            if child is None:
                children[key] = len(begin)
                begin.append(i)
                stop.append(n)
                link.append(0)
                depth.append(-1)
                if last:
                    link[last] = node
                    last = 0
            else:
                first, end = begin[child], stop[child]
                size = (end if end <= i else i + 1) - first
                if length >= size:
                    edge += size
                    length -= size
                    node = child
                    continue
                if letters[first + length] == letter:
                    if last:
                        link[last] = node
                    length += 1
                    break
                split, first = len(begin), first + length
                begin += (begin[child], i)
                stop += (first, n)
                link += (0, 0)
                depth += (rest - 1, -1)  # what is left of the suffix before this letter
                begin[child] = first
                children[key] = split
                children[split * sigma + letter] = split + 1
                children[split * sigma + letters[first]] = child
                if last:
                    link[last] = split
                last = split
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - rest + 1
    return children, depth, sigma


class RangeMinimum:
    """Minima of ranges in constant time: a table of powers of two over blocks of entries."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(values.dtype).max, values.dtype)
        padded[: len(values)] = values
        grid = padded.reshape(blocks, BLOCK)
        self.values = padded
        self.before = np.minimum.accumulate(grid, axis=1).ravel()
        self.after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [grid.min(axis=1)]
        while (step := 1 << (len(self.levels) - 1)) * 2 <= blocks:
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-step], below[step:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of ``values[low..high]``, both ends included."""
        first, last = low // BLOCK, high // BLOCK
        found = np.minimum(self.after[low], self.before[high])
        width = last - first - 1
        wide = np.flatnonzero(width > 0)
        level = np.frexp(width[wide].astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = wide[level == k]
            left, right = first[at] + 1, last[at] - (1 << k)
            inner = np.minimum(self.levels[k][left], self.levels[k][right])
            found[at] = np.minimum(found[at], inner)
        within = np.flatnonzero(first == last)
        if len(within):
            start, end = low[within], high[within]
            least = self.values[start]
            for step in range(1, BLOCK):
                least = np.minimum(least, self.values[np.minimum(start + step, end)])
            found[within] = least
        return found


class Extensions:
    """Longest common extensions of positions of a word, and the order of its suffixes."""

    def __init__(self, letters: list[int]):
        children, depth, sigma = suffix_tree(letters)
        keys = np.fromiter(children.keys(), np.int64, len(children))
        nodes = np.fromiter(children.values(), np.int64, len(children))
        order = np.argsort(keys)
        parents, nodes = keys[order] // sigma, nodes[order]
        depths = np.array(depth)
        above = np.zeros(len(depth), np.int64)
        above[nodes] = depths[parents]
        ends = np.cumsum(np.bincount(parents, minlength=len(depth)))
        firsts = np.concatenate([[0], ends[:-1]])
        firsts[depths < 0] = -1
        below, firsts, ends = nodes.tolist(), firsts.tolist(), ends.tolist()
        leaves: list[int] = []
        others: list[int] = []
        waiting: list[int] = []
        node = 0
        while True:
            while (first := firsts[node]) >= 0:
                waiting += below[ends[node] - 1 : first : -1]
                node = below[first]
            leaves.append(node)
            if not waiting:
                break
            # Between two children the tour is back at their parent.
            node = waiting.pop()
            others.append(node)
        in_order = np.array(leaves)
        by_suffix = np.sort(in_order)
        self.rank = np.empty(len(letters), np.int64)
        self.rank[np.searchsorted(by_suffix, in_order)] = np.arange(len(letters))
        self.least = RangeMinimum(above[np.array(others, np.int64)])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal letters from two different positions on."""
        a, b = self.rank[a], self.rank[b]
        return self.least(np.minimum(a, b), np.maximum(a, b) - 1)


def lyndon_ends(rank: list[int]) -> list[int]:
    """End of the longest Lyndon word at each position: the next suffix of smaller rank."""
    n = len(rank)
    ends, stack = [n] * n, []
    for i, value in enumerate(rank):
        while stack and rank[stack[-1]] > value:
            ends[stack.pop()] = i
        stack.append(i)
    return ends


def runs(letters: list[int]) -> np.ndarray:
    """Runs as rows ``begin, end, period``; first and last letter must occur only once."""
    n = len(letters)
    right, left = Extensions(letters), Extensions(letters[::-1])
    found = []
    at = np.arange(n)
    # No suffix is a prefix of another, so the reverse order of letters reverses the ranks.
    for rank in (right.rank, n - 1 - right.rank):
        ends = np.array(lyndon_ends(rank.tolist()))
        some = np.flatnonzero((ends < n) & (PERIODS * (ends - at) <= n) & (at > 0))
        i, j = some, ends[some]
        begin = i - left(n - i, n - j)
        end = j + right(i, j)
        period = j - i
        long = end - begin >= np.maximum(SHORTEST, PERIODS * period)
        found.append(np.stack([begin, end, period], axis=1)[long])
    return np.unique(np.concatenate(found), axis=0)


@dataclass
class Stretches:
    """What is left of a batch: word numbers, their places, and the stretch of each."""

    code: np.ndarray
    place: np.ndarray
    stretch: np.ndarray


def frequent_stretches(code: np.ndarray, owner: np.ndarray) -> Stretches:
    """Stretches of one text in which words occur often enough for a run, or nearly so."""
    left = Stretches(code, np.arange(len(code)), owner)
    for _ in range(CUTS):
        before = len(left.code)
        if not before:
            break
        key = left.stretch * (int(left.code.max()) + 1) + left.code
        _, number, counts = np.unique(key, return_inverse=True, return_counts=True)
        keep = counts[number] >= PERIODS
        place, stretch = left.place[keep], left.stretch[keep]
        fresh = np.ones(len(place), bool)
        fresh[1:] = (np.diff(place) != 1) | (np.diff(stretch) != 0)
        stretch = np.cumsum(fresh) - 1
        long = np.bincount(stretch, minlength=1)[stretch] >= SHORTEST
        left = Stretches(left.code[keep][long], place[long], stretch[long])
        if len(left.code) == before:
            break
    return left


def text_runs(code: np.ndarray, place: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Runs of one text's stretches as rows ``start, length, period``, by start and period."""
    _, word = np.unique(code, return_inverse=True)
    cuts = np.flatnonzero(np.diff(stretch)) + 1
    # Letters that occur once stand before, between and after the stretches.
    marks = word.max() + 1 + np.arange(len(cuts) + 2)
    ends = np.concatenate([[0], cuts, [len(word)]])
    letters = np.insert(word, ends, marks).tolist()
    places = np.insert(place, ends, -1)
    found = runs(letters)
    table = np.stack(
        [places[found[:, 0]], found[:, 1] - found[:, 0], found[:, 2]], axis=1
    )
    return table[np.lexsort((table[:, 2], table[:, 0]))]


def planted(code: np.ndarray, first: int, n: int, doc_id: int) -> None:
    """Repeats a part of every tenth text's words in place, as the id's checksum says."""
    checksum = zlib.crc32(str(doc_id).encode())
    if checksum % 10 or not n:
        return
    g = checksum // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    code[first + a : first + n] = code[first + a + np.arange(n - a) % p]


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words, the word numbers of all texts, and where each text's words begin."""
    parts = pc.ascii_split_whitespace(texts)
    coded = pc.list_flatten(parts).dictionary_encode()
    owner = pc.list_parent_indices(parts).to_numpy()
    code = coded.indices.to_numpy().astype(np.int64)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # before a leading and after a trailing gap
        owner, code = owner[code != empty], code[code != empty]
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
    return coded.dictionary, code, np.concatenate([[0], ends])


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def report(batch: pa.RecordBatch, plant: bool) -> pa.RecordBatch:
    """One row for each text of a batch."""
    ids = batch.column("id").to_pylist()
    words, code, ends = word_lists(batch.column("text"))
    if plant:
        for row, doc_id in enumerate(ids):
            if doc_id != NO_ID:
                planted(code, int(ends[row]), int(ends[row + 1] - ends[row]), doc_id)
    owner = np.repeat(np.arange(len(ids)), np.diff(ends))
    left = frequent_stretches(code, owner)
    bounds = np.searchsorted(left.place, ends)
    kept = np.ones(len(code), bool)
    tables: list[np.ndarray | None] = [None] * len(ids)
    for row in np.flatnonzero(np.diff(bounds)).tolist():
        part = slice(int(bounds[row]), int(bounds[row + 1]))
        table = text_runs(left.code[part], left.place[part], left.stretch[part])
        if len(table):
            for start, length, period in table.tolist():
                kept[start + period : start + length] = False
            table[:, 0] -= ends[row]
            tables[row] = table
    # The kept words of every text, joined by one space.
    sizes = np.concatenate([[0], np.cumsum(kept)])[ends].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(sizes), words.take(pa.array(code[kept])))
    joined = pc.binary_join(lists, " ")
    rows = []
    for doc_id, table, text in zip(ids, tables, joined, strict=True):
        digest = _sha(text.as_buffer() or b"")
        if table is None:
            rows.append((doc_id, 0, None, None, None, None, _sha(b""), digest))
            continue
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in table.tolist())
        start, length, period = min(table.tolist(), key=lambda run: (-run[1], run[0], run[2]))
        rows.append((doc_id, len(table), start, length, period, 1000 * length // period,
                     _sha(listed.encode()), digest))
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds, strict=True)], names
    )


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False
) -> DataFrame:
    """Runs of every text: their number, the longest, and digests of all and of what is kept.

    Of a run only its first period is kept. ``plant`` first repeats part of every tenth
    text's words, by the checksum of its id; rows without an id stay as they are. Null,
    empty and blank texts have no words and no runs, and the four columns of the longest run
    are null where there is none. Repeated rows are reported one by one, a null id stays
    null, and an empty table gives no rows. No other column is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False)
            for batch in by_bytes(whole, sizes, BATCH_BYTES):
                yield report(batch, plant)

    found = common.texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)
    return found.withColumn("id", common.real_id("id"))
