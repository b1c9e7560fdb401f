"""Removal of long byte strings that an earlier document holds, by merged Burrows-Wheeler
transforms.

A string of 50 bytes can only repeat where some anchor in it repeats: the smallest of the
hashed 20-byte grams it is made of. Text without an anchor that two documents share is
left out first. What remains are segments: the 50-byte strings around one anchor that
have it as their smallest. Equal segments are one, with the smallest id that holds it.

The segments of an anchor's bucket are split into shards, each with a Burrows-Wheeler
transform of its own. The transforms are merged by refining their interleave: every round
orders suffixes by one symbol more, reading nothing but the transforms. A suffix whose common
prefix with all others ends in a round leaves, as what it is extended to can only be alone
as well. Those left after 50 rounds form the repeated intervals, and the smallest id in an
interval tells which strings go.

An anchor around which very many segments stand is not given to one bucket. Its strings
go to the buckets of their own hashes instead, where equal ones meet, and a batch sends a
string once however many of its documents hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import common
from codestrata.llm.tokens import by_bytes

common.ship(__name__)
common.ship("codestrata.llm.tokens")

LENGTH = 50
GRAM = 20
# Grams in a string, and so the most strings that one anchor can stand for in a row.
REACH = LENGTH - GRAM + 1
# Text bytes per bucket of anchors, segments per shard, text bytes handled together.
BUCKET_BYTES = 16 << 20
SHARD_SEGMENTS = 4096
BATCH_BYTES = 8 << 20
# Runs around one anchor from which its strings are dealt by themselves, and segments
# that are merged together if they belong to several anchors.
HOT_RUNS = 1 << 14
# Marks such an anchor's key.
HOT = np.uint64(1 << 63)
# Buckets of such strings for each bucket of anchors, as there are more of them.
STRING_BUCKETS = 8


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at each position."""
    n = len(data) - GRAM + 1
    eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8))
    eights, total = eights.view(np.uint64).ravel(), np.zeros(n, np.uint64)
    for offset in (*range(0, GRAM - 8, 8), GRAM - 8):
        total ^= eights[offset : offset + n]
        total *= np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return total ^ (total >> np.uint64(32))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first start and end of the starts, for each run of strings with one anchor.

    Runs have ``REACH`` strings at most: a gram that follows itself starts a new run.
    """
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = gram_hashes(data)
    n, least, size = len(hashes) - REACH + 1, hashes, 1
    while 2 * size <= REACH:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    rest = REACH - size
    least = np.minimum(least[:n], least[rest : rest + n])
    starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    ends = np.append(starts[1:], n)
    long = ends - starts > REACH
    if long.any():
        pieces = [
            np.arange(a, b, REACH) if wide else np.array([a])
            for a, b, wide in zip(starts, ends, long, strict=True)
        ]
        starts = np.concatenate(pieces)
        ends = np.append(starts[1:], n)
    return least[starts], starts, ends


def keys_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 40 more bits of anchors.

    A bucket holds about a million anchors however many there are in all, so hardly any two
    share a key; if they do, text is looked at that does not repeat.
    """
    low = (hashes // np.uint64(buckets)) & np.uint64((1 << 40) - 1)
    return ((hashes % np.uint64(buckets)) << np.uint64(40)) | low


def announced(batch: pa.RecordBatch, buckets: int, number: int = 0) -> pa.RecordBatch:
    """What other batches must know of the anchors of this one, and what is settled here.

    An anchor is announced for the first and the last document of the batch that hold it,
    however many do; documents between them need no answer, as the anchor is shared. With
    the first comes the number of runs in the batch, as one more than its logarithm.
    """
    found = [anchors(np.frombuffer(text.as_buffer(), np.uint8))[0] for text in batch.column("text")]
    ids = batch.column("id").to_numpy()
    keys = keys_of(np.concatenate(found) if found else np.zeros(0, np.uint64), buckets)
    owners = np.repeat(ids, [len(f) for f in found])
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    runs = np.zeros(len(keys), np.uint8)
    runs[heads] = 1 + np.ceil(np.log2(np.diff(np.append(heads, len(keys))))).astype(np.uint8)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    keys, owners, runs = keys[fresh], owners[fresh], runs[fresh]
    edge = np.ones(len(keys), bool)
    edge[1:-1] = (keys[1:-1] != keys[:-2]) | (keys[1:-1] != keys[2:])
    out: dict[str, list] = {name: [] for name in _ANNOUNCED.names}
    where = (keys >> np.uint64(40)).astype(np.int64)
    for settled in (False, True):
        chosen = np.flatnonzero(edge != settled)
        chosen = chosen[np.lexsort((owners[chosen], where[chosen]))]
        cuts = np.flatnonzero(np.diff(where[chosen])) + 1
        for part in np.split(chosen, cuts) if len(chosen) else []:
            docs, counts = np.unique(owners[part], return_counts=True)
            out["bucket"].append(int(where[part[0]]))
            out["batch"].append(number)
            out["settled"].append(settled)
            out["docs"].append(docs.tobytes())
            out["counts"].append(counts.astype(np.int32).tobytes())
            out["keys"].append(keys[part].view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
            out["runs"].append(b"" if settled else runs[part].tobytes())
    return pa.RecordBatch.from_pydict(out, _ANNOUNCED)


_ANNOUNCED = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("settled", pa.bool_()),
                        ("docs", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()),
                        ("runs", pa.binary())])


def shared_anchors(rows: pa.Table, hot_runs: int = HOT_RUNS) -> pa.Table:
    """Per batch the anchors of one bucket that another document holds, too, by document.

    All documents are told alike which anchors have more than ``hot_runs`` runs, but for
    the rounding of a batch's runs to a power of two.
    """
    parts = []
    for row in rows.to_pylist():
        counts = np.frombuffer(row["counts"], np.int32)
        docs = np.repeat(np.frombuffer(row["docs"], np.int64), counts)
        wide = np.zeros((len(docs), 8), np.uint8)
        wide[:, :5] = np.frombuffer(row["keys"], np.uint8).reshape(-1, 5)
        keys = wide.view(np.uint64).ravel() | np.uint64(row["bucket"] << 40)
        runs = np.frombuffer(row["runs"], np.uint8) if row["runs"] else np.zeros(len(docs), np.uint8)
        batches = np.full(len(docs), row["batch"])
        parts.append((docs, keys, np.full(len(docs), row["settled"]), runs, batches))
    columns = [np.concatenate(column) for column in zip(*parts, strict=True)]
    order = np.lexsort((columns[0], columns[1]))
    docs, keys, settled, runs, batches = (column[order] for column in columns)
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    ends = np.append(starts[1:], len(keys))
    several = np.repeat(docs[starts] != docs[ends - 1], ends - starts)
    if len(keys):
        counts = np.where(runs, np.int64(1) << (np.maximum(runs, 1) - 1).astype(np.int64), 0)
        hot = np.add.reduceat(counts, starts) > hot_runs
        keys = np.where(np.repeat(hot, ends - starts), keys | HOT, keys)
    told = several | settled
    docs, keys, batches = docs[told], keys[told], batches[told]
    order = np.lexsort((docs, batches))
    docs, keys, batches = docs[order], keys[order], batches[order]
    own, firsts = np.unique(batches, return_index=True)
    cuts = firsts[1:]
    lists = [np.split(column, cuts) if len(own) else [] for column in (docs, keys)]
    return pa.table([pa.array(own, pa.int64()),
                     *(pa.array([x.tobytes() for x in parts], pa.binary()) for parts in lists)],
                    names=["batch", "docs", "keys"])


def by_document(rows: pa.Table) -> pa.Table:
    """Per document all its shared anchors, from the answers of all buckets to a batch."""
    docs, keys = (
        np.concatenate([np.frombuffer(x, kind) for x in rows.column(name).to_pylist()])
        for name, kind in (("docs", np.int64), ("keys", np.uint64))
    )
    order = np.argsort(docs, kind="stable")
    docs, keys = docs[order], keys[order]
    own, firsts = np.unique(docs, return_index=True)
    lists = np.split(keys, firsts[1:]) if len(own) else []
    return pa.table([pa.array(own, pa.int64()), pa.array([h.tobytes() for h in lists], pa.binary())],
                    names=["id", "keys"])


Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def segments(
    data: np.ndarray, runs: Runs, shared: np.ndarray, buckets: int
) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Anchor, starts, name and bytes of each segment whose anchor is shared, but not hot."""
    import xxhash

    hashes, starts, ends = runs
    chosen = np.isin(keys_of(hashes, buckets), shared)
    own, firsts, lasts = (column[chosen].tolist() for column in (hashes, starts, ends))
    text, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    contents = [text[a : b + LENGTH - 1] for a, b in zip(firsts, lasts, strict=True)]
    names = np.array([digest(content) for content in contents], np.uint64).view(np.int64).tolist()
    return zip(own, firsts, lasts, names, contents, strict=True)


def hot_strings(
    data: np.ndarray, runs: Runs, shared: np.ndarray, buckets: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and both hashes of the strings whose anchor is hot."""
    hot = shared[shared >= HOT] ^ HOT
    hashes, starts, ends = runs
    chosen = np.isin(keys_of(hashes, buckets), hot) if len(hot) else np.zeros(len(starts), bool)
    starts, sizes = starts[chosen], (ends - starts)[chosen]
    before = np.cumsum(sizes) - sizes
    places = np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))
    low, high = np.zeros(len(places), np.uint64), np.full(len(places), LENGTH, np.uint64)
    if len(places):
        eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8))
        eights = eights.view(np.uint64).ravel()
        for offset in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            word = eights[places + offset]
            low = (low ^ word) * np.uint64(0x9E3779B97F4A7C15)
            low ^= low >> np.uint64(29)
            high = (high + word) * np.uint64(0xC2B2AE3D27D4EB4F)
            high ^= high >> np.uint64(31)
        low = low * np.uint64(0xD6E8FEB86659FD93)
        high = high * np.uint64(0x165667B19E3779F9)
        low, high = low ^ (low >> np.uint64(32)), high ^ (high >> np.uint64(32))
    return places, low, high


def first_holders(
    docs: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each document's different strings in order, and which of them a smaller one holds."""
    order = np.lexsort((docs, low, high))
    docs, low, high = docs[order], low[order], high[order]
    other, fresh = np.ones(len(docs), bool), np.ones(len(docs), bool)
    other[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    fresh[1:] = other[1:] | (docs[1:] != docs[:-1])
    least = docs[other][np.cumsum(other) - 1]
    return docs[fresh], low[fresh], high[fresh], (docs > least)[fresh]


def name_of(digest: int) -> int:
    """A hash as a signed number."""
    return digest - (1 << 64) if digest >> 63 else digest


class Shard:
    """The Burrows-Wheeler transform of some segments, with the places of its suffixes.

    Symbols are bytes plus one, which no byte of UTF-8 text overflows; 0 ends a segment.
    """

    def __init__(self, contents: list[bytes]):
        width = max(map(len, contents)) + 1
        lengths = np.array([len(c) for c in contents])
        wide = np.zeros((len(contents), 2 * width), np.uint8)
        for row, content in enumerate(contents):
            wide[row, : len(content)] = np.frombuffer(content, np.uint8) + 1
        row, offset = np.nonzero(np.arange(width) <= lengths[:, None])
        suffixes = np.lib.stride_tricks.sliding_window_view(wide, width, axis=1)[row, offset]
        order = np.argsort(np.ascontiguousarray(suffixes).view(f"S{width}").ravel(), kind="stable")
        self.segment, self.offset = row[order], offset[order]
        before = wide[self.segment, np.maximum(self.offset - 1, 0)]
        self.symbols = np.where(self.offset > 0, before, 0).astype(np.uint8)

    def steps(self) -> np.ndarray:
        """For each suffix the place of the suffix that is one symbol longer."""
        order = np.argsort(self.symbols, kind="stable")
        places = np.empty(len(order), np.int64)
        places[order] = np.arange(len(order))
        return places


def merge(shards: list[Shard], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share ``depth`` symbols with others: interleaved places, and intervals.

    Places are those in the shards put one after the other. Only suffixes far enough from the
    begin of their segment are followed, to the one that is ``depth`` symbols longer.
    """
    bases = np.cumsum([0, *(len(s.symbols) for s in shards)])
    symbols = np.concatenate([s.symbols for s in shards])
    longer = np.concatenate([s.steps() + base for s, base in zip(shards, bases, strict=False)])
    places = np.flatnonzero(np.concatenate([s.offset for s in shards]) >= depth)
    group = np.zeros(len(places), np.int64)
    for _ in range(depth):
        read = symbols[places]
        order = np.argsort(read, kind="stable")
        read, group, places = read[order], group[order], longer[places[order]]
        fresh = np.ones(len(places), bool)
        fresh[1:] = (read[1:] != read[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(fresh)
        shared = ~(fresh & np.append(fresh[1:], True)[: len(fresh)])
        places, group = places[shared], group[shared]
    return places, group


def judged(contents: list[bytes], docs: np.ndarray) -> np.ndarray:
    """A bit for every string of each segment that a smaller document holds elsewhere."""
    shards = [Shard(contents[i : i + SHARD_SEGMENTS])
              for i in range(0, len(contents), SHARD_SEGMENTS)]
    places, interval = merge(shards)
    masks = np.zeros(len(contents), np.int64)
    if not len(places):
        return masks
    segment = np.concatenate([s.segment + i * SHARD_SEGMENTS for i, s in enumerate(shards)])[places]
    offset = np.concatenate([s.offset for s in shards])[places]
    starts = np.concatenate(([0], np.flatnonzero(np.diff(interval)) + 1))
    least = np.repeat(np.minimum.reduceat(docs[segment], starts),
                      np.diff(np.append(starts, len(segment))))
    late = least < docs[segment]
    np.bitwise_or.at(masks, segment[late], np.int64(1) << offset[late])
    return masks


def offered(batch: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """The different segments of a batch, each with its smallest document.

    Any larger document of the batch that has the segment loses it whole, whatever other
    batches hold, so that is settled here and only the smallest waits for a verdict. The
    same holds for each string of hot anchors, which are offered by hashes.
    """
    first: dict[bytes, tuple[int, int]] = {}
    settled: set[tuple[int, int]] = set()
    strings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for doc, data, shared in sorted(_shared_texts(batch), key=lambda item: item[0]):
        runs = anchors(data)
        for anchor, _, _, name, content in segments(data, runs, shared, buckets):
            known = first.setdefault(content, (doc, anchor))
            if known[0] < doc:
                settled.add((doc, name))
        _, low, high = hot_strings(data, runs, shared, buckets)
        if len(low):
            strings.append((np.full(len(low), doc), low, high))
    out: dict[str, list] = {name: [] for name in _OFFERED.names}
    by_bucket: dict[int, list[tuple[int, int, bytes]]] = {}
    for content, (doc, anchor) in first.items():
        by_bucket.setdefault(anchor % buckets, []).append((doc, anchor, content))
    for bucket, entries in by_bucket.items():
        out["bucket"].append(bucket)
        out["settled"].append(False)
        out["strings"].append(False)
        out["docs"].append(np.array([e[0] for e in entries], np.int64).tobytes())
        out["numbers"].append(np.array([e[1] for e in entries], np.uint64).tobytes())
        out["sizes"].append(np.array([len(e[2]) for e in entries], np.uint8).tobytes())
        out["contents"].append(b"".join(e[2] for e in entries))
    pairs = sorted(settled)
    for begin in range(0, len(pairs), 1 << 16):
        part = np.array(pairs[begin : begin + (1 << 16)], np.int64)
        out["bucket"].append(int(part[0, 0]) % buckets)
        out["settled"].append(True)
        out["strings"].append(False)
        out["docs"].append(part[:, 0].tobytes())
        out["numbers"].append(part[:, 1].tobytes())
        out["sizes"].append(b"")
        out["contents"].append(b"")
    if strings:
        docs, low, high, late = first_holders(*map(np.concatenate, zip(*strings, strict=True)))
        where = (high % np.uint64(STRING_BUCKETS * buckets)).astype(np.int64) + buckets
        for done in (False, True):
            chosen = np.flatnonzero(late == done)
            # What is settled is dealt by documents, what waits by strings.
            chosen = chosen[np.argsort(docs[chosen] if done else where[chosen], kind="stable")]
            cuts = (np.arange(1 << 16, len(chosen), 1 << 16) if done
                    else np.flatnonzero(np.diff(where[chosen])) + 1)
            for part in np.split(chosen, cuts) if len(chosen) else []:
                out["bucket"].append(int(docs[part[0]]) % buckets if done else int(where[part[0]]))
                out["settled"].append(done)
                out["strings"].append(True)
                out["docs"].append(docs[part].tobytes())
                out["numbers"].append(low[part].tobytes())
                out["sizes"].append(b"")
                out["contents"].append(b"" if done else high[part].tobytes())
    return pa.RecordBatch.from_pydict(out, _OFFERED)


_OFFERED = pa.schema([("bucket", pa.int64()), ("settled", pa.bool_()), ("strings", pa.bool_()),
                      ("docs", pa.binary()), ("numbers", pa.binary()), ("sizes", pa.binary()), ("contents", pa.binary())])


def verdicts(rows: pa.Table) -> pa.Table:
    """For each document the segments of one bucket it loses: all strings (-1) or a mask.

    Lost strings of hot anchors come together, as hashes, without a name.
    """
    import xxhash

    lost_docs, lost_strings = [], []
    hot: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    docs, numbers, contents = [], [], []
    for row in rows.to_pylist():
        owners = np.frombuffer(row["docs"], np.int64)
        if row["strings"]:
            low = np.frombuffer(row["numbers"], np.uint64)
            if row["settled"]:
                lost_docs.append(owners)
                lost_strings.append(low)
            else:
                hot.append((owners, low, np.frombuffer(row["contents"], np.uint64)))
            continue
        if row["settled"]:
            names = np.frombuffer(row["numbers"], np.int64)
            done.append((owners, names, np.full(len(owners), -1)))
            continue
        docs.append(owners)
        numbers.append(np.frombuffer(row["numbers"], np.uint64))
        edges = np.concatenate(([0], np.cumsum(np.frombuffer(row["sizes"], np.uint8), dtype=np.int64)))
        data = row["contents"]
        contents += [data[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    if contents:
        doc, anchor = np.concatenate(docs), np.concatenate(numbers)
        place: dict[bytes, int] = {}
        which = np.fromiter((place.setdefault(c, len(place)) for c in contents), np.int64)
        least = np.full(len(place), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        firsts = np.unique(which, return_index=True)[1]
        _, groups, sizes = np.unique(anchor[firsts], return_inverse=True, return_counts=True)
        masks = np.zeros(len(place), np.int64)
        several = np.flatnonzero(sizes[groups] > 1)
        several = several[np.argsort(groups[several], kind="stable")]
        # Anchors are judged some at a time, but the segments of one together.
        heads = np.flatnonzero(np.diff(groups[several], prepend=-1))
        heads = heads[np.flatnonzero(np.diff(heads // HOT_RUNS, prepend=-1))]
        for part in np.split(several, heads[1:]) if len(several) else []:
            masks[part] = judged([contents[firsts[i]] for i in part], least[part])
        verdict = np.where(doc > least[which], -1, masks[which])
        lost = np.flatnonzero(verdict)
        names = [name_of(xxhash.xxh3_64_intdigest(contents[i])) for i in lost.tolist()]
        done.append((doc[lost], np.array(names, np.int64), verdict[lost]))
    columns = [np.concatenate(c) for c in zip(*done, strict=True)] if done else [[], [], []]
    whole = pa.table([*(pa.array(c, pa.int64()) for c in columns),
                      pa.nulls(len(columns[0]), pa.binary())], names=_VERDICT)
    if hot:
        owners, low, _, late = first_holders(*map(np.concatenate, zip(*hot, strict=True)))
        lost_docs.append(owners[late])
        lost_strings.append(low[late])
    if not lost_docs:
        return whole
    owners, low = np.concatenate(lost_docs), np.concatenate(lost_strings)
    order = np.argsort(owners, kind="stable")
    own, begins = np.unique(owners[order], return_index=True)
    lists = np.split(low[order], begins[1:]) if len(own) else []
    nothing = pa.array(np.zeros(len(own), np.int64))
    parts = pa.table([pa.array(own, pa.int64()), nothing, nothing,
                      pa.array([x.tobytes() for x in lists], pa.binary())], names=_VERDICT)
    return pa.concat_tables([whole, parts])


_VERDICT = ["id", "name", "mask", "strings"]


def cut(
    data: np.ndarray, shared: np.ndarray, known: dict[int, int], lost: np.ndarray, buckets: int
):
    """Bytes that stay, and begins and ends of the runs that go."""
    gone = np.zeros(len(data) + 1, np.int32)
    runs = anchors(data) if known or len(lost) else None
    if len(lost):
        places, low, _ = hot_strings(data, runs, shared, buckets)
        places = places[np.isin(low, lost)]
        gone[places] += 1
        gone[places + LENGTH] -= 1
    begins, stops = [], []
    for _, start, end, name, _ in segments(data, runs, shared, buckets) if known else ():
        mask = known.get(name, 0)
        if mask == -1:
            begins.append(start)
            stops.append(end - 1 + LENGTH)
        elif mask:
            places = [start + offset for offset in range(end - start) if mask >> offset & 1]
            begins += places
            stops += [place + LENGTH for place in places]
    np.add.at(gone, np.array(begins, np.int64), 1)
    np.subtract.at(gone, np.array(stops, np.int64), 1)
    covered = np.cumsum(gone[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return data[~covered].tobytes(), edges[::2], edges[1::2]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES, hot_runs: int = HOT_RUNS,
) -> DataFrame:
    """Rows ``id, n_bytes, n_removed, begins, ends, kept``, one for every row of ``docs``.

    ``begins`` and ``ends`` are the maximal runs of bytes covered by a 50-byte string that
    also starts in a document with a smaller id, ``kept`` the bytes left (which may cut
    characters). Null and empty texts have none; rows that repeat an id never take from
    each other; a null id is smaller than all others and stays null. An empty table gives
    no rows. No other column is read.
    """
    texts = common.texts(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = size // bucket_bytes + 1

    def announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbered by partition, so that a task that runs again gives the same numbers.
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(_sized(batches)):
            yield announced(batch, buckets, first + number)

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sized(batches):
            yield offered(batch, buckets)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sized(batches):
            known_lists = batch.column("known").to_pylist()
            out: list[tuple] = []
            for (doc, data, shared), known in zip(_shared_texts(batch), known_lists, strict=True):
                verdict: dict[int, int] = {}
                lost = [np.zeros(0, np.uint64)]
                for one in known or ():
                    if one["strings"] is None:
                        verdict[one["name"]] = verdict.get(one["name"], 0) | one["mask"]
                    else:
                        lost.append(np.frombuffer(one["strings"], np.uint64))
                kept, begins, ends = cut(data, shared, verdict, np.concatenate(lost), buckets)
                out.append((doc, len(data), len(data) - len(kept), begins, ends, kept))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()),
                     pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                ["id", "n_bytes", "n_removed", "begins", "ends", "kept"],
            )

    told = texts.mapInArrow(
        announce, "bucket long, batch long, settled boolean, docs binary, counts binary,"
        " keys binary, runs binary"
    )
    answers = told.groupBy("bucket").applyInArrow(
        lambda rows: shared_anchors(rows, hot_runs), "batch long, docs binary, keys binary"
    )
    # A batch has bounded text, so all that is answered to it fits a task.
    answers = answers.groupBy("batch").applyInArrow(by_document, "id long, keys binary")
    answers = common.staged(answers, "anchors")
    flagged = answers.groupBy("id").agg(F.collect_list("keys").alias("keys"))
    # The texts are moved to their answers once: both uses below read the same exchange.
    marked = texts.join(flagged.hint("shuffle_hash"), "id", "left")
    offers = marked.where(F.col("keys").isNotNull()).mapInArrow(
        offer, "bucket long, settled boolean, strings boolean, docs binary, numbers binary,"
        " sizes binary, contents binary"
    )
    found = offers.groupBy("bucket").applyInArrow(
        verdicts, "id long, name long, mask long, strings binary"
    )
    own = found.groupBy("id").agg(F.collect_list(F.struct("name", "mask", "strings")).alias("known"))
    ready = marked.join(own.hint("shuffle_hash"), "id", "left")
    result = ready.mapInArrow(
        finish, "id long, n_bytes long, n_removed long, begins array<long>, "
        "ends array<long>, kept binary"
    )
    return result.withColumn("id", common.real_id("id"))


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        sizes = pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False)
        yield from by_bytes(whole, sizes, BATCH_BYTES)


def _shared_texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Id, bytes and shared anchors' keys of each document."""
    rows = zip(batch.column("id").to_pylist(), batch.column("text"),
               batch.column("keys").to_pylist(), strict=True)
    for doc, text, lists in rows:
        parts = [np.frombuffer(one, np.uint64) for one in lists or ()]
        shared = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        yield doc, np.frombuffer(text.as_buffer(), np.uint8), shared
