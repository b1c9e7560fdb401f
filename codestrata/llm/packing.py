"""Packing token sequences to full length with balanced cost.

The cost of a piece is estimated as linear in its tokens plus quadratic, for attention within
the piece. Documents are taken from the longest to the shortest, and each goes to the sequence
of lowest cost that still has room for it. Where none has, it is cut: the sequence of lowest
cost is filled and the rest goes on. The sequences of a group have exactly the room that its
documents need: as many full ones as fit, and powers of two for the rest, so none is padded.

A task packs the documents it reads in groups of bounded size, so nothing is shuffled. The
sequence ids hold the number of the partition: the same split of a table gives the same rows,
also when a task is run again.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from codestrata.llm import common
from codestrata.llm.tokens import by_bytes, model_path

common.ship(__name__)
common.ship("codestrata.llm.tokens")

MODEL = "word_bpe_49k.json"
END_ID = 2
CAPACITY = 4096
# Cost of a piece of n tokens: n * (LINEAR + QUADRATIC * n).
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
# A group is packed when it holds so many tokens or documents.
GROUP_TOKENS = 1 << 22
GROUP_DOCUMENTS = 1 << 17
BATCH_BYTES = 16 << 20
# Remembered parts of words; beyond it a worker forgets them all and starts anew.
REMEMBERED = 1 << 20

SCHEMA = (
    "id long, start long, length long, ids binary, doc_tokens long, sequence_id long,"
    " offset long"
)
PUNCTUATION = r"[!-/:-@\[-`{-~]"
# Letters after lower-casing, within the scripts that the short way below takes.
LETTERS = "[a-zß-öø-ſ]"
PARTS = rf"^(?P<before>(?:{PUNCTUATION}*[!-&(-/:-@\[-`{{-~])?)(?P<core>{LETTERS}+)(?P<after>{PUNCTUATION}*)$"


class WordIds:
    """Ids of texts by the tokenizers library, each different word encoded once.

    Words stand between ASCII white space. A tokenizer that drops white space, composes,
    lower-cases and then parts letters from punctuation gives a text the ids of its words one
    after the other, and a word of letters with punctuation around it the ids of these parts.
    Other words go to the library whole, and so do texts if the tokenizer has other steps.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = drops_white_space(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        # Numbers of known parts and of whole words, which are marked by a leading space.
        self.numbers: dict[str, int] = {"": 0}
        self.flat, self.ends = array("I"), array("q", [0, 0])

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the end of each text's ids."""
        if self.by_word:
            lists = pc.ascii_split_whitespace(texts)
            coded = pc.list_flatten(lists).dictionary_encode()
            words = np.bincount(pc.list_parent_indices(lists).to_numpy(), minlength=len(texts))
            ids, ends = self.of_words(coded.dictionary)
            ids, ends = gathered(ids, ends, coded.indices.to_numpy())
            ends = np.concatenate([[0], ends])[np.cumsum(words)]
        else:
            found = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            ids = np.array([i for item in found for i in item.ids], np.uint32)
            ends = np.cumsum([len(item.ids) for item in found])
        if len(self.numbers) > REMEMBERED:
            self.forget()
        return ids, ends

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, one after the other, and the end of each word's ids."""
        normal = self.normal(words).dictionary_encode()
        parts = pc.extract_regex(normal.dictionary, PARTS)
        form = normal.indices.to_numpy(zero_copy_only=False)
        # A special string may stand in a word that holds its opening mark.
        marked = pc.match_substring(words, "<|")
        plain = pc.and_not(parts.is_valid().take(normal.indices), marked)
        plain = plain.to_numpy(zero_copy_only=False)
        columns = [pc.fill_null(pc.struct_field(parts, [k]), "") for k in range(3)]
        coded = pa.concat_arrays(columns).dictionary_encode()
        numbers = self.numbered(coded.dictionary.to_pylist(), self.encoded_parts)
        numbers = numbers[coded.indices.to_numpy()].reshape(3, -1).T[form]
        whole = np.flatnonzero(~plain)
        numbers[whole] = 0
        rest = [" " + word for word in words.take(pa.array(whole)).to_pylist()]
        numbers[whole, 0] = self.numbered(rest, self.encoded_words)
        flat, ends = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.ends, np.int64)
        ids, ends = gathered(flat, ends[1:], numbers.ravel())
        return ids, ends[2::3]

    def normal(self, words: pa.Array) -> pa.Array:
        """Words as the tokenizer normalises them; for ASCII that is lower case alone."""
        is_ascii = pc.string_is_ascii(words)
        others = words.filter(pc.invert(is_ascii)).to_pylist()
        found = []
        for begin in range(0, len(others), 4096):
            block = others[begin : begin + 4096]
            normal = self.tokenizer.normalizer.normalize_str(" ".join(block)).split(" ")
            # Other white space within a word becomes a space; such words go whole.
            found += normal if len(normal) == len(block) else [""] * len(block)
        return pc.replace_with_mask(
            pc.ascii_lower(words), pc.invert(is_ascii), pa.array(found, pa.string())
        )

    def numbered(self, values: list[str], encoded) -> np.ndarray:
        """Number of each value; those not known yet are encoded."""
        known = self.numbers
        fresh = [value for value in values if value not in known]
        known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
        for ids in encoded(fresh):
            self.flat.extend(ids)
            self.ends.append(len(self.flat))
        return np.fromiter(map(known.__getitem__, values), np.int64, len(values))

    def encoded_parts(self, parts: list[str]) -> Iterator[list[int]]:
        """Ids of letters or of punctuation alone."""
        tokenize = self.model.tokenize
        for part in parts:
            if not part.isascii():
                part = "".join([BYTE_LETTERS[b] for b in part.encode()])
            yield [token.id for token in tokenize(part)]

    def encoded_words(self, words: list[str]) -> Iterator[list[int]]:
        for begin in range(0, len(words), 1024):
            block = [word[1:] for word in words[begin : begin + 1024]]
            for item in self.tokenizer.encode_batch_fast(block, add_special_tokens=False):
                yield item.ids


def gathered(
    flat: np.ndarray, ends: np.ndarray, numbers: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The lists of the given numbers, one after the other, and the end of each."""
    lengths = np.diff(ends, prepend=0)[numbers]
    behind = np.cumsum(lengths)
    total = int(behind[-1]) if len(behind) else 0
    place = np.repeat(ends[numbers] - behind, lengths)
    place += np.arange(total)
    return (flat[place] if total else np.zeros(0, np.uint32)), behind


def word_ids(path: str) -> WordIds:
    """The encoder of this worker process, which keeps the words it knows between tasks."""
    kept = sys.modules.setdefault("codestrata_kept", ModuleType("codestrata_kept"))
    encoders = kept.__dict__.setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = WordIds(path)
    return encoders[path]


def drops_white_space(spec: dict) -> bool:
    """Whether the steps of a tokenizer are those that take a text word by word."""
    steps = [step["type"] for step in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and spec["normalizer"]["normalizers"][1] | {"type": ""}
        == {"type": "", "pattern": {"Regex": r"\s+"}, "content": " "}
        and [cut["type"] for cut in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"].get("Regex")
        == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
        and not cuts[1]["add_prefix_space"]
        and not cuts[1]["use_regex"]
        and spec["model"]["type"] == "BPE"
        and all(token["content"].startswith("<|") and not token["normalized"]
                and not token["lstrip"] and not token["rstrip"] and not token["single_word"]
                for token in spec["added_tokens"])
    )


def byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte.

    Visible bytes are written as themselves and the others from 256 on, in their order.
    """
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


BYTE_LETTERS = byte_letters()


def rooms(tokens: int, capacity: int) -> np.ndarray:
    """Room of each sequence for so many tokens: full ones, then powers of two."""
    rest = tokens % capacity
    powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return np.array([capacity] * (tokens // capacity) + powers, np.int64)


def pack(
    lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> np.ndarray:
    """Pieces as rows ``document, start, length, sequence, offset``."""
    size = rooms(int(lengths.sum()), capacity)
    room, cost = size.copy(), np.zeros(len(size))
    full = np.inf
    pieces = array("q")
    for document in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[document])
        while left:
            sequence = int(np.where(room >= left, cost, full).argmin())
            if room[sequence] < left:
                sequence = int(cost.argmin())  # full sequences cost more than any other
            taken = min(left, int(room[sequence]))
            offset = int(size[sequence] - room[sequence])
            pieces.extend((document, start, taken, sequence, offset))
            room[sequence] -= taken
            cost[sequence] += taken * (linear + quadratic * taken)
            if not room[sequence]:
                cost[sequence] = full
            start, left = start + taken, left - taken
    return np.frombuffer(pieces, np.int64).reshape(-1, 5)


class Packer:
    """Collects the ids of documents and packs a group of them at a time."""

    def __init__(self, partition: int, capacity: int):
        self.next_sequence, self.capacity = partition << 36, capacity
        self.clear()

    def clear(self) -> None:
        self.blocks: list[tuple[list, np.ndarray, np.ndarray]] = []
        self.tokens = self.documents = 0

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.blocks.append((doc_ids, ids, lengths))
        self.tokens += len(ids)
        self.documents += len(doc_ids)

    def group(self) -> Iterator[pa.RecordBatch]:
        doc_ids = np.array([i for block, _, _ in self.blocks for i in block], np.int64)
        ids = np.concatenate([block for _, block, _ in self.blocks])
        lengths = np.concatenate([block for _, _, block in self.blocks])
        self.clear()
        begins = np.cumsum(lengths) - lengths
        pieces = pack(lengths, self.capacity)
        base = self.next_sequence
        self.next_sequence += int(pieces[:, 3].max()) + 1
        for first in range(0, len(pieces), 4096):
            document, start, length, sequence, offset = pieces[first : first + 4096].T
            data = [ids[b : b + n].tobytes() for b, n in
                    zip((begins[document] + start).tolist(), length.tolist(), strict=True)]
            columns = [doc_ids[document], start, length, pa.array(data, pa.binary()),
                       lengths[document], sequence + base, offset]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c))
                 for c in columns],
                [field.split()[0] for field in SCHEMA.split(", ")],
            )


def with_ends(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with one more after each document, little-endian, and the documents' lengths."""
    lengths = np.diff(ends, prepend=0) + 1
    return np.insert(ids, ends, end_id).astype("<u4"), lengths


def packed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL,
    end_id: int = END_ID, capacity: int = CAPACITY,
) -> DataFrame:
    """Rows ``id, start, length, ids, doc_tokens, sequence_id, offset``, one for each piece.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers. Every id of a
    document, and ``end_id`` after them, is in one piece. Null and empty texts are the end id
    alone; a null id stays null; repeated rows are documents of their own; equal lengths keep
    the order in which they are read; an empty table gives no rows. No other column is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        packer = Packer(TaskContext.get().partitionId(), capacity)
        for whole in batches:
            sizes = pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False)
            for batch in by_bytes(whole, sizes, BATCH_BYTES):
                tokenizer = tokenizer or word_ids(model_path(model))
                ids, lengths = with_ends(*tokenizer.of(batch.column("text")), end_id)
                packer.add(batch.column("id").to_pylist(), ids, lengths)
                if packer.tokens >= GROUP_TOKENS or packer.documents >= GROUP_DOCUMENTS:
                    yield from packer.group()
        if packer.documents:
            yield from packer.group()

    found = common.texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)
    return found.withColumn("id", common.real_id("id"))
