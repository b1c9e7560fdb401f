"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the longest prefix found in the model's compiled character map,
and every byte of the result remembers the source byte it came from. The normalised text
is encoded by the library with its own normalisation switched off, and the pieces are
projected through the alignment to byte spans of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from codestrata.llm import common
from codestrata.llm.tokens import MARK, MODEL, by_bytes, model_path, safe_to_cut

common.ship(__name__)
common.ship("codestrata.llm.tokens")

# Bytes of text that are encoded together.
BATCH_BYTES = 2 << 20
# A text that is normalised as a whole is encoded in blocks of about as many bytes.
BLOCK_BYTES = 1 << 16
_MARK = MARK.encode()


class CharMap:
    """The compiled character map: a double-array trie and the replacements it points to."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, begin: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``begin`` and its replacement."""
        if not self.units:
            return None
        found, node = None, self._child(self.units[0])
        for at in range(begin, len(data)):
            node ^= data[at]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[at]:
                break
            unit = self.units[node]
            node ^= self._child(unit)
            if unit >> 8 & 1:
                found = at + 1 - begin, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, offset = found
        return length, self.replacements[offset : self.replacements.index(b"\0", offset)]


class Normaliser:
    """Normalised bytes of a text and, for each of them, the source byte it came from."""

    def __init__(self, rules):
        self.map = CharMap(rules.precompiled_charsmap)
        self.prefix = rules.add_dummy_prefix
        self.squeeze = rules.remove_extra_whitespaces
        self.mark = _MARK if rules.escape_whitespaces else b" "

    def steps(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """Source span and replacement of one key or one character after the other."""
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit is None:
                lead = data[at]
                length = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = length, data[at : at + length]
            yield at, at + hit[0], hit[1]
            at += hit[0]

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The alignment has one entry more than the result: where the text kept ends."""
        out, origin, data = bytearray(), [], text.encode()
        spaced, end = self.squeeze, 0
        for begin, stop, piece in self.steps(data):
            for value in piece.split(b" ") if b" " not in piece else _chars(piece):
                if value == b" " and self.squeeze:
                    if spaced:
                        continue
                    spaced = True
                elif value:
                    spaced = False
                    end = stop
                value = self.mark if value == b" " else value
                out += value
                origin += [begin] * len(value)
            if not self.squeeze:
                end = stop
        if self.squeeze:
            while out.endswith(self.mark):
                del out[-len(self.mark) :], origin[-len(self.mark) :]
        if self.prefix and out:
            first = origin[0]
            out[:0], origin[:0] = self.mark, [first] * len(self.mark)
        return bytes(out), np.array([*origin, end], np.int64)


def _chars(piece: bytes) -> list[bytes]:
    return [char.encode() for char in piece.decode()]


class Encoder:
    """Encodes batches of texts; repeated words of a batch are encoded once."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        spec.ParseFromString(self.library.serialized_model_proto())
        rules = spec.normalizer_spec
        if not spec.trainer_spec.byte_fallback or any(p.type == 4 for p in spec.pieces):
            raise ValueError("the model must fall back to bytes and have no user symbols")
        self.normalise = Normaliser(rules)
        self.plain = (
            not rules.precompiled_charsmap
            and rules.add_dummy_prefix
            and rules.escape_whitespaces
            and not rules.remove_extra_whitespaces
            and safe_to_cut(self.library)
        )
        self.cuttable = safe_to_cut(self.library)
        self.width = np.array(
            [1 if p.type == 6 else len(p.piece.encode()) for p in spec.pieces], np.int64
        )
        # Source bytes of a piece when nothing but spaces was replaced.
        self.source_width = np.array(
            [w - 2 * p.piece.count(MARK) if p.type != 6 else 1
             for w, p in zip(self.width, spec.pieces, strict=True)], np.int64
        )
        rules.precompiled_charsmap = b""
        rules.add_dummy_prefix = rules.remove_extra_whitespaces = False
        rules.escape_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())

    def one(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begins and ends of one text through the general normalisation."""
        normal, origin = self.normalise(text)
        ids = np.array(self._blocks(normal), np.int32)
        edges = np.concatenate(([0], np.cumsum(self.width[ids]))).astype(np.int64)
        return ids, origin[edges[:-1]], origin[edges[1:]]

    def _blocks(self, normal: bytes) -> list[int]:
        """Ids of normalised bytes, encoded block by block where it is safe to cut."""
        ids: list[int] = []
        begin = 0
        while begin < len(normal):
            stop = len(normal)
            if self.cuttable and stop - begin > BLOCK_BYTES:
                cut = normal.find(_MARK, begin + BLOCK_BYTES)
                while cut > 0 and normal[cut - 3 : cut] == _MARK:
                    cut = normal.find(_MARK, cut + 3)
                stop = cut if cut > 0 else stop
            ids += self.bare.encode(normal[begin:stop].decode())
            begin = stop
        return ids

    def batch(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens per text, and ids, begins and ends of all texts in a row."""
        parts = pc.split_pattern(values, " ")
        owners = pc.list_parent_indices(parts).to_numpy()
        flat = pc.list_flatten(parts)
        # Texts with runs of spaces or marks of their own, and models with a character
        # map, take the general way; all others are made of single-spaced words.
        odd = pc.match_substring(values, MARK).to_numpy(zero_copy_only=False).copy()
        odd[owners[pc.equal(flat, "").to_numpy(zero_copy_only=False)]] = True
        if not self.plain:
            odd[:] = True
        keep = ~odd[owners]
        coded = flat.filter(pa.array(keep)).dictionary_encode()
        vocabulary = [MARK + word for word in coded.dictionary.to_pylist()]
        per_word = self.bare.encode(vocabulary, num_threads=1)
        sizes = np.fromiter(map(len, per_word), np.int64, len(per_word))
        table = np.fromiter((i for word in per_word for i in word), np.int32, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy() if len(coded) else np.zeros(0, np.int64)
        lengths = sizes[which]
        counts = np.zeros(len(values), np.int64)
        np.add.at(counts, owners[keep], lengths)
        before = np.cumsum(lengths) - lengths
        ids = table[np.repeat(first[which] - before, lengths) + np.arange(int(lengths.sum()))]
        starts = np.cumsum(counts) - counts
        widths = self.source_width[ids]
        heads = starts[(counts > 0)]
        widths[heads] -= 1  # the leading mark of a text has no source
        ends = np.cumsum(widths)
        base = np.zeros(len(values), np.int64)
        filled = counts > 0
        base[filled] = ends[heads] - widths[heads]
        ends -= np.repeat(base, counts)
        begins = ends - widths
        if odd.any():
            return self._with_odd(values, odd, counts, starts, ids, begins, ends)
        return counts, ids, begins, ends

    def _with_odd(self, values, odd, counts, starts, ids, begins, ends):
        """Puts the texts that took the general way between the others."""
        columns: tuple[list, list, list] = ([], [], [])
        last = 0
        for row in np.flatnonzero(odd):
            stop = starts[row]
            own = self.one(values[int(row)].as_py())
            counts[row] = len(own[0])
            for column, whole, mine in zip(columns, (ids, begins, ends), own, strict=True):
                column += [whole[last:stop], mine]
            last = stop
        for column, whole in zip(columns, (ids, begins, ends), strict=True):
            column.append(whole[last:])
        return counts, *(np.concatenate(column) for column in columns)


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = MODEL,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Rows ``id, ids, begins, ends, decoded``, one for every row of ``docs``.

    ``ids`` are the piece ids, ``begins`` and ``ends`` the byte spans of the pieces in the
    original text, ``decoded`` what the library decodes the ids to. Null and empty texts
    have no pieces; a null id stays null; repeated rows are encoded one by one; an empty
    table gives no rows. No other column is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            encoder = encoder or Encoder(model_path(model))
            sizes = pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False)
            for batch in by_bytes(whole, sizes, batch_bytes):
                counts, ids, begins, ends = encoder.batch(batch.column("text"))
                edges = np.concatenate(([0], np.cumsum(counts)))
                offsets = pa.array(edges, pa.int32())
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.array(column, pa.int32()))
                    for column in (ids, begins, ends)
                ]
                rows = [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)]
                decoded = pa.array(encoder.library.decode(rows, num_threads=1), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), *lists, decoded],
                    ["id", "ids", "begins", "ends", "decoded"],
                )

    schema = "id long, ids array<int>, begins array<int>, ends array<int>, decoded string"
    encoded = common.texts(docs, id_col, text_col).mapInArrow(run, schema)
    return encoded.withColumn("id", common.real_id("id"))
