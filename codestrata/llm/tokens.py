"""Token counts: batches of texts are encoded in Arrow functions that return lengths only.

A text is cut at safe boundaries first. A boundary is safe before a run of white-space
marks, when no piece of the vocabulary holds such a mark after another character: then no
merge can cross it, and the tokens of the parts are the tokens of the whole. The parts of a
batch are made distinct before they are encoded, and batches hold about equal bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm import common

common.ship(__name__)

MODEL = "piece_bpe_32k.model"
MARK = "▁"
# Bytes of text that are encoded together.
BATCH_BYTES = 8 << 20


def model_path(model: str) -> str:
    """Place of a vocabulary file on the machine that runs the task."""
    import public_tokenizers

    return model if "/" in model else public_tokenizers.path(model)


def by_bytes(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text stays alone."""
    start, ends = 0, np.cumsum(sizes)
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def safe_to_cut(processor) -> bool:
    """Whether no piece has a white-space mark after another character."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return not any(
        before != MARK and after == MARK
        for piece in pieces
        for before, after in zip(piece, piece[1:], strict=False)
    )


class PieceCounter:
    """Counts the tokens a SentencePiece model without a character map gives."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        spec.ParseFromString(self.processor.serialized_model_proto())
        rules = spec.normalizer_spec
        custom = any(piece.type == 4 for piece in spec.pieces)
        self.cuttable = (
            not rules.precompiled_charsmap
            and rules.add_dummy_prefix
            and rules.escape_whitespaces
            and not rules.remove_extra_whitespaces
            and not custom
            and self.processor.piece_to_id(MARK) != self.processor.unk_id()
            and safe_to_cut(self.processor)
        )

    def counts(self, values: pa.Array) -> np.ndarray:
        if not self.cuttable:
            encoded = self.processor.encode(values.to_pylist(), num_threads=1)
            return np.fromiter(map(len, encoded), np.int64, len(encoded))
        marked = pc.replace_substring(values, pattern=MARK, replacement=" ")
        parts = pc.split_pattern(marked, " ")
        owners = pc.list_parent_indices(parts).to_numpy()
        flat = pc.list_flatten(parts)
        empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
        totals = np.zeros(len(values), np.int64)
        # Words after a single space are looked up once; texts with runs of spaces go whole.
        runs = np.zeros(len(values), bool)
        runs[owners[empty]] = True
        plain = ~runs[owners]
        coded = flat.filter(pa.array(plain)).dictionary_encode()
        vocabulary = coded.dictionary.to_pylist()
        lengths = np.fromiter(
            map(len, self.processor.encode(vocabulary, num_threads=1)), np.int64, len(vocabulary)
        )
        if len(coded):
            np.add.at(totals, owners[plain], lengths[coded.indices.to_numpy()])
        for row in np.flatnonzero(runs):
            totals[row] = self.run_count(marked[int(row)].as_py())
        return totals

    def run_count(self, text: str) -> int:
        """Count of a text with runs of spaces, cut where a run begins."""
        if not text:
            return 0
        total, parts = 0, split_runs(text)
        for begin in range(0, len(parts), 4096):
            block = parts[begin : begin + 4096]
            whole = [part[1:] for part in block if part != " "]
            total += sum(map(len, self.processor.encode(whole, num_threads=1)))
            total += len(block) - len(whole)  # a lone mark is a piece, but no text gives it
        return total


def split_runs(text: str) -> list[str]:
    """Parts of a text with the leading mark added; each begins with its run of spaces."""
    import re

    return re.findall(r" +[^ ]*|[^ ]+", " " + text)


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = MODEL,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Rows ``id, n_bytes, n_tokens``, one for every row of ``docs``.

    Null and empty texts have no bytes and no tokens; a null id stays null; repeated rows
    are counted one by one; an empty table gives no rows. No other column is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, counter = model_path(model), None
        for whole in batches:
            sizes = pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False)
            for batch in by_bytes(whole, sizes, batch_bytes):
                counter = counter or counter_for(path)
                n_bytes = pc.cast(pc.binary_length(batch.column("text")), pa.int64())
                n_tokens = pa.array(counter.counts(batch.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), n_bytes, n_tokens], ["id", "n_bytes", "n_tokens"]
                )

    frame = common.texts(docs, id_col, text_col)
    counted = frame.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return counted.withColumn("id", common.real_id("id"))


def counter_for(path: str):
    """The counter for a vocabulary file: .model or .json."""
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


class JsonCounter:
    """Counts the tokens of a vocabulary in the tokenizers format; texts are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def counts(self, values: pa.Array) -> np.ndarray:
        encoded = self.tokenizer.encode_batch_fast(values.to_pylist(), add_special_tokens=False)
        return np.fromiter((len(item.ids) for item in encoded), np.int64, len(encoded))


def with_limit(counts: DataFrame, limit: int = 4096) -> DataFrame:
    """Adds whether the token limit is exceeded."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
