"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic and one on windows of ordinary
running text. A text is cut into windows, and each window is compressed with either
dictionary: the fewer bytes the toxic one needs, the more toxic the window. A text's evidence
is the sum over its windows above a calibrated threshold, and that sum by the text's length. A
logistic curve fitted on texts kept aside turns both into a score, so a long text is not toxic
for a few chance matches.

A toxic text is mostly ordinary, so the toxic dictionary is trained on those of its windows
that hold a sequence of bytes which more toxic documents hold than chance allows. Ordinary
words that it shortens all the same are added to the ordinary dictionary.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm import common
from codestrata.llm.tokens import by_bytes

common.ship(__name__)
common.ship("codestrata.llm.tokens")

# Documents of either label, and the bytes of the longest of them, in the training sample.
TOXIC_DOCUMENTS = 1500
ORDINARY_DOCUMENTS = 4000
SAMPLE_TEXT_BYTES = 1 << 15
DICTIONARY_BYTES = 1 << 13
CARRIER_BYTES = 24
# Sizes of the toxic dictionary that are tried.
TOXIC_DICTIONARY_BYTES = (1 << 11, 1 << 12)
SEGMENT_BYTES = 24
# Words of a window that a dictionary is trained on, and the windows of ordinary text.
TRAINING_WORDS = 3
ORDINARY_WINDOWS = 30_000
# One of so many sampled texts is kept aside for the calibration.
KEPT_ASIDE = 4
# Sequences of so many bytes, with the gaps around a word, are counted by documents.
GRAM_BYTES = 8
# A toxic sequence is found in so many toxic documents at least,
MIN_DOCUMENTS = 4
# ... and by so many standard deviations more often than chance allows.
EXCESS = 4.5
# Documents whose sequences are counted together.
COUNTED_DOCUMENTS = 500
LEVEL = 7
ROUNDS = 2
# Ordinary words added to the ordinary dictionary in a round.
CONFUSED_WORDS = 3000
# Evidence by length is that of so many words.
RATE_WORDS = 50
# Words whose lengths a task remembers.
REMEMBERED = 1 << 19
BATCH_BYTES = 8 << 20
EDGES = "\"'()*+,-./:;<=>?[]_`{|}~!#$%&@^\\"


@dataclass(frozen=True)
class Model:
    """Dictionaries, the threshold for a window, and the curve from evidence to score."""

    ordinary: bytes
    toxic: bytes
    threshold: int
    slope: float
    rate_slope: float
    middle: float

    def score(self, evidence: np.ndarray) -> np.ndarray:
        line = evidence @ np.array([self.slope, self.rate_slope]) - self.middle
        return 1 / (1 + np.exp(-np.clip(line, -700, 700)))


# Without both labels there is nothing to learn, and every score is low.
NEUTRAL = Model(b"        ", b"        ", 1 << 30, 1.0, 0.0, 10.0)


def windows(texts: pa.Array) -> pa.ListArray:
    """Windows of each text: its words, lower-cased and without punctuation at their ends.

    A window is as short as can be, so that what a word adds does not depend on its
    neighbours, and repeated windows are compressed once.
    """
    return pc.ascii_split_whitespace(pc.utf8_lower(texts))


def trimmed(values: pa.Array) -> pa.Array:
    return pc.utf8_trim(values, characters=EDGES)


class Gains:
    """Bytes that the toxic dictionary saves against the ordinary one, per window.

    The toxic dictionary is the ordinary text with toxic text before it, as toxic texts
    are mostly ordinary: matches in ordinary text then cost the same with either, and only
    toxic matches make a difference. A window stands between two carriers, pieces of ordinary
    text: a frame as short as one window would be stored uncompressed, and no match begins
    in a frame's last bytes.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard

        self.before, self.after = ordinary[-2 * CARRIER_BYTES : -CARRIER_BYTES], ordinary[-CARRIER_BYTES:]
        self.compressors = []
        for content in (ordinary, toxic + ordinary):
            known = zstandard.ZstdCompressionDict(content, zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=known, write_content_size=False,
                    write_checksum=False, write_dict_id=False,
                )
            )
        self.known: dict[str, int] = {}

    def __call__(self, word: str) -> int:
        gain = self.known.get(word)
        if gain is None:
            data = self.before + f" {word} ".encode() + self.after
            plain, toxic = (len(c.compress(data)) for c in self.compressors)
            gain = plain - toxic
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = gain
        return gain

    def of(self, values: pa.Array) -> np.ndarray:
        return np.fromiter(map(self, values.to_pylist()), np.int64, len(values))


@dataclass(frozen=True)
class Weighed:
    """Gains of the windows of several texts, the text of each, and the windows of a text."""

    gains: np.ndarray
    owners: np.ndarray
    lengths: np.ndarray

    def evidence(self, threshold: int) -> np.ndarray:
        """Gains above the threshold per text, in all and by length, both damped.

        Blank texts have none.
        """
        strong = self.gains >= threshold
        total = np.bincount(self.owners[strong], self.gains[strong], len(self.lengths))
        # A short text counts as one of RATE_WORDS words.
        rate = RATE_WORDS * total / np.maximum(self.lengths, RATE_WORDS)
        return np.stack([np.log1p(total), np.log1p(rate)], axis=1)


def weighed(texts: pa.Array, gains: Gains) -> Weighed:
    parts = windows(texts)
    coded = pc.list_flatten(parts).dictionary_encode()
    owners = pc.list_parent_indices(parts).to_numpy()
    own = gains.of(trimmed(coded.dictionary))[coded.indices.to_numpy()]
    return Weighed(own, owners, np.bincount(owners, minlength=len(texts)))


@dataclass
class Counted:
    """Words of the sample in order, and which of them hold a toxic sequence of bytes."""

    words: list[str]
    code: np.ndarray
    owner: np.ndarray
    marked: np.ndarray
    ordinary_documents: np.ndarray


def _counted(toxic: list[str], ordinary: list[str]) -> Counted:
    """Marks the words that hold a sequence which toxic documents have in excess."""
    parts = windows(pa.array(toxic + ordinary, pa.string()))
    coded = trimmed(pc.list_flatten(parts)).dictionary_encode()
    words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    owner = pc.list_parent_indices(parts).to_numpy().astype(np.int64)
    # Sequences of every word.
    numbers: dict[bytes, int] = {}
    flat, ends = [], [0]
    for word in words:
        data = b" " + word.encode() + b" "
        if word:
            flat += [numbers.setdefault(data[i : i + GRAM_BYTES], len(numbers))
                     for i in range(max(1, len(data) - GRAM_BYTES + 1))]
        ends.append(len(flat))
    flat, ends = np.array(flat, np.int64), np.array(ends, np.int64)
    found = np.zeros((2, max(1, len(numbers))), np.int64)
    by_word = np.zeros(max(1, len(words)), np.int64)
    for first in range(0, len(toxic) + len(ordinary), COUNTED_DOCUMENTS):
        part = slice(*np.searchsorted(owner, [first, first + COUNTED_DOCUMENTS]))
        pairs = np.unique(owner[part] * len(words) + code[part])
        document, own = pairs // max(1, len(words)), pairs % max(1, len(words))
        by_word += np.bincount(own[document >= len(toxic)], minlength=len(by_word))
        sizes = np.diff(ends)[own]
        place = np.repeat(ends[1:][own] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        grams = np.unique(np.repeat(document, sizes) * len(numbers) + flat[place])
        document, grams = grams // max(1, len(numbers)), grams % max(1, len(numbers))
        for side in (0, 1):
            here = grams[(document >= len(toxic)) == side]
            found[side] += np.bincount(here, minlength=found.shape[1])
    share = len(toxic) / max(1, len(toxic) + len(ordinary))
    expected = np.maximum(found.sum(axis=0) * share, 1e-9)
    excess = (found[0] - expected) / np.sqrt(expected)
    good = (found[0] >= MIN_DOCUMENTS) & (excess > EXCESS)
    hits = np.concatenate([[0], np.cumsum(good[flat])]) if len(flat) else np.zeros(1, np.int64)
    return Counted(words, code, owner, hits[ends[1:]] > hits[ends[:-1]], by_word)


def _joined(words: list[str]) -> bytes:
    return "".join(f" {word} " for word in words).encode()


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on windows, no larger than an eighth of them."""
    import zstandard

    samples = sorted(set(samples))
    random.Random(size).shuffle(samples)  # an order without meaning
    size = min(size, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT_BYTES, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        # Too little text to train on: as it stands, where it fits.
        return b"".join(samples)[-max(size, 8) :] or b"        "


def _windows_around(counted: Counted, at: np.ndarray) -> list[bytes]:
    """Running text around words: so many words of the same document."""
    before = (TRAINING_WORDS - 1) // 2
    first = np.searchsorted(counted.owner, counted.owner[at])
    last = np.searchsorted(counted.owner, counted.owner[at], side="right")
    begins = np.maximum(first, at - before).tolist()
    ends = np.minimum(last, at - before + TRAINING_WORDS).tolist()
    return [_joined([counted.words[c] for c in counted.code[a:b].tolist()])
            for a, b in zip(begins, ends, strict=True)]


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Trains on most of the texts and calibrates on the others.

    The size of the toxic dictionary, the rounds in which ordinary words join the ordinary one,
    the threshold for a window and the curve are what classifies the texts kept aside best. The
    dictionaries are not trained again on all texts: the curve would no longer fit them.
    """
    train_t, train_o = [
        [text for i, text in enumerate(side) if i % KEPT_ASIDE] for side in (toxic, ordinary)
    ]
    held = [(text, 1) for i, text in enumerate(toxic) if i % KEPT_ASIDE == 0]
    held += [(text, 0) for i, text in enumerate(ordinary) if i % KEPT_ASIDE == 0]
    best, model = -1.0, NEUTRAL
    for plain, marked in _dictionaries(train_t, train_o):
        quality, *curve = _calibrated(plain, marked, held)
        if quality > best:
            best, model = quality, Model(plain, marked, *curve)
    return model


def _dictionaries(toxic: list[str], ordinary: list[str]) -> Iterator[tuple[bytes, bytes]]:
    """Ordinary and toxic dictionaries of every size, before and after each round."""
    counted = _counted(toxic, ordinary)
    ordinary_place = int(np.searchsorted(counted.owner, len(toxic)))
    at = np.flatnonzero(counted.marked[counted.code[:ordinary_place]])
    toxic_windows = _windows_around(counted, at)
    # Windows of ordinary text, evenly over all of it.
    step = max(TRAINING_WORDS, (len(counted.code) - ordinary_place) // ORDINARY_WINDOWS)
    at = np.arange(ordinary_place, len(counted.code), step)
    first = _trained(_windows_around(counted, at), DICTIONARY_BYTES)
    common_first = np.argsort(-counted.ordinary_documents, kind="stable")
    others = [counted.words[c] for c in common_first.tolist()
              if counted.ordinary_documents[c] and not counted.marked[c]]
    for size in TOXIC_DICTIONARY_BYTES:
        plain, marked = first, _trained(toxic_windows, size)
        yield plain, marked
        for _ in range(ROUNDS):
            gains = Gains(plain, marked)
            taken = [word for word in others if gains(word) > 1][:CONFUSED_WORDS]
            plain += _joined(taken[::-1])
            yield plain, marked


def _calibrated(
    plain: bytes, marked: bytes, held: list[tuple[str, int]]
) -> tuple[float, int, float, float, float]:
    """The best quality (F1 at a score of 0.3), its threshold, slopes and offset."""
    gains = Gains(plain, marked)
    texts = pa.array([text for text, _ in held], pa.string())
    truth = np.array([label for _, label in held], np.float64)
    best = (-1.0, 1 << 30, 1.0, 0.0, 10.0)
    found = weighed(texts, gains)
    for threshold in range(1, 8):
        values = found.evidence(threshold)
        curve = _logistic(values, truth)
        guess = Model(plain, marked, threshold, *curve).score(values) >= 0.3
        hits = float((guess & (truth == 1)).sum())
        quality = 2 * hits / max(1.0, float(guess.sum() + truth.sum()))
        if quality > best[0]:
            best = (quality, threshold, *curve)
    return best


def _logistic(values: np.ndarray, truth: np.ndarray) -> tuple[float, float, float]:
    """Slopes and offset of a logistic curve with a small penalty, by Newton's steps.

    Slopes are not negative: more evidence never lowers a score.
    """
    used = [0, 1]
    while True:
        design = np.column_stack([values[:, used], -np.ones(len(values))])
        weights, penalty = np.zeros(len(used) + 1), np.diag([0.01] * (len(used) + 1))
        for _ in range(50):
            chance = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
            curve = (design * (chance * (1 - chance))[:, None]).T @ design + penalty
            step = np.linalg.solve(curve, design.T @ (truth - chance) - penalty @ weights)
            weights = weights + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        wrong = [k for k, weight in zip(used, weights, strict=False) if weight < 0]
        if not wrong:
            break
        used = [k for k in used if k != wrong[0]]
    slopes = dict(zip(used, weights.tolist(), strict=False))
    return slopes.get(0, 0.0), slopes.get(1, 0.0), float(weights[-1])


def is_held_out(id_column: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 2 modulo 4."""
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(4)) == 2


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", documents: tuple[int, int] = (TOXIC_DOCUMENTS, ORDINARY_DOCUMENTS),
) -> Model:
    """A model from a sample of labelled documents: so many toxic and ordinary ones.

    The sample holds the texts of at most ``SAMPLE_TEXT_BYTES`` bytes whose ids have the
    smallest hashes, so it is bounded and the same in every run. Rows held out and rows
    without an id, text or label are not sampled. Without both labels every score is low.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where(F.col("id").isNotNull() & ~is_held_out(F.col("id"))).distinct()
    order = F.xxhash64("id")
    sides = []
    for label, most in zip((1, 0), documents, strict=True):
        # Ids are chosen before any text is read: a few more than needed, as some texts
        # are too long or missing.
        chosen = marks.where(F.col("label") == label).orderBy(order, "id").limit(2 * most)
        rows = (
            docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .where(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
            .join(chosen, "id")
            .orderBy(order, "text")
            .limit(most)
        )
        sides.append(rows.select(F.lit(1).alias("sample"), "label", "text"))
    # The sample has a fixed bound, so one task trains on it; the driver gets the model.
    schema = (
        "ordinary binary, toxic binary, threshold long, slope double, rate_slope double,"
        " middle double"
    )
    sample = sides[0].unionByName(sides[1])
    row = sample.groupBy("sample").applyInArrow(_fitted, schema).first()
    return Model(*map(_plain, row)) if row else NEUTRAL


def _plain(value):
    return bytes(value) if isinstance(value, bytearray) else value


def _fitted(sample: pa.Table) -> pa.Table:
    label = sample.column("label").to_numpy()
    texts = sample.column("text").to_pylist()
    sides = [sorted(t for t, mark in zip(texts, label, strict=True) if mark == side) for side in (1, 0)]
    model = fit(*sides) if all(sides) else NEUTRAL
    return pa.table({
        "ordinary": pa.array([model.ordinary], pa.binary()),
        "toxic": pa.array([model.toxic], pa.binary()),
        "threshold": pa.array([model.threshold], pa.int64()),
        "slope": pa.array([model.slope]), "rate_slope": pa.array([model.rate_slope]),
        "middle": pa.array([model.middle]),
    })


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows ``id, score``, one for every row of ``docs``; only texts are read for a score.

    Null, empty and blank texts have no evidence and get the lowest score; a null id stays
    null; repeated rows are scored one by one; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = None
        for whole in batches:
            gains = gains or Gains(model.ordinary, model.toxic)
            sizes = pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False)
            for batch in by_bytes(whole, sizes, BATCH_BYTES):
                found = weighed(batch.column("text"), gains)
                scores = model.score(found.evidence(model.threshold))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(scores)], ["id", "score"]
                )

    scored = common.texts(docs, id_col, text_col).mapInArrow(run, "id long, score double")
    return scored.withColumn("id", common.real_id("id"))


def toxic_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = 0.3,
) -> DataFrame:
    """Rows ``id, held_out, score, predicted`` with a model trained on ``labels``."""
    model = train(docs, labels, id_col, text_col)
    return score(docs, model, id_col, text_col).select(
        "id", is_held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
