"""Quality rules, line first: bad lines go, then documents that lose too much text.

Each line is judged by its punctuation, as navigation and as boilerplate. A document is
rejected when the lines removed hold too large a share of its word characters, or when its
whole text fails the base rules on length and repetition.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm import common

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
SYMBOLS = "#*$%&|<>"
# Lines with a larger share of symbols than this are not prose.
MAX_SYMBOL_SHARE = 0.08
# Separators of menus and breadcrumbs; as many as a third of the words mark navigation.
SEPARATORS = "|>»›•·"
MIN_SEPARATORS = 3
# Lines of at least so many words without a single lower-case letter are shouted.
MIN_SHOUTED_WORDS = 5
# A document may lose this share of its word characters.
MAX_LOST_SHARE = 0.3
BOILERPLATE = (
    "all rights reserved", "accept cookies", "click here", "cookie policy", "copyright (c)",
    "enable javascript", "licensed under", "lorem ipsum", "privacy policy", "released under",
    "sign up now", "subscribe now", "terms of service", "terms of use", "uses cookies", "©",
)


def repeated_words(frame: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` to rows with words in ``w``: words in windows found twice.

    Windows are compared by 64-bit hashes within a text, made by joining the hashes of
    neighbouring runs of one, two and four words. Only texts in which some window
    repeats are sorted; what they cover is summed over the sorted window starts.
    """
    frame = frame.withColumn("run1", F.transform("w", lambda word: F.xxhash64(word)))
    for width in (1, 2, 4):
        run, other = F.col(f"run{width}"), f"run{2 * width}"
        left = F.slice(run, F.lit(1), F.size(run) - width)
        right = F.slice(run, F.lit(1 + width), F.size(run) - width)
        joined = F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))
        frame = frame.withColumn(other, F.when(F.size(run) > width, joined))
    frame = frame.withColumnRenamed("run8", "windows").drop("run1", "run2", "run4")
    pairs = F.sort_array(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    frame = frame.withColumn("pairs", F.when(repeats, pairs)).drop("windows")
    none = F.lit(None).cast("struct<h:bigint,i:int>")
    last = F.size("pairs") - 1
    near = F.arrays_zip(
        F.col("pairs").alias("x"),
        F.concat(F.array(none), F.slice("pairs", 1, last)).alias("before"),
        F.concat(F.slice("pairs", 2, last), F.array(none)).alias("after"),
    )
    twice = F.filter(
        near,
        lambda n: F.coalesce(n["x"]["h"] == n["before"]["h"], F.lit(False))
        | F.coalesce(n["x"]["h"] == n["after"]["h"], F.lit(False)),
    )
    frame = frame.withColumn("at", F.sort_array(F.transform(twice, lambda n: n["x"]["i"])))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "at",
        zero,
        lambda state, at: F.struct(
            (state["total"] + at + WINDOW - F.greatest(state["end"], at)).alias("total"),
            (at + WINDOW).alias("end"),
        ),
        lambda state: state["total"].cast("long"),
    )
    return frame.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))


def count_of(text: Column, chars: str) -> Column:
    """How often any of the characters occurs; an absent one costs a plain search."""
    counts = [
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit(""))))
        / len(char.encode())
        for char in chars
    ]
    return sum(counts[1:], counts[0]).cast("long")


def word_chars(text: Column) -> Column:
    return F.char_length(text) - count_of(text, common.SPACES)


def any_of(text: Column, phrases: tuple[str, ...] | str) -> Column:
    found = [F.contains(text, F.lit(phrase)) for phrase in phrases]
    return reduce(or_, found)


def shouted(line: Column) -> Column:
    gaps = count_of(line, common.SPACES)
    return (F.upper(line) == line) & (F.lower(line) != line) & (gaps >= MIN_SHOUTED_WORDS - 1)


def bad_line(line: Column) -> Column:
    """Whether a line fails a rule; blank lines fail none."""
    separators = count_of(line, SEPARATORS)
    gaps = count_of(line, common.SPACES)
    return (
        (count_of(line, SYMBOLS) > MAX_SYMBOL_SHARE * F.char_length(line))
        | ((separators >= MIN_SEPARATORS) & (3 * separators >= gaps))
        | shouted(line)
        | any_of(F.lower(line), BOILERPLATE)
    )


def clean_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: base counts, the cleaned text and the verdict.

    Columns: ``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines, n_bad_lines, cleaned, kept``. A null or empty text has no words
    and fails the base rules; a null id stays null; repeated rows are judged one by one; an
    empty table gives no rows. No other column is read.
    """
    frame = common.texts(docs, id_col, text_col)
    frame = frame.withColumn("w", common.words(F.col("text"))).withColumn(
        "lines", F.split("text", "\n")
    )
    frame = frame.withColumn("full", F.filter("lines", lambda x: F.btrim(x, F.lit(common.SPACES)) != ""))
    # Without any such mark in a text, its lines can only fail by being shouted.
    frame = frame.withColumn("low", F.lower("text"))
    marked = any_of(F.col("text"), SYMBOLS + SEPARATORS) | any_of(F.col("low"), BOILERPLATE)
    good = F.when(marked, F.filter("lines", lambda x: ~bad_line(x))).otherwise(
        F.filter("lines", lambda x: ~shouted(x))
    )
    frame = frame.withColumn("good", good)
    frame = frame.select(
        "id",
        "w",
        F.size("w").cast("long").alias("n_words"),
        word_chars(F.col("text")).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_bad_lines"),
        F.when(F.size("good") == F.size("lines"), F.col("text"))
        .otherwise(F.array_join("good", "\n"))
        .alias("cleaned"),
    )
    frame = repeated_words(frame)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    left = F.when(F.col("n_bad_lines") == 0, F.col("word_chars")).otherwise(
        word_chars(F.col("cleaned"))
    )
    enough = left >= (1 - MAX_LOST_SHARE) * F.col("word_chars")
    return frame.select(
        common.real_id(F.col("id")).alias("id"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "n_lines", "n_bad_lines", "cleaned",
        (~failed & enough).alias("kept"),
    )
