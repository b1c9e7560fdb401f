"""Line dedup: lines found in many documents are dropped from all but one of them.

Normalised lines are exploded with their positions and hashed, distinct documents are counted
per hash, and each text is put together again by position from what stands between the lines
that it loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm import common


def line_key(line: Column) -> Column:
    """A line without white space at its ends and with A to Z lower-cased."""
    return common.lower_ascii(F.btrim(line, F.lit(common.SPACES)))


def line_hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


def text_key(text: Column) -> list[Column]:
    """Two hashes that tell the texts of one id apart."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def repeated_lines(
    docs: DataFrame, id_col: str, text_col: str, min_documents: int, min_length: int
) -> DataFrame:
    """Rows ``id, first, second, positions``: the lines that a text of an id loses.

    Texts that lose none are absent; ``first`` and ``second`` are the keys of the text. Only
    hashes and positions are shuffled. A key that a third of all documents hold is first
    reduced to one row per document and then counted with partial sums, and only the join that
    marks its lines sees it as a group, which adaptive execution splits.
    """
    text = F.col("text")
    first, second = text_key(text)
    lines = common.texts(docs, id_col, text_col).select(
        "id", first.alias("first"), second.alias("second"),
        F.posexplode(F.split(text, "\n")).alias("position", "line"),
    )
    hashed = (
        lines.select("id", "first", "second", "position", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_length)
        .select("id", "first", "second", "position", line_hash(F.col("key")).alias("hash"))
    )
    frequent = (
        hashed.select("id", "hash").distinct()
        .groupBy("hash")
        .agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_documents)
        .drop("n")
    )
    # Rows equal in id and text lose the same lines.
    return (
        hashed.join(frequent, "hash")
        .where(F.col("id") != F.col("keeper"))
        .groupBy("id", "first", "second")
        .agg(F.array_sort(F.collect_set("position")).alias("positions"))
    )


def between(lines: Column, positions: Column) -> Column:
    """Lines that are at none of the positions, which ascend; every line is copied once."""
    ends = F.concat(positions, F.array(F.size(lines)))

    def stretch(end: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1) + 1)
        return F.slice(lines, start + 1, end - start)

    return F.flatten(F.transform(ends, stretch))


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_documents: int = 3,
    min_length: int = 20,
    report: str = "line_report",
) -> DataFrame:
    """``docs`` with cleaned texts and a struct column ``report(n_lines, n_dropped)``.

    A key of at least ``min_length`` code points found in at least ``min_documents``
    documents loses its lines except in the largest id that holds it. Null and empty texts
    are one empty line. All rows of one id count as one document and each keeps its row;
    a null id is one document, smaller than all others. Other columns pass through; one
    named as the report is replaced. An empty table gives an empty one.
    """
    drops = repeated_lines(docs, id_col, text_col, min_documents, min_length)
    names = {
        name: common.fresh(docs.columns, name)
        for name in ("own_id", "own_first", "own_second", "lost", "kept", "lines")
    }
    keys = [names[name] for name in ("own_id", "own_first", "own_second")]
    lost, kept, all_lines = (names[name] for name in ("lost", "kept", "lines"))
    drops = drops.select(
        F.col("id").alias(keys[0]), F.col("first").alias(keys[1]), F.col("second").alias(keys[2]),
        F.col("positions").alias(lost),
    )
    others = [column for column in docs.columns if column.lower() != report.lower()]
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.coalesce(F.col(id_col).cast("long"), F.lit(common.NO_ID)), *text_key(text)]
    joined = docs.select(
        *others, *(column.alias(name) for column, name in zip(own, keys, strict=True))
    ).join(drops.hint("shuffle_hash"), keys, "left")
    whole = F.col(lost).isNull()
    parts = joined.withColumn(all_lines, F.split(text, "\n")).withColumn(
        kept, F.when(~whole, between(F.col(all_lines), F.col(lost)))
    )
    counts = F.struct(
        F.size(all_lines).cast("long").alias("n_lines"),
        F.when(whole, F.lit(0)).otherwise(F.size(lost)).cast("long").alias("n_dropped"),
    )
    cleaned = F.when(whole, text).otherwise(F.array_join(kept, "\n"))
    columns = [cleaned.alias(c) if c == text_col else F.col(c) for c in others]
    return parts.select(*columns, counts.alias(report))
