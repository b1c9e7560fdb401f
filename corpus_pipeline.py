"""A corpus run in stages: each reads what the one before it kept and wrote.

Toxic documents go, repeated lines go, one document of each group of near duplicates
stays, sources are mixed to their weights, and what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import common, lines, mixing, near_duplicates, pieces, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

WEIGHTS = [5, 2, 1]
# From this score on a text is toxic.
TOXIC_SCORE = 0.3
# Rows without an id are numbered by their text from here on, above all ids.
NO_ID_RANGE = 1 << 62
# SQL has neither trained dictionaries nor the tokenizer.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is not predicted as toxic; labels are learnt from, never looked up.

    The decision is made for a text under its id, so rows that repeat an id, or have none, are
    judged one by one.
    """
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    key = common.fresh(docs.columns, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))))
    scores = toxicity.score(keyed, model, id_col=key)
    toxic = scores.where(F.col("score") >= TOXIC_SCORE).select(F.col("id").alias(key)).distinct()
    return keyed.join(toxic.hint("shuffle_hash"), key, "left_anti").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many have; those left with no text at all go."""
    report = common.fresh(docs.columns, "line_report")
    cleaned = lines.drop_repeated_lines(docs, report=report)
    emptied = (F.col(f"{report}.n_dropped") > 0) & (
        F.btrim("text", F.lit(common.SPACES)) == ""
    )
    return cleaned.where(~emptied).select(
        *[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c)
          for c in docs.columns]
    )


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Words come in fives and the similarity is 0.8. All rows of a kept id stay. A row without an
    id is a document of its own, behind all others, and of several with one text one stays.
    """
    key = common.fresh(docs.columns, "node_key")
    by_text = F.pmod(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), F.lit(NO_ID_RANGE))
    keyed = docs.withColumn(
        key, F.coalesce(F.col("doc_id").cast("long"), by_text + F.lit(NO_ID_RANGE)))
    found = near_duplicates.near_duplicates(keyed, id_col=key, words=5, percent=80)
    gone = found.where(~F.col("kept")).select(F.col("id").alias(key)).distinct()
    kept = keyed.join(gone.hint("shuffle_hash"), key, "left_anti")
    nameless = kept.where(F.col("doc_id").isNull()).dropDuplicates([key])
    return kept.where(F.col("doc_id").isNotNull()).unionByName(nameless).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes, and none of the others.

    Rows equal in id, source and text get the same number of copies, rounded up.
    """
    mix = mixing.mix(docs, WEIGHTS).where("taken > 0")
    copies = mix.groupBy(
        common.own_id(F.col("id")).alias("mix_id"), F.col("source").alias("mix_source"),
        F.col("text_hash").alias("mix_text"),
    ).agg(F.ceil(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("mix_copies"))
    same = (
        (common.own_id(F.col("doc_id")) == F.col("mix_id"))
        & F.col("source").eqNullSafe(F.col("mix_source"))
        & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("mix_text"))
    )
    taken = docs.join(copies.hint("shuffle_hash"), same)
    repeated = taken.withColumn("mix_copies", F.explode(F.sequence(F.lit(1), "mix_copies")))
    return repeated.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the digests that check them."""
    rows = pieces.encode(docs)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("mixing", mixed_sources),
    ("pieces", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return docs
