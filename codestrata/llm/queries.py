"""The operators over their whole tables, as queries, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import (
    lines, mixing, near_duplicates, neighbours, packing, periods, pieces, quality,
    repeated_spans, sharding, tokens, toxicity, whitening,
)
from codestrata.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(table(spark, sf_dir, "documents"))
    return tokens.with_limit(counts, 4096).withColumnRenamed("id", "doc_id")


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = near_duplicates.near_duplicates(docs, words=3, percent=85)
    return found.withColumnRenamed("id", "doc_id")


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept",
    )


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.toxic_scores(docs, labels).withColumnRenamed("id", "doc_id")


@query
def op5_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeated_spans.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed",
        F.size("begins").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=[5, 2, 1])
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"))
    return encoded.select(F.col("id").alias("doc_id"), *piece_digests())


def piece_digests() -> list:
    """Digest columns of encoded rows."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


@query
def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)
    return found.withColumnRenamed("id", "vec_id")


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id", "line_report.n_lines", "line_report.n_dropped",
        F.sha2("text", 256).alias("kept_sha256"),
    )


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(table(spark, sf_dir, "documents"), plant=True)
    return found.withColumnRenamed("id", "doc_id")


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces_of = packing.packed(table(spark, sf_dir, "documents"))
    return pieces_of.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    by_component = F.posexplode(F.arrays_zip("whitened", "explained"))
    return rows.select(
        "id", "n", "deviation", "identity_error", by_component.alias("place", "own")
    ).select(
        F.col("id").alias("vec_id"), (F.col("place") + 1).alias("component"), "n",
        F.col("deviation").cast("long").alias("deviation"), "own.whitened", "own.explained",
        "identity_error",
    )


_WORDS = (
    "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),"
    " lambda x: x <> '')"
)

ORACLES["op10_line_dedup"] = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
frequent as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20
  group by key having count(distinct doc_id) >= 3),
judged as (
  select k.*, f.key is not null and k.doc_id <> f.keeper as dropped
  from keyed k left join frequent f using (key))
select doc_id, count(*) as n_lines,
  cast(count(*) filter (where dropped) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), ''))
    as kept_sha256
from judged group by doc_id
"""

ORACLES["op3_quality_rules"] = f"""
with docs as (
  select doc_id, coalesce(text, '') as text, {_WORDS} as w,
    string_split(coalesce(text, ''), chr(10)) as lines
  from documents),
windows as (
  select doc_id, unnest(range(1, len(w) - 6)) as i, w from docs where len(w) >= 8),
hashed as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as key from windows),
twice as (
  select doc_id, i from hashed
  qualify count(*) over (partition by doc_id, key) > 1),
covered as (
  select doc_id, count(distinct i + j) as n
  from twice, range(0, 8) as t(j) group by doc_id),
judged as (
  select doc_id, text, w, lines,
    list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as filled,
    list_filter(lines, lambda x: not (
      length(x) - length(translate(x, '#*$%&|<>', '')) > 0.08 * length(x)
      or (length(x) - length(translate(x, '|>»›•·', '')) >= 3
        and 3 * (length(x) - length(translate(x, '|>»›•·', '')))
          >= length(x) - length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')))
      or (upper(x) = x and lower(x) <> x
        and length(x) - length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')) >= 4)
      or regexp_matches(lower(x), 'all rights reserved|accept cookies|click here|cookie policy'
        '|copyright \\(c\\)|enable javascript|licensed under|lorem ipsum|privacy policy'
        '|released under|sign up now|subscribe now|terms of service|terms of use|uses cookies'
        '|©'))) as good
  from docs),
measured as (
  select doc_id, cast(len(w) as bigint) as n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
    cast(len(filled) - len(list_distinct(filled)) as bigint) as n_dup_lines,
    length(regexp_replace(array_to_string(good, chr(10)), '[\\x20\\x09-\\x0D]', '', 'g')) as kept_chars
  from judged)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines,
  coalesce(n, 0) as n_repeat_words,
  n_words < 20 or 100 * coalesce(n, 0) > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * coalesce(n, 0) > 30 * n_words)
    and kept_chars >= (1 - 0.3) * word_chars as kept
from measured left join covered using (doc_id)
"""
