"""Methods and members of types: source text cut into blocks by the depth of its braces.

A text is cut behind every brace and semicolon. Running sums over these pieces, in one window
per file, give each piece its depth and the tokens, decisions and lines up to it. Among the
braces that open or close blocks of one depth, opening and closing ones alternate, so the brace
after an opening one ends its block, and a difference of running sums measures the block. The
block around a piece is the last one opened at its depth.

All of it is one shuffle by file, made before texts are cut: a table of few or small files, read
by one task, is then cut by all of them, and a text takes less room than the counts of its
pieces. A file's name must be unique in its repository.

This is no parser. Headers are told by patterns: a method by a name and parameters before its
block, with nothing that makes it a call, and a type as for ``type_declarations``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codestrata.functions.text import DECISION, NOT_CODE, with_line_feeds
from codestrata.operators.code import TYPE_HEADER, without_type_arguments
from codestrata.schemas import columns

# What is counted as one token: words, operators of two characters, other visible characters.
# A literal is one character by then.
TOKEN = r"[\w$\x{80}-\x{10FFFF}]++|&&|\|\||[-+*/%&|^!=<>]=|\+\+|--|->|::|[^\s]"
# The wildcard of a type argument is no decision.
WILDCARD = r"[<,]\s*+\?"
# From the name of a method to the brace or semicolon behind its parameters. What is repeated
# gives nothing back, and no search starts within a word, so the time it takes grows with the
# length of the header alone.
METHOD = (
    r"(?<![A-Za-z_$])([A-Za-z_$][\w$]*+)\s*+\(((?:[^()]++|\([^()]*+\))*+)\)"
    r"\s*+(?:throws\s[^(){}=;]*+)?[{;]\z"
)
# Words before parentheses that are no method names, and words before a name
# that make it no declaration.
NOT_A_NAME = (
    "if", "for", "while", "switch", "catch", "synchronized", "try", "return", "super", "this",
    "new", "do", "else", "assert", "throw", "throws", "case", "yield",
)
NOT_BEFORE = (
    "new", "return", "throw", "else", "case", "do", "record", "yield", "assert", "goto",
)
TYPED = r"[\w$>\]]\s*+\z"
LAST_WORD = r"([\w$]++)\s*+\z"
ANNOTATION = r"@(?!interface)[\w$.]++(?:\s*+\([^()]*+\))?"
PARENTHESES = r"\([^()]*+\)"
FIELD = r"\A(?:[\w$.]++ )+[\w$]++ ?[=,;]"

_FILE = ("repository", "file")
TASKS_A_CORE = 8


def plain_code(text: Column) -> Column:
    """Text with its line feeds, where a literal is a quotation mark and a comment a space."""
    unified = with_line_feeds(text)
    found = F.regexp_extract_all(unified, F.lit(NOT_CODE), F.lit(0))

    def stand_in(part: Column) -> Column:
        literal = F.startswith(part, F.lit('"')) | F.startswith(part, F.lit("'"))
        feeds = F.length(part) - F.length(F.replace(part, F.lit("\n")))
        mark = F.when(literal, F.lit('"')).otherwise(F.lit(" "))
        return F.concat(mark, F.repeat(F.lit("\n"), feeds.cast("int")))

    joined = F.zip_with(
        F.split(unified, NOT_CODE),
        F.transform(found, stand_in),
        lambda code, other: F.concat(code, F.coalesce(other, F.lit(""))),
    )
    return F.array_join(joined, "")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _feeds(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n")))).cast("long")


def _written(text: Column) -> Column:
    """Lines of a piece with something on them."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"\S")))
    return F.size(lines).cast("long")


def dealt(sources: DataFrame) -> DataFrame:
    """The sources, dealt by file over several tasks for each core.

    The number is stated, as adaptive execution would merge tasks by the size of the texts,
    which is a small part of what is made of them.
    """
    spark = sources.sparkSession
    number = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        TASKS_A_CORE * spark.sparkContext.defaultParallelism,
    )
    return sources.select(*_FILE, "text").repartition(number, *_FILE)


def pieces(sources: DataFrame) -> DataFrame:
    """Pieces of the texts with their counts; the last one of a file may end in no mark."""
    cut = dealt(sources).select(
        *_FILE, F.posexplode(F.split(plain_code(F.col("text")), "(?<=[{};])")).alias(
            "position", "piece"),
    )
    piece = F.col("piece")
    mark = F.when(F.regexp_like(piece, F.lit(r"[{};]\z")), F.right(piece, F.lit(1)))
    # A line that goes on from the piece before was counted there.
    goes_on = (F.col("position") > 0) & F.regexp_like(
        F.substring_index(piece, "\n", 1), F.lit(r"\S"))
    return cut.select(
        *_FILE, "position", mark.alias("mark"),
        F.when(mark.isin("{", ";"), piece).alias("header"),
        _count(piece, TOKEN).alias("tokens"),
        (_count(piece, DECISION) - _count(piece, WILDCARD)).alias("decisions"),
        (_written(piece) - goes_on.cast("long")).alias("lines"),
        _feeds(piece).alias("feeds"),
    )


def _blanked(text: Column, mark: str, pattern: str) -> Column:
    """Text with spaces for what the pattern finds, which always holds the mark."""
    return F.when(F.contains(text, F.lit(mark)), F.regexp_replace(text, pattern, " ")).otherwise(text)


def _headers(found: DataFrame) -> DataFrame:
    """Adds what the header of a piece says: a type, a method, or declared names."""
    header, mark = F.col("header"), F.col("mark")
    plain = F.regexp_replace(without_type_arguments(header), r"\s++", " ")
    type_like = (mark == "{") & (
        F.contains(header, F.lit("class")) | F.contains(header, F.lit("interface"))
        | F.contains(header, F.lit("enum"))
    )
    is_type = F.coalesce(type_like & F.regexp_like(F.when(type_like, plain), F.lit(TYPE_HEADER)),
                         F.lit(False))
    signature = F.when(F.contains(header, F.lit("(")), F.regexp_extract(header, METHOD, 0))
    name = F.regexp_extract(header, METHOD, 1)
    before = F.left(header, F.length(header) - F.length(F.col("signature")))
    last_word = F.regexp_extract(F.col("before"), LAST_WORD, 1)
    typed = F.regexp_like("before", F.lit(TYPED)) & ~last_word.isin(*NOT_BEFORE)
    bare = F.rtrim("before", F.lit(" \t\n")) == ""
    method = (
        ~F.col("is_type") & (F.col("signature") != "") & ~F.col("name").isin(*NOT_A_NAME)
        & (typed | bare | F.endswith(F.rtrim("before", F.lit(" \t\n")), F.lit(")")))
    )
    # Names declared by a statement: those after the commas outside brackets of any kind.
    # Each step is a column of its own, as it is named more than once.
    unmarked = F.when(~F.col("is_type") & ~F.col("is_method"), _blanked(header, "@", ANNOTATION))
    stripped = _blanked(without_type_arguments(F.col("stripped")), "[", r"\[[^\[\]]*+\]")
    stripped = F.trim(F.regexp_replace(stripped, r"\s++", " "))
    commas = (F.length("stripped") - F.length(F.replace("stripped", F.lit(",")))).cast("long")
    assigns = F.contains("stripped", F.lit("="))
    declares = F.regexp_like("stripped", F.lit(FIELD)) & (assigns | (mark == ";"))
    goes_on = F.startswith("stripped", F.lit(",")) & (assigns | (mark == ";"))
    told = (
        found.withColumn("is_type", is_type)
        .withColumn("type_header", F.when(F.col("is_type"), plain))
        .withColumn("signature", F.coalesce(signature, F.lit("")))
        .withColumn("name", F.when(F.col("signature") != "", name))
        .withColumn("before", F.when(F.col("signature") != "", before))
        .withColumn("typed", F.coalesce(typed, F.lit(False)))
        .withColumn("is_method", F.coalesce(method, F.lit(False)))
        .withColumn("stripped", unmarked)
    )
    for _ in range(3):
        told = told.withColumn("stripped", _blanked(F.col("stripped"), "(", PARENTHESES))
    return told.withColumn("stripped", stripped).withColumn(
        "declared", F.when(declares, commas + 1).when(goes_on, commas).otherwise(F.lit(0))
    )


def declarations(sources: DataFrame) -> DataFrame:
    """Types, methods and statements that declare names, each with the block around it.

    ``around`` is null at the top of a file and in blocks that are no type's.
    """
    mark = F.col("mark")
    # The headers are read before the sorts, so that no other text is moved.
    told = _headers(pieces(sources)).select(
        *_FILE, "position", "mark", "tokens", "decisions", "lines", "feeds", "is_type",
        "type_header", "is_method", "typed", "name", "declared",
        F.when(F.col("is_method"), F.col("signature")).alias("signature"),
    )
    in_file = Window.partitionBy(*_FILE)
    so_far = in_file.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(mark == "{", 1).when(mark == "}", -1).otherwise(0)
    sums = [F.sum(name).over(so_far).alias(f"{name}_so_far")
            for name in ("tokens", "decisions", "lines", "feeds")]
    placed = told.select("*", F.sum(step).over(so_far).alias("depth"), *sums)
    totals = [f"{name}_so_far" for name in ("tokens", "decisions", "lines", "feeds")]
    level = F.when(mark == "{", F.col("depth")).when(mark == "}", F.col("depth") + 1)
    by_level = Window.partitionBy(*_FILE, "level").orderBy("position")
    end = F.lead(F.struct(*totals)).over(by_level)
    file_end = F.struct(*[F.max(name).over(in_file).alias(name) for name in totals])
    blocks = placed.withColumn("level", level).withColumn(
        # A block that is never closed ends with its file.
        "end", F.when(mark == "{", F.coalesce(end, file_end))
    )
    # A block is looked up by its level, and what may be declared by the level around it.
    opener = F.struct(
        F.col("level").alias("key"), F.lit(True).alias("opens"))
    inner = F.struct(
        (F.col("depth") - step).alias("key"), F.lit(False).alias("opens"))
    found = F.col("is_type") | F.col("is_method") | (F.col("declared") > 0)
    roles = F.filter(
        F.array(F.when(mark == "{", opener), F.when(found, inner)), lambda role: role.isNotNull()
    )
    both = blocks.withColumn("role", F.explode(roles))
    own = F.when(
        F.col("role.opens"),
        F.struct("is_type", "position", F.regexp_extract("type_header", TYPE_HEADER, 3).alias("name")),
    )
    outer = (
        Window.partitionBy(*_FILE, "role.key").orderBy("position", F.desc("role.opens"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    around = F.last(own, ignorenulls=True).over(outer)
    return (
        both.withColumn("around", around)
        .where(~F.col("role.opens"))
        .withColumn("around", F.when(F.col("around.is_type"), F.col("around")))
    )


def _constructs(name: Column) -> Column:
    return F.coalesce(name == F.col("around.name"), F.lit(False))


def method_metrics(sources: DataFrame) -> DataFrame:
    """``complexity`` rows: size, decisions and parameters of every method with a body.

    A method begins on the line of its name and ends with its block. ``nloc`` counts its lines
    with code, ``length`` all of them, and ``ccn`` is one more than its decisions. The name is
    preceded by that of the type around it. Methods without a type before their name are
    constructors, and named as the type around them.
    """
    signature = F.col("signature")
    # From the name to the opening brace.
    own_lines = _written(signature)
    begin_feeds = F.col("feeds_so_far") - _feeds(signature)
    inside = {
        name: F.col(f"end.{name}_so_far") - F.col(f"{name}_so_far")
        for name in ("tokens", "decisions", "lines")
    }
    listed = F.trim(F.regexp_extract(signature, METHOD, 2))
    for pattern in (ANNOTATION, PARENTHESES):
        listed = F.regexp_replace(listed, pattern, " ")
    listed = F.trim(without_type_arguments(listed))
    commas = F.length(listed) - F.length(F.replace(listed, F.lit(",")))
    method = F.concat(
        F.coalesce(F.concat("around.name", F.lit("::")), F.lit("")), F.col("name")
    )
    rows = declarations(sources).where(
        F.col("is_method") & (F.col("mark") == "{") & (F.col("typed") | _constructs(F.col("name")))
    )
    return rows.select(
        *_FILE,
        method.alias("method"),
        (own_lines + inside["lines"]).cast("int").alias("nloc"),
        (inside["decisions"] + 1).cast("int").alias("ccn"),
        (_count(signature, TOKEN) + inside["tokens"]).cast("int").alias("tokens"),
        F.when(listed == "", 0).otherwise(commas + 1).cast("int").alias("parameters"),
        (F.col("end.feeds_so_far") - begin_feeds + 1).cast("int").alias("length"),
    )


def type_structure(sources: DataFrame) -> DataFrame:
    """``structure`` rows: every type with the methods and attributes of its own body.

    Constructors are no methods, and of a statement every name it declares is an attribute.
    What is declared in a nested type counts there, and what stands in a method nowhere.
    """
    found = declarations(sources)
    method = (
        F.col("is_method") & F.col("typed") & ~_constructs(F.col("name"))
        & F.col("around").isNotNull()
    )
    attributes = F.when(F.col("around").isNotNull(), F.col("declared")).otherwise(F.lit(0))
    block = F.when(F.col("is_type"), F.col("position")).otherwise(F.col("around.position"))
    by_type = (
        found.where(F.col("is_type") | F.col("around").isNotNull())
        .select(*_FILE, block.alias("position"), "type_header", method.alias("method"),
                attributes.alias("attributes"))
        .groupBy(*_FILE, "position")
        .agg(
            F.max("type_header").alias("header"),
            F.count_if("method").alias("methods"),
            F.sum("attributes").alias("attributes"),
        )
    )

    def part(group: int) -> Column:
        return F.regexp_extract("header", TYPE_HEADER, group)

    def names(group: int) -> Column:
        return F.regexp_replace(F.trim(part(group)), r" ?, ?", ";")

    word = part(2)
    rows = by_type.withColumns({
        "type_name": part(3),
        "kind": F.when(word.isin("interface", "enum"), word).otherwise("class"),
        "is_abstract": F.contains(part(1), F.lit("abstract ")),
        "is_interface": word == "interface",
        "methods": F.col("methods").cast("int"),
        "attributes": F.col("attributes").cast("int"),
        "extends": names(4),
        "implements": names(5),
    })
    return rows.select(*columns("structure"))
