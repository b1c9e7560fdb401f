"""Complexity, structure, line and test metrics of source code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.names import non_empty
from codestrata.functions.numeric import ratio_or_zero, round_scaled
from codestrata.functions.text import (
    TEST_FRAMEWORKS,
    annotation_count,
    code_only,
    decision_count,
    framework_mentions,
    has_spare_slot,
    is_comment,
    is_test_file,
    line_head,
    line_slots,
    names_framework,
    with_line_feeds,
    written_line_count,
)
from codestrata.schemas import columns

_MODIFIER = "(?:public|protected|private|abstract|static|final) "
# For a header: what precedes an opening brace, in single spaces and without type arguments.
# A search never starts within a run of modifiers, and what is repeated gives nothing back,
# so the time it takes grows with the length of the header alone.
TYPE_HEADER = (
    rf"(?<!{_MODIFIER})((?:{_MODIFIER})*+)(@interface|\b(?:class|interface|enum))"
    r" ([A-Za-z_$][\w$]*+) ?(?:(?<= )extends (.+?))?(?:(?<= )implements (.+))?\{\z"
)


def file_complexity(methods: DataFrame) -> DataFrame:
    return methods.groupBy("repository", "file").agg(F.avg("ccn").alias("avg_ccn"))


def complexity_summary(methods: DataFrame) -> DataFrame:
    return methods.groupBy("repository").agg(
        round_scaled(F.avg("ccn"), 2).alias("avg_ccn"),
        F.max("ccn").cast("int").alias("max_ccn"),
        round_scaled(F.avg("nloc"), 2).alias("avg_method_nloc"),
        round_scaled(F.avg("parameters"), 2).alias("avg_method_params"),
    )


def structure_summary(types: DataFrame) -> DataFrame:
    """Types by kind, methods, and types that extend something."""
    return types.groupBy("repository").agg(
        F.count_if(F.col("kind") == "class").alias("classes"),
        F.count_if(F.col("kind") == "interface").alias("interfaces"),
        F.coalesce(F.sum("methods"), F.lit(0)).alias("methods"),
        F.count_if(non_empty(F.col("extends")).isNotNull()).alias("inheritance_links"),
    )


def source_profile(sources: DataFrame) -> DataFrame:
    """Line, test and framework totals per repository from one pass over the texts.

    Texts are exploded into lines that are reduced to counters in the same stage, so
    only counters are shuffled. Measures of the file as a whole are taken from its
    first line; a file without text has one row and no lines. Totals that a caller
    does not select are not computed.
    """
    text = F.col("text")
    unified = F.col("unified")
    files = sources.select(
        "repository",
        (is_test_file(F.col("file")) & text.isNotNull()).alias("is_test"),
        with_line_feeds(text).alias("unified"),
        F.when(is_test_file(F.col("file")), annotation_count(text)).alias("annotations"),
        F.when(is_test_file(F.col("file")), framework_mentions(text)).alias("mentions"),
    )
    lines = files.select(
        "repository",
        "is_test",
        "annotations",
        "mentions",
        has_spare_slot(unified).alias("spare_slot"),
        F.posexplode_outer(line_slots(unified)).alias("position", "line"),
    ).select(
        "repository",
        "is_test",
        "annotations",
        "mentions",
        "spare_slot",
        (F.coalesce("position", F.lit(0)) == 0).alias("first"),
        line_head(F.col("line")).alias("head"),
    )
    first, in_test, head = F.col("first"), F.col("is_test"), F.col("head")
    blank, comment = head == "", is_comment(head)
    frameworks = (
        F.coalesce(F.bool_or(first & names_framework(F.col("mentions"), name)), F.lit(False))
        .alias(name)
        for name in TEST_FRAMEWORKS
    )
    return lines.groupBy("repository").agg(
        F.count_if(first).alias("files"),
        (F.count_if(blank) - F.count_if(first & F.col("spare_slot"))).alias("blank"),
        F.count_if(comment).alias("comment"),
        F.count_if(~blank & ~comment).alias("code"),
        F.count_if(first & in_test).alias("test_files"),
        F.coalesce(F.sum(F.when(first, F.col("annotations"))), F.lit(0)).alias("test_methods"),
        F.count_if(~blank & ~in_test).alias("main_loc"),
        F.count_if(~blank & in_test).alias("test_loc"),
        *frameworks,
    )


def line_classes(profile: DataFrame) -> DataFrame:
    """``loc`` rows of a source profile; every file counts, readable or not."""
    return profile.select(
        *(F.col(name.removeprefix("java_")).alias(name) for name in columns("loc"))
    )


def tests_summary(profile: DataFrame) -> DataFrame:
    """``tests`` rows of a source profile, with the frameworks in use by name."""
    in_use = F.array(*(F.when(F.col(name), F.lit(name)) for name in TEST_FRAMEWORKS))
    return profile.withColumns(
        {
            "test_to_main_ratio": ratio_or_zero(F.col("test_loc"), F.col("main_loc"), 4),
            "frameworks": F.array_join(in_use, ";"),
        }
    ).select(*columns("tests"))


def testability(test_methods: DataFrame, structure: DataFrame) -> DataFrame:
    """Test methods per method for every repository with types."""
    return structure.join(test_methods, "repository", "left").select(
        "repository",
        F.coalesce("test_methods", F.lit(0)).alias("test_methods"),
        "methods",
        ratio_or_zero(F.coalesce("test_methods", F.lit(0)), F.col("methods"), 4).alias(
            "testability"
        ),
    )


def type_declarations(sources: DataFrame) -> DataFrame:
    """Type declarations found by pattern, one row each in file order.

    An approximation, not a parser: it feeds no other operator. Annotation types are
    classes here, as is every declaration that is neither interface nor enum.
    """
    found = sources.select(
        "repository",
        "file",
        # The outer form is not preceded by a filter that would search the text twice.
        F.posexplode_outer(type_headers(code_only(F.col("text")))).alias("position", "header"),
    ).filter(F.col("position").isNotNull())

    def part(group: int) -> Column:
        return F.regexp_extract("header", TYPE_HEADER, group)

    def names(group: int) -> Column:
        return F.regexp_replace(F.trim(part(group)), r" ?, ?", ";")

    word = part(2)
    kind = F.when(word.isin("interface", "enum"), word).otherwise("class")
    return found.select(
        "repository",
        "file",
        "position",
        part(3).alias("type_name"),
        kind.alias("kind"),
        F.contains(part(1), F.lit("abstract ")).alias("is_abstract"),
        (word == "interface").alias("is_interface"),
        names(4).alias("extends"),
        names(5).alias("implements"),
    )


def type_headers(code: Column) -> Column:
    """Headers of the type declarations of a code text, in order.

    The text is cut at braces and semicolons first, so that no pattern runs on through the
    rest of it.
    """
    ended = F.split(F.replace(code, F.lit("{"), F.lit("{;")), "[;}]")
    headers = F.filter(
        ended,
        lambda part: F.endswith(part, F.lit("{"))
        & (F.contains(part, F.lit("class")) | F.contains(part, F.lit("interface"))
           | F.contains(part, F.lit("enum"))),
    )
    plain = F.transform(
        headers, lambda part: F.regexp_replace(without_type_arguments(part), r"\s++", " ")
    )
    return F.filter(plain, lambda part: F.rlike(part, F.lit(TYPE_HEADER)))


def without_type_arguments(header: Column) -> Column:
    """A header without what stands in angle brackets, however deep they are nested.

    Empty where a bracket is left open.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"))

    def step(state: Column, piece: Column) -> Column:
        opens, closes = (F.startswith(piece, F.lit(mark)) for mark in "<>")
        depth = (
            F.when(opens, state["depth"] + 1)
            .when(closes, F.greatest(state["depth"] - 1, F.lit(0)))
            .otherwise(state["depth"])
        )
        text = F.when(closes, F.substr(piece, F.lit(2))).otherwise(piece)
        kept = F.when(depth == 0, F.concat(state["kept"], F.lit(" "), text))
        return F.struct(depth.alias("depth"), F.coalesce(kept, state["kept"]).alias("kept"))

    pieces = F.split(header, "(?=[<>])")
    stripped = F.aggregate(
        pieces, start, step, lambda state: F.when(state["depth"] == 0, state["kept"])
    )
    return F.when(
        F.contains(header, F.lit("<")) | F.contains(header, F.lit(">")), F.coalesce(stripped, F.lit(""))
    ).otherwise(header)


def file_decision_points(sources: DataFrame) -> DataFrame:
    """Decision points and written lines per file: file level, not per method."""
    return sources.select(
        "repository",
        "file",
        decision_count(code_only(F.col("text"))).alias("decisions"),
        written_line_count(F.col("text")).alias("nloc"),
    )
