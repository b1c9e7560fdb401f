"""Expressions over whole source texts.

Lines are cut with a plain split and classified by their first characters. Both stay
inside generated code on the UTF-8 bytes; the same work done with regular expressions
takes about ten times as long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that end a line besides the line feed, and the whitespace
# characters that do not.
CARRIAGE_RETURN = "\r"
RARE_BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
INDENTATION = (
    "\t\x1f \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u202f\u205f\u3000"
)
WHITESPACE = "\n" + CARRIAGE_RETURN + RARE_BREAKS + INDENTATION

# Prefixes that make a line a comment, the test annotation, the path
# and name marks of a test file, and the import marks of the known test frameworks.
COMMENT_PREFIXES = ("//", "*", "/*")
TEST_ANNOTATION = r"(?U)@Test\b"
TEST_FOLDER = "/src/test/"
TEST_SUFFIXES = ("Test.java", "Tests.java")
TEST_FRAMEWORKS = {
    "assertj": r"org\.assertj",
    "junit": r"org\.junit|junit\.framework",
    "mockito": r"org\.mockito",
    "spock": r"spock\.lang",
    "testng": r"org\.testng",
}

# The look-aheads at the start of the next patterns test one character class before any
# alternative is tried, which halves the time they take.
#
# Literals come before comments, so that "http://x" is not taken for a comment.
# Possessive groups keep the matcher iterative on very long literals, and what is never
# closed runs to the end of the text, so no opening mark is scanned for twice.
NOT_CODE = (
    r"""(?=["'/])(?:"""
    r'"""(?s:.*?)(?:"""|\z)'
    r'|"(?:[^"\\\n]++|\\.)*+"'
    r"|'(?:[^'\\\n]++|\\.)*+'"
    r"|/\*(?s:.*?)(?:\*/|\z)"
    r"|//[^\n]*)"
)
DECISION = r"(?=[cfiw&|?])(?:\b(?:if|for|while|case|catch)\b|&&|\|\||\?)"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def with_line_feeds(text: Column) -> Column:
    """Text in which every line ends with a line feed.

    Looking for a character is several times cheaper than replacing it, and most texts
    hold none but line feeds, so replacements only run where something was found.
    """

    def holds(mark: str) -> Column:
        return F.contains(text, F.lit(mark))

    def feed(value: Column, mark: str) -> Column:
        return F.replace(value, F.lit(mark), F.lit("\n"))

    dos = feed(feed(text, "\r\n"), CARRIAGE_RETURN)
    rare = reduce(lambda left, right: left | right, map(holds, RARE_BREAKS))
    return (
        F.when(rare, reduce(feed, RARE_BREAKS, dos))
        .when(holds(CARRIAGE_RETURN), dos)
        .otherwise(text)
    )


def line_slots(unified: Column) -> Column:
    """Everything between line feeds; one more than the lines if the last is finished."""
    return F.split(unified, "\n")


def has_spare_slot(unified: Column) -> Column:
    """Whether the last slot is no line: nothing follows the last line feed."""
    return (unified == "") | F.endswith(unified, F.lit("\n"))


def line_head(line: Column) -> Column:
    """Line without its indentation; empty for a blank line."""
    return F.ltrim(line, F.lit(WHITESPACE))


def is_comment(head: Column, prefixes: tuple[str, ...] = COMMENT_PREFIXES) -> Column:
    """Prefix test only: no state is kept between the lines of a block comment."""
    tests = (F.startswith(head, F.lit(prefix)) for prefix in prefixes)
    return reduce(lambda left, right: left | right, tests)


def written_line_count(text: Column) -> Column:
    """Lines that are not blank."""
    slots = line_slots(with_line_feeds(text))
    return F.size(F.filter(slots, lambda line: line_head(line) != "")).cast("long")


def is_test_file(path: Column) -> Column:
    """Whether a repository-relative path is in a test folder or named like a test.

    The folder mark starts with a slash, so the path gets one too: the test folder of a
    repository with a single module is at its top.
    """
    matches = F.contains(F.concat(F.lit("/"), path), F.lit(TEST_FOLDER))
    for suffix in TEST_SUFFIXES:
        matches = matches | F.endswith(path, F.lit(suffix))
    return matches


def annotation_count(text: Column) -> Column:
    return _count(text, TEST_ANNOTATION)


def framework_mentions(text: Column) -> Column:
    """Distinct import marks of any test framework, found in one pass.

    The marks are captured in a look-ahead, so one that starts inside another counts.
    """
    marks = "|".join(TEST_FRAMEWORKS.values())
    initials = "".join(sorted({mark[0] for mark in marks.split("|")}))
    pattern = f"(?iu)(?=[{initials}])(?=({marks}))"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def names_framework(mentions: Column, framework: str) -> Column:
    pattern = F.lit(f"(?iu){TEST_FRAMEWORKS[framework]}")
    return F.exists(mentions, lambda mention: F.rlike(mention, pattern))


def code_only(text: Column) -> Column:
    """Text with comments and literals blanked out."""
    return F.regexp_replace(text, NOT_CODE, " ")


def decision_count(code: Column) -> Column:
    return _count(code, DECISION)
