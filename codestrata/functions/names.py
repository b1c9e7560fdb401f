"""Repository keys, folder names and blank handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata.functions.text import WHITESPACE


def folder_of(repository: Column) -> Column:
    """``owner/name`` as a flat folder name."""
    return F.replace(repository, F.lit("/"), F.lit("__"))


def repository_of(folder: Column) -> Column:
    return F.replace(folder, F.lit("__"), F.lit("/"))


def short_name(repository: Column) -> Column:
    return F.substring_index(repository, "/", -1)


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every Unicode kind."""
    return F.trim(text, F.lit(WHITESPACE))


def non_empty(text: Column) -> Column:
    """NULL for both a missing and an empty string."""
    return F.nullif(text, F.lit(""))


def text_or_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
