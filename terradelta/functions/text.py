"""Paths, dates and reported numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def stem(path: Column) -> Column:
    """The file's name without its last ending."""
    return F.regexp_extract(slashes(path), r"([^/]+?)(?:\.[^./]*)?$", 1)


def top_folder(path: Column) -> Column:
    """The first folder of a relative path; null for a bare file name or one that begins with a dot."""
    found = F.regexp_extract(slashes(path), r"^([^/.][^/]*)/", 1)
    return F.when(found != "", found)


def after_token(path: Column, tokens: list[str]) -> Column:
    """What stands behind the first of `tokens` that the path has, split once; null without any."""
    out = F.lit(None).cast("string")
    for token in reversed(tokens):  # a short list of literals
        out = F.when(slashes(path).contains(token), F.substr(slashes(path), F.instr(slashes(path), F.lit(token)) + len(token))).otherwise(out)
    return out


def compact_date(text: Column) -> Column:
    """2018-01-01T00:00:00Z as 20180101."""
    return F.replace(F.substring(text, 1, 10), F.lit("-"))


def fixed(value: Column, digits: int = 3, signed: bool = False) -> Column:
    """A number with so many decimals, with its sign if asked for; a dash for null."""
    return F.when(value.isNotNull(), F.format_string(f"%{'+' if signed else ''}.{digits}f", value)).otherwise("-")


def normal_id(text: Column) -> Column:
    """Whole numbers that were once read as floats, such as 17.0; null for other text."""
    return F.regexp_extract(F.trim(text), r"^(\d+)(?:\.0+)?$", 1).try_cast("bigint")


def zero_padded(number: Column, width: int) -> Column:
    """Whole numbers with at least `width` digits; longer ones stay whole."""
    return F.format_string(f"%0{width}d", number.cast("long"))
