"""Expressions on text that agree with Python's notion of white space and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.split and str.strip know it; a character class for Java and RE2.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def words(c: Column) -> Column:
    return F.filter(F.split(c, WS + "+"), lambda w: w != "")


def token_count(c: Column) -> Column:
    """int(words * 1.3); 0 for a null or blank text."""
    return F.coalesce((F.size(words(c)) * F.lit(1.3)).cast("int"), F.lit(0))


def chunk_id(content: Column, position: Column) -> Column:
    """First 8 hex digits of the SHA-256 of the content and the position."""
    return F.substring(F.sha2(F.concat(content, position.cast("string")), 256), 1, 8)


def text_hash(c: Column, digits: int = 64) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def sequence_number(c: Column) -> Column:
    """The number of the first Stage, Step or Phase in a text, null if there is none or it overflows."""
    return F.regexp_extract(c, r"(?i)(Stage|Step|Phase)\s+(\d+)", 2).try_cast("bigint")


def header_path(*headers: Column) -> Column:
    """h1 > h2 > ...: nulls are skipped, empty headers are not."""
    return F.concat_ws(" > ", *headers)
