"""Comment lists: ordered ``TAG=value`` strings with repeated, case-insensitive tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tagged(comments: Column, tag: str) -> Column:
    """The comments of a tag, in order."""
    prefix = tag.upper() + "="
    return F.filter(comments, lambda c: F.upper(F.substring(c, 1, len(prefix))) == prefix)


def lookup(comments: Column, tag: str, nth: int = 0) -> Column:
    """The nth value of a tag, or null."""
    return F.substring(F.get(tagged(comments, tag), F.lit(nth)), len(tag) + 2, 1 << 30)


def count(comments: Column, tag: str) -> Column:
    return F.size(tagged(comments, tag))


def header_tags(line: Column) -> Column:
    """Map of a stream header's space-separated tags: first letter to value."""
    words = F.filter(F.slice(F.split(line, " "), 2, 1 << 30), lambda w: w != "")
    return F.map_from_entries(F.transform(words, lambda w: F.struct(F.substring(w, 1, 1), F.substring(w, 2, 1 << 30))))
