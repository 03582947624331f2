"""Digests of pages, evidence and row identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def short(text: Column, n: int = 16) -> Column:
    """The first characters of a SHA-1."""
    return F.substring(F.sha1(text.cast("binary")), 1, n)


def body_digest(content: Column) -> Column:
    """Of a page without its front matter."""
    return short(F.regexp_replace(content, "(?s)\\A---\\n.*?\\n---\\n?", ""))


def row_id(*parts: Column, n: int = 16) -> Column:
    """Of some fields, told apart by a zero byte."""
    return short(F.concat_ws("\u0000", *parts), n)


def combined(content: Column, order: Column) -> Column:
    """Aggregate: one digest over the contents of several files in order."""
    return F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), content.alias("c")))), lambda x: x["c"]), "").cast("binary"))
