"""Text normalisation and similarity scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.canonical import folded, shingles, tokens  # noqa: F401



def normalize_text(x: Column) -> Column:
    """Case folded, white space runs to one space, trimmed."""
    return folded(x)


def token_count(x: Column) -> Column:
    """White-space separated tokens; 0 for empty text."""
    n = F.trim(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.when(n == "", 0).otherwise(F.size(F.split(n, " "))).cast("long")


def text_hash(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def preview(x: Column, width: int) -> Column:
    """White space collapsed, cut to width with dots."""
    flat = F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.left(flat, F.lit(width - 3)), F.lit("..."))).otherwise(flat)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def byte_bucket(n: Column) -> Column:
    """Size classes of byte counts."""
    return F.when(n <= 0, "0").when(n <= 1024, "1-1024").when(n <= 4096, "1025-4096").when(n <= 32768, "4097-32768").otherwise("32769+")


def count_bucket(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n == 1, "1").when(n <= 4, "2-4").when(n <= 16, "5-16").otherwise("17+")
