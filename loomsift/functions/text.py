"""Column expressions over small texts: trimming, comments, tags, structural keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..formats.fixed import STRUCTURAL_KEYS


def trim(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_structural_key(key: Column) -> Column:
    lower = ascii_lower(key)
    out = F.lit(False)
    for k in STRUCTURAL_KEYS:
        out = out | F.contains(lower, F.lit(k))
    return out


def ppm_comments(text: Column) -> Column:
    """array<struct<n,value>>: lines of the first 8 KiB that begin with a hash, left-trimmed."""
    lines = F.transform(F.split(F.substring(text, 1, 8192), r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+", ""))
    found = F.filter(lines, lambda x: F.startswith(x, F.lit("#")))
    return F.transform(found, lambda x, i: F.struct((i + 1).cast("long").alias("n"), x.alias("value")))


def tag_pair(line: Column) -> Column:
    """struct<key,value> of a line ``"k": "v",``; null if either is empty."""
    two = F.split(line, ":", 2)
    key = F.regexp_replace(F.get(two, F.lit(0)), r'^[\s"]+|[\s"]+$', "")
    value = F.regexp_replace(F.get(two, F.lit(1)), r'^[\s"]+|[\s",]+$', "")
    return F.when((key != "") & (value != ""), F.struct(key.alias("key"), value.alias("value")))


def css_comments(css: Column) -> Column:
    """Bodies of comments outside strings, in order (the last may not be open)."""
    whole = F.regexp_extract_all(css, F.lit(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|/\*(?s:.*?)\*/"), F.lit(0))
    return F.transform(F.filter(whole, lambda x: F.startswith(x, F.lit("/*"))), lambda x: F.substr(x, F.lit(3), F.length(x) - 4))
