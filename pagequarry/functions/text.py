"""Scalar functions on extracted text: transforms, dates, cells, dot paths."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.functions.urls import col, trim_ws


@dataclass(frozen=True)
class Transform:
    """One step on an extracted value: trim, lowercase, uppercase, regex (pattern), split (separator)."""

    type: str
    pattern: str = ""
    separator: str = ""


def regex_step(c: Column, pattern: str) -> Column:
    """First capture group if the pattern has one, else the match; without a match (or with a bad pattern) the value."""
    try:
        group = 1 if re.compile(pattern).groups else 0
    except re.error:
        return c
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group)).otherwise(c)


def split_step(c: Column, separator: str) -> Column:
    return F.split(c, re.escape(separator) if separator else "", -1)


def apply_transforms(c: Column | str, steps: Sequence[Transform]) -> Column:
    """Left fold of the steps; what follows a split is not applied."""
    out = col(c)
    for s in steps:
        if s.type == "trim":
            out = trim_ws(out)
        elif s.type == "lowercase":
            out = F.lower(out)
        elif s.type == "uppercase":
            out = F.upper(out)
        elif s.type == "regex":
            out = regex_step(out, s.pattern)
        elif s.type == "split":
            return split_step(out, s.separator)
        else:
            raise ValueError(f"unknown transform {s.type!r}")
    return out


def first_non_empty(*cs: Column | str) -> Column:
    """First value that isn't blank, trimmed; else the empty string."""
    return F.coalesce(*[F.nullif(trim_ws(c), F.lit("")) for c in cs], F.lit(""))


#: Layouts of publication dates, in the order they are tried.
PUBLISHED = (
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd MMM yyyy HH:mm:ss z", "dd MMM yyyy HH:mm:ss Z", "dd MMM yy HH:mm z", "dd MMM yy HH:mm Z",
)


def published_at(*candidates: Column | str) -> Column:
    """First candidate that one of the layouts reads, as a UTC timestamp; null if none does."""
    tries = []
    for c in candidates:
        s = F.regexp_replace(trim_ws(c), r"^[A-Z][a-z]{2}, ", "")
        tries += [F.try_to_timestamp(F.nullif(s, F.lit("")), F.lit(p)) for p in PUBLISHED]
    return F.coalesce(*tries)


#: Layouts of dates in PDF information, day of the week taken off.
PDF_DATES = ("MMM d HH:mm:ss yyyy z", "MMM d HH:mm:ss yyyy", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss")


def pdf_date(c: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(trim_ws(c), r"^[A-Z][a-z]{2} ", ""), r" +", " ")
    return F.coalesce(*[F.try_to_timestamp(F.nullif(s, F.lit("")), F.lit(p)) for p in PDF_DATES])


def cell(c: Column | str, kind: T.DataType) -> Column:
    """A value as text of a CSV cell: whole floats without a fraction, nested values as JSON, null empty."""
    v = col(c)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        out = F.to_json(v)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))
    else:
        out = v.cast("string")
    return F.coalesce(out, F.lit(""))


def has_path(schema: T.StructType, path: str) -> T.DataType | None:
    """Type at a dot path, or None."""
    kind: T.DataType = schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
            return None
        kind = kind[name].dataType
    return kind
