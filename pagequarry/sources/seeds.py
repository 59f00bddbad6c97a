"""Seed lists: plain text, CSV and TSV files as (pos, url, fallback)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.urls import trim_ws

MAX_LINE = 1 << 20


def resolve_named(header: Sequence[str], name: str) -> int:
    for i, h in enumerate(header):
        if h.strip().lower() == name.strip().lower():
            return i
    raise ValueError(f"column {name!r} not found in {list(header)}")


def resolve_url_column(header: Sequence[str], name: str = "") -> int:
    """The named column (case doesn't matter), else url, else the first."""
    if name:
        return resolve_named(header, name)
    if not header:
        raise ValueError("empty header row")
    try:
        return resolve_named(header, "url")
    except ValueError:
        return 0


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A URL a line; blank lines and # lines don't count. A line of over MAX_LINE bytes is an error."""
    long = F.raise_error(F.lit(f"{path}: a line is longer than {MAX_LINE} bytes")).cast("string")
    value = F.when(F.octet_length("value") > MAX_LINE, long).otherwise(F.col("value"))
    lines = spark.read.text(path).select(value.alias("value")).select(F.monotonically_increasing_id().alias("pos"), trim_ws("value").alias("url"))
    return lines.where("url <> '' AND NOT startswith(url, '#')").select("pos", "url", F.lit("").alias("fallback"))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", url_column: str = "", fallback_column: str = "") -> DataFrame:
    """A file with a header; short rows are padded, rows without a URL dropped."""
    raw = spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("mode", "PERMISSIVE").option("enforceSchema", False).csv(path)
    if not raw.columns:
        raise ValueError("empty header row")
    i = resolve_url_column(raw.columns, url_column)
    fallback = F.lit("")
    if fallback_column:
        j = resolve_named(raw.columns, fallback_column)
        if i == j:
            raise ValueError("the fallback column is the URL column")
        fallback = F.coalesce(trim_ws(F.col(f"`{raw.columns[j]}`")), F.lit(""))
    rows = raw.select(F.monotonically_increasing_id().alias("pos"), trim_ws(F.col(f"`{raw.columns[i]}`")).alias("url"), fallback.alias("fallback"))
    return rows.where("coalesce(url, '') <> ''")


def read_seeds(spark: SparkSession, path: str, url_column: str = "", fallback_column: str = "") -> DataFrame:
    """By extension: .csv, .tsv, anything else as text."""
    low = path.lower()
    if low.endswith((".csv", ".tsv")):
        return read_delimited(spark, path, "\t" if low.endswith(".tsv") else ",", url_column, fallback_column)
    if fallback_column:
        raise ValueError(f"a fallback column needs a .csv or .tsv file, not {path}")
    return read_text(spark, path)
