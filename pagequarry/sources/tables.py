"""Readers of stored tables and documents."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry import schemas

SITEMAP_BYTES = 100 << 20
BODY_BYTES = 20 << 20


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records that were written as JSON lines."""
    return spark.read.schema(schemas.RECORDS).json(path)


def read_fetches(spark: SparkSession, path: str) -> DataFrame:
    """Stored responses; bodies are cut at the size limit of a fetch."""
    f = spark.read.schema(schemas.FETCHES).parquet(path)
    return f.withColumn("body", F.when(F.octet_length("body") > BODY_BYTES, F.decode(F.substring(F.encode("body", "UTF-8"), 1, BODY_BYTES), "UTF-8")).otherwise(F.col("body")))


def read_tier_cache(spark: SparkSession, path: str) -> DataFrame:
    """Observed tiers; route.latest_tier gives each host's."""
    return spark.read.schema(schemas.TIER_CACHE).parquet(path)


def read_content_cache(spark: SparkSession, path: str) -> DataFrame:
    """Stored answers, for route.with_cache."""
    return spark.read.schema(schemas.CONTENT_CACHE).parquet(path)


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """url (the path), body of sitemap files, gunzipped by magic number."""

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        def one(b: bytes) -> str:
            if b[:2] == b"\x1f\x8b":
                import io

                b = gzip.GzipFile(fileobj=io.BytesIO(b)).read(SITEMAP_BYTES)
            return b[:SITEMAP_BYTES].decode("utf-8", "replace")

        return content.map(one)

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), text("content").alias("body"))
