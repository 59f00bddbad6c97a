"""The operators as SQL functions: those on URLs and answers are SQL expressions that Catalyst sees into, those on
documents read batches of pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import quality
from pagequarry.functions.urls import PARTS, TRACKING
from pagequarry.html import extract, render
from pagequarry.html.dom import parse
from pagequarry.html.spec import parse_field_spec, parse_schema


_BLOCK = "STRUCT<vendor: STRING, marker: STRING>"
_VERDICT = "STRUCT<valid: BOOLEAN, reason: STRING, escalate: BOOLEAN, vendor: STRING, marker: STRING>"


def _part(u: str, n: int) -> str:
    return f"regexp_extract({u}, R'{PARTS}', {n})"


def _host(u: str) -> str:
    at = f"regexp_replace({_part(u, 2)}, '^.*@', '')"
    return rf"CASE WHEN {at} RLIKE R'^(\[[^\]]*\]|[^:\[\]]*):[0-9]*$' THEN regexp_replace({at}, ':[0-9]*$', '') ELSE {at} END"


def _text(spark: SparkSession, shape: str, expression: Column) -> str:
    """SQL text of a Column over columns of that shape (without lambdas)."""
    plan = spark.createDataFrame([], shape).select(expression.alias("x"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql()


def expressions(spark: SparkSession) -> dict[str, str]:
    """Signature and body of each function that is an expression."""
    u = r"regexp_replace(url, R'^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '')"
    names = ", ".join(f"'{t}'" for t in TRACKING)
    pairs = f"transform(filter(split({_part(u, 4)}, '&'), p -> p <> ''), p -> struct(regexp_extract(p, '^([^=]*)(.*)$', 1) AS k, regexp_extract(p, '^([^=]*)(.*)$', 2) AS v))"
    query = f"array_join(transform(array_sort(filter({pairs}, p -> NOT array_contains(array({names}), lower(p.k)))), p -> concat(p.k, p.v)), '&')"
    scheme, at = f"lower({_part(u, 1)})", f"lower(regexp_replace({_part(u, 2)}, '^.*@', ''))"
    port = f"CASE {scheme} WHEN 'http' THEN regexp_replace({at}, ':80$', '') WHEN 'https' THEN regexp_replace({at}, ':443$', '') ELSE {at} END"
    path = f"CASE WHEN {_part(u, 3)} = '' THEN '/' ELSE {_part(u, 3)} END"
    canonical = f"CASE WHEN {_host(u)} <> '' THEN concat({scheme}, '://', regexp_extract({_part(u, 2)}, '^(.*@)', 1), {port}, {path}, CASE WHEN {query} = '' THEN '' ELSE concat('?', {query}) END) END"
    block = _text(spark, "body string", quality.soft_block("body"))
    shape = f"status int, content_type string, body string, wall {_BLOCK}"
    parts = {n: _text(spark, shape, quality.validity("status", "content_type", "body", block=F.col("wall"), field=n)) for n in ("valid", "reason", "escalate", "vendor", "marker")}
    verdict = "named_struct(" + ", ".join(f"'{n}', {x}" for n, x in parts.items()) + ")"
    verdict = re.sub(r"\bwall\b", "detect_soft_block(body)", verdict)
    category = _text(spark, "error string, reason string, status int", quality.classify_failure("error", "reason", "status"))
    return {
        "canonicalize_url(url STRING) RETURNS STRING": canonical,
        "url_host(url STRING) RETURNS STRING": f"nullif(lower({_host(u)}), '')",
        f"detect_soft_block(body STRING) RETURNS {_BLOCK}": f"CAST({block} AS {_BLOCK})",
        f"check_validity(status INT, content_type STRING, body STRING) RETURNS {_VERDICT}": f"CAST({verdict} AS {_VERDICT})",
        "classify_failure(error STRING, reason STRING, status INT) RETURNS STRING": category,
    }


def register(spark: SparkSession) -> list[str]:
    """Register the functions on spark and return their names."""
    import json

    inline = expressions(spark)
    for signature, body in inline.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")

    @F.pandas_udf("array<string>")
    def extract_links(html: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([extract.all_links(parse(h), b or "") for h, b in zip(html, base)])

    @F.pandas_udf("string")
    def extract_css(html: pd.Series, spec: pd.Series) -> pd.Series:
        """JSON of fields given as ``name=selector`` joined by line breaks."""
        programs = {s: [parse_field_spec(x) for x in s.split("\n")] for s in spec.unique()}
        return pd.Series([json.dumps(extract.css(parse(h), programs[s]), sort_keys=True, ensure_ascii=False) for h, s in zip(html, spec)])

    @F.pandas_udf("string")
    def extract_schema(html: pd.Series, schema: pd.Series) -> pd.Series:
        """JSON of what a schema (itself JSON) extracts."""
        programs = {s: parse_schema(json.loads(s)) for s in schema.unique()}
        return pd.Series([json.dumps(extract.schema(parse(h), programs[s]), sort_keys=True, ensure_ascii=False) for h, s in zip(html, schema)])

    @F.pandas_udf("string")
    def page_metadata_json(html: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(extract.metadata(parse(h), b or ""), sort_keys=True, ensure_ascii=False) for h, b in zip(html, base)])

    @F.pandas_udf("string")
    def to_markdown(html: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([render.to_markdown(parse(h), b or "") for h, b in zip(html, base)])

    @F.pandas_udf("string")
    def readable(html: pd.Series) -> pd.Series:
        return pd.Series([render.readable(parse(h), h or "") for h in html])

    @F.pandas_udf("boolean")
    def is_spa_shell(html: pd.Series) -> pd.Series:
        return pd.Series([extract.is_shell(parse(h)) for h in html])

    made = {"extract_links": extract_links, "extract_css": extract_css, "extract_schema": extract_schema, "page_metadata": page_metadata_json, "to_markdown": to_markdown, "readable": readable, "is_spa_shell": is_spa_shell}
    for name, f in made.items():
        spark.udf.register(name, f)
    return [*made, *(x.partition("(")[0] for x in inline)]
