"""HTML operators as Arrow-batched UDFs: a page is parsed once for all the parts that are asked for."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.functions.text import published_at
from pagequarry.functions.urls import col
from pagequarry.html import extract, render
from pagequarry.html.dom import parse
from pagequarry.html.spec import FieldSpec, Schema

_S, _A = T.StringType(), T.ArrayType(T.StringType())
METADATA = T.StructType([T.StructField(n, k) for n, k in (("title", _S), ("description", _S), ("canonical", _S), ("language", _S), ("published", _A), ("open_graph", T.MapType(_S, _S)), ("twitter", T.MapType(_S, _S)), ("json_ld", _A))])


def parse_page(html: Column | str, base: Column | str, *, css: Sequence[FieldSpec] = (), schema: Schema | None = None, links: bool = False, same_domain: bool = False, first: str = "", metadata: bool = False, markdown: bool = False, readable: bool = False, shell: bool = False, required: Sequence[str] = ()) -> Column:
    """struct with the parts asked for: css, schema, links, first, metadata, markdown, readable, shell, missed.

    With readable, css, schema and markdown see the readable part; metadata and links always the page."""
    kinds: list[T.StructField] = []
    add = lambda name, kind: kinds.append(T.StructField(name, kind))
    if css:
        add("css", T.StructType([T.StructField(f.name, f.spark_type()) for f in css]))
    if schema:
        add("schema", schema.spark_type())
    if links:
        add("links", _A)
    if first:
        add("first", _S)
    if metadata:
        add("metadata", METADATA)
    if readable:
        add("readable", _S)
    if markdown:
        add("markdown", _S)
    if shell:
        add("shell", T.BooleanType())
    if required:
        add("missed", _S)
    result = T.StructType(kinds)
    css = tuple(css)

    def one(page: str | None, url: str | None) -> dict:
        page, url = page or "", url or ""
        doc, out = parse(page), {}
        if links:
            out["links"] = extract.all_links(doc, url, same_domain)
        if first:
            out["first"] = extract.first_link(doc, url, first, same_domain)
        if metadata:
            out["metadata"] = extract.metadata(doc, url)
        if shell:
            out["shell"] = extract.is_shell(doc)
        if required:
            out["missed"] = extract.missed_selector(doc, required)
        if readable:
            out["readable"] = render.readable(doc, page)
            doc = parse(out["readable"])
        if css:
            got = extract.css(doc, css)
            out["css"] = {f.name: got.get(f.name) for f in css}
        if schema:
            out["schema"] = _filled(extract.schema(doc, schema), schema.spark_type())
        if markdown:
            out["markdown"] = render.to_markdown(doc, url)
        return {k.name: out.get(k.name) for k in kinds}

    @F.pandas_udf(result)
    def run(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p, u) for p, u in zip(pages, urls)], columns=[k.name for k in kinds])

    return run(col(html), col(base))


def _filled(value: object, kind: T.DataType) -> object:
    """Absent fields of nested objects as nulls, in the order of the type."""
    if isinstance(kind, T.StructType):
        return {f.name: _filled(value.get(f.name), f.dataType) for f in kind.fields} if isinstance(value, dict) else None
    if isinstance(kind, T.ArrayType) and isinstance(value, list):
        return [_filled(v, kind.elementType) for v in value]
    return value


def finish_metadata(m: Column) -> Column:
    """parse_page's metadata with the first candidate that is a date as published_at."""
    tries = F.filter(F.transform(m["published"], lambda c: published_at(c)), lambda t: t.isNotNull())
    return F.struct(*[m[c].alias(c) for c in ("title", "description", "canonical", "language")], F.get(tries, F.lit(0)).alias("published_at"), *[m[c].alias(c) for c in ("open_graph", "twitter", "json_ld")])


def page_metadata(html: Column | str, base: Column | str) -> Column:
    """struct(title, description, canonical, language, published_at, open_graph, twitter, json_ld)."""
    return finish_metadata(parse_page(html, base, metadata=True)["metadata"])


def hit_stats(extracted: Column, schema: T.StructType) -> Column:
    """struct(fields, hits) of a struct of extracted fields."""
    return F.struct(F.lit(len(schema.fields)).alias("fields"), sum((F.when(extracted[f.name].isNotNull(), 1).otherwise(0) for f in schema.fields), F.lit(0)).alias("hits"))


def merge_fields(df: DataFrame, flat: str, nested: str, out: str = "extracted") -> DataFrame:
    """One struct of the fields of both struct columns; where both have one, the nested schema's wins."""
    a, b = df.schema[flat].dataType, df.schema[nested].dataType
    cols = [F.col(f"{flat}.{n}").alias(n) for n in a.fieldNames() if n not in b.fieldNames()] + [F.col(f"{nested}.{n}").alias(n) for n in b.fieldNames()]
    return df.withColumn(out, F.struct(*cols))
