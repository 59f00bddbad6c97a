"""The record of a URL, its CSV and JSON forms, dead letters, and the sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.functions import pdftext
from pagequarry.functions.quality import is_html, is_json, is_pdf, is_reachable
from pagequarry.functions.text import cell, has_path
from pagequarry.functions.urls import canonicalize_url, content_hash
from pagequarry.html.functions import finish_metadata, parse_page
from pagequarry.html.spec import FieldSpec, Schema

DISCOVERY = "struct<path:string,primary_url:string,fallback_url:string>"
EVASION = "struct<browser_like:boolean,stealth:boolean,user_agent:string,jitter_ms:bigint,tls_match:string,proxy:boolean>"
PDF = "struct<page_count:int,title:string,author:string,created_at:timestamp,has_text_layer:boolean,used_ocr:boolean,extractor_tier:string,pages:array<struct<number:int,text:string>>>"
PAGE = {"title": "string", "description": "string", "canonical": "string", "language": "string", "published_at": "timestamp", "open_graph": "map<string,string>", "twitter": "map<string,string>", "json_ld": "array<string>"}
#: Columns of a CSV file before the extracted ones.
CSV_BASE = ("url", "canonical_url", "tier", "status_code", "duration_ms", "content_type", "failure_category", "error")


def build(outcomes: DataFrame, fetched_at: Column, css: Sequence[FieldSpec] = (), schema: Schema | None = None, body_format: str = "", metadata: bool = True, readable: bool = False, screenshots: str = "") -> DataFrame:
    """Records of route.outcomes' rows, each page parsed once.

    Fields and markdown come from the readable part if that is asked for; metadata always from the page; where css
    and schema share a name, the schema's value is taken. Further columns of outcomes are used where they are there:
    seed_url (as the seed was given; url is what was fetched), final_url, redirects, discovery, evasion, from_cache,
    screenshot (bytes), and from apply_pdf pdf, title, body_bytes, content_hash."""
    given = dict(zip(outcomes.columns, outcomes.columns))
    optional = lambda name, kind: F.col(given[name]) if name in given else F.lit(None).cast(kind)
    pdf = optional("pdf", PDF)
    ok, kind = F.col("valid"), F.coalesce("content_type", F.lit(""))
    html = ok & is_html(kind) & pdf.isNull()
    canonical = canonicalize_url("url")
    o = outcomes.withColumn("__page", F.when(html, F.col("body")))
    clean = readable and body_format == "html"
    if css or schema or metadata or clean or body_format == "markdown":
        o = o.withColumn("__x", parse_page("__page", canonical, css=css, schema=schema, markdown=body_format == "markdown", readable=readable, metadata=metadata))
    fields: dict[str, Column] = {f.name: F.col(f"__x.css.{f.name}") for f in css} | ({n: F.col(f"__x.schema.{n}") for n in schema.fields} if schema else {})
    some = F.coalesce(*[F.when(c.isNotNull(), True) for c in fields.values()], F.lit(False)) if fields else F.lit(False)
    extracted = F.when(some, F.struct(*[c.alias(n) for n, c in fields.items()])) if fields else F.lit(None).cast("string")
    body = o["body"]
    if body_format == "markdown":
        out = F.when(pdf.isNotNull() | is_json(kind), body).when(html, F.col("__x.markdown")).otherwise(body)
        named = F.when(pdf.isNull() & is_json(kind), "json").otherwise("markdown")
    elif body_format == "html":
        out = F.when(html, F.col("__x.readable")).otherwise(body) if clean else body
        named = F.when(pdf.isNotNull(), "markdown").otherwise("html")
    elif body_format == "json":
        out = (F.when(some, F.to_json(extracted)) if fields else F.when(F.lit(False), "")).when(is_json(kind), body).otherwise(F.lit("{}"))
        named = F.lit("json")
    else:
        out = named = F.lit(None).cast("string")
    out = F.when(ok, out)
    read = finish_metadata(F.col("__x.metadata")) if metadata else None
    page = F.when(html, read) if metadata else F.lit(None).cast("struct<title:string>")
    if metadata and "title" in given:
        bare = F.struct(*[(F.col("title") if n == "title" else F.lit(None).cast(t)).alias(n) for n, t in PAGE.items()])
        page = F.when(html, read).when(F.col("title").isNotNull(), bare)
    hits = sum((F.when(F.col(f"__x.css.{f.name}").isNotNull(), 1).otherwise(0) for f in css), F.lit(0))
    size = F.coalesce(optional("body_bytes", "int"), F.octet_length("body"))
    digest = F.coalesce(optional("content_hash", "string"), content_hash("body"))
    return o.select(
        F.coalesce(optional("seed_url", "string"), "url").alias("url"), canonical.alias("canonical_url"), fetched_at.alias("fetched_at"), "tier", "status_code", "duration_ms",
        F.when(body.isNotNull(), digest).alias("content_hash"), extracted.alias("extracted"), out.alias("body"), F.when(out.isNotNull(), named).alias("body_format"),
        F.struct(
            "content_type", size.alias("body_bytes"), F.when(body.isNotNull(), F.coalesce(optional("final_url", "string"), "url")).alias("final_url"), optional("redirects", "array<string>").alias("redirects"),
            (F.when(ok, F.struct(F.lit(len(css)).alias("fields"), hits.alias("hits"))) if css else F.lit(None).cast("struct<fields:int,hits:int>")).alias("extraction"),
            optional("discovery", DISCOVERY).alias("discovery"), page.alias("page"),
            (F.when(F.col("screenshot").isNotNull(), screenshot_path(screenshots, canonical)) if screenshots and "screenshot" in given else F.lit(None).cast("string")).alias("screenshot_path"),
            F.coalesce(optional("from_cache", "boolean"), F.lit(False)).alias("from_cache"), optional("evasion", EVASION).alias("evasion"), "soft_block", pdf.alias("pdf"),
        ).alias("metadata"),
        "error", "failure_category",
    )


def blocked(urls: DataFrame, like: DataFrame, fetched_at: Column, tier: str) -> DataFrame:
    """Records, of like's columns, of URLs (url) that robots rules keep from being fetched."""
    why = {"url": F.col("url"), "canonical_url": F.col("url"), "fetched_at": fetched_at, "tier": F.lit(tier), "status_code": F.lit(0), "duration_ms": F.lit(0), "error": F.lit("blocked by robots.txt"), "failure_category": F.lit("robots_blocked")}
    return urls.select(*[why.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def apply_pdf(outcomes: DataFrame, texts: DataFrame, ocr: bool = False) -> DataFrame:
    """outcomes with the bodies of PDF answers replaced by their text, and pdf (struct) or a soft failure.

    texts: url, plain, layout, ocr, info (the tools' output). A PDF without text keeps its body and gets the
    category extraction_failed, or pdf_tooling_missing where no tool gave anything. The document's title is
    the page's title."""
    read = pdftext.extract("plain", "layout", "ocr" if ocr else None)
    numbered = F.transform(pdftext.pages_of(F.when(~pdftext.is_stub("plain"), F.col("plain")).when(~pdftext.is_stub("layout"), F.col("layout")).otherwise(F.col("ocr") if ocr else F.lit(None).cast("string"))), lambda p: F.struct(p["number"].alias("number"), p["text"].alias("text")))
    t = texts.select("url", read.withField("pages", numbered).alias("__t"), pdftext.info("info").alias("__i"), (F.col("plain").isNull() & F.col("layout").isNull()).alias("__none"), F.when(~pdftext.is_stub("plain"), True).otherwise(~pdftext.is_stub("layout")).alias("__layer"))
    j = outcomes.join(t, "url", "left")
    pdf = F.col("valid") & is_pdf(F.coalesce("content_type", F.lit("")))
    got = F.coalesce(pdf & (F.col("__t.category") == "success"), F.lit(False))
    failed = pdf & ~got
    bare = F.coalesce(F.col("__none"), F.lit(True))
    made = F.struct(F.col("__i.page_count").alias("page_count"), F.col("__i.title").alias("title"), F.col("__i.author").alias("author"), F.col("__i.created_at").alias("created_at"), F.col("__layer").alias("has_text_layer"), F.col("__t.used_ocr").alias("used_ocr"), F.col("__t.tier").alias("extractor_tier"), F.col("__t.pages").alias("pages"))
    change = {
        "body": F.when(got, F.col("__t.text")).otherwise(F.col("body")), "content_type": F.when(got, F.lit("text/markdown")).otherwise(F.col("content_type")),
        "failure_category": F.when(failed & bare, F.lit("pdf_tooling_missing")).when(failed, F.lit("extraction_failed")).otherwise(F.col("failure_category")),
        "error": F.when(failed & bare, F.lit("pdftotext not found")).when(failed, F.lit("pdf: no text")).otherwise(F.col("error")),
    }
    before = [F.octet_length("body").alias("body_bytes"), content_hash("body").alias("content_hash")]
    return j.select(*[change[c].alias(c) if c in change else F.col(c) for c in outcomes.columns], *before, F.when(got, made).alias("pdf"), F.when(got & (F.col("__i.title") != ""), F.col("__i.title")).alias("title"))


def dead_letters(records: DataFrame) -> DataFrame:
    return records.where(~is_reachable("failure_category"))


def jsonl(records: DataFrame) -> DataFrame:
    """One JSON line a record; nulls left out, empty strings kept."""
    return records.select(F.to_json(F.struct(*records.columns)).alias("line"))


def flatten(records: DataFrame, columns: Sequence[str] | None = None, parity: bool = True) -> DataFrame:
    """Records as text cells: the given dot paths in order, or the base columns and then the extracted fields, sorted.

    With parity, the base column content_type is only read at top level (and so is blank where it is part of
    the metadata)."""
    kind = has_path(records.schema, "extracted")
    extracted = sorted(kind.fieldNames()) if isinstance(kind, T.StructType) else []
    paths = list(columns) if columns is not None else [*CSV_BASE, *(f"extracted.{n}" for n in extracted)]
    out = []
    for p in paths:
        q = "metadata.content_type" if p == "content_type" and not parity and has_path(records.schema, p) is None else p
        found = has_path(records.schema, q)
        out.append((cell(F.col(q), found) if found is not None else F.lit("")).alias(p))
    return records.select(*out)


def locked_keys(records: DataFrame, pos: str, extracted: str = "extracted") -> list[str]:
    """Keys of the first record's extracted map, sorted: a CSV header is fixed by them."""
    row = records.orderBy(pos).select(F.array_sort(F.map_keys(extracted)).alias("k")).limit(1).collect()
    return list(row[0]["k"] or []) if row else []


def dropped_keys(records: DataFrame, locked: Sequence[str], extracted: str = "extracted") -> DataFrame:
    """records with dropped: sorted keys of the extracted map that the header doesn't have."""
    return records.withColumn("dropped", F.array_sort(F.array_except(F.map_keys(extracted), F.array(*[F.lit(k) for k in locked]).cast("array<string>"))))


def write(records: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "append") -> None:
    """Sink by extension: .csv and .tsv as cells with a header, anything else as JSON lines."""
    if path.endswith((".csv", ".tsv")):
        flatten(records, columns).write.mode(mode).option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)
        return
    if columns is not None:
        raise ValueError("columns only go with .csv and .tsv")
    records.write.mode(mode).option("ignoreNullFields", True).json(path)


def write_urls(urls: DataFrame, path: str) -> None:
    urls.select("url").write.mode("append").text(path)


def screenshot_path(folder: str, url: Column) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.sha2(url.cast("binary"), 256), F.lit(".png"))
