r"""Text that came out of PDF files: pages at form feeds, stubs, the plain - layout - OCR ladder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.functions.text import pdf_date
from pagequarry.functions.urls import col, trim_ws

STUB_BYTES = 16


def is_stub(text: Column | str) -> Column:
    """Fewer than 16 bytes beside form feeds and outer white space."""
    return F.octet_length(trim_ws(F.replace(F.coalesce(col(text), F.lit("")), F.lit("\f"), F.lit("")))) < STUB_BYTES


def pages_of(text: Column | str) -> Column:
    """array<struct(number, text)> from 1; form feeds at the end make no page."""
    body = F.regexp_replace(col(text), r"\f+$", "")
    return F.transform(F.split(body, "\f", -1), lambda x, i: F.struct((i + 1).alias("number"), x.alias("text")))


def render(text: Column | str) -> Column:
    return F.replace(col(text), F.lit("\f"), F.lit("\n\n"))


def is_encryption_error(message: Column | str) -> Column:
    m = F.lower(F.coalesce(col(message), F.lit("")))
    return m.contains("incorrect password") | m.contains("pdf file is encrypted") | m.contains("encrypted pdf")


def is_pdf_bytes(body: Column | str) -> Column:
    return F.substring(col(body).cast("binary"), 1, 5) == F.unhex(F.lit("255044462D"))


def stitch(pages: Column) -> Column:
    """Recognised pages array<struct(name, text)> joined by form feeds in the order of the number in their names."""
    number = lambda p: F.coalesce(F.regexp_extract(p["name"], r"([0-9]+)[^0-9]*$", 1).try_cast("int"), F.lit(-1))
    numbered = F.transform(pages, lambda p: F.struct(number(p).alias("n"), p["name"].alias("name"), p["text"].alias("text")))
    return F.array_join(F.transform(F.array_sort(numbered), lambda p: p["text"]), "\f")


def extract(plain: Column | str, layout: Column | str, ocr: Column | str | None = None) -> Column:
    """struct(text, tier, used_ocr, category): the first text that isn't a stub. Without one, pdf_tooling_missing
    where no OCR was at hand, else extraction_failed."""
    rungs = [("pdftotext", plain, False), ("pdftotext-layout", layout, False)] + ([("tesseract", ocr, True)] if ocr is not None else [])
    out = None
    for tier, text, used in rungs:
        got = F.struct(render(text).alias("text"), F.lit(tier).alias("tier"), F.lit(used).alias("used_ocr"), F.lit("success").alias("category"))
        ok = col(text).isNotNull() & ~is_stub(text)
        out = F.when(ok, got) if out is None else out.when(ok, got)
    failed = "extraction_failed" if ocr is not None else "pdf_tooling_missing"
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("text"), F.lit("").alias("tier"), F.lit(False).alias("used_ocr"), F.lit(failed).alias("category")))


def info(text: Column | str) -> Column:
    """struct(title, author, page_count, created_at) from "Key: value" lines."""
    value = lambda k: trim_ws(F.regexp_extract(col(text), rf"(?m)^{k}:([^\n]*)$", 1))
    return F.struct(value("Title").alias("title"), value("Author").alias("author"), value("Pages").try_cast("int").alias("page_count"), pdf_date(value("CreationDate")).alias("created_at"))
