"""Laid-out pages to markdown: reading order in one or two columns, headings by size, page markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.scalars import SPACE

MIN_TEXT_CHARS, MAX_HEADING_CHARS, DEFAULT_SIZE = 10, 100, 11.0
SCANNED_NOTE = "*[scanned page %d: no text layer; OCR not configured]*"  # fixed value
#: document_id, page (from 1), width, blocks
PAGES = "document_id string, page int, width double, blocks array<struct<type:int, bbox:array<double>, lines:array<struct<spans:array<struct<text:string, size:double>>>>>>"


def trimmed(text):
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def heading_level(size, body):
    ratio = size / body
    return F.when(body <= 0, 0).when(ratio >= 1.5, 1).when(ratio >= 1.3, 2).when(ratio >= 1.08, 3).otherwise(0)


def page_blocks(pages: DataFrame) -> DataFrame:
    """Text blocks in reading order: document_id, page, turn, flat text, paragraph lines, median size.

    A page has two columns where one block ends left of its middle and another starts right of it; blocks that straddle
    the middle belong to the left column."""
    b = pages.select("document_id", "page", "width", F.posexplode("blocks").alias("pos", "b")).filter("b.type = 0")
    b = b.select("document_id", "page", "pos", (F.col("width") / 2).alias("mid"), F.expr("b.bbox[0]").alias("x0"), F.expr("b.bbox[1]").alias("y0"), F.expr("b.bbox[2]").alias("x1"), "b.lines")
    b = b.filter(F.exists("lines", lambda x: F.exists(x.spans, lambda s: trimmed(s.text) != "")))  # blocks without text take no part
    on_page = Window.partitionBy("document_id", "page")
    two = F.bool_or(F.col("x1") < F.col("mid")).over(on_page) & F.bool_or(F.col("x0") > F.col("mid")).over(on_page)
    straddles = (F.col("x0") < F.col("mid")) & (F.col("x1") > F.col("mid"))
    column = F.when(two & ~straddles & ((F.col("x0") + F.col("x1")) / 2 >= F.col("mid")), 1).otherwise(0)
    turn = F.row_number().over(on_page.orderBy(column, "y0", "x0", "pos"))
    lines = F.filter(F.transform("lines", lambda x: trimmed(F.array_join(F.transform(x.spans, lambda s: s.text), ""))), lambda t: t != "")
    spans = F.filter(F.flatten(F.transform("lines", lambda x: x.spans)), lambda s: trimmed(s.text) != "")
    sizes = F.array_sort(F.transform(spans, lambda s: s["size"]))
    n = F.size(sizes)
    median = F.when(n > 0, (F.element_at(sizes, ((n + 1) / 2).cast("int")) + F.element_at(sizes, (n / 2).cast("int") + 1)) / 2)
    return b.select("document_id", "page", turn.alias("turn"), lines.alias("lines"), F.when(n > 0, median).alias("size"))


def body_sizes(pages: DataFrame) -> DataFrame:
    """(document_id, body): the commonest span size, of equally common ones that seen first; scanned pages do not count."""
    text = F.flatten(F.transform(F.flatten(F.transform(F.filter("blocks", lambda b: b["type"] == 0), lambda b: b.lines)), lambda x: F.transform(x.spans, lambda s: s.text)))
    pages = pages.filter(F.length(trimmed(F.array_join(text, ""))) >= MIN_TEXT_CHARS)
    spans = pages.select("document_id", "page", F.posexplode("blocks").alias("pos", "b")).filter("b.type = 0")
    spans = spans.select("document_id", "page", "pos", F.posexplode(F.flatten(F.transform("b.lines", lambda x: x.spans))).alias("at", "s")).filter(trimmed(F.col("s.text")) != "")
    counted = spans.groupBy("document_id", F.col("s.size").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "pos", "at")).alias("first"))
    return counted.groupBy("document_id").agg(F.min_by("size", F.struct(-F.col("n"), F.col("first"))).alias("body"))


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """(document_id, markdown): a marker for each page, then a note where it has next to no text, else its blocks."""
    blocks = page_blocks(pages).join(body_sizes(pages), "document_id", "left")
    flat = F.array_join("lines", " ")
    level = F.when(F.length(flat) > MAX_HEADING_CHARS, 0).otherwise(heading_level(F.col("size"), F.coalesce("body", F.lit(DEFAULT_SIZE))))
    text = F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), flat)).otherwise(F.array_join("lines", "\n"))
    made = blocks.filter(F.size("lines") > 0).groupBy("document_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("text")))), lambda x: x.text), "\n\n").alias("body"), F.sum(F.length(flat)).alias("chars"))
    joined = pages.select("document_id", "page").join(made, ["document_id", "page"], "left")
    marker = F.format_string("<!-- page: %d -->", "page")
    scanned = F.coalesce("chars", F.lit(0)) < MIN_TEXT_CHARS
    rendered = F.concat_ws("\n\n", marker, F.when(scanned, F.format_string(SCANNED_NOTE, "page")).otherwise(F.when(F.col("body") != "", F.col("body"))))
    return joined.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", rendered.alias("text")))), lambda x: x.text), "\n\n").alias("markdown"))
