"""Uploaded files as rows: classification, decoding and titles, for batches and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.scalars import decode_utf8
from pagewright.operators.layout import pages_to_markdown

TEXT_SUFFIXES = (".md", ".markdown", ".txt")
TEXT_TYPES = ("text/markdown", "text/x-markdown", "text/plain")
PDF_SUFFIXES, PDF_TYPES = (".pdf",), ("application/pdf",)
UNNAMED = "uploaded-document"


def basename(filename: Column) -> Column:
    """The last part of a path, whichever way its slashes lean; a missing name gets a fixed one."""
    return F.coalesce(F.nullif(F.regexp_extract(filename, r"([^/\\]*)[/\\]*$", 1), F.lit("")), F.lit(UNNAMED))


def classify(filename: Column, mime: Column) -> Column:
    """'direct' for text by suffix or type, else 'pdf' by either, else null: the file is not supported."""
    suffix = F.lower(F.regexp_extract(basename(filename), r"(?<=.)(\.[^.]+)$", 1))  # a name that only begins with a dot has none
    mime = F.coalesce(mime, F.lit(""))
    return F.when(suffix.isin(*TEXT_SUFFIXES) | mime.isin(*TEXT_TYPES), "direct").when(suffix.isin(*PDF_SUFFIXES) | mime.isin(*PDF_TYPES), "pdf")


def title(filename: Column, document_id: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(basename(filename), r"(?<=.)\.[^.]*$", ""), F.lit("")), document_id)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder: document_id (by the path), filename, content."""
    return identified(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def identified(raw: DataFrame) -> DataFrame:
    """A file keeps its id when its content changes."""
    return raw.select(F.sha2(F.col("path"), 256).alias("document_id"), F.col("path").alias("filename"), "content")


def _kinds(files: DataFrame) -> DataFrame:
    mime = F.col("mime_type") if "mime_type" in files.columns else F.lit(None).cast("string")
    return files.withColumn("kind", classify(F.col("filename"), mime))


def artifacts(files: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Documents (document_id, title, markdown, error) of uploaded files of a supported kind. Text is decoded; a PDF takes
    its pages from ``pages`` (the converter's page table, ``layout.PAGES``), and is an error where there are none."""
    named = _kinds(files).filter("kind is not null").withColumn("title", title(F.col("filename"), F.col("document_id")))
    direct = named.filter("kind = 'direct'").select("document_id", "title", decode_utf8(F.col("content")).alias("markdown"), F.lit(None).cast("string").alias("error"))
    pdf = named.filter("kind = 'pdf'").select("document_id", "title")
    if pages is None:
        made = pdf.withColumn("markdown", F.lit(None).cast("string"))
    else:
        wanted = pages.join(pdf.select("document_id"), "document_id", "left_semi")
        made = pdf.join(pages_to_markdown(wanted), "document_id", "left")
    return direct.unionByName(made.select("document_id", "title", "markdown", F.when(F.col("markdown").isNull(), "no pages were converted").alias("error")))


def rejected(files: DataFrame) -> DataFrame:
    """Files of no supported kind: they get no document."""
    return _kinds(files).filter("kind is null").select("document_id", "filename")


def save_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each file to ``folder/document_id/basename`` where it lies; (document_id, file_path, error), the error in
    place of a path where it could not be written."""
    rows = files.select("document_id", basename(F.col("filename")).alias("name"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        for batch in batches:
            paths, errors = [], []
            for document, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    fs.create_dir(f"{root}/{document}", recursive=True)
                    with fs.open_output_stream(f"{root}/{document}/{name}", compression=None) as out:
                        out.write(content or b"")
                    paths.append(f"{folder}/{document}/{name}")
                    errors.append(None)
                except OSError as problem:
                    paths.append(None)
                    errors.append(str(problem))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(errors, pa.string())], names=["document_id", "file_path", "error"])

    return rows.mapInArrow(run, "document_id string, file_path string, error string")


def delete_files(folder: str, document_id: str) -> None:
    """Removes a document's files; nothing happens where there are none."""
    fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
    if fs.get_file_info(f"{root}/{document_id}").type == pafs.FileType.Directory:
        fs.delete_dir(f"{root}/{document_id}")
