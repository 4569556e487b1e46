"""A folder of page files as a source: one HTML file per page, named ``page-<id>.html``.

Files are read by Spark's ``binaryFile`` source; the page id comes from the file name, the
text from the bytes: UTF-8 unless the page declares ISO-8859-1 or windows-1252 in a ``meta``
charset, in which case each byte is its character.  A file without an id in its name, or one
that isn't valid UTF-8 where it should be, goes to the quarantine with the reason.  Spark's file
sources skip files of no bytes, so a page written with a null or empty html is in neither table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The file names and the single-byte charsets a page may declare.
NAME = r"(?:^|/)page-(-?\d+)\.html$"
SINGLE_BYTE = ("iso-8859-1", "latin1", "latin-1", "windows-1252")
CHARSET = r"""(?is)<meta\b[^>]*?charset\s*=\s*["']?([A-Za-z0-9_-]+)"""


def write_page_files(pages: DataFrame, folder: str) -> None:
    """Every page as ``folder/page-<page_id>.html`` in UTF-8, written by the tasks that hold it.

    A null html gives an empty file; a page without an id is not written.  Writing a page again
    replaces its file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        written = 0
        for batch in batches:
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                if page_id is None:
                    continue
                with files.open_output_stream(f"{base}/page-{page_id}.html") as out:
                    out.write((html or "").encode())
                written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["written"])

    pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "written long").agg(F.sum("written")).collect()


def _text(content: Column) -> tuple[Column, Column]:
    """The text of the bytes and whether it is what the bytes say."""
    utf8 = content.cast("string")
    declared = F.lower(F.regexp_extract(utf8, CHARSET, 1))
    single = declared.isin(*SINGLE_BYTE)
    text = F.when(single, F.decode(content, "ISO-8859-1")).otherwise(utf8)
    return text, single | F.is_valid_utf8(utf8)


def read_page_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(page_id, html)`` of the good files and ``(path, error)`` of the others."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    name = F.regexp_extract("path", NAME, 1)
    text, right = _text(F.col("content"))
    error = (
        F.when(name == "", "no page id in the file name")
        .when(~right, "not UTF-8 and no single-byte charset declared")
    )
    read = raw.select("path", name.alias("name"), text.alias("html"), error.alias("error"))
    good = read.where(F.col("error").isNull()).select(F.col("name").cast("long").alias("page_id"), "html")
    return good, read.where(F.col("error").isNotNull()).select("path", "error")
