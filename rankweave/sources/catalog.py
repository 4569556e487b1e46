"""The catalog: one line of text and one link per issue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import join_url
from .pages import decoded, element, page_links

# The form of a catalog line, and the classes of the list and of its items.
LINE = r"(?U)^Issue #(\d+)\s+—\s+(\w+)\s+(\d+)\W+(\d+)$"
LIST_CLASS, ITEM_CLASS = "issues", "issue"


def parse_catalog(lines: DataFrame, base_url: str) -> tuple[DataFrame, DataFrame]:
    """Split ``(line, href)`` into parsed issues and lines that do not parse.

    Parsed rows are ``(id, publish_date, url)`` and whatever else came along;
    the rest keep their columns.
    """

    def part(i: int):
        return F.regexp_extract("line", LINE, i)

    day = F.concat_ws(" ", part(2), part(3), part(4))
    read = lines.withColumn("_id", F.try_to_number(part(1), F.lit("9" * 18)).cast("bigint")).withColumn(
        "_date", F.to_date(F.try_to_timestamp(day, F.lit("MMMM d yyyy")))
    )
    good = F.col("line").isNotNull() & F.col("_id").isNotNull() & F.col("_date").isNotNull()
    parsed = read.filter(good).select(
        F.col("_id").alias("id"),
        F.col("_date").alias("publish_date"),
        join_url(base_url, F.col("href")).alias("url"),
        *[c for c in lines.columns if c not in ("line", "href")],
    )
    return parsed, read.filter(~F.coalesce(good, F.lit(False))).select(*lines.columns)


def catalog_lines(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(line, href)`` of every issue division of the issue list of each catalog page.

    The list starts at the division of class ``issues``; each division of class ``issue`` after
    it gives its text (tags dropped, references decoded, white space at both ends removed) and
    the first link it holds (null without).  A page without the list gives no lines; an issue
    division is taken to hold no other division.
    """
    listed = F.regexp_extract(F.col(html), rf"""(?is)<div\b[^>]*?\sclass\s*=\s*["']?{LIST_CLASS}["'\s>].*""", 0)
    items = F.regexp_extract_all(listed, F.lit(element("div", ITEM_CLASS)), F.lit(0))
    rows = pages.select(F.explode(items).alias("item"))
    text = decoded(F.regexp_replace(F.regexp_replace("item", r"<[^>]*>", ""), r"^\s+|\s+$", ""))
    return rows.select(text.alias("line"), F.get(page_links(F.col("item")), F.lit(0)).alias("href"))
