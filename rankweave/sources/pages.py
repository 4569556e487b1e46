"""Extraction from raw pages, all of it as column expressions.

Elements are found by pattern, not by building a tree: an element goes from its opening tag
to the first closing tag of its kind.  That is exact for elements that hold none of their own
kind.  Pages whose tables are nested or don't close are therefore left to the quarantine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import remove_first, strip_query

TEXT = T.StringType()
ENTRIES = T.ArrayType(
    T.StructType(
        [T.StructField(c, TEXT) for c in ("title", "author", "content", "main_link")]
        + [T.StructField("other_links", T.ArrayType(TEXT)), T.StructField("tag", TEXT)]
    )
)
# Entry positions inside a page stay below this, so ids never meet.
IDS_PER_ISSUE = 1 << 32

# The character references that pages use; the ampersand's comes last.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}
HREF = r"""(?i)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
TITLED = r"""(?is)<a\b[^>]*?\stitle\s*=[^>]*>.*?</a\s*>"""
CONTENT = r"""(?is)<div\b[^>]*?\sid\s*=\s*["']?content["'\s>].*"""


def page_title(html: Column) -> Column:
    """Raw text of the first title element, empty where there is none."""
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def decoded(text: Column) -> Column:
    """Character references as the characters they stand for."""
    for written, meant in REFERENCES.items():
        text = F.replace(text, F.lit(written), F.lit(meant))
    return text


def page_links(html: Column) -> Column:
    """Every href of an anchor, decoded, in page order."""
    found = F.regexp_extract_all(html, F.lit(HREF), F.lit(1))
    return F.transform(found, lambda v: decoded(F.regexp_replace(v, r"""^["']|["']$""", "")))


def element(name: str, css_class: str) -> str:
    """A pattern for an element of a class; group 1 is what it holds."""
    word = rf"""(?:"(?:[^"]*\s)?{css_class}(?:\s[^"]*)?"|'(?:[^']*\s)?{css_class}(?:\s[^']*)?'|{css_class}(?=[\s>]))"""
    return rf"(?is)<{name}\b[^>]*?\sclass\s*=\s*{word}[^>]*>(.*?)</{name}\s*>"


def all_of(fragment: Column, pattern: str) -> Column:
    return F.regexp_extract_all(fragment, F.lit(pattern), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it.

    Spark writes a column out wherever it is named, and inside array functions it finds no
    common parts; a function of the element of an array of one is given a computed value.
    """
    return F.get(F.transform(F.array(value), lambda held: use(held)), F.lit(0))


def held_by(fragment: Column, pattern: str) -> Column:
    """What the first match holds; null without one."""
    return F.get(F.regexp_extract_all(fragment, F.lit(pattern), F.lit(1)), F.lit(0))


def text_of(fragment: Column) -> Column:
    return decoded(F.regexp_replace(fragment, r"(?s)<[^>]*>", ""))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_start(text: Column, start: Column) -> Column:
    rest = F.substring(text, F.length(start) + 1, F.length(text))
    return F.when(F.startswith(text, start), rest).otherwise(text)


def without_end(text: Column, end: Column) -> Column:
    rest = F.substring(text, F.lit(1), F.length(text) - F.length(end))
    return F.when(F.endswith(text, end), rest).otherwise(text)


def no_links() -> Column:
    return F.array().cast("array<string>")


def entry(fits: Column, **fields: Column) -> Column:
    """An entry, or null if the item hasn't what its layout needs."""
    parts = []
    for field in ENTRIES.elementType.fields:
        value = fields.get(field.name, F.lit(None))
        parts.append(value.cast(field.dataType).alias(field.name))
    return F.when(fits, F.struct(*parts))


def described_item(item: Column) -> Column:
    """A description with a marked link, or one line of link and name."""

    def long(desc: Column, marked: Column, author: Column, content: Column, links: Column) -> Column:
        def of(title: Column, target: Column) -> Column:
            return entry(
                desc.isNotNull() & target.isNotNull(),
                title=title,
                author=author,
                content=let(without_start(content, title), lambda rest: without_start(rest, F.lit(" — "))),
                main_link=target,
                other_links=remove_first(links, target),
            )

        return let(text_of(marked), lambda title: let(F.get(page_links(marked), F.lit(0)), lambda target: of(title, target)))

    def line(desc: Column, author: Column, content: Column, links: Column) -> Column:
        single = F.size(links) == 1
        return entry(
            desc.isNotNull() & author.isNotNull(),
            title=stripped(without_end(content, author)),
            author=author,
            main_link=F.when(single, F.get(links, F.lit(0))),
            other_links=F.when(single, no_links()).otherwise(links),
        )

    def of(desc: Column, marked: Column, author: Column, content: Column, links: Column) -> Column:
        return F.when(marked.isNotNull(), long(desc, marked, author, content, links)).otherwise(
            line(desc, author, content, links)
        )

    def of_desc(desc: Column) -> Column:
        name = F.coalesce(held_by(item, element("p", "name")), held_by(desc, element("span", "name")))
        return let(held_by(desc, element("span", "mainlink")), lambda marked: let(
            text_of(name), lambda author: let(stripped(text_of(desc)), lambda content: let(
                page_links(item), lambda links: of(desc, marked, author, content, links)
            ))
        ))

    return let(held_by(item, element("p", "desc")), of_desc)


def primary_item(item: Column) -> Column:
    """A primary link, the first division that opens after it, and a cell of metadata."""
    link = element("a", "primary")

    def of(body: Column, meta: Column) -> Column:
        opened = F.regexp_extract(item, link, 0)
        return entry(
            body.isNotNull() & meta.isNotNull(),
            title=text_of(held_by(item, link)),
            author=metadata_author(meta),
            content=text_of(body),
            main_link=strip_query(F.get(page_links(opened), F.lit(0))),
            other_links=F.transform(page_links(body), strip_query),
            tag=metadata_tag(meta),
        )

    def of_rest(after: Column) -> Column:
        return let(held_by(after, r"(?is)<div\b[^>]*>(.*?)</div\s*>"), lambda body: let(
            stripped(text_of(held_by(item, element("td", "metadata")))), lambda meta: of(body, meta)
        ))

    # Nothing comes after a link that isn't there.
    return let(F.when(item.rlike(link), F.regexp_extract(item, link + "(.*)", 2)), of_rest)


def titled_rows(table: Column) -> Column:
    """Entries of the titled links in a table: text in the row after theirs, author in the next."""

    def of_rows(rows: Column) -> Column:
        def of_links(links: Column, text_row: Column, content: Column, author: Column) -> Column:
            def of_link(link: Column) -> Column:
                return entry(
                    F.lit(True),
                    title=text_of(link),
                    author=author,
                    content=content,
                    main_link=strip_query(F.get(page_links(link), F.lit(0))),
                    other_links=F.coalesce(F.transform(page_links(text_row), strip_query), no_links()),
                )

            return F.transform(links, of_link)

        def of_row(row: Column, i: Column) -> Column:
            text_row, author_row = F.get(rows, i + 1), F.get(rows, i + 2)
            return let(all_of(row, TITLED), lambda links: F.when(F.size(links) > 0, let(
                text_of(text_row), lambda content: let(
                    text_of(author_row), lambda author: of_links(links, text_row, content, author)
                )
            )).otherwise(F.array().cast(ENTRIES)))

        return F.flatten(F.transform(rows, of_row))

    return let(all_of(table, r"(?is)<tr\b[^>]*>.*?</tr\s*>"), of_rows)


def metadata_tag(text: Column) -> Column:
    """The word after the last ``#`` that has one; null without."""
    found = F.regexp_extract(text, r"(?U)^.*#(\w+).*$", 1)
    return F.when(found != "", found)


def metadata_author(text: Column) -> Column:
    """The text without a closing tag and its hash sign."""
    tag = metadata_tag(text)
    ends = tag.isNotNull() & F.endswith(text, tag)
    bare = F.when(ends, F.length(text) - F.length(tag)).otherwise(F.length(text))
    left = F.substring(text, F.lit(1), bare)
    cut = F.when(F.endswith(left, F.lit("#")), F.substring(left, F.lit(1), F.length(left) - 1)).otherwise(left)
    return F.when(tag.isNull(), text).otherwise(F.trim(cut))


def read_page(html: Column) -> Column:
    """``(entries, error)`` of a page; every part of it is computed once, and only if it is needed."""

    def found(entries: Column) -> Column:
        return F.struct(entries.cast(ENTRIES).alias("entries"), F.lit(None).cast("string").alias("error"))

    def failed(why: str) -> Column:
        return F.struct(F.lit(None).cast(ENTRIES).alias("entries"), F.lit(why).alias("error"))

    def items(within: Column, classes: str, read: Callable[[Column], Column]) -> Column:
        return F.transform(all_of(within, element("table", classes)), read)

    def complete(entries: Column) -> Column:
        return F.coalesce(F.forall(entries, lambda e: e.isNotNull()), F.lit(False))

    def of_tables(tables: Column) -> Column:
        nested = F.exists(tables, lambda t: F.substring(t, 2, 1 << 30).rlike(r"(?i)<table\b"))
        unclosed = F.regexp_count(html, F.lit(r"(?i)<table\b")) != F.size(tables)
        content = F.when(html.rlike(CONTENT), F.regexp_extract(html, CONTENT, 0))

        def titled(entries: Column) -> Column:
            alone = F.size(all_of(html, TITLED)) != F.size(entries)
            return F.when(alone, failed("a titled link outside the rows of a table")).otherwise(found(entries))

        def primary(entries: Column) -> Column:
            rows = F.flatten(F.transform(tables, titled_rows))
            return F.when((F.size(entries) > 0) & complete(entries), found(entries)).otherwise(let(rows, titled))

        def described(entries: Column) -> Column:
            return F.when(complete(entries), found(entries)).otherwise(let(items(html, "item", primary_item), primary))

        return (
            F.when(nested, failed("a table inside a table"))
            .when(unclosed, failed("a table that isn't closed"))
            .otherwise(let(items(content, "(?:el-item|item)", described_item), described))
        )

    tables = all_of(html, r"(?is)<table\b[^>]*>.*?</table\s*>")
    return F.when(html.isNull(), failed("no page")).otherwise(let(tables, of_tables))


def parse_pages(pages: DataFrame) -> DataFrame:
    """Pages ``(issue_id, html, ...)`` with ``entries`` and ``error`` for ``html``.

    Three layouts are tried, and the first that fits every item of the page wins.  ``entries``
    is null exactly where none does; ``error`` then says why.  A page that holds nothing gives
    an empty array.
    """
    kept = [c for c in pages.columns if c != "html"]
    # As rows of an array of one: a filter on what was read doesn't read the page again.
    return pages.select(*kept, F.inline_outer(F.array(read_page(F.col("html")))))


def entries_of(parsed: DataFrame) -> DataFrame:
    """One row per entry with an id fixed by the issue and the position on its page."""
    rows = parsed.filter(F.col("entries").isNotNull()).select("issue_id", F.posexplode("entries").alias("pos", "entry"))
    return rows.select(
        (F.col("issue_id") * IDS_PER_ISSUE + F.col("pos")).alias("id"),
        F.col("issue_id").cast("int").alias("issue_id"),
        "entry.*",
    )


def failures_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("entries").isNull()).select("issue_id", "error")


def entry_counts(issues: DataFrame, entries: DataFrame) -> DataFrame:
    """Issues with ``num_entries`` brought up to date; 0 where there are none."""
    counts = entries.groupBy(F.col("issue_id").cast("bigint").alias("id")).agg(F.count("*").alias("_n"))
    return (
        issues.join(counts, "id", "left")
        .withColumn("num_entries", F.coalesce("_n", F.lit(0)).cast("int"))
        .drop("_n")
    )
