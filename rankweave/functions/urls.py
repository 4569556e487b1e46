"""URL helpers and the link column of the report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_query(url: Column) -> Column:
    """Drop ``?query`` and keep the fragment."""
    return F.regexp_replace(url, r"^([^?#]*)\?[^#]*", "$1")


def join_url(base: str, href: Column) -> Column:
    """Resolve absolute, protocol-relative, root-relative and plain hrefs.

    ``base`` is the site root (scheme and host), as for a catalog page.
    """
    root = base.rstrip("/")
    scheme = base.split("://", 1)[0]
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit(scheme + ":"), href))
        .when(href.startswith("/"), F.concat(F.lit(root), href))
        .when(href == "", F.lit(base))
        .otherwise(F.concat(F.lit(root + "/"), href))
    )


def markdown_link(title: Column, link: Column) -> Column:
    """``[title](link)``; null as soon as one part is null."""
    return F.concat(F.lit("["), title, F.lit("]("), link, F.lit(")"))


def remove_first(items: Column, item: Column) -> Column:
    """The array without the first element equal to ``item``."""
    at = F.coalesce(F.array_position(items, item), F.lit(0)).cast("int")
    rest = F.concat(
        F.slice(items, F.lit(1), F.greatest(at - 1, F.lit(0))),
        F.slice(items, at + 1, F.size(items)),
    )
    return F.when(at == 0, items).otherwise(rest)
