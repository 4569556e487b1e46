"""A catalog page to (line, href) rows and on to issues."""

from __future__ import annotations

from rankweave.sources import catalog

PAGE = """<html><div class="head"><a href="/">home</a> Issue #1 — May 1, 2020</div>
<div class='issues'>
  <div class="issue"><a href="/issues/12"><b>Issue #12</b></a> &mdash; <time>June 3, 2021</time></div>
  <div class="issue">
     <a href="https://other.example/13?a=1&amp;b=2">Issue #13</a> — July 4, 2022 </div>
  <div class="issue">Issue #14 — July 5, 2022</div>
  <div class="issue"><a href="/x">Issue 15: unknown</a><a href="/y">more</a></div>
</div></html>"""


def test_lines_of_a_catalog_page(spark):
    pages = spark.createDataFrame([(PAGE,), ("<html>no list</html>",), (None,)], "html string")
    lines = [(r.line, r.href) for r in catalog.catalog_lines(pages).collect()]
    assert lines == [
        ("Issue #12 &mdash; June 3, 2021", "/issues/12"),
        ("Issue #13 — July 4, 2022", "https://other.example/13?a=1&b=2"),
        ("Issue #14 — July 5, 2022", None),
        ("Issue 15: unknownmore", "/x"),  # all text of the division, as the reference takes it
    ]
    parsed, bad = catalog.parse_catalog(catalog.catalog_lines(pages), "https://weekly.example")
    assert sorted((r.id, str(r.publish_date)) for r in parsed.collect()) == [(13, "2022-07-04"), (14, "2022-07-05")]
    assert bad.count() == 2  # a reference the line form doesn't know, and a line of another form
