"""A folder of page files: ids from names, charsets, and the quarantine."""

from __future__ import annotations

from rankweave.sources.page_files import read_page_files, write_page_files


def test_round_trip_and_quarantine(spark, tmp_path):
    folder = tmp_path / "pages"
    pages = spark.createDataFrame(
        [(1, "<p>café — <a href='x'>x</a></p>"), (2, None), (None, "<p>no id</p>"), (3, "")], "page_id long, html string"
    )
    write_page_files(pages, str(folder))
    (folder / "page-7.html").write_bytes(b'<meta charset="ISO-8859-1"><p>caf\xe9</p>')
    (folder / "page-8.html").write_bytes(b"<p>caf\xe9</p>")  # not UTF-8, nothing declared
    (folder / "notes.html").write_bytes(b"<p>hello</p>")
    (folder / "page-9.txt").write_bytes(b"not a page")
    good, bad = read_page_files(spark, str(folder))
    assert sorted((r.page_id, r.html) for r in good.collect()) == [
        (1, "<p>café — <a href='x'>x</a></p>"),
        (7, '<meta charset="ISO-8859-1"><p>café</p>'),
    ]
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in bad.collect()}
    # Spark's file sources skip files of no bytes: pages 2 and 3 are in neither table.
    assert errors == {
        "page-8.html": "not UTF-8 and no single-byte charset declared",
        "notes.html": "no page id in the file name",
    }


def test_empty_folder_of_pages(spark, tmp_path):
    folder = tmp_path / "none"
    write_page_files(spark.createDataFrame([], "page_id long, html string"), str(folder))
    (folder / "page-1.html").write_bytes(b"<p>one</p>")
    good, bad = read_page_files(spark, str(folder))
    assert [(r.page_id, r.html) for r in good.collect()] == [(1, "<p>one</p>")] and bad.count() == 0
