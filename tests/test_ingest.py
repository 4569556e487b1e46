"""Pages, catalog, stores and incremental ingestion."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from rankweave import BM25Searcher, embed
from rankweave.functions.embed import HashingEmbedder
from rankweave.functions.similarity import as_vector, cosine_distance, cosine_similarity
from rankweave.functions.text import fold_accents, porter_stem, tokenize
from rankweave.functions.urls import join_url, markdown_link, remove_first, strip_query
from rankweave.schema import quality_checks
from rankweave.sources import pages, store
from rankweave.sources.catalog import parse_catalog
from rankweave.sources.ingest import Library
from rankweave.streaming.ingest_stream import start_ingest

BASE = "https://weekly.example"

LAYOUT_1 = """
<div id="content">
 <table class="el-item x"><tr><td>
  <p class="desc"><span class="mainlink"><a href="https://a.example/1?ref=w">Fast &amp; small</a></span> — A text
   with a <a href="https://b.example/?q=1">link</a>.</p>
  <p class="name">Jane Doe</p></td></tr></table>
 <table class="item"><tr><td>
  <p class="desc"><a href="https://c.example">One line</a> <span class="name">Joe</span></p></td></tr></table>
 <table class="other"><tr><td>not an entry</td></tr></table>
</div>"""
LAYOUT_2 = """
<table class="item"><tr><td>
  <div><a class="primary" href="https://a.example/2?utm=1#top">Second</a></div><p>between</p>
  <div>Text with <a href="https://b.example/x?utm=1">two</a> <a href="https://b.example/y?utm=2">links</a></div>
 </td></tr><tr><td class="metadata"> Jane Doe #tools </td></tr></table>
<table class="item"><tr><td><div><a class="primary" href="https://a.example/3">Third</a></div><div>More</div>
 </td></tr><tr><td class="metadata">Joe</td></tr></table>"""
LAYOUT_3 = """
<table><tr><td><a title="x" href="https://a.example/4?utm=1">Fourth</a></td></tr>
<tr><td>Content <a href="https://b.example/z?u=1">z</a></td></tr><tr><td>Jane</td></tr></table>
<table><tr><td><a title="y" href="https://a.example/5">Fifth</a></td></tr></table>"""
FALLBACK = """
<div id="content"><table class="item"><tr><td><div><a class="primary" href="u">T</a></div><div>C</div></td></tr>
<tr><td class="metadata">M</td></tr></table></div>"""


def entry(title, author, content, main_link, other_links, tag=None):
    return dict(title=title, author=author, content=content, main_link=main_link, other_links=other_links, tag=tag)


def read_entries(spark, html):
    page = spark.createDataFrame([(1, html)], "issue_id bigint, html string")
    row = pages.parse_pages(page).first()
    return None if row.entries is None else [e.asDict() for e in row.entries], row.error


@pytest.mark.parametrize(
    "html, want",
    [
        (
            LAYOUT_1,
            [
                entry("Fast & small", "Jane Doe", "A text\n   with a link.", "https://a.example/1?ref=w", ["https://b.example/?q=1"]),
                entry("One line", "Joe", None, "https://c.example", []),
            ],
        ),
        (
            LAYOUT_2,
            [
                entry("Second", "Jane Doe", "Text with two links", "https://a.example/2#top", ["https://b.example/x", "https://b.example/y"], "tools"),
                entry("Third", "Joe", "More", "https://a.example/3", []),
            ],
        ),
        (
            LAYOUT_3,
            [
                entry("Fourth", "Jane", "Content z", "https://a.example/4", ["https://b.example/z"]),
                entry("Fifth", None, None, "https://a.example/5", []),
            ],
        ),
        (FALLBACK, [entry("T", "M", "C", "u", [])]),
        ("<p>plain</p>", []),
        ("", []),
        # An unclosed element, a stray end tag and a title without author in the first layout.
        ("<div id=content></b><p>open", []),
    ],
)
def test_layouts(spark, html, want):
    assert read_entries(spark, html) == (want, None)


NESTED = '<table class="item"><tr><td><table></table></td></tr></table>'


@pytest.mark.parametrize("html", ['<a title="x" href="u">alone</a>', None, NESTED, "<table><tr><td>open"])
def test_unreadable_pages_say_why(spark, html):
    entries, error = read_entries(spark, html)
    assert entries is None and error


def test_no_title_and_no_author_is_not_the_first_layout(spark):
    page = '<div id="content"><table class="item"><tr><td><p class="desc">just text</p></td></tr></table></div>'
    assert read_entries(spark, page) == ([], None)


def test_pages_are_read_without_python(spark):
    parsed = pages.parse_pages(spark.createDataFrame([(1, LAYOUT_2)], "issue_id bigint, html string"))
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_links_of_a_page(spark):
    html = """<A class=x HREF='/one?a=1&amp;b=2'>1</A> <a data-href="no" href=/two>2</a> <a data-href="no">3</a>
    <a
     href="/four">4</a> <abbr href="no">5</abbr> <a href="">6</a>"""
    assert one(spark, pages.page_links(F.lit(html))) == ["/one?a=1&b=2", "/two", "/four", ""]


def test_pages_to_entries(spark):
    rows = [(1, LAYOUT_1), (2, LAYOUT_2), (3, '<a title="x" href="u">alone</a>'), (4, "<p></p>")]
    parsed = pages.parse_pages(spark.createDataFrame(rows, "issue_id bigint, html string")).cache()
    entries = pages.entries_of(parsed)
    assert {(r.issue_id, r.title) for r in entries.collect()} == {
        (1, "Fast & small"),
        (1, "One line"),
        (2, "Second"),
        (2, "Third"),
    }
    assert entries.select("id").distinct().count() == 4
    assert [r.issue_id for r in pages.failures_of(parsed).collect()] == [3]


def test_catalog(spark):
    lines = [
        ("Issue #12 — May 3, 2023", "/issues/12"),
        ("Issue #13 —  December 31 2023", "https://other.example/13"),
        ("Issue 12: unknown", "/x"),
        ("Issue #14 — Brumaire 3, 2023", "/issues/14"),
        ("Issue #15 — February 31, 2023", "/issues/15"),
        (None, "/y"),
    ]
    good, bad = parse_catalog(spark.createDataFrame(lines, "line string, href string"), BASE)
    assert sorted(map(tuple, good.collect())) == [
        (12, datetime.date(2023, 5, 3), "https://weekly.example/issues/12"),
        (13, datetime.date(2023, 12, 31), "https://other.example/13"),
    ]
    assert {r.href for r in bad.collect()} == {"/x", "/issues/14", "/issues/15", "/y"}


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "href, want",
    [
        ("/a/b?c", "https://weekly.example/a/b?c"),
        ("a/b", "https://weekly.example/a/b"),
        ("//cdn.example/x", "https://cdn.example/x"),
        ("mailto:x@y.example", "mailto:x@y.example"),
        ("HTTP://x.example", "HTTP://x.example"),
        ("", BASE),
    ],
)
def test_join_url(spark, href, want):
    assert one(spark, join_url(BASE, F.lit(href))) == want


def test_url_helpers(spark):
    assert one(spark, strip_query(F.lit("http://x/?a=1&b#f?g"))) == "http://x/#f?g"
    assert one(spark, markdown_link(F.lit("t"), F.lit("l"))) == "[t](l)"
    assert one(spark, markdown_link(F.lit("t"), F.lit(None).cast("string"))) is None
    items = F.array(*map(F.lit, "abab"))
    assert one(spark, remove_first(items, F.lit("b"))) == ["a", "a", "b"]
    assert one(spark, remove_first(items, F.lit("a"))) == ["b", "a", "b"]
    assert one(spark, remove_first(items, F.lit("z"))) == list("abab")
    assert one(spark, remove_first(items, F.lit(None).cast("string"))) == list("abab")


@pytest.mark.parametrize(
    "text, tag, author",
    [("Jane #tools", "tools", "Jane"), ("Jane", None, "Jane"), ("#a and #b!", "b", "#a and #b!"), ("Jo #ünï", "ünï", "Jo")],
)
def test_metadata(spark, text, tag, author):
    assert one(spark, pages.metadata_tag(F.lit(text))) == tag
    assert one(spark, pages.metadata_author(F.lit(text))) == author


@pytest.mark.parametrize(
    "word, stem",
    [
        # Examples of the published algorithm.
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
        ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
        ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("tanned", "tan"), ("falling", "fall"),
        ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"),
        ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"),
        ("vietnamization", "vietnam"), ("predication", "predic"), ("operator", "oper"), ("feudalism", "feudal"),
        ("decisiveness", "decis"), ("hopefulness", "hope"), ("triplicate", "triplic"), ("formative", "form"),
        ("formalize", "formal"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"),
        ("allowance", "allow"), ("airliner", "airlin"), ("adjustable", "adjust"), ("replacement", "replac"),
        ("adjustment", "adjust"), ("dependent", "depend"), ("adoption", "adopt"), ("communism", "commun"),
        ("activate", "activ"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"),
        ("controll", "control"), ("roll", "roll"), ("is", "is"), ("by", "by"),
    ],
)
def test_porter(word, stem):
    assert porter_stem(word) == stem


def test_tokens(spark):
    text = F.lit("L'Été n°42, the RUNNING foxes_run")
    assert one(spark, tokenize(text)) == ["l", "été", "n", "42", "the", "running", "foxes", "run"]
    assert one(spark, tokenize(text, "english", ["the"])) == ["l", "et", "n", "run", "fox", "run"]
    assert one(spark, tokenize(F.lit(None).cast("string"))) == []
    assert one(spark, fold_accents(F.lit("Čeština ñ"))) == "cestina n"
    with pytest.raises(ValueError):
        tokenize(text, "other")


def test_similarity_columns(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert one(spark, cosine_similarity(a, b)) == pytest.approx(0.5**0.5)
    assert one(spark, cosine_distance(a, a)) == 0
    assert one(spark, cosine_similarity(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, cosine_similarity(a, F.array(F.lit(1.0)))) is None
    with pytest.raises(Exception, match="expected 3 values, got 2"):
        one(spark, as_vector(a, 3))


def test_keys_and_names(spark):
    old = spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5)], "id bigint, name string, x double")
    new = spark.createDataFrame([("c", 2), ("d", 3), ("d", 3), ("e", 4)], "name string, id int")
    assert {r.id for r in store.new_keys(new, old).collect()} == {3, 4}
    got = store.insert_or_ignore(new, old)
    assert got.columns == ["id", "name", "x"]
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1.5), (2, "b", 2.5), (3, "d", None), (4, "e", None)]
    with pytest.raises(ValueError, match="not in the target"):
        store.append_by_name(new.withColumn("z", F.lit(1)), old)


def test_vectors_replace_their_model_alone(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.sql("select id, array(cast(id as float)) vec from range(4)")
    store.write_vectors(rows.withColumn("model_id", F.lit(1)), path)
    store.write_vectors(rows.withColumn("model_id", F.lit(2)), path)
    store.write_vectors(rows.filter("id < 2").withColumn("model_id", F.lit(2)), path)
    got = {r.model_id: r.n for r in spark.read.parquet(path).groupBy("model_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 4, 2: 2}


def test_embeddings_of_documents_are_stored_and_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue whale")], "id bigint, doc string")
    vecs = docs.select("id", embed(F.col("doc"), HashingEmbedder(32)).alias("vec"), F.lit(1).alias("model_id"))
    store.write_vectors(vecs, str(tmp_path))
    assert spark.read.parquet(str(tmp_path)).select(F.size("vec").alias("n")).distinct().first().n == 32


def test_quality_checks_find_violations(spark):
    issues = spark.sql("select 1L id, date'2020-01-01' publish_date, 'u' url union all select 1L, null, null")
    entries = spark.sql(
        "select 1L id, 1 issue_id, 't' title union all select 1L, 9, null union all select 2L, null, 't' "
        "union all select 1L, 1, 't' union all select null, 1, 't' union all select null, 1, 't'"
    )
    vectors = spark.sql("select 1L id, array(1f, 2f) vec union all select 2L, array(1f) union all select 3L, null")
    got = {r.rule: r.violations for r in quality_checks(issues, entries, vectors, 2).collect()}
    assert got == {
        "issues.id unique": 1,
        "entries.id unique": 2,
        "vectors.id unique": 0,
        "issues.publish_date not null": 1,
        "issues.url not null": 1,
        "entries.title not null": 1,
        "vectors.vec not null": 1,
        "vectors.vec length": 1,
        "entries.issue_id known": 1,
    }


def arrivals(spark, *issues):
    pages_of = {1: LAYOUT_1, 2: LAYOUT_2, 3: LAYOUT_3, 4: '<a title="x" href="u">alone</a>', 5: FALLBACK}
    rows = [(f"Issue #{i} — May {i}, 2023" if i else "broken", f"/issues/{i}", pages_of.get(i, "")) for i in issues]
    return spark.createDataFrame(rows, "line string, href string, html string")


def state(library):
    return (
        sorted(map(tuple, library.issues().select("id", "publish_date", "num_entries").collect())),
        sorted(r.title for r in library.entries().collect()),
        sorted((r.issue_id or 0, r.line or "") for r in library.quarantine().collect()),
    )


def hits(library, text):
    found = BM25Searcher(library.index(), 5).search(text)
    return [r.title for r in found.retrieve(library.entries(), library.issues(), 5).orderBy("rank").collect()]


def test_ingest_is_incremental_and_repeatable(spark, tmp_path):
    library = Library(spark, str(tmp_path), buckets=4)
    assert library.issues().count() == 0
    library.ingest(arrivals(spark, 1, 4, 0, 1), 0, BASE)
    first = state(library)
    assert first[0] == [(1, datetime.date(2023, 5, 1), 2)]
    assert first[1] == ["Fast & small", "One line"]
    assert first[2] == [(0, "broken"), (4, "")]
    library.ingest(arrivals(spark, 1, 4, 0, 1), 0, BASE)
    assert state(library) == first
    # A known issue is skipped, new ones are added, a failed one is tried again.
    library.ingest(arrivals(spark, 1, 2, 5, 4), 1, BASE)
    issues, titles, _ = state(library)
    assert [(i, n) for i, _, n in issues] == [(1, 2), (2, 2), (5, 1)]
    assert titles == ["Fast & small", "One line", "Second", "T", "Third"]
    assert hits(library, "fast small")[0] == "Fast & small"
    whole = Library(spark, str(tmp_path / "whole"), buckets=4)
    whole.ingest(arrivals(spark, 1, 2, 5), 0, BASE)
    for query in ("fast links", "text with two links", "one line joe"):
        assert hits(whole, query) == hits(library, query)


def test_ingest_from_a_stream(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "lib")
    library = Library(spark, root, buckets=4)
    for batch in ((1, 2), (2, 3)):
        arrivals(spark, *batch).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("line string, href string, html string").parquet(source)
        start_ingest(stream, library, BASE).awaitTermination(120)
    issues, titles, _ = state(library)
    assert [(i, n) for i, _, n in issues] == [(1, 2), (2, 2), (3, 2)]
    assert titles == ["Fast & small", "Fifth", "Fourth", "One line", "Second", "Third"]
    assert hits(library, "second") == ["Second"]


def test_a_page_is_read_once(spark):
    """A value named in several places is computed in one: the plan holds every pattern a few times."""
    page = spark.createDataFrame([(1, LAYOUT_1)], "issue_id bigint, html string")
    plan = pages.entries_of(pages.parse_pages(page))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<p\\b") <= 4
    assert plan.count("<table\\b") <= 8


def test_the_quarantine_filter_does_not_read_pages_again(spark):
    page = spark.createDataFrame([(1, LAYOUT_1)], "issue_id bigint, html string")
    plan = pages.failures_of(pages.parse_pages(page))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<table\\b") <= 8
