"""The inverted index as three tables.

``postings(bucket, field, term, id, tf, dl)`` keeps the document length next to
the count, so scoring needs no join with the documents.  ``term_stats(field,
term, df)`` and ``corpus_stats(field, n, total_len, n_postings)`` hold sums only:
adding documents adds rows, readers sum them, and no row is ever rewritten.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .sizing import Size, scoring_tasks

WHOLE = "*"
# No token is empty, so this stands for the document itself.
DOCUMENT = ""
TEXT_FIELDS = ("title", "author", "content", "tag")
# No more than this many terms can hold more than this share of all postings.
HOT_TERMS = 10_000


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class KeywordIndex:
    postings: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    fields: tuple[str, ...]
    buckets: int = 1
    analyzer: str = "simple"
    stop_words: tuple[str, ...] | None = None
    # Of an index computed when it is read: the index of given terms alone, for a number of queries.
    narrow: Callable[[DataFrame, int], KeywordIndex] | None = None
    narrowed: bool = False
    # Of a stored or narrowed index: how many documents it has.
    documents: int | None = None

    def for_terms(self, terms: DataFrame, size: Size, queries: int = 1) -> KeywordIndex:
        """This index for the given query terms; only the search that has them may use it.

        A narrowed index shuffles no other words.  Terms too large to broadcast leave the
        index whole, and the join with them selects the same postings.
        """
        if self.narrow is None or not size.fits():
            return self
        return self.narrow(terms.select("term").distinct(), queries)

    def totals(self) -> Column:
        """Field to ``(n, total_len)``, one small map for the whole plan."""
        per_field = self.corpus_stats.groupBy("field").agg(
            F.struct(F.sum("n").alias("n"), F.sum("total_len").alias("total_len")).alias("sums")
        )
        return per_field.agg(F.map_from_entries(F.collect_list(F.struct("field", "sums")))).scalar()

    def hot_terms(self) -> DataFrame:
        """Terms with so many postings that a join must split them.

        ``salts`` says over how many tasks.  A term is hot when it holds more
        than one in HOT_TERMS of the postings, which bounds both the rows here
        and the sum of ``salts`` by a small multiple of HOT_TERMS.
        """
        total = self.corpus_stats.agg(F.sum("n_postings").alias("v")).scalar()
        share = F.greatest(F.lit(1), F.floor(total / HOT_TERMS))
        per_term = self.term_stats.groupBy("field", "term").agg(F.sum("df").alias("df"))
        return per_term.filter(F.col("df") > share).select(
            "field", "term", F.ceil(F.col("df") / share).cast("int").alias("salts")
        )


def _words(stop_words: Sequence[str] | None) -> tuple[str, ...] | None:
    return None if stop_words is None else tuple(stop_words)


def counted_words(docs: DataFrame, fields: dict[str, str], analyzer: str, stop_words: Sequence[str] | None) -> DataFrame:
    """``(field, id, dl, words)`` per document and field; words are ``(term, tf)``.

    Words are counted inside the row: in the sorted tokens each run of equal
    ones is a word.  So counts leave the document ready made, without a shuffle.
    """
    texts = [F.struct(F.lit(name).alias("field"), F.col(c).alias("text")) for name, c in fields.items()]
    if len(texts) == 1:
        long = docs.select("id", texts[0].alias("one")).select("one.field", "id", "one.text")
    else:
        long = docs.select("id", F.inline(F.array(*texts))).select("field", "id", "text")
    row = long.select("field", "id", F.sort_array(tokenize("text", analyzer, stop_words)).alias("tokens"))

    def opens_run(i: Column) -> Column:
        return (i == 1) | (F.element_at("tokens", i) != F.element_at("tokens", i - 1))

    def word(start: Column, run: Column) -> Column:
        end = F.coalesce(F.get("starts", run + 1), F.size("tokens") + 1)
        return F.struct(F.element_at("tokens", start).alias("term"), (end - start).cast("bigint").alias("tf"))

    places = F.when(F.size("tokens") > 0, F.sequence(F.lit(1), F.size("tokens"))).otherwise(F.array().cast("array<int>"))
    starts = row.withColumn("starts", F.filter(places, opens_run))
    return starts.select(
        "field", "id", F.size("tokens").cast("bigint").alias("dl"), F.transform("starts", word).alias("words")
    )


def posting_rows(counted: DataFrame, *, mark_documents: bool = False) -> DataFrame:
    """``(field, id, dl, term, tf)``; with a row of ``tf`` -1 per document if asked."""
    words = F.col("words")
    if mark_documents:
        mark = F.struct(F.lit(DOCUMENT).alias("term"), F.lit(-1).cast("bigint").alias("tf"))
        words = F.array_append(words, mark)
    # The outer form, because for the plain one Spark adds a filter on the array
    # that would count all words a second time; no word is null otherwise.
    rows = counted.select("field", "id", "dl", F.inline_outer(words))
    return rows.filter(F.col("term").isNotNull())


def term_counts(postings: DataFrame) -> DataFrame:
    # Written over tf so that postings and counts share one exchange.
    return postings.groupBy("field", "term").agg(F.sum(F.least("tf", F.lit(1))).alias("df"))


def derive_index(
    docs: DataFrame,
    fields: dict[str, str],
    *,
    analyzer: str = "simple",
    stop_words: Sequence[str] | None = None,
) -> KeywordIndex:
    """An index computed when it is read, for searches on fresh text.

    A search narrows it to the words its queries ask for (``for_terms``), so that no
    other words are shuffled; counts and totals stay those of all text.

    The text is tokenized once: every document sends its length along as one
    more word, and the three tables read the same exchange.  What tells them
    apart is the sign of ``tf``; as that is a sum, no filter on it moves below
    the exchange.  Words are spread by document, which the scoring needs too, over as many
    tasks as the documents and the queries of a search need.
    """
    words = posting_rows(counted_words(docs, fields, analyzer, stop_words), mark_documents=True)
    spelled = tuple(fields), 1, analyzer, _words(stop_words)

    def narrow(terms: DataFrame, queries: int) -> KeywordIndex:
        mark = docs.sparkSession.range(1).select(F.lit(DOCUMENT).alias("term"))
        wanted = words.join(F.broadcast(terms.union(mark)), "term", "left_semi")
        n = docs.count()
        return KeywordIndex(*_derived(wanted, scoring_tasks(n, queries)), *spelled, narrowed=True, documents=n)

    return KeywordIndex(*_derived(words), *spelled, narrow=narrow)


def _derived(words: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    dealt = words.repartition("id") if tasks is None else words.repartition(tasks, "id")
    counted = dealt.groupBy("field", "id", "dl", "term").agg(F.sum("tf").alias("tf"))
    postings = counted.filter(F.col("tf") > 0).withColumn("bucket", F.lit(0))
    totals = (
        counted.filter(F.col("tf") < 0)
        .groupBy("field")
        .agg(F.count("*").alias("n"), F.sum("dl").alias("total_len"), F.sum("dl").alias("n_postings"))
    )
    return postings, term_counts(postings), totals


def save_index(
    docs: DataFrame,
    fields: dict[str, str],
    path: str,
    *,
    analyzer: str = "simple",
    stop_words: Sequence[str] | None = None,
    buckets: int = 64,
    delta: int = 0,
) -> None:
    """Write one delta of the index; writing the same delta again replaces it.

    Words are counted in the row that is read, and only the counts are shuffled, by term
    bucket: a term lies in one or few files, and a bucket too large for one task is split by
    size.  The totals are written last, and a delta without them isn't read.
    """
    spark = docs.sparkSession
    counted = counted_words(docs, fields, analyzer, stop_words)
    postings = posting_rows(counted).withColumn("bucket", bucket_of(F.col("term"), buckets))
    target = f"{path}/postings/delta={delta}"
    (
        postings.hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "field", "term", "id")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(target)
    )
    # Everything else follows from the written postings; text is not read again.
    written = spark.read.parquet(target)
    stats = term_counts(written).withColumn("bucket", bucket_of(F.col("term"), buckets))
    (
        stats.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/term_stats/delta={delta}")
    )
    sums = written.groupBy("field").agg(F.sum("tf").alias("total_len"), F.count("*").alias("n_postings"))
    names = spark.createDataFrame([(f,) for f in fields], "field string")
    totals = names.join(sums, "field", "left").select(
        "field",
        docs.agg(F.count("*").alias("n")).scalar().alias("n"),
        F.coalesce("total_len", F.lit(0)).alias("total_len"),
        F.coalesce("n_postings", F.lit(0)).alias("n_postings"),
        F.lit(buckets).alias("buckets"),
        F.lit(analyzer).alias("analyzer"),
        (F.lit(None) if stop_words is None else F.array(*map(F.lit, stop_words))).cast("array<string>").alias("stop_words"),
    )
    totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus_stats/delta={delta}")


def load_index(spark: SparkSession, path: str) -> KeywordIndex:
    totals = spark.read.parquet(f"{path}/corpus_stats")
    how = totals.select("field", "n", "buckets", "analyzer", "stop_words", "delta").distinct().collect()
    if len({(r.buckets, r.analyzer, _words(r.stop_words)) for r in how}) != 1:
        raise ValueError(f"{path} was written with different settings: {how}")
    whole = F.col("delta").isin(sorted({r.delta for r in how}))
    return KeywordIndex(
        spark.read.parquet(f"{path}/postings").where(whole),
        spark.read.parquet(f"{path}/term_stats").where(whole),
        totals,
        tuple(sorted({r.field for r in how})),
        how[0].buckets,
        how[0].analyzer,
        _words(how[0].stop_words),
        documents=sum(r.n for r in how if r.field == how[0].field),
    )


def append_index(
    docs: DataFrame, fields: dict[str, str], path: str, *, delta: int, index: KeywordIndex
) -> None:
    """Add documents with ids the index does not hold; earlier files stay as they are."""
    save_index(
        docs,
        fields,
        path,
        analyzer=index.analyzer,
        stop_words=index.stop_words,
        buckets=index.buckets,
        delta=delta,
    )
