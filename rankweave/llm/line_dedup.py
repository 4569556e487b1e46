"""Line dedup: drop lines that many documents hold.

Lines are normalised and hashed where they are read; a count of distinct documents
per hash (with its smallest document) finds the common lines, and each document gets
back the set of hashes it loses.  Rows of the shuffles are hashes, never lines; a line
of a third of all documents is counted by partial sums and joined with skew splitting.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import empty_if_null, fresh, key_of, portions, texts_of
from .kernels import SPACES


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a normalised line; None for lines too short to count."""
    key = line.strip(SPACES).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return blake2b(key, digest_size=16).digest()


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            keys, owners = [], []
            for owner, text in zip(batch.column("k").to_pylist(), texts_of(batch, "text"), strict=True):
                own = {line_key(line, min_chars) for line in text.split(b"\n")} - {None}
                keys.extend(own)
                owners.extend([owner] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(owners, pa.int64())], names=["h", "k"])

    return run


def common_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 2, min_chars: int = 10):
    """Per (document, hash) of a line to drop: columns ``k`` and ``h``."""
    found = docs.select(key_of(doc_id).alias("k"), empty_if_null(text).alias("text")).mapInArrow(
        _line_rows(min_chars), "h binary, k long"
    )
    counted = found.groupBy("h").agg(F.min("k").alias("first"), F.max("k").alias("last"), _documents(min_docs).alias("n"))
    common = counted.where((F.col("first") != F.col("last")) & (F.col("n") >= min_docs)).select("h", "first")
    return found.join(common, "h").where(F.col("k") != F.col("first")).select("k", "h")


def _documents(min_docs: int):
    """At least two is seen from smallest and largest; more needs a count."""
    return F.lit(2) if min_docs <= 2 else F.count_distinct("k")


def dedup_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 2, min_chars: int = 10, report: bool = False
) -> DataFrame:
    """``docs`` without the lines whose key stands in ``min_docs`` documents or more.

    A key is the line, ASCII white space stripped at both ends, A-Z in lower case; keys of
    fewer than ``min_chars`` code points never count.  The document of the smallest id keeps
    its lines.  With ``report`` the columns ``n_lines`` and ``n_dropped`` are added.  A null
    or empty text is one empty line and stays as it is (null becomes empty only if reported);
    all rows with a null id are one document, smaller than every other; rows that repeat an
    id are one document and lose the same lines.  Other columns pass through whatever their
    names; of a table without rows there are none.
    """
    drops = common_lines(docs, text, doc_id, min_docs, min_chars).groupBy("k").agg(F.collect_set("h").alias("hashes"))
    key, gone = fresh(docs, "_key"), fresh(docs, "_gone")
    joined = docs.withColumn(key, key_of(doc_id)).join(
        drops.select(F.col("k").alias(key), F.col("hashes").alias(gone)).hint("shuffle_hash"), key, "left"
    )
    joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns], gone)
    fields = list(docs.schema.fields)
    if report:
        fields = [f for f in fields if f.name not in ("n_lines", "n_dropped")]
        fields += [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return joined.mapInArrow(_rebuild(text, gone, min_chars, report), T.StructType(fields))


def _rebuild(text: str, gone: str, min_chars: int, report: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text):
            kept, n_lines, n_dropped = [], [], []
            hashes = batch.column(gone).to_pylist()
            originals = batch.column(text).cast(pa.binary()).to_pylist()
            for original, lost in zip(originals, hashes, strict=True):
                split = (original or b"").split(b"\n")
                stay = split
                if lost:
                    lost = set(lost)
                    stay = [line for line in split if line_key(line, min_chars) not in lost]
                kept.append(b"\n".join(stay).decode() if report or original is not None else None)
                n_lines.append(len(split))
                n_dropped.append(len(split) - len(stay))
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != gone}
            columns[text] = pa.array(kept, pa.string())
            if report:
                columns = {n: c for n, c in columns.items() if n not in ("n_lines", "n_dropped")}
                columns |= {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup_lines(docs, report=True).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


# \s of the contract is spelled out; translate lower-cases A-Z alone.
OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d
),
n AS (
  SELECT *, translate(
    trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
),
c AS (
  SELECT key, min(doc_id) AS first FROM n WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
),
m AS (SELECT n.*, c.key IS NOT NULL AND n.doc_id <> c.first AS dropped FROM n LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
