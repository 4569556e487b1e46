"""The registered queries as SQL for the comparison, independent of the engine.

A query is a list of named parts; ``sql`` puts the needed ones in front.
"""

from __future__ import annotations

import re

TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def tokens(col: str) -> str:
    return TOKENS.format(col)


PARTS: dict[str, str] = {
    "entries": """
        SELECT doc_id AS id, (doc_id % (SELECT count(*) FROM pages))::INTEGER AS issue_id,
               string_split(text, chr(10))[1] AS title, source AS author, text AS content,
               concat('https://', source, '.example.com/doc/', doc_id, '?ref=', lang) AS main_link, lang AS tag
        FROM documents""",
    "gaps": """
        SELECT doc_id AS id, (doc_id % (SELECT count(*) + 7 FROM pages))::INTEGER AS issue_id,
               string_split(text, chr(10))[1] AS title,
               CASE WHEN doc_id % 5 <> 0 THEN source END AS author,
               CASE WHEN doc_id % 11 <> 0 THEN text END AS content,
               CASE WHEN doc_id % 7 <> 0
                    THEN concat('https://', source, '.example.com/doc/', doc_id, '?ref=', lang) END AS main_link,
               CASE WHEN doc_id % 3 <> 0 THEN lang END AS tag
        FROM documents""",
    "issues": """
        SELECT page_id AS id, (DATE '2013-05-01' + (7 * page_id)::INTEGER) AS publish_date, url FROM pages""",
    "docs": """
        SELECT id, concat(title, chr(10), coalesce(author, ''), chr(10), coalesce(content, ''), chr(10),
                          coalesce(tag, '')) AS doc
        FROM entries""",
    "docs_with_gaps": """
        SELECT id, concat(title, chr(10), coalesce(author, ''), chr(10), coalesce(content, ''), chr(10),
                          coalesce(tag, '')) AS doc
        FROM gaps""",
    "queries": "SELECT item_id AS query_id, text AS query FROM benchmark",
    # Whole-document index.
    "doc_tokens": f"SELECT id, {tokens('doc')} AS words FROM docs",
    "doc_words": "SELECT id, len(words) AS dl, unnest(words) AS term FROM doc_tokens",
    "doc_postings": "SELECT id, dl, term, count(*) AS tf FROM doc_words GROUP BY id, dl, term",
    "doc_terms": "SELECT term, count(*) AS df FROM doc_postings GROUP BY term",
    "doc_totals": "SELECT count(*) AS n, sum(len(words))::BIGINT AS total_len FROM doc_tokens",
    "query_words": f"SELECT query_id, unnest({tokens('query')}) AS term FROM queries",
    "query_sets": "SELECT DISTINCT query_id, term FROM query_words",
    "bm25_parts": """
        SELECT query_id, id,
               ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf
                 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / (total_len / n))) AS part
        FROM query_sets JOIN doc_postings USING (term) JOIN doc_terms USING (term), doc_totals""",
    "bm25": """
        SELECT query_id, id, round(sum(round(part * 1e12)::BIGINT)::DOUBLE / 1e12, 6) AS score
        FROM bm25_parts GROUP BY query_id, id""",
    # Index per field.
    "field_texts": """
        SELECT id, unnest(['title', 'author', 'content', 'tag']) AS field,
               unnest([title, coalesce(author, ''), coalesce(content, ''), coalesce(tag, '')]) AS text
        FROM entries""",
    "field_tokens": f"SELECT id, field, {tokens('text')} AS words FROM field_texts",
    "field_words": "SELECT id, field, len(words) AS dl, unnest(words) AS term FROM field_tokens",
    "field_postings": "SELECT id, field, dl, term, count(*) AS tf FROM field_words GROUP BY id, field, dl, term",
    "field_terms": "SELECT field, term, count(*) AS df FROM field_postings GROUP BY field, term",
    "field_totals": """
        SELECT field, count(*) AS n, sum(len(words))::BIGINT AS total_len FROM field_tokens GROUP BY field""",
    "query_bags": "SELECT query_id, term, count(*) AS qtf FROM query_words GROUP BY query_id, term",
    "bm25_field_parts": """
        SELECT query_id, id,
               ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * qtf * tf
                 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / (total_len / n))) AS part
        FROM query_bags JOIN field_postings USING (term) JOIN field_terms USING (field, term)
             JOIN field_totals USING (field)""",
    "bm25f": """
        SELECT query_id, id, round(sum(round(part * 1e12)::BIGINT)::DOUBLE / 1e12, 6) AS score
        FROM bm25_field_parts GROUP BY query_id, id""",
    # Vectors.
    "asked": """
        SELECT item_id AS query_id, text AS query, embedding::DOUBLE[] AS q
        FROM benchmark JOIN embeddings ON vec_id = item_id""",
    "cosines": """
        SELECT query_id, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, asked""",
    "knn": "SELECT query_id, id, round(s, 6) AS score FROM cosines",
    "knn_far": "SELECT query_id, id, round(1 - s, 6) AS distance FROM cosines",
    # Hashed embedding of documents and queries.
    "doc_slots": """
        SELECT id, (('0x' || substr(md5(term), 1, 8))::BIGINT % 64)::INTEGER AS slot, count(*) AS c
        FROM doc_words GROUP BY id, slot""",
    "doc_norms": "SELECT id, sqrt(sum(c * c)) AS size FROM doc_slots GROUP BY id",
    "doc_vectors": """
        SELECT id, slot, (coalesce(c, 0) / size)::FLOAT AS value
        FROM (SELECT id, unnest(range(64))::INTEGER AS slot, size FROM doc_norms) LEFT JOIN doc_slots USING (id, slot)""",
    "query_slots": """
        SELECT query_id, (('0x' || substr(md5(term), 1, 8))::BIGINT % 64)::INTEGER AS slot, count(*) AS c
        FROM query_words GROUP BY query_id, slot""",
    "query_norms": "SELECT query_id, sqrt(sum(c * c)) AS size FROM query_slots GROUP BY query_id",
    "query_vectors": """
        SELECT query_id, slot, (c / size)::FLOAT::DOUBLE AS value
        FROM query_slots JOIN query_norms USING (query_id)""",
    "doc_sizes": "SELECT id, sqrt(sum(value::DOUBLE * value::DOUBLE)) AS dn FROM doc_vectors GROUP BY id",
    "query_sizes": "SELECT query_id, sqrt(sum(value * value)) AS qn FROM query_vectors GROUP BY query_id",
    "text_knn": """
        SELECT query_id, id, round(sum(d.value::DOUBLE * q.value) / any_value(dn * qn), 6) AS score
        FROM doc_vectors d JOIN query_vectors q USING (slot) JOIN doc_sizes USING (id)
             JOIN query_sizes USING (query_id)
        GROUP BY query_id, id""",
}


def ranked(name: str, source: str, k: int, order: str = "score DESC, id") -> str:
    """Define a part with the best ``k`` rows per query and their rank."""
    PARTS[name] = f"""
        SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY {order}))::INTEGER AS rank
        FROM {source} QUALIFY rank <= {k}"""
    return name


ranked("bm25_50", "bm25", 50)
ranked("bm25_20", "bm25", 20)
ranked("bm25f_50", "bm25f", 50)
ranked("knn_50", "knn", 50)
ranked("far_50", "knn_far", 50, "distance, id")
ranked("text_20", "text_knn", 20)
ranked("list_a", "bm25", 50)
ranked("list_f", "bm25f", 50)


def chain(name: str, first: str, second: str, value: str, order: str) -> None:
    """All hits of two lists once, the first list's number where both have it."""
    PARTS[name] = f"""
        SELECT query_id, id, arg_min(score, source) AS score, min(source) AS source, arg_min(place, source) AS place
        FROM (SELECT query_id, id, score, 0 AS source, -score AS place FROM {first}
              UNION ALL SELECT query_id, id, {value} AS score, 1 AS source, {order} AS place FROM {second})
        GROUP BY query_id, id"""


chain("chained", "list_a", "knn_50", "score", "-score")
chain("chained_f", "list_f", "far_50", "distance", "distance")


def rrf(name: str, first: str, second: str, formula: str) -> None:
    PARTS[name + "_ranks"] = f"""
        SELECT query_id, id, dense_rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS place FROM {first}
        UNION ALL
        SELECT query_id, id, dense_rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS place FROM {second}"""
    PARTS[name] = f"SELECT query_id, id, round({formula}, 9) AS score FROM {name}_ranks GROUP BY query_id, id"


rrf("fused", "list_a", "knn_50", "sum(1.0::DOUBLE / (60 + place))")
rrf("fused_inv", "list_a", "knn_50", "1.0::DOUBLE / sum(60 + place)")
rrf("fused_all", "bm25", "knn_50", "sum(1.0::DOUBLE / (60 + place))")
ranked("fused_50", "fused", 50)
ranked("fused_inv_50", "fused_inv", 50)


def overlap(name: str, hits: str) -> None:
    """Share of the distinct query terms among the document's terms."""
    PARTS[name + "_sets"] = "SELECT id, list_distinct(words) AS have FROM doc_tokens"
    PARTS[name] = f"""
        SELECT h.query_id, h.id, round(count(*) FILTER (WHERE list_contains(have, term)) / count(*), 6) AS score
        FROM {hits} h JOIN {name}_sets USING (id) JOIN query_sets s ON s.query_id = h.query_id
        GROUP BY h.query_id, h.id"""


overlap("paired", "bm25_20")
# The best window of 128 words.
PARTS["doc_windows"] = """
    SELECT id, (generate_subscripts(words, 1) - 1) // 128 AS part, unnest(words) AS term FROM doc_tokens"""
PARTS["query_sizes_in_terms"] = "SELECT query_id, count(*) AS terms FROM query_sets GROUP BY query_id"
PARTS["window_shares"] = """
    SELECT h.query_id, h.id, w.part, count(DISTINCT s.term) AS shared
    FROM bm25_20 h JOIN query_sets s ON s.query_id = h.query_id JOIN doc_windows w ON w.id = h.id AND w.term = s.term
    GROUP BY ALL"""
PARTS["paired_cut"] = """
    SELECT query_id, id, round(max(shared) / any_value(terms), 6) AS score
    FROM window_shares JOIN query_sizes_in_terms USING (query_id) GROUP BY query_id, id"""
overlap("paired_fused", "fused")
overlap("paired_chain", "chained_f")


def max_sim(name: str, hits: str) -> None:
    """Sum over query words of the best product with a document word."""
    key = "(('0x' || substr(md5(term), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings))"
    PARTS["doc_keys"] = f"SELECT DISTINCT id, {key} AS k FROM doc_words"
    PARTS["query_keys"] = f"SELECT query_id, {key} AS k, count(*) AS times FROM query_words GROUP BY 1, 2"
    PARTS["products"] = """
        SELECT a.k AS qk, b.vec_id AS dk, list_inner_product(e.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS p
        FROM (SELECT DISTINCT k FROM query_keys) a JOIN embeddings e ON e.vec_id = a.k, embeddings b"""
    PARTS[name + "_best"] = f"""
        SELECT h.query_id, h.id, q.k, q.times, max(p) AS best
        FROM {hits} h JOIN query_keys q ON q.query_id = h.query_id JOIN doc_keys d ON d.id = h.id
             JOIN products ON qk = q.k AND dk = d.k
        GROUP BY ALL"""
    PARTS[name] = f"SELECT query_id, id, round(sum(times * best), 6) AS score FROM {name}_best GROUP BY query_id, id"


max_sim("late", "bm25_20")
max_sim("late_chain", "chained")
ranked("late_chain_20", "late_chain", 20)


def retrieved(name: str, hits: str, order: str = "score DESC, id") -> str:
    """Rows of the best 20 hits that have an entry with a known issue."""
    PARTS[name] = f"""
        SELECT query_id,
               (row_number() OVER (PARTITION BY query_id ORDER BY {order.replace('id', 'h.id')}))::INTEGER AS rank,
               h.id, title, author, coalesce(content, '') AS content, main_link, publish_date::VARCHAR AS date
        FROM {hits} h JOIN entries e ON e.id = h.id JOIN issues i ON i.id = e.issue_id QUALIFY rank <= 20"""
    return name


def sql(select: str) -> str:
    """The select with every part it needs in front, in order of definition."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b\w+\b", text):
            if name in PARTS and name not in needed and text is not PARTS[name]:
                visit(PARTS[name])
                if name not in needed:
                    needed.append(name)

    visit(select)
    parts = ", ".join(f"{n} AS ({_line(PARTS[n])})" for n in needed)
    return (f"WITH {parts} " if needed else "") + _line(select)


def _line(text: str) -> str:
    return " ".join(text.split())


def every(name: str) -> str:
    return sql(f"SELECT * FROM {name}")


CATALOG = """
    (SELECT o_orderkey AS id, o_orderdate::DATE AS publish_date,
            CASE WHEN o_orderstatus = 'O' THEN 'https://other.example/' ELSE 'https://weekly.example/issues/' END
              || o_orderkey AS url
     FROM orders WHERE o_orderpriority <> '5-LOW')"""
HREFS = r"""regexp_extract_all(html, '(?i)<a\b[^>]*?\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)"""
LINKS = f"""list_transform({HREFS}, lambda h: replace(replace(replace(trim(h, chr(34) || chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))"""
EXTRACT = """
    SELECT doc_id * 4294967296 + pos AS id, doc_id::INTEGER AS issue_id, title, author, content, main_link,
           other_links, tag
    FROM (
        SELECT doc_id, 0 AS pos, line AS title, source AS author, text || ' more' AS content,
               'https://a.example/' || doc_id || '?utm=1' AS main_link,
               'https://b.example/' || doc_id || '?utm=2' AS other_links, NULL::VARCHAR AS tag
        FROM base WHERE doc_id % 4 = 0
        UNION ALL
        SELECT doc_id, 1, trim(line), source, NULL, 'https://c.example/' || doc_id, '', NULL
        FROM base WHERE doc_id % 4 = 0
        UNION ALL
        SELECT doc_id, 0, line, source, text || 'ref', 'https://a.example/' || doc_id || '#x',
               'https://b.example/' || doc_id, lang
        FROM base WHERE doc_id % 4 = 1
        UNION ALL
        SELECT doc_id, 0, line, source, text || 'src', 'https://a.example/' || doc_id,
               'https://b.example/' || doc_id, NULL
        FROM base WHERE doc_id % 4 = 2)"""

ORACLES: dict[str, str] = {
    "index_postings": sql("SELECT term, id, tf, dl FROM doc_postings"),
    "index_term_stats": every("doc_terms"),
    "index_corpus_stats": every("doc_totals"),
    "index_field_stats": sql("""
        SELECT field, n, total_len, n_terms, sum_df FROM field_totals
        JOIN (SELECT field, count(*) AS n_terms, sum(df)::BIGINT AS sum_df FROM field_terms GROUP BY field)
        USING (field)"""),
    "bm25_document": every("bm25_50"),
    "bm25_document_all": every("bm25"),
    "bm25_fields": every("bm25f_50"),
    "knn_exact": every("knn_50"),
    "knn_distance": every("far_50"),
    "knn_text": every("text_20"),
    "fuse_chain": sql("""
        SELECT query_id, id, score,
               (row_number() OVER (PARTITION BY query_id ORDER BY source, place, id))::INTEGER AS rank
        FROM chained"""),
    "fuse_rrf": every("fused_50"),
    "fuse_rrf_inverse_sum": every("fused_inv_50"),
    "fuse_rrf_all": every("fused_all"),
    "rerank_fetch": sql("SELECT query_id, id, doc FROM bm25_20 JOIN docs USING (id)"),
    "rerank_pair": every(ranked("paired_20", "paired", 20)),
    "rerank_pair_truncated": every(ranked("paired_cut_20", "paired_cut", 20)),
    "rerank_maxsim": every(ranked("late_20", "late", 20)),
    "documents_view": every("docs_with_gaps"),
    "catalog_parse": f"SELECT id, publish_date, url FROM {CATALOG}",
    "catalog_quarantine": """
        SELECT 'Issue ' || o_orderkey || ': unknown' AS line,
               CASE WHEN o_orderstatus = 'O' THEN 'https://other.example/' ELSE '/issues/' END || o_orderkey AS href
        FROM orders WHERE o_orderpriority = '5-LOW'""",
    "tag_extract": sql("SELECT id, tag, coalesce(author, 'nobody') AS author FROM gaps"),
    "url_strip_query": r"SELECT page_id, regexp_replace(url, '\?[^#]*', '') AS url FROM pages",
    "url_join": f"""
        SELECT page_id, pos, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href
                                  ELSE 'https://weekly.example' || href END AS url
        FROM (SELECT page_id, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS href
              FROM (SELECT page_id, list_append({LINKS}, url) AS l FROM pages))""",
    "page_titles": "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages",
    "page_links": f"""
        SELECT page_id, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS link
        FROM (SELECT page_id, {LINKS} AS l FROM pages)""",
    "links_minus_main": sql("""
        SELECT id, unnest([0, 1])::INTEGER AS pos, unnest(['https://x.example/' || id, main_link]) AS link
        FROM gaps WHERE main_link IS NOT NULL
        UNION ALL
        SELECT id, unnest([0, 1, 2])::INTEGER, unnest([NULL, 'https://x.example/' || id, NULL])
        FROM gaps WHERE main_link IS NULL"""),
    "entries_extract": "WITH base AS (SELECT *, string_split(text, chr(10))[1] AS line FROM documents)" + EXTRACT,
    "pages_quarantine": "SELECT doc_id AS issue_id FROM documents WHERE doc_id % 4 = 3",
    "ingest_new": sql("SELECT id, issue_id, title FROM entries WHERE id NOT IN (SELECT doc_id FROM labels)"),
    "ingest_upsert": sql(f"""
        SELECT id, publish_date, url FROM issues
        UNION ALL SELECT id, publish_date, url FROM {CATALOG} WHERE id NOT IN (SELECT page_id FROM pages)"""),
    "ingest_union": sql("""
        SELECT id, issue_id, title, author, content, main_link, tag
        FROM entries WHERE id IN (SELECT doc_id FROM labels)
        UNION ALL
        SELECT id, issue_id, title, author, content, NULL, NULL
        FROM entries WHERE id NOT IN (SELECT doc_id FROM labels)"""),
    "entry_orphans": sql("SELECT id, issue_id FROM gaps WHERE issue_id NOT IN (SELECT page_id FROM pages)"),
    "issue_counts": sql("""
        SELECT i.id, publish_date, url, count(e.id)::INTEGER AS num_entries
        FROM issues i LEFT JOIN entries e ON e.issue_id = i.id GROUP BY ALL"""),
    "model_registry": r"""
        SELECT 'test/model ' || label AS model_name, max(len(embedding))::INTEGER AS dimension,
               count(*) AS n_vectors, 'test-model-' || label || '.bin' AS index_filename
        FROM embeddings GROUP BY label""",
    "quality_checks": sql("""
        SELECT 'issues.id unique' AS rule, count(*) FILTER (WHERE page_id % 10 = 0) AS violations FROM pages
        UNION ALL SELECT 'entries.id unique', count(*) FILTER (WHERE doc_id % 4 = 0 AND doc_id % 7 <> 0) FROM documents
        UNION ALL SELECT 'vectors.id unique', count(*) FILTER (WHERE vec_id % 3 = 0) FROM embeddings
        UNION ALL SELECT 'issues.publish_date not null', 0
        UNION ALL SELECT 'issues.url not null',
            count(*) FILTER (WHERE page_id % 9 = 0) + count(*) FILTER (WHERE page_id % 90 = 0) FROM pages
        UNION ALL SELECT 'entries.title not null',
            count(*) FILTER (WHERE doc_id % 6 = 0) + count(*) FILTER (WHERE doc_id % 12 = 0) FROM documents
        UNION ALL SELECT 'vectors.vec not null', sum(CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END)
            FILTER (WHERE vec_id % 8 = 0 AND vec_id % 5 <> 0)::BIGINT FROM embeddings
        UNION ALL SELECT 'vectors.vec length', sum(CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END)
            FILTER (WHERE vec_id % 5 = 0)::BIGINT FROM embeddings
        UNION ALL SELECT 'entries.issue_id known', coalesce(sum(CASE WHEN id % 4 = 0 THEN 2 ELSE 1 END), 0)::BIGINT
            FROM gaps WHERE issue_id NOT IN (SELECT page_id FROM pages)"""),
    "embed_docs": sql("SELECT id, slot, round(value::DOUBLE, 6) AS value FROM doc_vectors"),
}
retrieved("rows_bm25", "bm25_50_plain")
PARTS["bm25_50_plain"] = "SELECT query_id, id, score FROM bm25_50"
retrieved("rows_fused", "paired_fused")
retrieved("rows_chain", "paired_chain")
PARTS["late_chain_plain"] = "SELECT query_id, id, score FROM late_chain_20"
retrieved("rows_late", "late_chain_plain")
ORACLES["retrieve"] = every("rows_bm25")
ORACLES["hybrid_end_to_end"] = every("rows_fused")
ORACLES["hybrid_chain_fields"] = every("rows_chain")
ORACLES["hybrid_chain_maxsim"] = every("rows_late")
ORACLES["result_links"] = sql(
    "SELECT query_id, rank, id, '[' || title || '](' || main_link || ')' AS title, author, date FROM rows_fused"
)
for stored, derived in (
    ("bm25_stored", "bm25_document"),
    ("bm25_fields_stored", "bm25_fields"),
    ("knn_index_stored", "knn_distance"),
    ("knn_pruned", "knn_distance"),
    ("bm25_pruned", "bm25_document"),
    ("knn_by_name", "knn_exact"),
    ("pages_from_files", "page_links"),
    ("catalog_page", "catalog_parse"),
    ("hybrid_stored", "hybrid_chain_fields"),
):
    ORACLES[stored] = ORACLES[derived]
