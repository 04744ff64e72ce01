"""Repeated passages by sorted hashes of windows, in place of a suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from veilwork.llm.exchange import exchange, partitions
from veilwork.llm.spans import PLACES, SPAN_WORDS, find_repeats, gather_runs, merged, readable, send_runs, stretches


def repeated_passages(docs: DataFrame, min_words: int = SPAN_WORDS) -> DataFrame:
    """Every passage of at least `min_words` words that occurs at two places or more.

    No suffix is kept or sorted. The hash of every stretch of `min_words` words is sent to the partition that the stretch's
    minimiser selects, in runs of neighbours with an equal minimiser, so equal stretches meet. There all hashes are sorted
    and neighbours compared, which finds all equal stretches; those that overlap in their document are joined into spans.

    Returns (doc_id, start_word, end_word, n_words, is_copy, source_doc_id): maximal spans of words (see
    tokens.split_words; end is exclusive). Stretches of which the same words occur at a smaller (doc_id, word) have
    is_copy; source_doc_id is the least document in which part of the span occurs. Every word of every repeated stretch is
    in a span, and no other.

    Rows without doc_id or text and texts of fewer words than `min_words` give nothing. Rows with equal doc_id and equal
    text are one document. A passage repeated inside one document counts. An empty table gives an empty result; columns
    other than doc_id and text are ignored.
    """
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    parts = partitions(docs.sparkSession)

    def receive(payloads: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        arrays = gather_runs(payloads)
        if arrays is None:
            return
        found = stretches(find_repeats(*arrays), min_words)
        yield pa.RecordBatch.from_pydict(found)

    places = exchange(readable(docs), send_runs(min_words, parts, neighbours=False), receive, PLACES, parts)
    return merged(places, parts).drop("paths")


def passages_sql(min_words: int = SPAN_WORDS) -> str:
    """The rows of repeated_passages over `documents` as SQL for DuckDB: all windows by their words, grouped."""
    ascii_low = f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
    return f"""
WITH docs AS MATERIALIZED (
  SELECT DISTINCT doc_id, regexp_extract_all({ascii_low}, '[a-z0-9\\x{{80}}-\\x{{10ffff}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), places AS MATERIALIZED (
  SELECT doc_id, p, md5_number(array_to_string(w[p + 1 : p + {min_words}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - {min_words} + 1)) AS p FROM docs WHERE len(w) >= {min_words})
), firsts AS (
  SELECT h, min(struct_pack(doc_id := doc_id, p := p)) AS first FROM places GROUP BY h HAVING count(DISTINCT struct_pack(doc_id := doc_id, p := p)) > 1
), flagged AS (
  SELECT DISTINCT doc_id, p, first <> struct_pack(doc_id := doc_id, p := p) AS is_copy, first.doc_id AS source FROM places JOIN firsts USING (h)
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, is_copy ORDER BY p) AS span FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id, is_copy ORDER BY p) + {min_words} THEN 0 ELSE 1 END AS fresh FROM flagged)
)
SELECT doc_id, CAST(min(p) AS INT) AS start_word, CAST(max(p) + {min_words} AS INT) AS end_word, CAST(max(p) + {min_words} - min(p) AS INT) AS n_words, is_copy, min(source) AS source_doc_id FROM numbered GROUP BY doc_id, is_copy, span
"""
