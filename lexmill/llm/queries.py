"""The queries of this subpackage, by name, and the SQL of those that SQL can express on whole tables.

The others are beyond SQL (tokenizers, models, packing, extraction from markup) or too slow there (edit distance against every substring, all distances); tests/llm compares them with
brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op3_decontamination
from .html_text import op8_html_extraction
from .language_id import op4_language_id
from .near_dup import op9_minhash_dedup
from .packing import op1_packing
from .quality import op6_quality
from .substring_dedup import op10_substring_dedup
from .suffix_dedup import op7_suffix_dedup
from .token_counts import op5_token_counts
from .vector_search import op2_inverted_multi_index

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    own = (op1_packing, op2_inverted_multi_index, op3_decontamination, op4_language_id, op5_token_counts, op6_quality, op7_suffix_dedup, op8_html_extraction, op9_minhash_dedup, op10_substring_dedup)
    return {f.__name__: f for f in own}


_REPEATED_BYTES = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, substr(h, 2 * pos - 1, 2) AS b, pos, md5(substr(h, 2 * pos - 1, 200)) AS k, pos + 99 <= length(h) // 2 AS whole
  FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS pos FROM d)),
later AS (SELECT doc_id, pos, 1 AS hit FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM bytes WHERE whole) WHERE nth > 1),
marked AS (SELECT doc_id, pos, b, max(CASE WHEN l.hit IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone
  FROM bytes LEFT JOIN later AS l USING (doc_id, pos)),
runs AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 AS starts FROM marked),
done AS (SELECT doc_id, count(*) AS n_bytes, sum(gone) AS n_removed, sum(CASE WHEN starts THEN 1 ELSE 0 END) AS n_spans, string_agg(b, '' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_bytes, 0) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN done USING (doc_id)
"""

_NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d WHERE len(w) >= 4),
windows AS (SELECT doc_id, string_agg(word, ' ') OVER ahead AS k, count(*) OVER ahead AS n FROM words
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
shingles AS (SELECT DISTINCT doc_id, k FROM windows WHERE n = 4 UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles AS x JOIN shingles AS y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes AS s ON s.doc_id = a JOIN sizes AS t ON t.doc_id = b WHERE 100 * common >= 80 * (s.n + t.n - common)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

_REPEATED_WORDS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
windows AS (SELECT doc_id, pos, string_agg(word, ' ') OVER ahead AS k, count(*) OVER ahead AS n FROM words
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
later AS (SELECT doc_id, pos, 1 AS hit FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM windows WHERE n = 20) WHERE nth > 1),
marked AS (SELECT doc_id, pos, word, max(CASE WHEN l.hit IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN later AS l USING (doc_id, pos)),
done AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN done USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_suffix_dedup": _REPEATED_BYTES, "op9_minhash_dedup": _NEAR_DUPLICATES, "op10_substring_dedup": _REPEATED_WORDS}
