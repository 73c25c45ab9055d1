"""Full-text search over texts or corpus segments (P-01 to P-05, H-03, T-01, T-08, K-07)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

#: Ranges that a hit lists at most.
MOST_RANGES = 21


def matcher(query: str, match: str = "word", case_sensitive: bool = False, ignore_accents: bool = False) -> str | None:
    """P-01, P-03. The pattern of a query; None if nothing is left of it after trimming. Apostrophes and runs of white space are interchangeable."""
    body = unicodedata.normalize("NFC", query.strip())
    if ignore_accents:
        body = "".join(X._folded(c) for c in body)
    if not body:
        return None
    body = P.escaped(body)
    for c in "'’":
        body = body.replace(c, "\0")
    body = P.WS_PLUS.join(body.split()).replace("\0", "['’]")
    if match == "word":
        body = f"(?<![{P.LETTER}0-9]){body}(?![{P.LETTER}0-9])"
    elif match != "substring":
        raise ValueError(f"match is word or substring, not {match}")
    return body if case_sensitive else f"(?iu){body}"


def search(texts: DataFrame, query: str, match: str = "word", case_sensitive: bool = False, ignore_accents: bool = False, normalise: bool = True, id_col: str = "seg_id", text_col: str = "text") -> DataFrame:
    """P-02, P-04. Rows of texts that match, with all their columns and ranges: [start, end) in the normalised text, the first MOST_RANGES."""
    pattern = matcher(query, match, case_sensitive, ignore_accents)
    if pattern is None:
        return texts.where(F.lit(False)).withColumn("ranges", F.lit(None).cast(X.RANGES))
    text = F.col(text_col)
    seen = X.fold(text) if ignore_accents else X.nfc(text) if normalise else text
    rows = texts.where(text.isNotNull()).withColumn("_seen", seen).where(F.col("_seen").rlike(pattern))
    return rows.withColumn("ranges", X.ranges(F.col("_seen"), pattern, MOST_RANGES)).drop("_seen")


def page(hits: DataFrame, limit: int = 10, offset: int = 0, id_col: str = "seg_id", text_col: str = "text") -> DataFrame:
    """T-01. Short texts first, then by id."""
    return hits.orderBy(F.length(text_col), id_col).offset(offset).limit(limit)


def corpus_search(texts: DataFrame, query: str, lang: str = "lb", show: tuple[str, ...] | None = None, match: str = "word", case_sensitive: bool = False, ignore_accents: bool = False, limit: int = 10, offset: int = 0) -> DataFrame:
    """C-04, P-05. texts: seg_id, lang, text. A page of hits: seg_id, text, marked, ranges, total (of all hits), and other: the hit's texts in the languages to show."""
    if not (2 <= len(query) <= 200 and 1 <= limit <= 50 and offset >= 0):
        raise ValueError("a query has 2 to 200 characters, a page 1 to 50 hits from offset 0")
    hits = search(texts.where(F.col("lang") == lang).select("seg_id", "text"), query, match, case_sensitive, ignore_accents)
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    shown = page(hits, limit, offset).crossJoin(F.broadcast(total))  # one row
    pattern = matcher(query, match, case_sensitive, ignore_accents)
    marked = X.highlighted(F.col("text"), pattern) if pattern and not ignore_accents else F.col("text")
    others = texts.where(F.col("lang") != lang) if show is None else texts.where(F.col("lang").isin(*show) & (F.col("lang") != lang))
    other = others.join(shown.select("seg_id"), "seg_id", "left_semi").groupBy("seg_id").agg(F.map_from_entries(F.collect_list(F.struct("lang", "text"))).alias("other"))
    return shown.join(other, "seg_id", "left").select("seg_id", "text", marked.alias("marked"), "ranges", "total", "other").orderBy(F.length("text"), "seg_id")
