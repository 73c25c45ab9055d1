"""Tokens with offsets, words and clauses: the working form of all checkers.

Texts are dealt out by document before they are exploded, so the windows over a document's tokens need no shuffle
of the (much larger) token rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

QUOTES = ("„", "“", "”", '"', "«", "»", "‚", "‘", "’", "'", "‹", "›")
CLAUSE_ENDS = (".", ",", ";", ":", "!", "?", "…", "(", ")", '"', "“", "”", "«", "»", "–", "—")
PAUSES = (".", ",", ";", ":", "!", "?", "…", "(", ")", "[", "]", "–", "—", "/")


def document_window() -> Window:
    return Window.partitionBy("doc_id").orderBy("pos")


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """H-01. Per token: doc_id, pos, type (word, number, punct, space), text, start, end. Joined in order they are the text again."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).repartition("doc_id")
    parts = rows.select("doc_id", F.posexplode(F.regexp_extract_all("_text", F.lit(P.TOKEN), F.lit(0))).alias("pos", "text"))
    kind = F.when(F.col("text").rlike(f"^[{P.SPACE}]"), "space").when(F.col("text").rlike("^[0-9]"), "number").when(F.col("text").rlike(f"^['’]?[{P.LETTER}]"), "word").otherwise("punct")
    end = F.sum(F.length("text")).over(document_window().rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return parts.select("doc_id", "pos", kind.alias("type"), "text", (end - F.length("text")).alias("start"), end.alias("end"))


def token_counts(tokens: DataFrame) -> DataFrame:
    """A-06. Tokens of each document by type."""
    return tokens.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


def words(tokens: DataFrame) -> DataFrame:
    """W-04. The words of each document: widx from 0, text with straight apostrophes, lower, start, end, clause, and whether a clause ends after it."""
    w, whole = document_window(), Window.partitionBy("doc_id")
    ends = ((F.col("type") == "punct") & F.col("text").isin(*CLAUSE_ENDS)).cast("int")
    marked = tokens.select("*", F.sum(ends).over(w).alias("clause")).select("*", F.max("clause").over(whole).alias("_all")).where("type = 'word'")
    text = X.straight(F.col("text"))
    after = F.coalesce(F.lead("clause").over(w), F.col("_all")) > F.col("clause")
    return marked.select("doc_id", "pos", (F.row_number().over(w) - 1).alias("widx"), text.alias("text"), F.lower(text).alias("lower"), "start", "end", F.col("clause").cast("int").alias("clause"), after.alias("break_after"))


def clauses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """W-04, a clause a row: doc_id, clause, first (the widx of its first word), words (their texts, straight); clauses without words are left out.

    The same words and clauses as of words(), without offsets. Each text is parted where it stands: nothing is dealt out or sorted,
    and no rows of tokens are made. A word's index is its place among words and ends of clauses, less the ends before it.
    """
    split = F.regexp_extract_all(X.straight(F.col(text_col)), F.lit(f"[{P.SPACE}]+|{P.NUMBER}|({P.WORD}|[{''.join(CLAUSE_ENDS)}])|[^{P.SPACE}{P.LETTER}0-9]"), F.lit(1))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.filter(split, lambda x: x != "").alias("_units"))
    ends = F.filter(F.transform("_units", lambda x, i: F.when(x.isin(*CLAUSE_ENDS), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "_units", F.concat(ends, F.array(F.size("_units"))).alias("_ends"))

    def part(end: Column, k: Column) -> Column:
        start = F.coalesce(F.get("_ends", k - 1) + 1, F.lit(0))
        return F.struct(k.alias("clause"), (start - k).alias("first"), F.slice("_units", start + 1, end - start).alias("words"))

    return rows.select("doc_id", F.explode(F.transform("_ends", part)).alias("x")).select("doc_id", "x.*").where(F.size("words") > 0)


def neighbours(tokens: DataFrame) -> DataFrame:
    """W-01, W-02, W-03, W-08. Per word: what stands before and after it.

    next_type, next_text: the next token that is neither space nor quotation mark; quoted: whether one was skipped;
    prev_word: the token before, spaces left out, if it is a word; initial: whether a sentence starts here (quotation
    marks skipped); initial_strict: the same with quotation marks in the way; hashtag: whether # stands before it.
    """
    w = document_window()
    quote = (F.col("type") == "punct") & F.col("text").isin(*QUOTES)
    raw = tokens.select("*", F.lag("text").over(w).alias("_raw"))
    solid = raw.where("type <> 'space'").select("*", F.lag(F.struct("type", "text")).over(w).alias("_prev"), F.sum(quote.cast("int")).over(w).alias("_quotes"), quote.alias("_quote"))
    solid = solid.select("*", F.max("_quotes").over(Window.partitionBy("doc_id")).alias("_all"))
    plain = solid.where(~F.col("_quote")).select("*", F.lead(F.struct("type", "text", "_quotes")).over(w).alias("_next"), F.lag(F.struct("type", "text")).over(w).alias("_before"))
    ends = lambda c: c.isNull() | ((c["type"] == "punct") & c["text"].rlike("[.!?…:]"))
    return plain.where("type = 'word'").select(
        "doc_id", "pos", "text", "start", "end",
        F.col("_next.type").alias("next_type"), F.col("_next.text").alias("next_text"),
        (F.coalesce(F.col("_next._quotes"), F.col("_all")) > F.col("_quotes")).alias("quoted"),
        F.when(F.col("_prev.type") == "word", F.col("_prev.text")).alias("prev_word"),
        ends(F.col("_before")).alias("initial"), ends(F.col("_prev")).alias("initial_strict"),
        F.coalesce(F.col("_raw") == "#", F.lit(False)).alias("hashtag"),
    )
