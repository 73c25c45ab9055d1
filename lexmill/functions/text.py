"""Column functions on text: normal forms, terms, sentences, match ranges, case, elision."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P

RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _plain(text: str | None) -> bool:
    return text is None or text.isascii()


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if _plain(t) else unicodedata.normalize("NFC", t))


def _folded(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M")) or c


@F.pandas_udf(T.StringType())
def _fold(texts: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return texts.map(lambda t: t if _plain(t) else "".join(known[c] if c in known else known.setdefault(c, _folded(c)) for c in unicodedata.normalize("NFC", t)))


def nfc(text: Column) -> Column:
    """The composed normal form. ASCII texts never leave the JVM's hands changed."""
    return _nfc(text)


def fold(text: Column) -> Column:
    """Without accents: each character's decomposition without marks; a lone mark stays (P-02)."""
    return _fold(text)


def straight(text: Column) -> Column:
    """Typographic apostrophes as straight ones (H-05)."""
    return F.replace(text, F.lit("’"), F.lit("'"))


def elision(word: Column) -> tuple[Column, Column]:
    """The prefix d' or z' of a word, and the rest (H-06)."""
    w = straight(word)
    prefix = F.regexp_extract(w, r"^([dDzZ]')(?s:.+)$", 1)
    return prefix, F.substring(w, F.length(prefix) + 1, F.length(w))


def head(text: Column) -> Column:
    return F.substring(text, 1, 1)


def tail(text: Column) -> Column:
    return F.substring(text, F.lit(2), F.length(text))


def capitalised(text: Column) -> Column:
    return text.rlike(r"^\p{Lu}")


def like_case(model: Column, text: Column, all_caps: bool = False) -> Column:
    """text with a capital where model begins with one; with all_caps, all in capitals where model is (H-07)."""
    title = F.when(head(model) == F.upper(head(model)), F.concat(F.upper(head(text)), tail(text))).otherwise(text)
    return F.when((F.length(model) > 1) & (model == F.upper(model)), F.upper(text)).otherwise(title) if all_caps else title


def match_case(model: Column, text: Column) -> Column:
    """A suggestion in the case of the word that it replaces: only title words change it (H-07)."""
    title = (head(model) == F.upper(head(model))) & (tail(model) == F.lower(tail(model)))
    shout = title & (text == F.upper(text)) & (F.length(text) > 1)
    low = title & (head(text) == F.lower(head(text)))
    return F.when(shout, F.concat(head(text), F.lower(tail(text)))).when(low, F.concat(F.upper(head(text)), tail(text))).otherwise(text)


# Words too frequent to find anything by, in four languages.
STOP_WORDS = frozenset(
    "an a de den d' dem der e en eng et ass sinn si vun vu fir mat op um am datt ze och net sech hien hie mir mer ech du dat déi dee wéi ginn gëtt hunn huet "
    "und die der das den dem des ein eine ist sind zu mit von für auf im in nicht sich es er sie wir ich dass wird werden "
    "le la les l' un une des du de et est sont à au aux en pour par sur dans que qui ne pas se il elle nous je "
    "the a an and is are to of in on for with that it be by as at this we i".split()
)


def terms(text: Column, normalise: bool = True) -> Column:
    """The search terms of a text, in order: words without elided articles and stop words, and a 5-letter prefix for each longer one (H-02, P-06)."""
    raw = F.regexp_extract_all(F.lower(nfc(text) if normalise else text), F.lit(P.TERM), F.lit(0))
    words = F.transform(raw, lambda w: F.regexp_replace(straight(w), "^[dlzcjmnst]'", ""))
    words = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*sorted(STOP_WORDS)))
    return F.flatten(F.transform(words, lambda w: F.when(F.length(w) > 5, F.array(w, F.concat(F.substring(w, 1, 5), F.lit("*")))).otherwise(F.array(w))))


def sentences(text: Column, most: int = 6) -> Column:
    """At most that many sentences: parted after . ! ? … and space or at line ends, trimmed, longer than three characters (H-04)."""
    parts = F.transform(F.split(text, f"(?<=[.!?…])[{P.SPACE}]+|\\n+"), trimmed)
    return F.slice(F.filter(parts, lambda s: F.length(s) > 3), 1, most)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{P.SPACE}]+|[{P.SPACE}]+$", "")


def collapsed(text: Column) -> Column:
    return F.regexp_replace(text, f"[{P.SPACE}]+", " ")


def ranges(text: Column, pattern: str, most: int | None = None) -> Column:
    """[start, end) of each match, in code points, without leaving the JVM: the lengths of what stands between matches and of the matches are added up (H-03)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    # Both arrays are short (matches of one query in one text), so the running sum may be an aggregate.
    state = F.struct(F.lit(0).alias("at"), F.array().cast(RANGES).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))).alias("out"))

    shown = F.slice(found, 1, most) if most else found
    pairs = F.zip_with(F.slice(between, 1, F.size(shown)), shown, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(F.size(shown) > 0, F.aggregate(pairs, state, step, lambda acc: acc["out"])).otherwise(F.array().cast(RANGES))


def highlighted(text: Column, pattern: str) -> Column:
    """Matches between double asterisks (K-07)."""
    return F.regexp_replace(text, f"(?:{pattern})", "**$0**")


def line_and_column(text: Column, start: Column) -> tuple[Column, Column]:
    """1-based line and column of an offset (K-09)."""
    before = F.split(F.substring(text, F.lit(1), start), "\n")
    return F.size(before), F.length(F.element_at(before, -1)) + 1


def context(text: Column, start: Column, end: Column, width: int = 30) -> Column:
    """What stands around a finding, with white space collapsed (K-09)."""
    first = F.greatest(F.lit(0), start - width)
    return trimmed(collapsed(F.substring(text, first + 1, end + width - first)))
