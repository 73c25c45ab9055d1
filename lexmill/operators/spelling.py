"""Spelling against a word list (P-07 to P-09, H-08, A-06, J-17). Each distinct word is judged once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .tokens import neighbours


def acronym(word: Column) -> Column:
    """P-07."""
    return F.length(word).between(2, 6) & (word == F.upper(word)) & word.rlike(r"\p{Lu}")


def valid_words(words: DataFrame, wordlist: DataFrame) -> DataFrame:
    """P-08. words: word (distinct). The same plus valid: as it is, without d' or z', without edge apostrophes, or part by part between hyphens; a form with a capital first letter
    also in small letters, and one all in capitals in small letters or with a capital first."""
    w = X.straight(F.col("word"))
    _, rest = X.elision(F.col("word"))
    core = F.regexp_replace(rest, "^'+|'+$", "")
    parts = F.filter(F.split(core, "-"), lambda p: p != "")
    hyphened = core.contains("-") & (F.size(parts) > 1)

    def variants(f: Column) -> Column:
        small = F.lower(f)
        loud = (f == F.upper(f)) & (small != f) & (F.length(f) > 1)
        return F.array_compact(F.array(f, F.when(X.capitalised(f) & ((X.tail(f) == F.lower(X.tail(f))) | loud), small), F.when(loud, F.concat(X.head(f), X.tail(small)))))

    # Candidate forms: way 0 needs any of them; way 1, the parts of a compound, all.
    ways = F.concat(
        F.transform(F.array_distinct(F.flatten(F.transform(F.array(w, rest, core), variants))), lambda f: F.struct(F.lit(0).alias("way"), f.alias("form"))),
        F.when(hyphened, F.transform(F.filter(parts, lambda p: ~(acronym(p) | p.rlike("^[0-9]+$"))), lambda f: F.struct(F.lit(1).alias("way"), f.alias("form")))).otherwise(F.array().cast("array<struct<way: int, form: string>>")),
    )
    each = words.select("word", hyphened.alias("hyphened"), F.explode(ways).alias("x")).select("word", "hyphened", "x.*")
    listed = wordlist.select("form", F.lit(True).alias("hit")).distinct()
    judged = each.join(listed, "form", "left").groupBy("word").agg(
        F.max((F.col("way") == 0) & F.col("hit").isNotNull()).alias("any"), F.min((F.col("way") == 0) | F.col("hit").isNotNull()).alias("all"), F.first("hyphened").alias("hyphened")
    )
    clitic = F.lower(X.straight(F.col("word"))).isin("'t", "'s")
    return judged.select("word", (F.col("any") | clitic | (F.col("hyphened") & F.col("all"))).alias("valid"))


def suggestions(unknown: DataFrame, wordlist: DataFrame, most: int = 5, distance: int = 2) -> DataFrame:
    """H-08. unknown: word. The same plus suggestions, nearest by edit distance first, ties in order of the alphabet.

    Words share a candidate's bucket if they agree in a word with one letter left out of a six-letter key, so only likely
    pairs are compared, never every pair.
    """
    prefix, rest = X.elision(F.col("word"))
    core = F.regexp_replace(rest, "^'+|'+$", "")

    def keys(word: Column) -> Column:
        low = F.substring(F.lower(word), 1, 6)
        return F.array_distinct(F.concat(F.array(low), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low))), lambda i: F.concat(F.substring(low, F.lit(1), i - 1), F.substring(low, i + 1, F.lit(6))))))

    left = unknown.select("word", prefix.alias("prefix"), core.alias("core"), F.explode(keys(core)).alias("key"))
    right = wordlist.select("form").distinct().select("form", F.explode(keys(F.col("form"))).alias("key"))
    near = left.join(right, "key").select("word", "prefix", "core", "form").distinct().withColumn("d", F.levenshtein(F.lower("core"), F.lower("form"))).where(F.col("d") <= distance)
    order = Window.partitionBy("word").orderBy("d", "form")
    best = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    said = F.concat("prefix", X.match_case(F.col("core"), F.col("form")))
    listed = best.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("n", said.alias("s")))).alias("x")).select("word", F.array_distinct(F.col("x.s")).alias("suggestions"))
    return unknown.join(listed, "word", "left").withColumn("suggestions", F.coalesce("suggestions", F.array().cast("array<string>")))


def check_spelling(tokens: DataFrame, wordlist: DataFrame, ignore: list[str] = (), skip_acronyms: bool = True, skip_capitalised: bool = False, most: int = 5) -> DataFrame:
    """P-09. Per unknown word: doc_id, word, start, end, suggestions."""
    if skip_capitalised:
        rows = neighbours(tokens)
    else:
        rows = tokens.where("type = 'word'")
    rows = rows.where(F.length("text") > 1)
    if ignore:
        rows = rows.where(~F.lower("text").isin(*[w.lower() for w in ignore]))
    if skip_acronyms:
        rows = rows.where(~acronym(F.col("text")))
    if skip_capitalised:
        rows = rows.where(~X.capitalised(F.col("text")) | F.col("initial_strict"))
    rows = rows.select("doc_id", F.col("text").alias("word"), "start", "end")
    judged = valid_words(rows.select("word").distinct(), wordlist).where(~F.col("valid")).select("word")
    said = suggestions(judged, wordlist, most) if most else judged.withColumn("suggestions", F.array().cast("array<string>"))
    return rows.join(said, "word").select("doc_id", "word", "start", "end", "suggestions")
