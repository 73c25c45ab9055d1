"""The public checks (C-01 to C-03, C-10, J-08 to J-11, A-09, A-10, T-06, T-07, K-01, K-05, P-10)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import shared_folder
from .grammar import check_grammar
from .nrule import check_n_rule
from .orthography import check_orthography, rule_hints
from .spelling import check_spelling
from .tokens import token_counts, tokenize, words

KINDS = ("germanism", "auxiliary", "gender", "case", "contraction")
FINDING = ["doc_id", "family", "check", "rule", "text", "start", "end", "suggestion", "message", "confidence"]


@dataclass
class Language:
    """The tables that checks look words up in. wordlist: form; germanisms: german_key, german, lb, note; the others as lexicon makes them."""

    wordlist: DataFrame
    germanisms: DataFrame | None = None
    nouns: DataFrame | None = None
    participles: DataFrame | None = None
    n_forms: DataFrame | None = None
    german: DataFrame | None = None


def confidence_rank(confidence: Column) -> Column:
    """T-07. 0 for high, 1 for medium, 2 for low."""
    return F.when(confidence == "high", 0).when(confidence == "medium", 1).otherwise(2)


def at_least(findings: DataFrame, confidence: str) -> DataFrame:
    """P-10."""
    return findings.where(confidence_rank(F.col("confidence")) <= ("high", "medium", "low").index(confidence))


def not_at(findings: DataFrame, others: DataFrame) -> DataFrame:
    """J-08, J-09, J-11. Findings that start where none of the others does."""
    return findings.join(others.select("doc_id", "start").distinct(), ["doc_id", "start"], "left_anti")


def not_inside(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """J-10. Findings that start within none of the spans; the document is the equality key of the interval join."""
    s = spans.select(F.col("doc_id").alias("_doc"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    return findings.join(s, (F.col("doc_id") == F.col("_doc")) & (F.col("start") >= F.col("_start")) & (F.col("start") < F.col("_end")), "left_anti")


def german_first(spelling: DataFrame, germanisms: DataFrame, most: int = 5) -> DataFrame:
    """J-01. Spelling findings whose word is a listed German one: the list's words come first."""
    prefix, core = X.elision(F.col("word"))
    rows = spelling.withColumn("_key", F.lower(core)).withColumn("_prefix", prefix).join(germanisms.select(F.col("german_key").alias("_key"), F.col("lb").alias("_lb")), "_key", "left")
    listed = F.transform(F.split("_lb", ",\\s*"), lambda x: F.concat("_prefix", x))
    both = F.slice(F.concat(listed, F.filter("suggestions", lambda s: ~F.col("_lb").contains(s))), 1, max(1, most))
    return rows.withColumn("suggestions", F.when(F.col("_lb").isNotNull(), both).otherwise(F.col("suggestions"))).drop("_key", "_prefix", "_lb")


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows, written once to the shared folder for all families that read them."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _spelling_rows(spelling: DataFrame) -> DataFrame:
    return spelling.select("doc_id", F.lit("spelling").alias("family"), F.lit("unknown-word").alias("check"), F.lit(None).cast("string").alias("rule"), F.col("word").alias("text"), "start", "end", F.array_join("suggestions", ", ").alias("suggestion"), F.array_join(F.transform("hints", lambda h: h["hint"]), "; ").alias("message"), F.lit("high").alias("confidence"))


def _n_rows(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lit("n-rule").alias("family"), F.col("direction").alias("check"), "rule", F.col("word").alias("text"), "start", "end", "suggestion", F.concat(F.lit("before "), F.col("next_word")).alias("message"), "confidence")


def _orthography_rows(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lit("orthography").alias("family"), "check", "rule", "text", "start", "end", "suggestion", "message", "confidence")


def _grammar_rows(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lit("grammar").alias("family"), F.col("kind").alias("check"), F.lit(None).cast("string").alias("rule"), "text", "start", "end", "suggestion", "message", "confidence")


def spell_check(docs: DataFrame, language: Language, n_rule: bool = True, orthography: bool = True, lookup: bool = False, most: int = 5, ignore: list[str] = (), skip_capitalised: bool = False) -> DataFrame:
    """C-01. docs: doc_id, text. Findings of the spelling, n-rule and orthography families."""
    tokens = kept(tokenize(docs), "tokens")
    spelling = check_spelling(tokens, language.wordlist, ignore, True, skip_capitalised, most)
    if language.germanisms is not None:
        spelling = german_first(spelling, language.germanisms, most)
    spelling = kept(spelling, "spelling")
    out = _spelling_rows(rule_hints(spelling))
    if n_rule:
        out = out.unionByName(_n_rows(not_at(check_n_rule(tokens, language.wordlist, language.n_forms if lookup else None), spelling)))
    if orthography:
        out = out.unionByName(_orthography_rows(check_orthography(docs)))
    return out


def n_rule_check(docs: DataFrame, language: Language, lookup: bool = True, min_confidence: str = "low") -> DataFrame:
    """C-03."""
    return at_least(check_n_rule(tokenize(docs), language.wordlist, language.n_forms if lookup else None), min_confidence)


def draft_check(docs: DataFrame, language: Language, lookup: bool = True, ignore: list[str] = (), hide_germanisms: bool = False) -> DataFrame:
    """C-02. All four families. n-rule findings on unknown words and on rewritten auxiliaries go, spelling findings within sure orthography findings too; with hide_germanisms also those that a Germanism explains (as reports show it)."""
    tokens = kept(tokenize(docs), "tokens")
    spelling = kept(check_spelling(tokens, language.wordlist, ignore, most=4), "spelling")
    n_rule = check_n_rule(tokens, language.wordlist, language.n_forms if lookup else None)
    out = []
    if language.nouns is not None and language.participles is not None:
        grammar = kept(check_grammar(docs, words(tokens), language.nouns, language.participles, spelling, language.germanisms, language.german if lookup else None), "grammar")
        n_rule = not_at(n_rule, grammar.where("kind = 'auxiliary'"))
        out.append(_grammar_rows(grammar))
    orthography = kept(check_orthography(docs), "orthography")
    shown = not_inside(spelling, orthography.where("confidence = 'high'"))
    if hide_germanisms and out:
        shown = not_at(shown, out[0].where("check = 'germanism'"))
    out += [_spelling_rows(rule_hints(shown)), _n_rows(not_at(n_rule, spelling)), _orthography_rows(orthography)]
    all_ = out[0]
    for part in out[1:]:
        all_ = all_.unionByName(part)
    return all_


def ordered(findings: DataFrame) -> DataFrame:
    """T-06. By document, place and check."""
    return findings.orderBy("doc_id", "start", "check", "end")


def summary(findings: DataFrame, tokens: DataFrame) -> DataFrame:
    """A-09. Per document: findings, high, and words."""
    counted = findings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("confidence") == "high").alias("high"))
    total = token_counts(tokens).where("type = 'word'").select("doc_id", F.col("n").alias("words"))
    return total.join(counted, "doc_id", "left").select("doc_id", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("high", F.lit(0)).alias("high"), "words")


def located(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """K-09. Findings with line, column and what stands around them."""
    rows = findings.join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id")
    line, column = X.line_and_column(F.col("_text"), F.col("start"))
    return rows.select("*", line.alias("line"), column.alias("column"), X.context(F.col("_text"), F.col("start"), F.col("end")).alias("around")).drop("_text")


def report(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """K-05, A-10. One row a document: markdown, families and checks in a fixed order, sure findings first."""
    line = F.format_string("- [%s] **%s** → **%s** — %s (%d:%d)", F.col("confidence"), F.col("text"), F.coalesce("suggestion", F.lit("")), F.coalesce("message", F.lit("")), F.col("line"), F.col("column"))
    kind = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("check")), F.lit(0))
    family = F.array_position(F.array(*[F.lit(f) for f in ("grammar", "spelling", "n-rule", "orthography")]), F.col("family"))
    rows = located(findings, docs).select("doc_id", "family", F.struct(family.alias("f"), F.when(F.col("family") == "grammar", kind).otherwise(0).alias("k"), confidence_rank(F.col("confidence")).alias("c"), "start", "check", line.alias("line")).alias("x"))
    per = rows.groupBy("doc_id", "family").agg(F.array_sort(F.collect_list("x")).alias("x"))
    block = F.concat(F.lit("### "), F.col("family"), F.lit("\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n"))
    return per.select("doc_id", F.struct(F.col("x")[0]["f"].alias("f"), block.alias("b")).alias("y")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("y")), lambda y: y["b"]), "\n\n").alias("markdown"))


def as_json(rows: DataFrame) -> DataFrame:
    """K-01. One JSON document a row."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def by_confidence(findings: DataFrame) -> DataFrame:
    """A-14."""
    return findings.groupBy("family", "check", "confidence").agg(F.count(F.lit(1)).alias("n"))


def first_at(findings: DataFrame) -> DataFrame:
    """W-07. One finding for each place and check."""
    order = Window.partitionBy("doc_id", "start", "check").orderBy("end", "suggestion")
    return findings.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
