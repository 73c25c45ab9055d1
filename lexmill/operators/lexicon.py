"""Dictionary documents (L-01 to L-12, K-01 to K-04, P-11, P-12, P-14, J-03 to J-05, J-15, U-04, C-06 to C-08).

Raw JSON is read once with explicit schemas; fields that may be a string or a list, and open trees, stay JSON text until an
operator needs them. Rich text is nested two levels deep in practice; three are unrolled.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

# The dictionary's codes and their labels.
CLASSES = dict(
    SUBST="noun", VRB="verb", ADJ="adjective", ADV="adverb", PREP="preposition", KONJ="conjunction", CONJ="conjunction", PRON="pronoun", ART="article", INTERJ="interjection",
    INTJ="interjection", NUM="numeral", PART="particle", AFFIX="affix", PREF="prefix", SUFF="suffix", ABR="abbreviation", ABK="abbreviation", PHR="phrase", NP="proper noun",
)
GENDERS = dict(M="masculine", F="feminine", N="neuter", PL="plural only")
LANGUAGES = ("de", "fr", "en", "pt")
PERSONS = dict(p1="ech", p2="du", p3="hien/hatt/si", p4="mir", p5="dir", p6="si")
CASES = ("nominative", "accusative", "dative", "genitive")
URL = "https://lod.lu/artikel/"
KNOWN_MEANING_KEYS = ("meaningID", "number", "meaningVideo", "inflection", "targetLanguages", "examples")

LEAF = "struct<type: string, content: string, joinWithPreviousWord: boolean>"
DEPTH = 3
PART = LEAF
for _ in range(DEPTH - 1):
    PART = f"struct<type: string, content: string, joinWithPreviousWord: boolean, parts: array<{PART}>>"
SEARCH = "results array<struct<id: string, article_id: string, word_lb: string, scientific_name: string, pos: string, erroneous: boolean, sign_language: boolean, matches: array<string>, meanings: array<struct<id: string, translation: string, number: int, secondaryHeadword: string, sign_language: boolean>>>>"
MEANING = f"meaningID string, number int, inflection struct<forms: array<struct<content: string>>>, targetLanguages map<string, struct<parts: array<{PART}>>>, examples array<struct<parts: array<{PART}>, audioFiles: struct<ogg: string, aac: string>>>"
ENTRY = "entry struct<lod_id: string, partOfSpeech: string, lemma: string, nRuleForm: string, trademark: boolean, ipa: string, tables: string, audioString: string, audioFiles: struct<ogg: string, aac: string>, allSynonyms: string, infoboxes: string, categories: array<struct<label: string, code: string>>, microStructures: array<struct<partOfSpeech: string, auxiliaryVerb: string, pastParticiple: string, grammaticalUnits: array<struct<grammaticalInformation: string, meanings: array<string>>>>>>"
SYNONYMS = "synonymGroups array<struct<fromTerms: array<string>, toSynonyms: array<struct<syn: string>>>>, otherPotentialSynonyms struct<synonyms: array<struct<syn: string>>>"


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def part_of_speech(code: Column) -> Column:
    """H-09. SUBST+N is a noun (neuter); unknown codes stay."""
    table = lambda d, k: F.coalesce(F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[k], k)
    parts = F.split(code, "\\+")
    extra = F.filter(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda g: table(GENDERS, g)), lambda x: x != "")
    base = table(CLASSES, parts[0])
    return F.when(code.isNull() | (code == ""), "").when(F.size(extra) > 0, F.concat(base, F.lit(" ("), F.array_join(extra, ", "), F.lit(")"))).otherwise(base)


def tags_stripped(text: Column) -> Column:
    bare = F.regexp_replace(text, "<[^>]*>", "")
    for name, c in (("amp", "&"), ("lt", "<"), ("gt", ">")):
        bare = F.replace(bare, F.lit(f"&{name};"), F.lit(c))
    return X.trimmed(bare)


def parts_text(parts: Column, bold: bool = False, depth: int = DEPTH) -> Column:
    """L-02. The words of rich text: a space between them unless one joins the word before it; labels left out."""

    def step(acc: Column, p: Column) -> Column:
        own = F.when(F.size(p["parts"]) > 0, parts_text(p["parts"], bold, depth - 1)).otherwise(p["content"]) if depth > 1 else p["content"]
        if bold:
            own = F.when(p["type"] == "inflectedHeadword", F.concat(F.lit("**"), _filled(own), F.lit("**"))).otherwise(own)
        space = F.when((acc != "") & ~F.coalesce(p["joinWithPreviousWord"], F.lit(False)), " ").otherwise("")
        return F.when(own.isNull() | (own == "") | F.coalesce(p["type"] == "attribute", F.lit(False)), acc).otherwise(F.concat(acc, space, own))

    return F.coalesce(F.aggregate(parts, F.lit(""), step, lambda s: X.trimmed(F.regexp_replace(s, "\\s+([,.;:!?])", "$1"))), F.lit(""))


def labels(parts: Column, depth: int = DEPTH) -> Column:
    """L-03. The contents of attributes, depth first."""
    own = lambda p: F.when((p["type"] == "attribute") & p["content"].isNotNull(), F.array(p["content"])).otherwise(F.array().cast("array<string>"))
    if depth == 1:
        return F.flatten(F.transform(parts, own))
    return F.flatten(F.transform(parts, lambda p: F.concat(own(p), F.coalesce(labels(p["parts"], depth - 1), F.array().cast("array<string>")))))


def example(e: Column) -> Column:
    """L-04."""
    gloss = F.filter(e["parts"], lambda p: p["type"] == "gloss")
    text = F.filter(e["parts"], lambda p: F.coalesce(p["type"] != "gloss", F.lit(True)))
    return F.struct(
        parts_text(text, bold=True).alias("text"), F.when(F.size(gloss) > 0, parts_text(gloss)).alias("gloss"), F.coalesce(labels(e["parts"]), F.array().cast("array<string>")).alias("labels"),
        F.coalesce(e["audioFiles"]["aac"], e["audioFiles"]["ogg"]).alias("audio"),
    )


TRANSLATION = "struct<text: string, clarifier: string, notes: array<string>>"


def translations(parts: Column) -> Column:
    """L-05. A fold in order: clarifiers and notes go to the translation before them."""

    def step(acc: Column, p: Column) -> Column:
        text = F.when(F.size(p["parts"]) > 0, parts_text(p["parts"], depth=DEPTH - 1)).otherwise(X.trimmed(F.coalesce(p["content"], F.lit(""))))
        new = F.concat(acc, F.array(F.struct(text.alias("text"), F.lit(None).cast("string").alias("clarifier"), F.array().cast("array<string>").alias("notes"))))
        last, before = F.try_element_at(acc, F.lit(-1)), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        clarified = F.concat(before, F.array(F.struct(last["text"].alias("text"), F.concat_ws("; ", last["clarifier"], text).alias("clarifier"), last["notes"].alias("notes"))))
        noted = F.concat(before, F.array(F.struct(last["text"].alias("text"), last["clarifier"].alias("clarifier"), F.concat(last["notes"], F.array(text)).alias("notes"))))
        kind = F.coalesce(p["type"], F.lit(""))
        return F.when(text == "", acc).when((kind == "translation") | (F.size(acc) == 0), new).when(kind == "semanticClarifier", clarified).otherwise(noted)

    return F.aggregate(parts, F.array().cast(f"array<{TRANSLATION}>"), step)


def translation_text(t: Column) -> Column:
    return F.concat(t["text"], F.coalesce(F.concat(F.lit(" ["), _filled(t["clarifier"]), F.lit("]")), F.lit("")), F.when(F.size(t["notes"]) > 0, F.concat(F.lit(" ("), F.array_join(t["notes"], "; "), F.lit(")"))).otherwise(""))


def strings(raw: Column) -> Column:
    """A field that may be one string or a list of them."""
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))


def extras(raw: Column) -> Column:
    """L-07. Unknown keys of a meaning with a scalar, or a list of strings, as a map."""
    all_ = F.from_json(raw, "map<string,string>")
    kept = F.map_filter(all_, lambda k, v: ~k.isin(*KNOWN_MEANING_KEYS) & v.isNotNull() & (v != "") & ~v.startswith("{") & (v != "[]") & (~v.startswith("[") | v.startswith('["')))
    return F.transform_values(kept, lambda k, v: F.when(v.startswith('["'), F.array_join(F.from_json(v, "array<string>"), ", ")).otherwise(v))


def meaning(raw: Column, at: Column) -> Column:
    """L-08, A-13."""
    m = F.from_json(raw, MEANING)
    examples = F.coalesce(F.transform(m["examples"], example), F.array().cast("array<struct<text: string, gloss: string, labels: array<string>, audio: string>>"))
    known = F.map_filter(m["targetLanguages"], lambda k, v: k.isin(*LANGUAGES) & v.isNotNull())
    return F.struct(
        F.coalesce(m["meaningID"], F.lit("")).alias("id"), F.coalesce(m["number"], at + 1).alias("number"), F.coalesce(F.transform_values(known, lambda k, v: translations(v["parts"])), F.create_map().cast(f"map<string, array<{TRANSLATION}>>")).alias("translations"),
        F.coalesce(F.filter(F.transform(m["inflection"]["forms"], lambda f: f["content"]), lambda f: f != ""), F.array().cast("array<string>")).alias("forms"),
        examples.alias("examples"), F.size(examples).alias("example_count"), extras(raw).alias("extra"),
    )


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("lemma", T.StringType()), T.StructField("id", T.StringType())])))
def _links(trees: pd.Series) -> pd.Series:
    def one(raw: str | None) -> list:
        out, seen = [], set()

        def visit(node) -> None:
            if isinstance(node, dict):
                if node.get("tag") == "internalLink" and isinstance(node.get("content"), str) and isinstance(node.get("idRef"), str) and node["idRef"] not in seen:
                    seen.add(node["idRef"])
                    out.append({"lemma": node["content"], "id": node["idRef"]})
                node = list(node.values())
            if isinstance(node, list):
                for x in node:
                    visit(x)

        visit(json.loads(raw) if raw else None)
        return out

    return trees.map(one)


def read_hits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S-16, L-01, D11. Search responses, one JSON document a file: file, ord, and the hits in their order."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", SEARCH).alias("r"))
    return hits(raw.select("file", F.posexplode("r.results").alias("ord", "h")))


def hits(rows: DataFrame) -> DataFrame:
    """L-01. Normalised hits of rows with a raw hit h; hits without an id go."""
    h = F.col("h")
    key = F.coalesce(h["article_id"], h["id"])
    senses = F.transform(h["meanings"], lambda m: F.struct(F.coalesce(m["id"], F.lit("")).alias("id"), F.coalesce(m["number"], F.lit(0)).alias("number"), F.coalesce(m["translation"], F.lit("")).alias("translation"), _filled(m["secondaryHeadword"]).alias("secondary")))
    return rows.where(key.isNotNull()).select(
        *[c for c in rows.columns if c != "h"], key.alias("id"), F.coalesce(h["word_lb"], key).alias("lemma"), F.coalesce(h["pos"], F.lit("")).alias("pos"), part_of_speech(h["pos"]).alias("pos_label"),
        F.coalesce(F.filter(F.transform(h["matches"], tags_stripped), lambda m: m != ""), F.array().cast("array<string>")).alias("matched"), F.coalesce(h["erroneous"], F.lit(False)).alias("erroneous"),
        F.coalesce(h["sign_language"], F.lit(False)).alias("sign_language"), _filled(h["scientific_name"]).alias("scientific_name"), senses.alias("meanings"), F.concat(F.lit(URL), key).alias("url"),
    )


def read_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S-17, L-08, D12. Entry responses, one JSON document a file, normalised; tables stays JSON text."""
    e = spark.read.text(path, wholetext=True).select(F.from_json("value", ENTRY).alias("r")).select("r.entry.*").where("lod_id is not null")
    s = F.when(~F.coalesce(F.col("allSynonyms").startswith("["), F.lit(True)), F.from_json("allSynonyms", SYNONYMS))
    groups = F.transform(s["synonymGroups"], lambda g: F.struct(F.coalesce(g["fromTerms"], F.array().cast("array<string>")).alias("terms"), F.filter(F.transform(g["toSynonyms"], lambda x: x["syn"]), lambda x: x != "").alias("synonyms")))
    sections = F.transform("microStructures", lambda m: F.struct(
        F.coalesce(m["partOfSpeech"], F.col("partOfSpeech"), F.lit("")).alias("pos"), part_of_speech(F.coalesce(m["partOfSpeech"], F.col("partOfSpeech"))).alias("pos_label"), m["auxiliaryVerb"].alias("auxiliary"), strings(m["pastParticiple"]).alias("participles"),
        F.transform(m["grammaticalUnits"], lambda u: F.struct(strings(u["grammaticalInformation"]).alias("information"), F.transform(u["meanings"], lambda raw, i: meaning(raw, i)).alias("meanings"))).alias("units"),
    ))
    return e.select(
        F.col("lod_id").alias("id"), F.coalesce("lemma", "lod_id").alias("lemma"), F.coalesce("partOfSpeech", F.lit("")).alias("pos"), part_of_speech(F.col("partOfSpeech")).alias("pos_label"), _filled(F.col("ipa")).alias("ipa"), _filled(F.col("nRuleForm")).alias("n_form"),
        F.coalesce("trademark", F.lit(False)).alias("trademark"), F.coalesce("audioFiles.aac", "audioFiles.ogg").alias("audio"), _filled(F.col("audioString")).alias("audio_string"), F.concat(F.lit(URL), "lod_id").alias("url"), sections.alias("sections"),
        F.coalesce(F.filter(groups, lambda g: F.size(g["synonyms"]) > 0), F.array().cast("array<struct<terms: array<string>, synonyms: array<string>>>")).alias("synonyms"),
        F.coalesce(F.filter(F.transform(s["otherPotentialSynonyms"]["synonyms"], lambda x: x["syn"]), lambda x: x != ""), F.array().cast("array<string>")).alias("other_synonyms"),
        _links(F.col("infoboxes")).alias("see_also"), F.filter(F.transform("categories", lambda c: F.coalesce(c["label"], c["code"], F.lit(""))), lambda c: c != "").alias("categories"), "tables",
    )


def valid_id(text: Column) -> Column:
    """P-11."""
    return text.rlike(r"^\p{Lu}[\p{L}\p{N}_-]{0,63}$")


def resolve(words: DataFrame, all_hits: DataFrame, entries: DataFrame) -> DataFrame:
    """L-12, J-15. words: query. query, id, via (the lemma of the hit that led there), alternatives (at most five). all_hits: query_key (the query in small letters), ord, id, lemma."""
    q = words.select("query", X.trimmed(F.col("query")).alias("q")).select("query", "q", F.lower("q").alias("query_key"), F.upper("q").alias("as_id"))
    direct = q.where(valid_id(F.col("as_id")) & F.col("q").rlike("[0-9]$")).join(entries.select(F.col("id").alias("as_id")), "as_id", "left_semi").select("query", F.col("as_id").alias("id"), F.lit(None).cast("string").alias("via"), F.array().cast("array<string>").alias("alternatives"))
    rest = q.join(direct.select("query"), "query", "left_anti").join(all_hits.select("query_key", "ord", "id", "lemma"), "query_key")
    order = Window.partitionBy("query").orderBy((F.lower("lemma") != F.col("query_key")).cast("int"), "ord")
    ranked = rest.withColumn("n", F.row_number().over(order))
    best = ranked.where("n = 1").select("query", "id", F.col("lemma").alias("via"))
    others = ranked.join(best.select("query", F.col("id").alias("best")), "query").where("id <> best").groupBy("query").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "id"))), 1, 5), lambda x: x["id"]).alias("alternatives"))
    found = best.join(others, "query", "left").select("query", "id", "via", F.coalesce("alternatives", F.array().cast("array<string>")).alias("alternatives"))
    return direct.unionByName(found)


def gender(pos: Column) -> Column:
    return _filled(F.regexp_extract(pos, "\\+([MFN])\\b", 1))


def noun_table(all_hits: DataFrame) -> DataFrame:
    """J-03, A-07, P-12. form, lemma, gender, is_lemma: what check_articles needs, from hits with their query. A lemma's gender counts if it has one only; an inflected form counts if one hit has it."""
    good = all_hits.where(F.col("pos").startswith("SUBST") & ~F.col("erroneous")).withColumn("g", gender(F.col("pos")))
    exact = good.where("lemma = query").groupBy("query").agg(F.when(F.size(F.collect_set(F.coalesce("g", F.lit("?")))) == 1, F.max("g")).alias("gender"))
    exact = exact.select(F.col("query").alias("form"), F.col("query").alias("lemma"), "gender", F.lit(True).alias("is_lemma"))
    other = good.join(exact.select(F.col("form").alias("query")), "query", "left_anti").where(F.exists("matched", lambda m: F.lower(m) == F.lower("query")))
    other = other.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.first("lemma").alias("lemma"), F.first("g").alias("gender")).where("n = 1")
    return exact.unionByName(other.select(F.col("query").alias("form"), "lemma", "gender", F.lit(False).alias("is_lemma")))


def participle_table(all_hits: DataFrame, entries: DataFrame) -> DataFrame:
    """J-04, A-08. form, lemma, aux: of the first verb that a form belongs to (single words before phrases), if the form is its past participle."""
    good = all_hits.where((F.col("pos") == "VRB") & ~F.col("erroneous") & F.exists("matched", lambda m: F.lower(m) == F.lower("query")))
    order = Window.partitionBy("query").orderBy(F.col("lemma").contains(" ").cast("int"), "ord")
    first = good.withColumn("n", F.row_number().over(order)).where("n = 1").select(F.lower("query").alias("form"), "id")
    table = F.from_json(F.get_json_object("tables", "$.verbConjugation"), "pastParticiple string, auxiliaryVerb string")
    split = lambda c: F.transform(F.split(F.lower(c), "[/,]| an | oder "), X.trimmed)
    empty = F.array().cast("array<string>")
    known = entries.select("id", "lemma", F.concat(F.transform(F.flatten(F.transform("sections", lambda s: s["participles"])), F.lower), F.coalesce(split(table["pastParticiple"]), empty)).alias("parts"), F.concat(F.flatten(F.transform("sections", lambda s: F.coalesce(split(s["auxiliary"]), empty))), F.coalesce(split(table["auxiliaryVerb"]), empty)).alias("auxes"))
    hunn, sinn = F.array_contains("auxes", "hunn"), F.array_contains("auxes", "sinn")
    aux = F.when(hunn & sinn, "both").when(hunn, "hunn").when(sinn, "sinn")
    return first.join(known, "id").where(F.array_contains("parts", F.col("form")) & aux.isNotNull()).select("form", "lemma", aux.alias("aux"))


def n_form_table(all_hits: DataFrame, entries: DataFrame) -> DataFrame:
    """J-05. form, n_form (null where the lemma has none): of the first faultless hit whose lemma is the word."""
    order = Window.partitionBy("query").orderBy("ord")
    first = all_hits.where(~F.col("erroneous") & (F.lower("lemma") == F.lower("query"))).withColumn("n", F.row_number().over(order)).where("n = 1").select(F.col("query").alias("form"), "id")
    return first.join(entries.select("id", "n_form"), "id").select("form", "n_form")


def german_hits(all_hits: DataFrame, most: int = 4) -> DataFrame:
    """G-06, T-05, A-11. german, lemma, pos, sense, ord: the best translations of German queries; single words and exact senses first."""
    q = F.lower("query")
    # A sense fits if it has the word between non-letters; without any, the first sense stands for the hit.
    fits = F.filter("meanings", lambda m: F.array_contains(F.split(F.lower(m["translation"]), r"[^\p{L}]+"), q))
    sense = F.coalesce(F.try_element_at(fits, F.lit(1))["translation"], F.try_element_at("meanings", F.lit(1))["translation"], F.lit(""))
    rows = all_hits.where(~F.col("erroneous")).select(F.col("query").alias("german"), "lemma", F.col("pos_label").alias("pos"), sense.alias("sense"), F.col("ord").alias("at"))
    exact = F.lower(X.trimmed(F.regexp_replace("sense", r"\s*\[.*?\]\s*", ""))) == F.lower("german")
    score = F.when(~F.col("lemma").contains(" "), 2).otherwise(0) + F.when(exact, 3).otherwise(0)
    order = Window.partitionBy("german").orderBy(score.desc(), "at")
    return rows.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= most).select("german", "lemma", "pos", "sense", "ord")


def verb_table(entries: DataFrame) -> DataFrame:
    """L-09. id, mood, tense, and a column for each person."""
    moods = entries.select("id", F.explode(F.from_json(F.get_json_object("tables", "$.verbConjugation"), "map<string,string>")).alias("mood", "raw")).where(F.col("raw").startswith("{") & (F.col("mood") != "@attributes"))
    tenses = moods.select("id", "mood", F.explode(F.from_json("raw", "map<string,string>")).alias("tense", "forms")).where(F.col("forms").startswith("{"))
    persons = tenses.select("id", "mood", "tense", F.from_json("forms", "map<string,string>").alias("f"))
    return persons.select("id", "mood", "tense", *[F.col("f")[p].alias(p) for p in PERSONS])


def adjective_table(entries: DataFrame) -> DataFrame:
    """L-10. id, degree, number, gender, and a column for each case."""
    step = lambda df, name, of: df.select(*[c for c in df.columns if c != of], F.explode(F.from_json(of, "map<string,string>")).alias(name, "raw")).where(F.col("raw").startswith("{"))
    rows = entries.select("id", F.get_json_object("tables", "$.adjDeclension.declension").alias("raw"))
    for name in ("degree", "number", "gender"):
        rows = step(rows, name, "raw")
    forms = F.from_json("raw", "map<string,string>")
    return rows.select("id", "degree", "number", "gender", *[forms[c].alias(c) for c in CASES])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])))
def _leaves(trees: pd.Series) -> pd.Series:
    def one(raw: str | None) -> list:
        out = []

        def visit(node, path: str) -> None:
            if isinstance(node, dict):
                for k, v in node.items():
                    if k != "@attributes":
                        visit(v, f"{path}.{k}" if path else k)
            else:
                out.append({"path": path, "value": ", ".join(map(str, node)) if isinstance(node, list) else str(node)})

        if raw:
            visit(json.loads(raw), "")
        return out

    return trees.map(one)


def generic_table(entries: DataFrame) -> DataFrame:
    """L-11. id, path, value: every leaf of an entry's tables, whatever their kind."""
    return entries.select("id", F.explode(_leaves(F.col("tables"))).alias("x")).select("id", "x.path", "x.value")


def listed_forms(entries: DataFrame) -> DataFrame:
    """A-12, K-04. id, forms: the distinct forms that an entry lists, and its participles; what stands in where it has no table."""
    units = F.flatten(F.transform("sections", lambda s: s["units"]))
    forms = F.flatten(F.transform(F.flatten(F.transform(units, lambda u: u["meanings"])), lambda m: m["forms"]))
    return entries.select("id", F.array_distinct(forms).alias("forms"), F.flatten(F.transform("sections", lambda s: s["participles"])).alias("participles"))


def trimmed_entry(entries: DataFrame, languages: tuple[str, ...] = LANGUAGES, examples: int = 3) -> DataFrame:
    """P-14, W-09. id, number, translations (text by language), examples: the meanings of entries as the lookup shows them."""
    m = entries.select("id", "lemma", F.explode(F.flatten(F.transform(F.flatten(F.transform("sections", lambda s: s["units"])), lambda u: u["meanings"]))).alias("m"))
    said = F.transform_values(F.map_filter("m.translations", lambda k, v: k.isin(*languages)), lambda k, v: F.array_join(F.transform(v, translation_text), "; "))
    return m.select("id", "lemma", F.col("m.number").alias("number"), said.alias("translations"), F.slice("m.examples", 1, examples).alias("examples") if examples else F.array().alias("examples"), F.col("m.example_count").alias("example_count"))


def rendered_hits(all_hits: DataFrame, limit: int = 10) -> DataFrame:
    """K-02. query, markdown: a line a hit, and a line for each of its first six meanings."""
    odd = F.filter("matched", lambda f: F.lower(f) != F.lower("lemma"))
    line = F.concat(
        F.format_string("- **%s** — %s — id `%s`", F.col("lemma"), F.coalesce(_filled(F.col("pos_label")), F.col("pos")), F.col("id")), F.coalesce(F.concat(F.lit(" — *"), F.col("scientific_name"), F.lit("*")), F.lit("")),
        F.when(F.col("erroneous"), " — ⚠ a known *erroneous* spelling").otherwise(""), F.when(F.size(odd) > 0, F.concat(F.lit(" — matched form: "), F.array_join("matched", ", "))).otherwise(""),
    )
    senses = F.transform(F.slice("meanings", 1, 6), lambda m: F.concat(F.lit("  - "), F.when(m["number"] != 0, F.concat(m["number"].cast("string"), F.lit(". "))).otherwise(""), m["translation"], F.coalesce(F.concat(F.lit(" ("), m["secondary"], F.lit(")")), F.lit(""))))
    block = F.array_join(F.concat(F.array(line), F.coalesce(senses, F.array().cast("array<string>"))), "\n")
    ranked = all_hits.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("ord"))).where(F.col("n") <= limit)
    return ranked.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n").alias("markdown"))


def rendered_entries(entries: DataFrame, languages: tuple[str, ...] = LANGUAGES, examples: int = 3) -> DataFrame:
    """K-03. id, markdown."""
    empty = F.array().cast("array<string>")

    def shown_meaning(m: Column) -> Column:
        told = [F.when(F.size(m["translations"][k]) > 0, F.concat(F.lit(f"- {k.upper()}: "), F.array_join(F.transform(m["translations"][k], translation_text), "; "))) for k in languages]
        forms = F.when(F.size(m["forms"]) > 0, F.concat(F.lit("- Forms listed: "), F.array_join(m["forms"], ", ")))
        more = F.transform(F.map_entries(m["extra"]), lambda x: F.concat(F.lit("- "), x["key"], F.lit(": "), x["value"]))
        said = F.transform(F.slice(m["examples"], 1, max(1, examples)), lambda e: F.concat(F.lit("  - "), F.when(F.size(e["labels"]) > 0, F.concat(F.lit("["), F.array_join(e["labels"], ", "), F.lit("] "))).otherwise(""), e["text"], F.coalesce(F.concat(F.lit(" — *"), e["gloss"], F.lit("*")), F.lit(""))))
        count = F.when(m["example_count"] > 0, F.lit("- Examples:") if examples else F.format_string("- %d example(s) available", m["example_count"]))
        lines = F.concat(F.array(F.format_string("**%d.**", m["number"]), *told, forms), F.coalesce(more, empty), F.array(count), said if examples else empty)
        return F.filter(lines, lambda x: x.isNotNull())

    units = F.flatten(F.transform("sections", lambda s: s["units"]))
    meanings = F.flatten(F.transform(F.flatten(F.transform(units, lambda u: u["meanings"])), shown_meaning))
    head = F.array(
        F.format_string("# %s  (%s)", F.col("lemma"), F.coalesce(_filled(F.col("pos_label")), F.col("pos"))),
        F.concat_ws(" · ", F.format_string("id: `%s`", "id"), F.concat(F.lit("IPA: /"), F.col("ipa"), F.lit("/")), F.concat(F.lit("n-rule form: **"), F.col("n_form"), F.lit("**")), F.when(F.col("trademark"), "trademark")),
        F.concat(F.lit("Audio: "), F.col("audio")), F.concat(F.lit("Link: "), F.col("url")),
    )
    gram = F.flatten(F.transform("sections", lambda s: F.array(F.concat(F.lit("auxiliary: "), s["auxiliary"]), F.when(F.size(s["participles"]) > 0, F.concat(F.lit("past participle: "), F.array_join(s["participles"], " / "))))))
    rest = F.concat(
        F.transform("synonyms", lambda g: F.concat(F.lit("Synonyms: "), F.array_join(g["synonyms"], ", "))), F.array(F.when(F.size("other_synonyms") > 0, F.concat(F.lit("Other possible synonyms: "), F.array_join("other_synonyms", ", ")))),
        F.array(F.when(F.size("see_also") > 0, F.concat(F.lit("Related: "), F.array_join(F.transform(F.slice("see_also", 1, 30), lambda x: F.format_string("%s (`%s`)", x["lemma"], x["id"])), ", ")))), F.array(F.when(F.size("categories") > 0, F.concat(F.lit("Categories: "), F.array_join("categories", "; ")))),
    )
    return entries.select("id", F.array_join(F.filter(F.concat(head, gram, meanings, rest), lambda x: x.isNotNull()), "\n").alias("markdown"))


# The names of moods and tenses.
MOODS = dict(indicative="Indicative", conditional="Conditional (Konjunktiv II)", imperative="Imperative", subjunctive="Subjunctive")
TENSES = dict(present="present", presentSimple="present", pastSimple="simple past (Imperfekt)", presentPerfect="perfect", pastPerfect="pluperfect")
CONDITIONAL = dict(presentPerfect="periphrastic (géif/géing + inf.)", presentSimple="synthetic")


def _named(table: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], key)


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def _rule(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda _: F.lit("---")), " | "), F.lit(" |"))


def _pivoted(rows: DataFrame, keys: tuple[str, ...], title: Column) -> DataFrame:
    """rows: id, group, ord, label, cells (a map). id, block: a table a group, its columns in order of ord, its rows the keys that any column has."""
    per = rows.groupBy("id", "group").agg(F.array_sort(F.collect_list(F.struct("ord", "label", "cells")), lambda x, y: (x["ord"] - y["ord"]).cast("int")).alias("c"))
    used = F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: F.exists("c", lambda x: x["cells"][k].isNotNull()))
    header = F.concat(F.array(F.lit("")), F.transform("c", lambda x: x["label"]))
    lines = F.transform(used, lambda k: _row(F.concat(F.array(_named(PERSONS, k)), F.transform("c", lambda x: F.coalesce(x["cells"][k], F.lit("–"))))))
    return per.select("id", "group", F.concat(F.lit("### "), title, F.lit("\n"), F.array_join(F.concat(F.array(_row(header), _rule(header)), lines), "\n")).alias("block"))


def rendered_inflection(entries: DataFrame) -> DataFrame:
    """K-04. id, markdown: conjugation and declension as tables, any other table as a list of its leaves, or else the forms that the entry lists."""
    verbs = verb_table(entries)
    label = F.when(F.col("mood") == "conditional", _named(CONDITIONAL, F.col("tense"))).otherwise(_named(TENSES, F.col("tense")))
    cells = F.map_from_arrays(F.array(*[F.lit(p) for p in PERSONS]), F.array(*PERSONS))
    verbs = verbs.withColumn("ord", F.row_number().over(Window.partitionBy("id").orderBy(F.monotonically_increasing_id()))).select("id", F.col("mood").alias("group"), "ord", label.alias("label"), cells.alias("cells"))
    adjectives = adjective_table(entries)
    named = F.when(F.col("gender") == "masculineFeminineNeutral", "all genders").when(F.col("gender") == "neutral", "neuter").otherwise(F.col("gender"))
    cases = F.map_from_arrays(F.array(*[F.lit(c) for c in CASES]), F.array(*CASES))
    adjectives = adjectives.withColumn("ord", F.row_number().over(Window.partitionBy("id").orderBy(F.monotonically_increasing_id()))).select("id", F.col("degree").alias("group"), "ord", F.concat(F.when(F.col("number") == "plural", "pl. ").otherwise("sg. "), named).alias("label"), cases.alias("cells"))
    tables = _pivoted(verbs, tuple(PERSONS), _named(MOODS, F.col("group"))).unionByName(_pivoted(adjectives, CASES, F.col("group")))
    tables = tables.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", "block"))), lambda x: x["block"]), "\n\n").alias("tables"))
    leaves = generic_table(entries).where(~F.col("path").startswith("verbConjugation") & ~F.col("path").startswith("adjDeclension.declension"))
    leaves = leaves.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "path", F.lit(": "), "value"))), "\n").alias("leaves"))
    conjugation = F.from_json(F.get_json_object("tables", "$.verbConjugation"), "infinitive string, pastParticiple string, auxiliaryVerb string")
    head = F.concat_ws(" · ", F.concat(F.lit("infinitive: "), conjugation["infinitive"]), F.concat(F.lit("past participle: "), conjugation["pastParticiple"]), F.concat(F.lit("auxiliary: "), conjugation["auxiliaryVerb"]))
    own = entries.select("id", "lemma", "pos_label", "n_form", head.alias("head")).join(listed_forms(entries), "id").join(tables, "id", "left").join(leaves, "id", "left")
    listed = F.when(F.col("tables").isNull() & F.col("leaves").isNull(), F.concat_ws("\n", F.when(F.size("forms") > 0, F.concat(F.lit("- "), F.array_join("forms", ", "))), F.when(F.size("participles") > 0, F.concat(F.lit("- past participle: "), F.array_join("participles", " / "))), F.when((F.size("forms") == 0) & (F.size("participles") == 0), "No inflection data for this entry.")))
    n_form = F.concat(F.lit("n-rule form: **"), F.col("n_form"), F.lit("**"))
    return own.select("id", F.concat_ws("\n", F.format_string("# Inflection: %s (%s) — `%s`", "lemma", "pos_label", "id"), n_form, F.when(F.col("head") != "", F.col("head")), "tables", "leaves", listed).alias("markdown"))


def dictionary_search(all_hits: DataFrame, query: str, lang: str = "lb", limit: int = 10) -> DataFrame:
    """C-06. all_hits: query_key (small letters), lang, ord and the columns of hits. The first hits of a query, in their order; a blank query has none."""
    if not (1 <= len(query) <= 100 and 1 <= limit <= 50 and lang in ("lb", *LANGUAGES)):
        raise ValueError("a query has 1 to 100 characters, a list 1 to 50 hits, a language is lb, de, fr, en or pt")
    return all_hits.where((F.col("query_key") == query.strip().lower()) & (F.col("lang") == lang)).orderBy("ord").limit(limit)


def dictionary_entry(words: DataFrame, all_hits: DataFrame, entries: DataFrame, languages: tuple[str, ...] = LANGUAGES, include_examples: bool = True, max_examples: int = 3) -> DataFrame:
    """C-07. words: query. The meanings of the entry that each word or id leads to."""
    found = resolve(words, all_hits, entries)
    return found.join(trimmed_entry(entries, languages, max_examples if include_examples else 0), "id")


def inflection(words: DataFrame, all_hits: DataFrame, entries: DataFrame) -> DataFrame:
    """C-08. words: query. query, id, markdown of the entry that each word or id leads to."""
    return resolve(words, all_hits, entries).select("query", "id").join(rendered_inflection(entries), "id")
