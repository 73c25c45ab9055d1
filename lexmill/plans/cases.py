"""Queries over constructed sentences and documents, and the SQL that each must agree with.

The tables hold no text of the language that the checks are for. So the rows of a table are dealt sentences, in turn by their key, and what every check must say of each
sentence is stated in SQL, as plain values joined to the same rows. Dictionary documents, corpora and rule books are made of the rows of nation, written to the
shared folder, and read again by the readers.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import compose, grammar, lexicon, nrule, orthography, rules, search, spelling
from ..operators.tokens import neighbours, tokenize, words
from ..session import shared_folder
from ..sources import corpus, hunspell, lists, lookup
from .catalogue import _table, query


def _quoted(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def dealt(spark: SparkSession, d: str, texts: list[str]) -> DataFrame:
    """The texts as documents of the rows of part, in turn: doc_id, text."""
    return _table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % len(texts) + 1).cast("int")).alias("text"))


def dealt_sql(cases: dict[str, list[tuple]], columns: str) -> str:
    """What dealt() documents must give: for each text its rows of the named columns."""
    rows = ", ".join(f"({k}, {', '.join(map(_quoted, row))})" for k, want in enumerate(cases.values()) for row in want)
    return f"SELECT p_partkey AS doc_id, {columns} FROM part JOIN (VALUES {rows}) AS v(k, {columns}) ON p_partkey % {len(cases)} = v.k"


def _listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# Orthography: of each sentence what is found: rule, text, its place, the suggestion, and how sure it is.
_O = "rule, text, start, suggestion, confidence"


def _check(name: str, check: str, cases: dict[str, list[tuple]]) -> None:
    def found(spark: SparkSession, d: str) -> DataFrame:
        return orthography.check_orthography(dealt(spark, d, list(cases)), [check]).select("doc_id", "rule", "text", "start", "suggestion", "confidence")

    placed = {s: [(rule, text, s.index(text) if at is None else at, new, sure) for rule, text, at, new, sure in want] for s, want in cases.items()}
    query(name, dealt_sql(placed, _O))(found)


_check("o01_marks", "punct-space", {
    "Wéi geet et ?": [("10.2.3", " ?", None, "?", "high")], "Komm ! Wat: alles ; gutt": [("10.2.2", " !", None, "!", "high"), ("10.3.3", " ;", None, ";", "high")],
    "Ech soen : nee": [("10.3.4", " :", None, ":", "high")], "Um 10 :30 Auer": [], "Wéi geet et?": [],
})
_check("o02_abbreviation", "abbreviation", {"Dat ass z.B. gutt.": [("8.5.1", "z.B.", None, "z. B.", "high")], "Dat ass z. B. gutt, asw.": [], "Hei d.h. do a u.a. och": [("8.5.1", "d.h.", None, "d. h.", "high"), ("8.5.1", "u.a.", None, "u. a.", "high")]})
_check("o03_units", "unit-space", {"Et sinn 10% méi.": [("8.5.1", "10%", None, "10 %", "high")], "Et kascht 3,5€ oder 2 kg": [("8.5.1", "3,5€", None, "3,5 €", "high")], "A4 an 12 km": [], "No 5km an 7cm": [("8.5.1", "5km", None, "5 km", "high"), ("8.5.1", "7cm", None, "7 cm", "high")]})
_check("o04_weekdays", "capitalisation", {"Mir gesinn eis de méindeg.": [("8.3", "méindeg", None, "Méindeg", "high")], "Mir gesinn eis de Méindeg.": [], "bis freideg oder samschdeg": [("8.3", "freideg", None, "Freideg", "high"), ("8.3", "samschdeg", None, "Samschdeg", "high")]})
_check("o05_adverbs", "capitalisation", {"Mir gi Sonndes spadséieren.": [("8.3", "Sonndes", None, "sonndes", "high")], "Sonndes gi mir spadséieren.": [], "Hie koum Gëschter heem": [("8.3", "Gëschter", None, "gëschter", "medium")]})
_check("o06_times_of_day", "capitalisation", {"Mir kommen gëschter mueren": [("8.3", "mueren", None, "Mueren", "high")], "Mir kommen gëschter Owend": [], "hie koum virgëschter nuecht": [("8.3", "nuecht", None, "Nuecht", "high")]})
_check("o07_e_before_ch", "e-accent", {"hie mëcht dat": [("2.2.3", "mëcht", None, "mécht", "high")], "hie mécht dat": [], "lëng an Dëngen": [("2.2.3", "lëng", None, "léng", "high"), ("2.2.3", "Dëngen", None, "Déngen", "high")]})
_check("o08_e_before_sch", "e-accent", {"eng Tésch": [("2.2.3", "Tésch", None, "Tësch", "high")], "eng Tësch": [], "Fésch a Késcht": [("2.2.3", "Fésch", None, "Fësch", "high"), ("2.2.3", "Késcht", None, "Këscht", "high")]})
_check("o09_sharp_s", "eszett", {"eng grouße Strooße": [("4.3.4.2", "grouße", None, "grousse", "high"), ("4.3.4.2", "Strooße", None, "Stroosse", "high")], "eng grouss Strooss": []})
_check("o10_accent_sign", "apostrophe", {"d´Haus": [("2.3.3", "d´H", None, "d’H", "high")], "op d`Plaz": [("2.3.3", "d`P", None, "d’P", "high")], "d'Haus": []})
_check("o11_space_after_article", "apostrophe", {"d' Haus": [("10.5.1", "d' Haus", None, "d'Haus", "high")], "op d’ Gaass": [("10.5.1", "d’ Gaass", None, "d’Gaass", "high")], "d'Haus": []})
_check("o12_first_apostrophe", "apostrophe", {"'T ass kal": [("8.7.5", "'T", None, "'t", "high")], "Jo. ’T reent": [("8.7.5", "’T", None, "’t", "high")], "'t ass kal": []})
_check("o13_ze", "apostrophe", {"z'entdecken": [("2.3.3", "z'entdecken", None, "ze entdecken", "low")], "z'iessen": [], "eppes z’erzielen": [("2.3.3", "z’erzielen", None, "ze erzielen", "low")]})
_check("o14_linking_s", "linking-s", {"Wanns de wëlls": [("4.4.1", "Wanns de", None, "Wann s de", "high")], "Wann s de wëlls": [], "ech weess obs du kënns": [("4.4.1", "obs du", None, "ob s du", "high")]})
_check("o15_dashes", "dash", {"Hien huet gesot - dat stëmmt.": [("10.3.5", " - ", None, " – ", "medium")], "10 - 12 Deeg": [], "eent, - zwee - dräi": [("10.3.5", " - ", 5, " – ", "medium"), ("10.3.5", " - ", 12, " – ", "medium")]})
_check("o16_quotations", "quotes", {'hie sot "jo" haut': [("10.4.1", '"jo"', None, "„jo“", "low")], "hie sot „jo“ haut": [], "hie sot « nee » haut": [("10.4.1", "« nee »", None, "„nee“", "low")]})
_check("o17_commas", "comma", {"Ech mengen datt et reent.": [("10.3.1.3", "mengen datt", None, "mengen, datt", "medium")], "Ech mengen, datt et reent.": [], "Egal ob et reent, awer well": [], "Si kënnt  well et reent": [("10.3.1.3", "kënnt well", 3, "kënnt, well", "medium")]})
_check("o18_sentence_starts", "capitalisation", {"Dat ass richteg. et geet.": [("8.7.5", "et", None, "Et", "medium")], "Dat ass z. b. richteg.": [], "Komm! sot hien.": [], "Wierklech? jo": [("8.7.5", "jo", None, "Jo", "medium")]})

_ALL_CHECKS = {
    "Wéi geet et ?": [("punct-space", "?")], "Dat ass z.B. gutt.": [("abbreviation", "z. B.")], "eng grouße Strooße": [("eszett", "grousse"), ("eszett", "Stroosse")], "gëschter mueren": [("capitalisation", "Mueren")],
    "Ech mengen, datt et reent. Mir gi sonndes moies spadséieren, z. B. mat 10 % manner. Wéi geet et? Egal ob et reent.": [], "Hien huet gesot - dat 10% méi datt": [("dash", " – "), ("unit-space", "10 %"), ("comma", "méi, datt")],
}


@query("o19_all_checks", dealt_sql(_ALL_CHECKS, "check_id, suggestion"))
def o19_all(spark, d):
    """O-19, W-07: all checks together, one finding for each place and check."""
    return compose.first_at(orthography.check_orthography(dealt(spark, d, list(_ALL_CHECKS)))).select("doc_id", F.col("check").alias("check_id"), "suggestion")


_HINTS = {"Straße": [("4.3.4.2",)], "fahren": [("4.3.1",)], "fahrt": [("4.3.1",)], "Photo": [("4.3.6.2",)], "mëcht": [("2.2.3",)], "Wieder": [("1.2.3",)], "Haus": []}


@query("h13_rule_hints", dealt_sql(_HINTS, "rule"))
def h13(spark, d):
    unknown = dealt(spark, d, list(_HINTS)).withColumnRenamed("text", "word").withColumn("suggestions", F.array().cast("array<string>"))
    return orthography.rule_hints(unknown).select("doc_id", F.explode("hints.rule").alias("rule"))


# The n-rule. Fixed words of the language.
_WORDS = "den de Mann Ball mir maachen maache Kaffi Apel Hond Direkter dat en Zuch ech kommen komme wann ass midd Zwee Phasen Phase Modell Haus schéin Geschicht eng Phas Ech hunn hu Saach Been doheem Gäert Kichen".split()
_N = "word, start, suggestion, direction, confidence, rule"


def _n_cases(name: str, cases: dict[str, list[tuple]], direction: str | None, forms: list[tuple] | None = None, doc: str = "") -> None:
    def found(spark: SparkSession, d: str) -> DataFrame:
        n_forms = None if forms is None else _listed(spark, forms, "form string, n_form string")
        rows = nrule.check_n_rule(tokenize(dealt(spark, d, list(cases))), _listed(spark, [(w,) for w in _WORDS], "form string"), n_forms)
        rows = rows if direction is None else rows.where(F.col("direction") == direction)
        return rows.select("doc_id", "word", "start", "suggestion", "direction", "confidence", "rule")

    placed = {s: [(word, s.index(word) if at is None else at, new, way, sure, rule) for word, at, new, way, sure, rule in want] for s, want in cases.items()}
    query(name, dealt_sql(placed, _N))(found)


_n_cases("n04_not_subject", {
    "si ass midd": [], "hunn si, vun senger Plaz": [], "e Steen geheien": [], "Frënn gesinn, eng ronn Saach": [], "zu Wien raschten": [], "Ech verkafen en (kaum benotzten) Computer.": [], "den Mann": [("den", None, "de", "drop-n", "high", "6.1.1")],
}, None)
_n_cases("n05_falling_n", {
    "den Mann": [("den", None, "de", "drop-n", "high", "6.1.1")], "Den Mann": [("Den", None, "De", "drop-n", "high", "6.1.1")], "mir maachen Kaffi": [("maachen", None, "maache", "drop-n", "medium", "6.1.1")], "den 5. Abrëll": [("den", None, "de", "drop-n", "high", "6.1.1")],
    "den Journal": [("den", None, "de", "drop-n", "high", "6.1.1")], "den Apel, den Hond, den Direkter, mir maachen dat, en Zuch": [], "eng schéin Geschicht": [("schéin", None, "schéi", "drop-n", "high", "6.1.1")],
}, "drop-n")
_n_cases("n06_missing_n", {
    "de Apel": [("de", None, "den", "add-n", "medium", "6.1.1")], "Kaffi a Uebst": [("a", 6, "an", "add-n", "high", "6.1.1")], "wa ech kommen": [("wa", None, "wann", "add-n", "high", "6.1.1")], "Ech hu.": [("hu", None, "hunn", "add-n", "high", "6.1.2.4")],
    "och wann s de näischt matbréngs.": [], "de Wäin gëtt gedronk, e Wäi schmaacht": [],
}, "add-n")
_n_cases("n07_compounds", {"en Zwee-Phasen-Modell": [("Phasen", None, "Phase", "drop-n", "medium", "6.1.2.5")], "en Zwee-Phase-Modell": []}, None)
_n_cases("n08_with_lexicon", {"de Mann kacht an der Kichen gären": [("Kichen", None, "Kiche", "drop-n", "high", "6.1.1")], "an der Kichen ass et": []}, None, [("Kichen", "Kiche"), ("Mann", None)])

_CONTEXTS = {"Apel": "keep", "Mann": "drop", "Hond": "keep", "d'Kanner": "keep", "LCTO-Programm": "keep", "BMW": "drop", "Job": "keep", "Journal": "drop", "Chartervol": "keep", "Chef": "drop", "Centime": "optional", "si": "optional", "s": "optional", "yoga": "unknown", "Uni": "keep", "Union": "optional", "5": "drop", "8": "keep", ".": "keep", "-": "unknown", "/": "keep", "14": "drop"}


@query("n03_token_contexts", dealt_sql({t: [(c,)] for t, c in _CONTEXTS.items()}, "context"))
def n03(spark, d):
    kind = F.when(F.col("text").rlike("^[0-9]"), "number").when(F.col("text").rlike(r"^\p{L}"), "word").otherwise("punct")
    return dealt(spark, d, list(_CONTEXTS)).select("doc_id", nrule.token_context(kind, F.col("text"))["ctx"].alias("context"))


_FORMS = {"Mann": "de", "Apel": "den", "Haus": "den", "Kaffi": "de", "Zuch": "den"}


@query("g07_n_forms", dealt_sql({t: [(f,)] for t, f in _FORMS.items()}, "form"))
def g07(spark, d):
    return dealt(spark, d, list(_FORMS)).select("doc_id", nrule.n_form(F.lit("den"), F.col("text")).alias("form"))


# Germanisms: a list, a reverse dictionary, and the shape of a participle.
_GERMAN = {"sehr": [("sehr", "ganz, immens, vill", "high")], "d'Wetter": [("d'Wetter", "d'Wieder", "high")], "getrunkt": [("getrunkt", "(look up)", "low")], "Baum": [("Baum", "Bam", "medium")], "zuch": []}
_LIST = [("sehr", "sehr", "ganz, immens, vill", ""), ("wetter", "Wetter", "Wieder", None)]


def _germanisms(spark: SparkSession, d: str, reverse: bool) -> DataFrame:
    unknown = dealt(spark, d, list(_GERMAN)).select("doc_id", F.col("text").alias("word"), F.lit(0).alias("start"), F.length("text").alias("end"))
    listed = _listed(spark, _LIST, "german_key string, german string, lb string, note string")
    table = _listed(spark, [("Baum", "Bam", "noun (masculine)", "Baum", 1)], "german string, lemma string, pos string, sense string, ord int")
    return grammar.germanisms(unknown, listed, table if reverse else None).select("doc_id", "text", "suggestion", "confidence")


@query("g01_germanisms", dealt_sql(_GERMAN, "text, suggestion, confidence"))
def g01(spark, d):
    """G-01, J-02: the list, then the reverse lookup, then the shape."""
    return _germanisms(spark, d, True)


@query("j01_germanisms_without_lookup", dealt_sql({k: [v for v in want if v[2] == "high"] for k, want in _GERMAN.items()}, "text, suggestion, confidence"))
def j01(spark, d):
    return _germanisms(spark, d, False)


_FIRST = {"sehr": [("ganz, immens, vill",)], "Haus": [("Hauss",)]}


@query("j01_list_first", dealt_sql(_FIRST, "suggestion"))
def j01_first(spark, d):
    """J-01 in the spell check: the list's words come before the speller's."""
    found = dealt(spark, d, list(_FIRST)).select("doc_id", F.col("text").alias("word"), F.lit(0).alias("start"), F.length("text").alias("end"), F.array(F.lit("Hauss")).alias("suggestions"))
    done = compose.german_first(found, _listed(spark, _LIST, "german_key string, german string, lb string, note string"), 3)
    return done.select("doc_id", F.array_join("suggestions", ", ").alias("suggestion"))


# Tokens and words.
_NEAR = {"Moien. An „Haus“ #Dag ech": [("Moien", ".", None, True, False, False), ("An", "Haus", None, True, False, True), ("Haus", "#", None, False, False, True), ("Dag", "ech", None, False, True, False), ("ech", None, "Dag", False, False, False)], "Jo": [("Jo", None, None, True, False, False)]}


@query("w02_neighbours", dealt_sql(_NEAR, "word, next_text, prev_word, initial, hashtag, quoted"))
def w02(spark, d):
    """W-01, W-02, W-03, W-08."""
    near = neighbours(tokenize(dealt(spark, d, list(_NEAR))))
    return near.select("doc_id", F.col("text").alias("word"), "next_text", "prev_word", "initial", "hashtag", "quoted")


_HEADS = {"mat der aler Fra do": [("der", "dative-f", "Fra", "mat")], "en Haus, de Bam": [("en", "indef", "Haus", None), ("de", "def", "Bam", None)], "d'Stad vun d'Leit": [("d'", "elided", "Stad", None), ("d'", "after-preposition", "Leit", "vun")], "wanns de Loscht hues": [], "de schéinen, Bam": []}


@query("w05_head_nouns", dealt_sql(_HEADS, "article, kind, noun, prep"))
def w05(spark, d):
    """W-05, J-06, G-08: articles with their nouns; a pronoun has none."""
    return grammar.article_jobs(words(tokenize(dealt(spark, d, list(_HEADS))))).select("doc_id", "article", "kind", "noun", F.col("prep.text").alias("prep"))


_CANDIDATES = {"Ech hunn gëschter e Kaffi gedronk.": [("hunn", "gedronk", 1)], "Ech weess, datt hien gaangen ass.": [("ass", "gaangen", 1)], "datt hien do gebaut ginn ass": [("ass", "ginn", 1), ("ass", "gebaut", 2)], "Moien": []}


@query("j07_participles_of_auxiliaries", dealt_sql(_CANDIDATES, "lower, participle, n"))
def j07(spark, d):
    """W-06, J-07."""
    return grammar.auxiliary_candidates(words(tokenize(dealt(spark, d, list(_CANDIDATES))))).select("doc_id", "lower", "participle", "n")


# Spelling.
_VALID = {"Haus": [(True,)], "d'Haus": [(True,)], "Hauss": [(False,)], "'t": [(True,)], "Zwee-Phasen-Modell": [(True,)], "Zwee-Qqq": [(False,)], "EU-Modell": [(True,)], "Haus'": [(True,)], "HAUS": [(True,)], "Maachen": [(True,)], "apel": [(False,)]}


@query("p08_valid_words", dealt_sql(_VALID, "valid"))
def p08_valid(spark, d):
    """P-08, J-17: forms as they stand, without clitics, by their parts, and capitalised or in capitals."""
    said = dealt(spark, d, list(_VALID)).withColumnRenamed("text", "word")
    judged = spelling.valid_words(said.select("word").distinct(), _listed(spark, [(w,) for w in _WORDS], "form string"))
    return said.join(judged, "word").select("doc_id", "valid")


_UNKNOWN = {"D'Hauss vum Mann, EU a x. Foobar": [("D'Hauss", "D'Haus"), ("Foobar", "")], "Kaffi an Apell": [("Apell", "Apel")], "an": []}


@query("h08_suggestions", dealt_sql(_UNKNOWN, "word, first"))
def h08(spark, d):
    """P-09, J-17, H-08: what a list doesn't have, but for words to ignore, with the nearest word of the list."""
    listed = _listed(spark, [(w,) for w in _WORDS], "form string")
    found = spelling.check_spelling(tokenize(dealt(spark, d, list(_UNKNOWN))), listed, ignore=["vum", "an"])
    return found.select("doc_id", "word", F.coalesce(F.try_element_at("suggestions", F.lit(1)), F.lit("")).alias("first"))


# Whole checks.
_DRAFTS = {
    "Ech hunn doheem bliwwen. Dat ass sehr Grouß.": [("grammar", "auxiliary", "hunn", "sinn"), ("grammar", "germanism", "sehr", "ganz"), ("orthography", "eszett", "Grouß", "Grouss")],
    "den Mann ?": [("n-rule", "drop-n", "den", "de"), ("orthography", "punct-space", " ?", "?")], "Mann": [],
}


def _language(spark: SparkSession) -> compose.Language:
    return compose.Language(
        _listed(spark, [(w,) for w in [*_WORDS, "Dat"]], "form string"), _listed(spark, [("sehr", "sehr", "ganz", "")], "german_key string, german string, lb string, note string"),
        _listed(spark, _NOUNS, "form string, lemma string, gender string, is_lemma boolean"), _listed(spark, _PARTICIPLES, "form string, lemma string, aux string"),
    )


@query("c02_drafts", dealt_sql(_DRAFTS, "family, check_id, text, suggestion"))
def c02(spark, d):
    """C-02, U-01, J-08 to J-11: all families; what one explains the others don't say again."""
    found = compose.draft_check(dealt(spark, d, list(_DRAFTS)), _language(spark), ignore=["bliwwen"], hide_germanisms=True)
    return compose.ordered(found.where("family <> 'spelling' or text <> 'Grouß'")).select("doc_id", "family", F.col("check").alias("check_id"), "text", "suggestion")


@query("c03_sure_n_rule", dealt_sql({"mir maachen Kaffi": [], "den Mann": [("den", "de")], "de Apel": []}, "word, suggestion"))
def c03(spark, d):
    found = compose.n_rule_check(dealt(spark, d, ["mir maachen Kaffi", "den Mann", "de Apel"]), _language(spark), min_confidence="high")
    return found.select("doc_id", "word", "suggestion")


_SPELLED = {"den Mann ass": [("n-rule", "den", "de")], "en Hauss !": [("spelling", "Hauss", "Haus"), ("orthography", " !", "!")], "Strooß": [("spelling", "Strooß", ""), ("orthography", "Strooß", "Strooss")]}


@query("c01_spelled", dealt_sql(_SPELLED, "family, text, suggestion"))
def c01_spelled(spark, d):
    """C-01, J-08: spelling, n-rule and orthography of sentences."""
    return compose.spell_check(dealt(spark, d, list(_SPELLED)), _language(spark), most=1).select("doc_id", "family", "text", "suggestion")


@query("a14_checks_by_confidence", "SELECT 'orthography' AS family, check_id, confidence, count(*) AS n FROM part JOIN (VALUES (0, 'punct-space', 'high'), (1, 'dash', 'medium'), (1, 'quotes', 'low')) AS v(k, check_id, confidence) ON p_partkey % 2 = v.k GROUP BY ALL")
def a14(spark, d):
    found = orthography.check_orthography(dealt(spark, d, ["gutt ?", 'eent - "zwee"'])).withColumn("family", F.lit("orthography"))
    return compose.by_confidence(found).select("family", F.col("check").alias("check_id"), "confidence", "n")


_REPORT = {"den Mann ?": [("### n-rule\n- [high] **den** → **de** — before Mann (1:1)\n\n### orthography\n- [high] ** ?** → **?** — no space stands before this mark (1:9)",)], "Mann": []}


@query("k05_reports", dealt_sql(_REPORT, "markdown"))
def k05(spark, d):
    """K-05, A-10, T-06, T-07: findings by family and check, as markdown."""
    docs = dealt(spark, d, list(_REPORT))
    return compose.report(compose.draft_check(docs, _language(spark)), docs).select("doc_id", "markdown")


@query("p03_escaped_search", "SELECT doc_id AS seg_id FROM documents WHERE contains(text, '.')")
def p03(spark, d):
    """P-03: a pattern's own signs are searched for as they are."""
    return search.search(_table(spark, d, "documents").select(F.col("doc_id").alias("seg_id"), "lang", "text"), ".", "substring").select("seg_id")


# Grammar. Fixed words of the language.
_NOUNS = [("Stad", "Stad", "F", True), ("Haus", "Haus", "N", True), ("Kaffi", "Kaffi", "M", True), ("Auto", "Auto", "M", True), ("Zäit", "Zäit", "F", True), ("Kanner", "Kand", "N", False), ("Leit", "Leit", None, False), ("Frënn", "Frënd", "M", False), ("Fra", "Fra", "F", True), ("Mamm", "Mamm", "F", True)]
_PARTICIPLES = [("gaangen", "goen", "sinn"), ("bliwwen", "bleiwen", "sinn"), ("gefuer", "fueren", "sinn"), ("gedronk", "drénken", "hunn"), ("ginn", "ginn", "both")]
_G = "kind, text, start, suggestion, confidence"


def _grammar(spark: SparkSession, d: str, cases: dict) -> DataFrame:
    docs = dealt(spark, d, list(cases))
    nouns, participles = _listed(spark, _NOUNS, "form string, lemma string, gender string, is_lemma boolean"), _listed(spark, _PARTICIPLES, "form string, lemma string, aux string")
    return grammar.check_grammar(docs, words(tokenize(docs)), nouns, participles)


def _g_cases(name: str, kinds: tuple[str, ...], cases: dict[str, list[tuple]]) -> None:
    def found(spark: SparkSession, d: str) -> DataFrame:
        return _grammar(spark, d, cases).where(F.col("kind").isin(*kinds)).select("doc_id", "kind", "text", "start", "suggestion", "confidence")

    placed = {s: [(kind, text.strip(), s.index(f" {text}") + 1 if f" {text}" in s else s.index(text), new, sure) for kind, text, new, sure in want] for s, want in cases.items()}
    query(name, dealt_sql(placed, _G))(found)


_g_cases("g02_dative", ("case",), {
    "Ech war mat meng Frënn do.": [("case", "mat meng", "mat menge", "high")], "Ech kommen vun d'Stad.": [("case", "vun d'Stad", "vun der Stad", "high")], "Ech fueren mat d'Auto.": [("case", "mat d'Auto", "mam Auto", "high")],
    "Ech spillen mat d'Kanner.": [("case", "mat d'Kanner", "mat de Kanner", "high")], "Ech schwätze mat eng Fra.": [("case", "mat eng", "mat enger", "high")], "Ech war mat menge Frënn a mat der Mamm am Haus, mam Auto.": [],
})
_g_cases("g03_gender", ("gender",), {
    "Mir ginn an de Stad.": [("gender", "de", "d'Stad", "high")], "Ech hunn den Haus gesinn.": [("gender", "den", "d'Haus", "high")], "D'Kaffi ass waarm.": [("gender", "D'Kaffi", "De Kaffi", "high")], "Ech hunn d'Auto gesinn.": [("gender", "d'Auto", "den Auto", "high")],
    "Ech hunn eng Kaffi gedronk.": [("gender", "eng", "e", "high")], "Ech hunn e Zäit.": [("gender", "e ", "eng", "high")], "D'Kanner an d'Leit sinn am Haus, den Auto an d'Stad och.": [], "Wann s de Loscht hues, komm.": [],
})
_g_cases("g04_contraction", ("contraction",), {"Ech fueren mat dem Auto.": [("contraction", "mat dem", "mam Auto", "low")], "Ech fueren mam Auto.": []})
_g_cases("g05_auxiliaries", ("auxiliary",), {
    "Ech hunn gëschter an d'Stad gaangen.": [("auxiliary", "hunn", "si", "high")], "Mir hunn eis doheem bliwwen.": [("auxiliary", "hunn", "sinn", "high")], "Hien huet op Paräis gefuer.": [("auxiliary", "huet", "ass", "high")],
    "Mir si gëschter an d'Stad gaangen an hunn e Kaffi gedronk.": [], "D'Haus ass gebaut ginn.": [], "Ech weess, datt hien gaangen huet.": [("auxiliary", "huet", "ass", "high")], "Hien ass e Kaffi gedronk.": [("auxiliary", "ass", "huet", "low")],
})


_GRAMMAR = {"Ech fueren mat dem Auto an hunn eis gefuer.": [("contraction",), ("auxiliary",)], "Ech hunn eng Kaffi.": [("gender",)], "Ech war mat meng Frënn do.": [("case",)], "Moien": []}


@query("g09_grammar", dealt_sql(_GRAMMAR, "kind"))
def g09(spark, d):
    return _grammar(spark, d, _GRAMMAR).select("doc_id", "kind")


# Documents of a dictionary, a corpus and a rule book, one for each nation.


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/cases-{uuid.uuid4().hex}"


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "nation")


def _written(spark: SparkSession, d: str, template: str, one_file: bool = False) -> str:
    """Files of the template, with a nation's key for @K@ (in letters for @W@) and its name for @N@: a file a nation, or one of all (a line each)."""
    path = _folder(spark)
    key = F.col("n_nationkey").cast("string")
    value = F.replace(F.replace(F.lit(template), F.lit("@K@"), key), F.lit("@N@"), F.col("n_name"))
    rows = _nations(spark, d).select(F.col("n_nationkey").alias("k"), F.replace(value, F.lit("@W@"), F.translate(key, "0123456789", "abcdefghij")).alias("value"))
    if one_file:
        rows.orderBy("k").coalesce(1).select("value").write.text(path)
    else:
        rows.repartition("k").write.partitionBy("k").text(path)
    return path


def _part(content: str, kind: str = "word", join: bool = False) -> dict:
    return {"type": kind, "content": content} | ({"joinWithPreviousWord": True} if join else {})


_ENTRY = json.dumps({"entry": {
    "lod_id": "BEEM@K@", "partOfSpeech": "SUBST+M", "lemma": "@N@", "ipa": "baːm", "nRuleForm": "@N@", "trademark": False,
    "infoboxes": [{"x": {"tag": "internalLink", "content": "Bësch", "idRef": "BESCH1"}}, {"tag": "internalLink", "content": "b", "idRef": "BESCH1"}],
    "allSynonyms": {"synonymGroups": [{"fromTerms": ["Bam"], "toSynonyms": [{"syn": "Gewiess"}]}], "otherPotentialSynonyms": {"synonyms": [{"syn": "Planz"}]}}, "categories": [{"label": "Natur", "code": "n"}],
    "tables": {
        "verbConjugation": {"infinitive": "x", "auxiliaryVerb": "hunn/sinn", "pastParticiple": "gebaamt", "indicative": {"present": {"p1": "baamen", "p2": "baams"}}},
        "adjDeclension": {"basicForms": {"positive": "gréng"}, "declension": {"positive": {"singular": {"masculine": {"nominative": "grénge", "dative": "gréngem"}}}}},
    },
    "microStructures": [{"pastParticiple": "gebaamt", "auxiliaryVerb": "hunn", "grammaticalUnits": [{"grammaticalInformation": ["fam"], "meanings": [{
        "meaningID": "M1", "number": 1, "region": "Norden", "tags": ["a", "b"], "inflection": {"forms": [{"content": "Beem"}, {"content": "Bam"}, {"content": "Beem"}]},
        "targetLanguages": {"en": {"parts": [_part("tree", "translation"), _part("a plant", "semanticClarifier"), _part("big", "note"), _part("wood", "translation")]}, "xx": {"parts": []}},
        "examples": [{"parts": [{"type": "text", "parts": [_part("EGS", "attribute"), _part("d'"), _part("Kanner", join=True), _part("um"), _part("@N@", "inflectedHeadword"), _part("!", join=True)]}, {"type": "gloss", "parts": [_part("si"), _part("klammen")]}], "audioFiles": {"ogg": "o", "aac": "a"}}],
    }]}]}],
}}, ensure_ascii=False)
_HITS = json.dumps({"results": [
    {"article_id": "BEEM@K@", "word_lb": "@N@", "pos": "SUBST+M", "matches": ["<em>Beem@W@</em>"], "meanings": [{"id": "M1", "translation": "tree [plant]", "number": 1, "secondaryHeadword": ""}]},
    {"id": "X@K@", "word_lb": "@N@schoul", "pos": "SUBST+F", "erroneous": True, "matches": []}, {"word_lb": "none"},
]}, ensure_ascii=False)


def _ingested(df: DataFrame) -> DataFrame:
    """Documents are normalised once, and written."""
    path = _folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(lexicon.read_entries(spark, _written(spark, d, _ENTRY)))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits, each file's for the query of its nation's name in small letters."""
    found = lexicon.read_hits(spark, _written(spark, d, _HITS))
    named = found.where("id like 'BEEM%'").select("file", F.lower("lemma").alias("query"))
    return _ingested(found.join(named, "file").withColumn("query_key", F.col("query")).withColumn("lang", F.lit("lb")))


_ID = "'BEEM' || n_nationkey AS id"


@query("s17_entries", f"SELECT {_ID}, n_name AS lemma, 'noun (masculine)' AS pos_label, n_name AS n_form FROM nation")
def s17(spark, d):
    """S-17, L-08, H-09."""
    return _entries(spark, d).select("id", "lemma", "pos_label", "n_form")


def _meanings(spark: SparkSession, d: str) -> DataFrame:
    each = _entries(spark, d).select("id", F.explode("sections").alias("s")).select("id", "s", F.explode("s.units").alias("u"))
    return each.select("id", "s", F.explode("u.meanings").alias("m"))


@query("l04_examples", f"SELECT {_ID}, 'd''Kanner um **' || n_name || '**!' AS text, 'si klammen' AS gloss, 'EGS' AS labels, 'a' AS audio FROM nation")
def l04(spark, d):
    """L-02, L-03, L-04."""
    return _meanings(spark, d).select("id", F.explode("m.examples").alias("x")).select("id", "x.text", "x.gloss", F.array_join("x.labels", ", ").alias("labels"), "x.audio")


@query("l05_translations", f"SELECT {_ID}, text, clarifier, notes FROM nation, (VALUES ('tree', 'a plant', 'big'), ('wood', NULL, '')) AS v(text, clarifier, notes)")
def l05(spark, d):
    return _meanings(spark, d).select("id", F.explode(F.col("m.translations")["en"]).alias("t")).select("id", "t.text", "t.clarifier", F.array_join("t.notes", ", ").alias("notes"))


@query("l06_links", f"SELECT {_ID}, 'BESCH1' AS link FROM nation")
def l06(spark, d):
    """L-06, U-04: each link once."""
    return _entries(spark, d).select("id", F.explode("see_also.id").alias("link"))


@query("l07_extras", f"SELECT {_ID}, key, value FROM nation, (VALUES ('region', 'Norden'), ('tags', 'a, b')) AS v(key, value)")
def l07(spark, d):
    return _meanings(spark, d).select("id", F.explode("m.extra").alias("key", "value"))


@query("l08_synonyms", f"SELECT {_ID}, 'Gewiess' AS synonyms, 'Planz' AS others, 'Natur' AS categories, 'gebaamt' AS participles FROM nation")
def l08(spark, d):
    e = _entries(spark, d)
    join = lambda c: F.array_join(c, ", ")
    return e.select("id", join(F.col("synonyms")[0]["synonyms"]).alias("synonyms"), join("other_synonyms").alias("others"), join("categories").alias("categories"), join(F.col("sections")[0]["participles"]).alias("participles"))


@query("l09_verb_tables", f"SELECT {_ID}, 'indicative' AS mood, 'present' AS tense, 'baamen' AS p1, 'baams' AS p2, CAST(NULL AS VARCHAR) AS p3 FROM nation")
def l09(spark, d):
    return lexicon.verb_table(_entries(spark, d)).select("id", "mood", "tense", "p1", "p2", "p3")


@query("l10_adjective_tables", f"SELECT {_ID}, 'positive' AS degree, 'singular' AS number, 'masculine' AS gender, 'grénge' AS nominative, 'gréngem' AS dative FROM nation")
def l10(spark, d):
    return lexicon.adjective_table(_entries(spark, d)).select("id", "degree", "number", "gender", "nominative", "dative")


@query("l11_table_leaves", f"""SELECT {_ID}, path, value FROM nation, (VALUES ('verbConjugation.infinitive', 'x'), ('verbConjugation.auxiliaryVerb', 'hunn/sinn'), ('verbConjugation.pastParticiple', 'gebaamt'),
    ('verbConjugation.indicative.present.p1', 'baamen'), ('verbConjugation.indicative.present.p2', 'baams'), ('adjDeclension.basicForms.positive', 'gréng'),
    ('adjDeclension.declension.positive.singular.masculine.nominative', 'grénge'), ('adjDeclension.declension.positive.singular.masculine.dative', 'gréngem')) AS v(path, value)""")
def l11(spark, d):
    return lexicon.generic_table(_entries(spark, d)).select("id", "path", "value")


@query("a12_listed_forms", f"SELECT {_ID}, 'Beem, Bam' AS forms FROM nation")
def a12(spark, d):
    """A-12: the distinct forms that an entry lists, in order."""
    return lexicon.listed_forms(_entries(spark, d)).select("id", F.array_join(F.slice("forms", 1, 2), ", ").alias("forms"))


@query("a13_examples_of_meanings", f"SELECT {_ID}, 1 AS number, 1 AS examples FROM nation")
def a13(spark, d):
    return _meanings(spark, d).select("id", F.col("m.number").cast("int").alias("number"), F.size("m.examples").alias("examples"))


@query("p14_trimmed_entries", f"SELECT {_ID}, 'tree [a plant] (big); wood' AS en, 0 AS examples FROM nation")
def p14(spark, d):
    """P-14, W-09, C-07: what the lookup shows of a meaning."""
    return lexicon.trimmed_entry(_entries(spark, d), ("en",), 0).select("id", F.col("translations")["en"].alias("en"), F.size("examples").alias("examples"))


@query("s16_hits", "SELECT id, ord, lemma, erroneous, matched FROM (SELECT 'BEEM' || n_nationkey AS id, 0 AS ord, n_name AS lemma, false AS erroneous, 'Beem' || translate(n_nationkey::VARCHAR, '0123456789', 'abcdefghij') AS matched FROM nation UNION ALL SELECT 'X' || n_nationkey, 1, n_name || 'schoul', true, '' FROM nation)")
def s16(spark, d):
    """S-16, L-01: hits in their order; one without an id goes."""
    return _hits(spark, d).select("id", F.col("ord").cast("int").alias("ord"), "lemma", "erroneous", F.array_join("matched", ", ").alias("matched"))


@query("j03_genders", "SELECT 'beem' || translate(n_nationkey::VARCHAR, '0123456789', 'abcdefghij') AS form, n_name AS lemma, 'M' AS gender, false AS is_lemma FROM nation")
def j03(spark, d):
    """J-03, A-07, P-12: the gender of an inflected form, from hits without a fault."""
    hits = _hits(spark, d).withColumn("query", F.when(F.size("matched") > 0, F.lower(F.col("matched")[0])).otherwise(F.col("query")))
    return lexicon.noun_table(hits).select("form", "lemma", "gender", "is_lemma")


@query("j04_participles", "SELECT 'gebaamt' || n_nationkey AS form, n_name AS lemma, 'both' AS aux FROM nation WHERE false")
def j04(spark, d):
    """J-04, A-08: no noun has a participle."""
    return lexicon.participle_table(_hits(spark, d), _entries(spark, d)).select("form", "lemma", "aux")


@query("a08_auxiliaries", "SELECT 'gebaamt' AS form, min(n_name) AS lemma, 'both' AS aux FROM nation WHERE n_nationkey = 7")
def a08(spark, d):
    """A-08, J-04: a verb's participle, and with what it forms the perfect."""
    verbs = _hits(spark, d).where("id = 'BEEM7'").withColumn("pos", F.lit("VRB")).withColumn("query", F.lit("gebaamt")).withColumn("matched", F.array(F.lit("gebaamt")))
    return lexicon.participle_table(verbs, _entries(spark, d)).select("form", "lemma", "aux")


@query("j05_n_forms", "SELECT n_name AS form, n_name AS n_form FROM nation")
def j05(spark, d):
    hits = _hits(spark, d)
    return lexicon.n_form_table(hits.withColumn("query", F.when(F.col("id").startswith("BEEM"), F.col("lemma")).otherwise(F.col("query"))).where("id like 'BEEM%'"), _entries(spark, d)).select("form", "n_form")


@query("l12_resolved", "SELECT lower(n_name) AS query, 'BEEM' || n_nationkey AS id, n_name AS via, 'X' || n_nationkey AS others FROM nation UNION ALL SELECT 'beem' || n_nationkey, 'BEEM' || n_nationkey, NULL, '' FROM nation")
def l12(spark, d):
    """L-12, J-15, P-11: a word by its best hit, an id by itself; what is neither is left out."""
    n = _nations(spark, d)
    asked = n.select(F.lower("n_name").alias("query")).union(n.select(F.concat(F.lit("beem"), "n_nationkey"))).union(n.select(F.concat(F.lit("nope "), "n_nationkey")))
    return lexicon.resolve(asked, _hits(spark, d), _entries(spark, d)).select("query", "id", "via", F.array_join("alternatives", ", ").alias("others"))


@query("p11_ids", "SELECT p_partkey, (p_partkey % 3 = 0) AS ok FROM part")
def p11(spark, d):
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("HAUS"), "p_partkey")).when(F.col("p_partkey") % 3 == 1, F.lit("d'Haus")).otherwise(F.lit(""))
    return _table(spark, d, "part").select("p_partkey", lexicon.valid_id(said).alias("ok"))


_POS = {"SUBST+N": "noun (neuter)", "SUBST+F": "noun (feminine)", "VRB": "verb", "XYZ": "XYZ", "": ""}


@query("h09_parts_of_speech", dealt_sql({k: [(v,)] for k, v in _POS.items()}, "label"))
def h09(spark, d):
    return dealt(spark, d, list(_POS)).select("doc_id", lexicon.part_of_speech(F.col("text")).alias("label"))


@query("h09_tags", "SELECT p_partkey, p_name AS text FROM part")
def h09_tags(spark, d):
    return _table(spark, d, "part").select("p_partkey", lexicon.tags_stripped(F.concat(F.lit("<em>"), "p_name", F.lit("</em>"))).alias("text"))


@query("g06_reverse_lookup", "SELECT lower(n_name) AS german, n_name AS lemma, 'tree [plant]' AS sense FROM nation")
def g06(spark, d):
    """G-06, T-05, A-11: the best translations of a German word."""
    return lexicon.german_hits(_hits(spark, d).where("id like 'BEEM%'")).select("german", "lemma", "sense")


@query("c06_dictionary_search", "SELECT 'BEEM' || n_nationkey AS id, n_name AS lemma FROM nation WHERE n_nationkey = 3")
def c06(spark, d):
    name = _nations(spark, d).where("n_nationkey = 3").first()["n_name"]
    return lexicon.dictionary_search(_hits(spark, d), f" {name.upper()} ", limit=1).select("id", "lemma")


@query("c07_dictionary_entries", "SELECT 'BEEM' || n_nationkey AS id, 'tree [a plant] (big); wood' AS en FROM nation")
def c07(spark, d):
    asked = _nations(spark, d).select(F.lower("n_name").alias("query"))
    return lexicon.dictionary_entry(asked, _hits(spark, d), _entries(spark, d), ("en",), False).select("id", F.col("translations")["en"].alias("en"))


@query("c08_inflection", "SELECT lower(n_name) AS query, 'BEEM' || n_nationkey AS id, true AS verb, true AS adjective FROM nation")
def c08(spark, d):
    """C-08, K-04."""
    asked = _nations(spark, d).select(F.lower("n_name").alias("query"))
    told = lexicon.inflection(asked, _hits(spark, d), _entries(spark, d))
    return told.select("query", "id", F.col("markdown").contains("| ech | baamen |").alias("verb"), F.col("markdown").contains("grénge").alias("adjective"))


@query("k02_rendered_hits", "SELECT lower(n_name) AS query, true AS hit, true AS matched, true AS meaning FROM nation")
def k02(spark, d):
    told = F.col("markdown")
    return lexicon.rendered_hits(_hits(spark, d)).select("query", told.contains("BEEM").alias("hit"), told.contains("matched form: Beem").alias("matched"), told.contains("tree [plant]").alias("meaning"))


@query("k03_rendered_entries", f"SELECT {_ID}, true AS translation, true AS example FROM nation")
def k03(spark, d):
    told = F.col("markdown")
    return lexicon.rendered_entries(_entries(spark, d)).select("id", told.contains("- EN: tree [a plant] (big); wood").alias("translation"), told.contains("[EGS] d'Kanner um **").alias("example"))


# Rule book: for each nation a chapter K with two sections.
_BOOK = "\n".join(json.dumps(r, ensure_ascii=False) for r in (
    {"id": "@K@", "title": "Komma @N@", "path": ["Sazzeechen"], "page": 3, "text": "De Komma *virun* @N@ Bloum@W@.", "examples": ["mengen, datt"], "cross_refs": ["2"], "variants": [{"main": "a", "secondary": "b"}], "subsections": ["@K@.1", "@K@.2"]},
    {"id": "@K@.1", "title": "Virun datt", "path": ["Sazzeechen", "Komma"], "page": 4, "text": "Viru Niewesätz.", "examples": ["@N@/Beem"], "cross_refs": [], "variants": [], "subsections": []},
    {"id": "@K@.2.1", "title": "Opzielung", "path": ["Sazzeechen", "Komma"], "page": 5, "text": "Wierder.", "examples": ["Bam"], "cross_refs": [], "variants": [], "subsections": []},
))


def _book(spark: SparkSession, d: str) -> DataFrame:
    return lists.read_rules(spark, _written(spark, d, _BOOK, one_file=True))


@query("s13_rules", "SELECT id, title, n_nationkey * 3 + o AS ord FROM (SELECT n_nationkey, n_nationkey::VARCHAR AS id, 'Komma ' || n_name AS title, 0 AS o FROM nation UNION ALL SELECT n_nationkey, n_nationkey || '.1', 'Virun datt', 1 FROM nation UNION ALL SELECT n_nationkey, n_nationkey || '.2.1', 'Opzielung', 2 FROM nation)")
def s13(spark, d):
    return _book(spark, d).select("id", "title", F.col("ord").cast("long").alias("ord"))


@query("j13_sections", "SELECT id, place FROM (VALUES ('4', 0), ('4.1', 1)) AS v(id, place)")
def j13(spark, d):
    """J-13, H-12: a paragraph and its subsections that the book has."""
    return rules.section(_book(spark, d), "§4.").select("id", "place")


@query("j14_sections_of_words", "SELECT n_nationkey || '.1' AS id FROM nation WHERE n_nationkey IN (SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 3)")
def j14(spark, d):
    """J-14, T-09: paragraphs with a word among their examples, in the order of the book."""
    return rules.sections_for_word(_book(spark, d), "beem").select("id")


@query("j14_example_words", "SELECT word, id FROM (SELECT 'mengen, datt' AS word, n_nationkey::VARCHAR AS id FROM nation UNION ALL SELECT unnest(['mengen', 'datt']), n_nationkey::VARCHAR FROM nation UNION ALL SELECT unnest([lower(n_name) || '/beem', lower(n_name), 'beem']), n_nationkey || '.1' FROM nation UNION ALL SELECT 'bam', n_nationkey || '.2.1' FROM nation)")
def j14_words(spark, d):
    return lists.example_words(_book(spark, d)).select("word", "id")


@query("p15_contents", "SELECT n_nationkey::VARCHAR AS id, 3 AS page FROM nation UNION ALL SELECT n_nationkey || '.1', 4 FROM nation")
def p15(spark, d):
    return rules.contents(_book(spark, d)).select("id", "page")


@query("k06_rendered_rules", "SELECT n_nationkey::VARCHAR AS id, '## §' || n_nationkey || ' Komma ' || n_name AS head, true AS variants, '§' || n_nationkey || ', S. 3' AS source FROM nation")
def k06(spark, d):
    """K-06, H-11."""
    told = rules.rendered(_book(spark, d).where("id not like '%.%'"))
    return told.select("id", F.split("markdown", "\n")[0].alias("head"), F.col("markdown").contains("a / b").alias("variants"), F.regexp_extract("markdown", "§[0-9]+, S. [0-9]+$", 0).alias("source"))


@query("t04_rule_search", "SELECT n_nationkey::VARCHAR AS id FROM nation WHERE n_nationkey = 5")
def t04(spark, d):
    """T-04, H-10, A-05: the paragraph that a question is about."""
    return rules.search_rules(_book(spark, d), "where does a comma go, Bloumf", 1).select("id")


_QUESTIONS = {"comma": [("comma Komma",)], "hyphen": [("hyphen Bindestréch",)], "moien": [("moien",)]}


@query("h10_expanded_questions", dealt_sql(_QUESTIONS, "expanded"))
def h10(spark, d):
    table = _listed(spark, [(q, rules.expanded(q)) for q in _QUESTIONS], "text string, expanded string")
    return dealt(spark, d, list(_QUESTIONS)).join(table, "text").select("doc_id", "expanded")


_BOOSTED = {"n-rule": [("6.1.1", 6.0), ("6.1.1", 8.0), ("6.1.2.2", 6.0), ("6.1.2.2", 8.0), ("6.1.2.4", 6.0), ("6.1.2.4", 8.0)], "the letter h": [("4.3.1", 6.0)], "ë1": [("2.2.3", 6.0), ("2.2.2", 8.0), ("2.2.3", 8.0)], "comma": []}


@query("j18_boosts", dealt_sql(_BOOSTED, "id, score").replace("AS doc_id, id, score", "AS doc_id, id, CAST(score AS DOUBLE) AS score"))
def j18(spark, d):
    table = _listed(spark, [(q, i, s) for q in _BOOSTED for i, s in rules.boosts(q)], "text string, id string, score double")
    return dealt(spark, d, list(_BOOSTED)).join(table, "text").select("doc_id", "id", "score")


# Corpora.
_TMX = "<tu tuid=\"@K@\"><prop type=\"x-domain\">press</prop><tuv xml:lang=\"lb-LU\"><seg>e <bpt i=\"1\">x</bpt>schéint<ept i=\"1\">y</ept> @N@ &amp;amp; &#8217;</seg></tuv><tuv xml:lang=\"fr_FR\"><seg>le @N@</seg></tuv><tuv lang=\"xx\"><seg>none</seg></tuv></tu>"
_LINES = "\n".join(['{"LU": "Moien @N@", "FR": "Salut", "n": @K@}', '{"translation": {"lb": "A @K@"}, "lb": "B"}', '{"source": "Äddi", "target": "Au revoir", "source_lang": "lb", "target_lang": "fr"}', "not json", '{"text_lb": "Jo", "domain": "x"}'])


@query("s01_tmx", "SELECT n_nationkey AS seg_id, n_nationkey::VARCHAR AS tuid, 'e schéint ' || n_name || ' &amp; ’' AS lb, 'le ' || n_name AS fr, 'press' AS domain FROM nation")
def s01(spark, d):
    """S-01, S-02, S-03, W-10: translation units, cleaned and numbered."""
    found = corpus.read_tmx(spark, _written(spark, d, _TMX, one_file=True))
    return found.select(F.col("seg_id").cast("int").alias("seg_id"), F.col("meta")["tuid"].alias("tuid"), F.col("text")["lb"].alias("lb"), F.col("text")["fr"].alias("fr"), F.col("meta")["x-domain"].alias("domain"))


@query("s02_cleaned_segments", "SELECT p_partkey, 'e ' || p_name || ' &lt; <' AS said FROM part")
def s02(spark, d):
    raw = F.concat(F.lit("e <bpt i='1'>x</bpt>"), "p_name", F.lit("<ept>y</ept> <ph/>&amp;lt; &lt;"))
    return _table(spark, d, "part").select("p_partkey", corpus.segment_cleaned(raw).alias("said"))


_SAID = "SELECT n_nationkey * 4 + o AS seg_id, lb, fr FROM (SELECT n_nationkey, 0 AS o, 'Moien ' || n_name AS lb, 'Salut' AS fr FROM nation UNION ALL SELECT n_nationkey, 1, 'A ' || n_nationkey, NULL FROM nation UNION ALL SELECT n_nationkey, 2, 'Äddi', 'Au revoir' FROM nation UNION ALL SELECT n_nationkey, 3, 'Jo', NULL FROM nation)"


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.col("seg_id").cast("int").alias("seg_id"), F.col("text")["lb"].alias("lb"), F.col("text")["fr"].alias("fr"))


@query("s04_json_lines", _SAID)
def s04_lines(spark, d):
    """S-04: the three layouts; a language's first text counts; other lines take no id."""
    return _pairs(corpus.read_jsonl(spark, _written(spark, d, _LINES, one_file=True)))


def _zipped(spark: SparkSession, d: str, member: str, template: str) -> str:
    """One archive of a member, written as a binary file by one task."""
    import io
    import zipfile

    lines = [r["value"] for r in spark.read.text(_written(spark, d, template, one_file=True)).collect()]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr(f"x/{member}", "\n".join(lines))
        z.writestr(f"__MACOSX/{member}", "none")
    path = f"{_folder(spark)}/c.zip"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(fs_path)
    out.write(data.getvalue())
    out.close()
    return path


@query("s05_zip", _SAID)
def s05(spark, d):
    return _pairs(corpus.read_corpus(spark, _zipped(spark, d, "a.jsonl", _LINES), _folder(spark)))


@query("s06_folder_of_zips", _SAID)
def s06(spark, d):
    """S-06, S-07, U-02: a folder; its archives are read too."""
    return _pairs(corpus.read_corpus(spark, _zipped(spark, d, "a.jsonl", _LINES).rpartition("/")[0], _folder(spark)))


@query("s11_german_list", "SELECT lower('Wort' || n_nationkey) AS german_key, n_name AS lb, CASE WHEN n_nationkey % 2 = 0 THEN 'x' END AS note FROM nation")
def s11(spark, d):
    """S-11, J-01: the last line of a word counts; remarks and half lines don't."""
    path = _folder(spark)
    line = F.concat(F.lit("# remark\nhalf line\nWort"), "n_nationkey", F.lit("\told\nWORT"), "n_nationkey", F.lit("\t"), "n_name", F.when(F.col("n_nationkey") % 2 == 0, "\tx").otherwise(""))
    _nations(spark, d).orderBy("n_nationkey").coalesce(1).select(line.alias("value")).write.text(path)
    return lists.read_germanisms(spark, path).select("german_key", "lb", "note")


@query("s12_markdown", "SELECT '# ' || n_name AS text FROM nation")
def s12(spark, d):
    return lists.read_markdown(spark, _written(spark, d, "<!-- x\ny -->\n# @N@\n")).select("text")


@query("s14_word_list", "SELECT DISTINCT unnest([n_name, 'haut', 'd''Haus']) AS form FROM nation")
def s14(spark, d):
    """S-14, S-15: forms without flags and morphology; counts are no words."""
    return lists.read_wordlist(spark, _written(spark, d, "3\n@N@/e1 po:noun\nhaut po:adverb\nd'Haus", one_file=True)).select("form")


_AFF = "SET UTF-8\nFLAG long\nNEEDAFFIX na\nFORBIDDENWORD fo\nSFX e1 Y 2\nSFX e1 0 er [^E]\nSFX e1 E en/g1 E\nSFX g1 N 1\nSFX g1 0 s .\nPFX on Y 1\nPFX on 0 on .\nSFX n1 N 1\nSFX n1 0 t ."


@query("s14_affix_forms", """SELECT DISTINCT unnest(CASE WHEN n_name LIKE '%E' THEN [n_name, stem || 'en', stem || 'ens', 'on' || n_name, 'on' || stem || 'en'] ELSE [n_name, n_name || 'er', 'on' || n_name, 'on' || n_name || 'er'] END
    || [n_name || '-maacht', 'haut']) AS form FROM (SELECT n_name, left(n_name, length(n_name) - 1) AS stem FROM nation)""")
def s14_affixes(spark, d):
    """S-14: forms that suffixes, suffixes of suffixes and prefixes make; what needs an affix or is forbidden is none."""
    dic = _written(spark, d, "9\n@N@/e1on po:noun\n@N@-maach/nan1\nhaut po:adverb\nhauter/fo", one_file=True)
    aff = _folder(spark)
    spark.createDataFrame([(_AFF,)], "value string").coalesce(1).write.text(aff)
    return hunspell.read_dictionary(spark, dic, aff)


@query("c10_writing_guide", "SELECT '# Rules' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '# Notes' AS text")
def c10(spark, d):
    """C-10, S-12."""
    def page(text: str) -> DataFrame:
        path = _folder(spark)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
        return lists.read_markdown(spark, path)

    return rules.writing_guide(page("<!-- x -->\n# Rules"), page("# Notes\n"))


def _length_of(key: str) -> str:
    if key.startswith("U"):
        raise ValueError("no such word")
    return str(len(key))


@query("s18_lookups", "SELECT n_name AS key, CASE WHEN n_name NOT LIKE 'U%' THEN length(n_name)::VARCHAR END AS body, CASE WHEN n_name LIKE 'U%' THEN 'ValueError: no such word' END AS error FROM nation")
def s18(spark, d):
    """S-08, S-18 to S-20, K-08: each key asked for once; a failure is its row's."""
    names = _table(spark, d, "customer").join(_nations(spark, d), F.col("c_nationkey") == F.col("n_nationkey"), "right").select(F.col("n_name").alias("key"))
    return lookup.look_up(names, _length_of, _folder(spark), pause=0.0).select("key", "body", "error")
