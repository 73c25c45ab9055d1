"""Rule book lookup (C-09, C-10, H-10 to H-12, J-13, J-14, J-18, K-06, P-15, T-04, T-09)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lists import example_words
from .retrieval import Index, bm25, build_index, query_terms

# What a question in another language has to find in the book, and the key paragraphs of some topics and letters.
EXPANSIONS = (
    (r"capital|upper|lower.?case|gro(ß|ss)schreib|kleinschreib|majuscule|minuscule", "Groussschreiwung Klengschreiwung groussgeschriwwen klenggeschriwwen"),
    (r"weekday|days? of the week|wochentag|jours? de la semaine|monday|montag|lundi", "Wochendeeg Méindeg Dageszäiten"),
    (r"time of day|tageszeit|morning|evening|morgens|abends", "Dageszäiten moies owes Mueren Owend"),
    (r"comma|komma|virgule", "Komma"),
    (r"hyphen|bindestrich|trait d.union", "Bindestréch"),
    (r"apostroph", "Apostroph"),
    (r"n.?rule|eifel|n-regel|règle du n", "n-Reegel"),
    (r"number|zahl|chiffre|digit|nombre", "Zuelen Zuel"),
    (r"abbrev|abkürz|abréviation", "Ofkierzungen Ofkierzung"),
    (r"quot|anführung|guillemet", "Gänseféisercher"),
    (r"compound|zusammen|together|composé|soudé", "Zesummeschreiwung zesummegeschriwwen Zesummesetzungen"),
    (r"separate|getrennt|apart|séparé", "auserneegeschriwwen Getrenntschreiwung"),
    (r"loan|fremdw|foreign|emprunt", "Friemwierder"),
    (r"french|französisch|français", "Franséisch franséisch"),
    (r"english|englisch|anglais", "Englesch englesch"),
    (r"greek|latin|griech|latein", "griichesch laténgesch"),
    (r"verb", "Verben Verb"),
    (r"vowel|vokal|voyelle", "Vokal Vokaler"),
    (r"long|lang", "laang laange"),
    (r"short|kurz|court", "kuerz kuerze"),
    (r"doubl|verdoppel", "verduebelt Verdueblung duebel"),
    (r"diphth", "Diphthongen Diphthong"),
    (r"(lengthening|stretch|dehnungs)[- ]?h|silent h|h muet", "Längt markéieren Deenungs"),
    (r"plural|pluriel", "Pluriel"),
    (r"ß|eszett|sharp s", "ss ß schaarfen"),
    (r"accent|akzent|aigu|grave|circonflexe", "Accent"),
    (r"umlaut|trema|tréma|diaeresis|ë", "Treema"),
    (r"question mark|fragezeichen|point d.interrogation", "Froenzeechen"),
    (r"exclamation|ausrufezeichen", "Ausruffzeechen"),
    (r"colon|doppelpunkt|deux.points", "Doppelpunkt"),
    (r"semicolon|semikolon|point.virgule", "Stréchpunkt Semikolon"),
    (r"dash|gedankenstrich|tiret", "Gedankestréch"),
    (r"title|titel|titre", "Titelen Titel"),
    (r"name|eigenname|nom propre", "Nimm Numm"),
    (r"polite|höflich|formal address|vouvoie|sie-form", "Héiflechkeetspronomen Urieden Dir Iech"),
    (r"sentence start|satzanfang|début de phrase", "Sazufank"),
    (r"diminutiv", "Diminutiv chen"),
    (r"particip|partizip", "Partizip"),
    (r"infinitiv", "Infinitiv"),
    (r"final consonant|auslaut|devoic|verhärtung", "Ennverhäerdung Laut um Enn"),
    (r"space|leerzeichen|espace", "Sputt"),
    (r"unit|einheit|percent|prozent|pour.?cent", "Moosseenheeten Prozentzeechen"),
)
TOPICS = (
    (r"n.?(rule|reegel|regel)|eifel", "6.1.1 6.1.2.2 6.1.2.4"),
    (r"(lengthening|stretch|dehnungs|deenungs)[- ]?h|\bh\b.*(long|laang|läng)", "4.3.1 1.2.3"),
    (r"(^|[\W\d_])[ëé]($|[\W\d_])|treema|accent aigu", "2.2.2 2.2.3"),
    (r"ß|eszett", "4.3.4.2 4.3.4.4"),
    (r"\bee\b|laangen e|long e", "2.1"),
    (r"r.?(rule|reegel)|ier|uer", "3.2.1"),
)
LETTERS = dict(
    n="6.1.1 6.1.2.2 6.1.2.4", h="4.3.1", s="4.3.4.2 4.3.4.3 4.3.4.4", z="4.3.4.7", g="4.3.2.1 4.3.2.3", j="4.3.3.2", k="4.3.5.1", q="4.3.5.1", x="4.3.5.3",
    f="4.3.6.1", v="4.3.6.1", w="4.3.6.1", e="2 2.1", é="2.2.2", ë="2.2.3", ä="2.2.1", t="4.5", r="3.2.1",
)
LETTER_BOOST, TOPIC_BOOST, EXAMPLE_BOOST = 6.0, 8.0, 1.5
SOURCE = "D'Lëtzebuerger Orthografie"


def rule_index(rules: DataFrame) -> Index:
    """S-13. Paragraphs as documents: the title three times, the path, and the text without asterisks."""
    doc = F.concat_ws(" ", "title", "title", "title", F.array_join("path", " "), F.replace("text", F.lit("*"), F.lit("")))
    return build_index(rules.select(F.col("ord").cast("bigint").alias("doc_id"), doc.alias("text")))


def expanded(query: str) -> str:
    """H-10. The query with the book's own words for what it asks about. (One short string: no table is needed.)"""
    return " ".join([query, *(more for pattern, more in EXPANSIONS if re.search(pattern, query, re.I))])


def boosts(query: str) -> list[tuple[str, float]]:
    """J-18. Paragraphs that letters and topics of a query point to."""
    letters = re.findall(r"(?:^|[^\w]|[\d_])([^\W\d_])(?=[^\w]|[\d_]|$)", query)
    out = [(s, LETTER_BOOST) for c in letters for s in LETTERS.get(c.lower(), "").split()]
    return out + [(s, TOPIC_BOOST) for pattern, ids in TOPICS if re.search(pattern, query, re.I) for s in ids.split()]


def search_rules(rules: DataFrame, query: str, limit: int = 3, index: Index | None = None) -> DataFrame:
    """T-04, A-05. The paragraphs that a question is about: the columns of rules, and score."""
    spark = rules.sparkSession
    asked = spark.createDataFrame([(0, expanded(query))], "query_id int, text string")
    scored = bm25(index or rule_index(rules), query_terms(asked)).join(rules.select(F.col("ord").cast("bigint").alias("doc_id"), "id"), "doc_id").select("id", "score")
    fixed = spark.createDataFrame(boosts(query) or [("", 0.0)], "id string, score double")
    words = spark.createDataFrame([(w.lower().replace("’", "'"),) for w in query.split()] or [("",)], "word string")
    examples = example_words(rules).join(F.broadcast(words), "word").select("id", F.lit(EXAMPLE_BOOST).alias("score"))
    total = scored.union(fixed).union(examples).groupBy("id").agg(F.sum("score").alias("score"))
    return rules.join(total, "id").orderBy(F.desc("score"), "ord").limit(limit)


def section(rules: DataFrame, number: str) -> DataFrame:
    """H-12, J-13. A paragraph and its direct subsections, in their order: the columns of rules, and place (0 for itself)."""
    clean = re.sub(r"^§\s*|\.$", "", number.strip()).strip()
    own = rules.where(F.col("id") == clean)
    parts = own.select(F.posexplode("subsections").alias("place", "id")).join(rules, "id").withColumn("place", F.col("place") + 1)
    return own.withColumn("place", F.lit(0)).unionByName(parts).orderBy("place")


def sections_for_word(rules: DataFrame, word: str, limit: int = 3) -> DataFrame:
    """J-14, T-09. Paragraphs with a word among their examples, in the order of the book; a word without any is searched for as a question."""
    hits = example_words(rules).where(F.col("word") == word.lower().replace("’", "'")).select("id").distinct()
    found = rules.join(hits, "id", "left_semi").orderBy("ord").limit(limit)
    return found if found.limit(1).count() else search_rules(rules, word, limit).drop("score")


def contents(rules: DataFrame) -> DataFrame:
    """P-15. The table of contents: chapters and their sections."""
    return rules.where(F.size(F.split("id", "\\.")) <= 2).orderBy("ord").select("id", "title", "page")


def rendered(sections: DataFrame, most: int = 6000) -> DataFrame:
    """K-06, H-11. id and markdown of each paragraph, cut at a number of characters."""
    body = F.concat_ws(
        "\n",
        F.format_string("## §%s %s", "id", "title"),
        F.concat(F.lit("*"), F.array_join(F.concat("path", F.array(F.concat_ws(" ", "id", "title"))), " › "), F.format_string(" (S. %d)*", "page")),
        F.concat(F.lit("\n"), F.trim("text")),
        F.when(F.size("subsections") > 0, F.concat(F.lit("\nSubsections: "), F.array_join(F.transform("subsections", lambda s: F.concat(F.lit("§"), s)), ", "))),
        F.when(F.size("variants") > 0, F.concat(F.lit("\nVariants (main / secondary): "), F.array_join(F.transform("variants", lambda v: F.concat_ws(" / ", v["main"], v["secondary"])), "; "))),
        F.when(F.size("cross_refs") > 0, F.concat(F.lit("\nSee also: "), F.array_join(F.transform("cross_refs", lambda s: F.concat(F.lit("§"), s)), ", "))),
    )
    cut = F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("\n…(truncated; ask for a subsection)"))).otherwise(body)
    return sections.select("id", F.concat(cut, F.lit("\n\nSource: "), citation()).alias("markdown"))


def writing_guide(digest: DataFrame, notes: DataFrame) -> DataFrame:
    """C-10. text: the digest of the rule book, a line across, and the notes on grammar. Both as read_markdown gives them, one row each; without either there is no guide."""
    return digest.select(F.col("text").alias("digest")).join(F.broadcast(notes.select(F.col("text").alias("notes")).limit(1))).select(F.concat_ws("\n\n---\n\n", "digest", "notes").alias("text"))


def citation():
    """H-11."""
    return F.format_string(f"{SOURCE}, §%s, S. %d", F.col("id"), F.col("page"))
