"""Grammar checks (G-01 to G-09): Germanisms, case after prepositions, gender of articles, contractions, auxiliaries.

Words of a document are one ordered partition; what stands near a word comes from lead and lag and from frames of a
few rows; lexicons are tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .nrule import lookup, n_form

# Fixed values of the language.
DATIVE_PREPOSITIONS = ("mat", "vun", "vu", "bei", "zu", "no", "aus", "zënter", "zanter", "vis-à-vis")
CONTRACTIONS = dict(mat="mam", vun="vum", vu="vum", zu="zum", bei="beim", an="am", a="am", op="um", u="um", un="um")
ARTICLES = dict(den="def", de="def", dem="dative-m", der="dative-f", en="indef", e="indef", eng="indef-f", engem="indef-dative-m", enger="indef-dative-f")
#: Determiners that cannot follow a preposition with the dative: their masculine, feminine and plural dative.
DATIVES = (
    {w: ("mengem", "menger", "mengen") for w in ("mäin", "meng")} | {w: ("dengem", "denger", "dengen") for w in ("däin", "deng")} | {w: ("sengem", "senger", "sengen") for w in ("säin", "seng")}
    | {w: ("hirem", "hirer", "hiren") for w in ("hiren", "hir")} | {w: ("eisem", "eiser", "eisen") for w in ("eisen", "eis")} | {w: ("ärem", "ärer", "ären") for w in ("ären", "är")}
    | {w: ("engem", "enger", "–") for w in ("eng", "en", "e")} | {w: ("kengem", "kenger", "kengen") for w in ("keng", "keen", "kee")} | {w: ("deem", "där", "deenen") for w in ("déi", "dat")}
)
GENDERS = dict(M="masculine", F="feminine", N="neuter")
TO_SINN = dict(hunn="sinn", hu="si", hues="bass", huet="ass", hutt="sidd", hat="war", has="wars", haten="waren", hätt="wier", häss="wiers", hätten="wieren")
TO_HUNN = dict(sinn="hunn", bass="hues", ass="huet", sidd="hutt", war="hat", wars="has", waren="haten", wier="hätt", wiers="häss", wieren="hätten")
NO_PARTICIPLES = "gären géint gëschter genuch genau géif géing géifen géingen gëtt gesond gelift gewinnt geschwënn gewëss bestëmmt vergiess erëm ëmmer eréischt besonnesch ënnen iwwer ënner".split()
PARTICIPLES = "komm fonnt bruecht bliwwen ginn gaangen kaf giess fort ukomm erakomm erauskomm matkomm".split()

FINDING = ["doc_id", "kind", "text", "start", "end", "suggestion", "message", "confidence"]


def _order() -> Window:
    return Window.partitionBy("doc_id").orderBy("widx")


def germanisms(unknown: DataFrame, listed: DataFrame, reverse: DataFrame | None = None) -> DataFrame:
    """G-01, J-01, J-02. unknown: doc_id, word, start, end; listed: german_key, german, lb, note; reverse: german, lemma, pos, sense, ord (see lexicon.german_hits).

    The list decides first, then the reverse lookup of words of three letters and more, then the shape of a participle. Without a reverse lookup only the list decides.
    """
    prefix, core = X.elision(F.col("word"))
    rows = unknown.select("doc_id", F.col("word").alias("text"), "start", "end", prefix.alias("prefix"), core.alias("core"), F.lower(core).alias("key"))
    rows = rows.join(listed.select(F.col("german_key").alias("key"), "lb", "note"), "key", "left")
    if reverse is not None:
        found = reverse.groupBy(F.lower("german").alias("key")).agg(F.array_sort(F.collect_list(F.struct("ord", "lemma", "pos", "sense"))).alias("hits"))
        rows = rows.join(found, "key", "left")
    else:
        rows = rows.withColumn("hits", F.lit(None).cast("array<struct<ord: int, lemma: string, pos: string, sense: string>>"))
    long = F.length("core") >= 3
    other = F.array_join(F.array_distinct(F.col("hits.lemma")), ", ")
    shape = F.lit(reverse is not None) & long & F.col("core").rlike(r"^ge\p{Ll}+(?:t|en)$")
    confidence = F.when(F.col("lb").isNotNull(), "high").when(long & (F.size("hits") > 0), "medium").when(shape, "low")
    raw = F.when(confidence == "high", F.col("lb")).when(confidence == "medium", other).when(shape, "(look up)")
    cased = F.array_join(F.transform(F.split(raw, ",\\s*"), lambda s: F.concat("prefix", _cased(F.col("core"), s))), ", ")
    suggestion = F.when(raw.startswith("("), raw).otherwise(cased)
    message = F.when(confidence == "high", F.concat(F.lit("a German word"), F.coalesce(F.concat(F.lit(" ("), F.when(F.col("note") != "", F.col("note")), F.lit(")")), F.lit("")))).when(confidence == "medium", "looks German; the dictionary translates it").otherwise("looks like a German participle")
    return rows.where(confidence.isNotNull()).select("doc_id", F.lit("germanism").alias("kind"), "text", "start", "end", suggestion.alias("suggestion"), message.alias("message"), confidence.alias("confidence"))


def _cased(model: Column, text: Column) -> Column:
    return F.when(X.capitalised(model), F.concat(F.upper(X.head(text)), X.tail(text))).otherwise(text)


def article_jobs(words: DataFrame) -> DataFrame:
    """W-05, J-06, G-08. Articles and determiners with the noun that they go with, and the preposition before them."""
    w = _order()
    ahead = F.collect_list(F.struct("text", "lower", "break_after")).over(w.rowsBetween(1, 3))
    rows = words.select("*", ahead.alias("ahead"), F.lag(F.struct("text", "lower", "start", "break_after")).over(w).alias("_before"))
    rows = rows.withColumn("prev", F.when(~F.col("_before.break_after"), F.col("_before")))
    stop_words = [*ARTICLES, *DATIVES, *DATIVE_PREPOSITIONS]
    # The first word of the next three that is a noun, with nothing in the way: 0 open, 1 found, 2 closed.
    start = F.struct(F.when(F.col("break_after"), 2).otherwise(0).alias("state"), F.lit(None).cast("string").alias("noun"))

    def step(acc: Column, x: Column) -> Column:
        noun = X.capitalised(x["text"]) & ~x["text"].rlike("^[dDzZ]'")
        blocked = x["lower"].isin(*stop_words) | (~noun & ~x["text"].rlike(r"^\p{Ll}"))
        state = F.when(acc["state"] != 0, acc["state"]).when(blocked, 2).when(noun, 1).when(x["break_after"], 2).otherwise(0)
        return F.struct(state.alias("state"), F.when((acc["state"] == 0) & (state == 1), x["text"]).otherwise(acc["noun"]).alias("noun"))

    rows = rows.withColumn("head", F.aggregate("ahead", start, step, lambda acc: acc["noun"]))
    elided = F.regexp_extract("text", r"^[dD]'(\p{Lu}(?s:.*))$", 1)
    kind = lookup(ARTICLES, F.col("lower"))
    after_prep = F.coalesce(F.col("prev.lower").isin(*DATIVE_PREPOSITIONS), F.lit(False))
    pronoun = F.col("lower").isin("de", "e") & F.coalesce(F.col("prev.lower").endswith("s") | F.col("prev.lower").endswith("st"), F.lit(False)) & ~after_prep
    determiner = F.col("lower").isin(*DATIVES)
    rows = rows.withColumn("kind", F.when(elided != "", F.when(after_prep, "after-preposition").otherwise("elided")).when(kind.isNotNull() & ~pronoun & F.col("head").isNotNull(), F.when(after_prep & determiner, "after-preposition").otherwise(kind)).when(kind.isNull() & determiner & after_prep, "after-preposition"))
    noun = F.when(elided != "", elided).otherwise(F.coalesce("head", "text"))
    article = F.when(elided != "", F.substring("text", 1, 2)).otherwise(F.col("text"))
    prep = F.when(after_prep, F.struct(F.col("prev.text").alias("text"), F.col("prev.lower").alias("lower"), F.col("prev.start").alias("start")))
    return rows.where("kind is not null").select("doc_id", "widx", "start", "end", "kind", article.alias("article"), noun.alias("noun"), prep.alias("prep"))


def check_articles(words: DataFrame, nouns: DataFrame) -> DataFrame:
    """G-02, G-03, G-04. nouns: form, lemma, gender (M, F, N or null), is_lemma; one row a form (see lexicon.noun_table)."""
    jobs = article_jobs(words).join(nouns.select(F.col("form").alias("_form"), "lemma", "gender", "is_lemma"), (F.col("noun") == F.col("_form")) & X.capitalised(F.col("noun")), "left")
    info, plural = F.col("lemma").isNotNull(), F.col("lemma").isNotNull() & ~F.col("is_lemma")
    g, noun, art = F.col("gender"), F.col("noun"), F.col("article")
    low, article = F.lower(art), F.col("kind")
    # Case: the nominative or accusative after a preposition that takes the dative.
    prep, plow = F.col("prep.text"), F.col("prep.lower")
    contracted = lookup(CONTRACTIONS, plow)
    elided = art.rlike("^[dD]'")
    m, f, pl = (lookup({k: v[i] for k, v in DATIVES.items()}, low) for i in range(3))
    article_case = (
        F.when(plural, F.concat_ws(" ", prep, n_form(F.lit("den"), noun), noun)).when(g == "F", F.concat_ws(" ", prep, F.lit("der"), noun))
        .when(g.isin("N", "M"), F.concat_ws(" ", F.coalesce(contracted, F.concat_ws(" ", prep, F.lit("dem"))), noun)).otherwise(F.concat_ws(" ", prep, F.lit("der/dem/de(n)"), noun))
    )
    form = F.when(plural, F.when(pl == "–", "(no plural)").otherwise(n_form(pl, noun))).when(g == "F", f).when(g.isin("M", "N"), m).otherwise(F.concat(m, F.lit(" (m./n.) / "), f, F.lit(" (f.) / "), n_form(pl, noun), F.lit(" (pl.)")))
    case_suggestion = F.when(elided, article_case).when(m.isNotNull(), F.concat_ws(" ", prep, _cased(art, form)))
    is_case = (article == "after-preposition") & F.col("prep").isNotNull() & case_suggestion.isNotNull()
    # Gender: of headwords in the singular with one gender only.
    sure = info & g.isNotNull() & F.col("is_lemma") & (article != "after-preposition")
    gender = (
        F.when((article == "elided") & (g == "M"), F.concat_ws(" ", _cased(art, n_form(F.lit("den"), noun)), noun))
        .when((article == "def") & (g != "M") & F.col("prep").isNull(), F.concat(_cased(art, F.lit("d'")), noun))
        .when((article == "dative-m") & (g == "F"), _cased(art, F.lit("der"))).when((article == "dative-f") & (g != "F"), _cased(art, F.lit("dem")))
        .when((article == "indef") & (g == "F"), _cased(art, F.lit("eng"))).when((article == "indef-f") & (g != "F"), _cased(art, n_form(F.lit("en"), noun)))
        .when((article == "indef-dative-m") & (g == "F"), _cased(art, F.lit("enger"))).when((article == "indef-dative-f") & (g != "F"), _cased(art, F.lit("engem")))
    )
    said_gender = F.concat(F.col("lemma"), F.lit(" is "), lookup(GENDERS, g))
    out = jobs.select(
        "doc_id", "start", "end", "prep",
        F.filter(F.array(
            F.when(is_case, F.struct(F.lit("case").alias("kind"), F.col("prep.start").alias("start"), case_suggestion.alias("suggestion"), F.concat(prep, F.lit(" takes the dative")).alias("message"), F.when(info, "high").otherwise("medium").alias("confidence"))),
            F.when(sure & gender.isNotNull(), F.struct(F.lit("gender").alias("kind"), F.col("start"), gender.alias("suggestion"), said_gender.alias("message"), F.when(article == "dative-f", "medium").otherwise("high").alias("confidence"))),
            F.when(sure & (article == "dative-m") & (g != "F") & contracted.isNotNull(), F.struct(F.lit("contraction").alias("kind"), F.col("prep.start").alias("start"), F.concat_ws(" ", contracted, noun).alias("suggestion"), F.lit("mostly contracted").alias("message"), F.lit("low").alias("confidence"))),
        ), lambda x: x.isNotNull()).alias("found"),
    )
    return out.select("doc_id", "end", F.explode("found").alias("x")).select("doc_id", "x.kind", "x.start", "end", "x.suggestion", "x.message", "x.confidence")


def looks_like_participle(text: Column, lower: Column) -> Column:
    shaped = lower.contains("ge") | lower.rlike(r"^(?:be|ver|ent|zer|er)\p{L}{3,}") | lower.rlike("(?:éiert|komm)$") | lower.isin(*PARTICIPLES)
    return ~X.capitalised(text) & (F.length(lower) >= 3) & ~lower.isin(*NO_PARTICIPLES, *TO_SINN, *TO_HUNN) & shaped


def auxiliary_candidates(words: DataFrame, most: int = 3) -> DataFrame:
    """W-06, J-07. For each auxiliary its likely participles, best first (n from 1): after it the last of its clause first; before it, if it ends its clause, the two words before.

    words: of tokens.words; or of tokens.clauses, without offsets: then start, end and next are not given, and no row is moved.
    """
    whole = "widx" in words.columns
    rows = _clauses_of(words) if whole else words.withColumn("more", F.lit(None).cast("array<struct<start: int>>"))
    is_aux = lambda x: x.isin(*TO_SINN, *TO_HUNN)
    rows = rows.select("*", F.transform("words", F.lower).alias("lowers")).where(F.exists("lowers", is_aux))
    at = F.filter(F.transform("lowers", lambda x, i: F.when(is_aux(x), i)), lambda i: i.isNotNull())
    rows = rows.select("*", at.alias("at"), F.size("words").alias("size"))

    # A participle after an auxiliary has no other auxiliary between them; one before it is at most two words away.
    def one(i: Column, k: Column) -> Column:
        behind = i == F.col("size") - 1
        start, stop = F.when(behind, F.greatest(i - 2, F.lit(0))).otherwise(i + 1), F.when(behind, i).otherwise(F.coalesce(F.get("at", k + 1), F.col("size")))
        return F.struct(
            (F.col("first") + i).alias("widx"), F.get("words", i).alias("text"), F.get("lowers", i).alias("lower"), F.get("more", i).alias("more"),
            behind.cast("int").alias("side"), (F.col("first") + start).alias("from"), F.slice("words", start + 1, stop - start).alias("near"),
        )

    aux = rows.select("doc_id", F.explode(F.transform("at", one)).alias("x")).select("doc_id", "x.*")
    likely = F.transform("near", lambda x, i: F.when(looks_like_participle(x, F.lower(x)), F.struct((F.col("from") + i).alias("pidx"), x.alias("participle"))))
    found = F.slice(F.reverse(F.filter(likely, lambda x: x.isNotNull())), 1, most)
    aux = aux.select("doc_id", "widx", "text", "lower", "more", "side", F.posexplode(found).alias("_k", "x"))
    return aux.select("doc_id", "widx", "text", "lower", *(["more.*"] if whole else []), "x.*", "side", (-F.col("x.pidx")).alias("rank"), (F.col("_k") + 1).alias("n"))


def _clauses_of(words: DataFrame) -> DataFrame:
    """The rows of tokens.clauses, of tokens.words; more: of each word start, end, and the next word of its document."""
    rows = words.select("*", F.lead("text").over(_order()).alias("next"))
    rows = rows.groupBy("doc_id", "clause").agg(F.array_sort(F.collect_list(F.struct("widx", "text", "start", "end", "next"))).alias("w"))
    return rows.select("doc_id", "clause", F.col("w")[0]["widx"].alias("first"), F.col("w.text").alias("words"), F.transform("w", lambda x: F.struct(x["start"], x["end"], x["next"])).alias("more"))


def check_auxiliaries(words: DataFrame, participles: DataFrame) -> DataFrame:
    """G-05, J-04. participles: form (lower case), lemma, aux (hunn, sinn, both). The first candidate that the table knows decides."""
    table = participles.select("form", "lemma", F.col("aux").alias("takes"))
    rows = auxiliary_candidates(words)
    low = F.lower("participle")
    rows = rows.withColumn("_a", low).withColumn("_b", F.when(low.endswith("e"), F.concat(low, F.lit("n"))))
    rows = rows.join(table.withColumnsRenamed({"form": "_a", "lemma": "lemma_a", "takes": "takes_a"}), "_a", "left").join(table.withColumnsRenamed({"form": "_b", "lemma": "lemma_b", "takes": "takes_b"}), "_b", "left")
    rows = rows.withColumn("lemma", F.coalesce("lemma_a", "lemma_b")).withColumn("takes", F.coalesce("takes_a", "takes_b")).where("lemma is not null")
    first = Window.partitionBy("doc_id", "widx").orderBy("n")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    sinn, hunn = lookup(TO_SINN, F.col("lower")), lookup(TO_HUNN, F.col("lower"))
    wrong_hunn, wrong_sinn = (F.col("takes") == "sinn") & sinn.isNotNull(), (F.col("takes") == "hunn") & hunn.isNotNull()
    following = F.coalesce("next", F.lit("."))
    suggestion = F.when(wrong_hunn, _cased(F.col("text"), n_form(sinn, following))).otherwise(_cased(F.col("text"), hunn))
    message = F.concat(F.col("lemma"), F.lit(" forms the perfect with "), F.col("takes"))
    return rows.where(wrong_hunn | wrong_sinn).select("doc_id", F.lit("auxiliary").alias("kind"), "text", "start", "end", suggestion.alias("suggestion"), message.alias("message"), F.when(wrong_hunn, "high").otherwise("low").alias("confidence"))


def check_grammar(docs: DataFrame, words: DataFrame, nouns: DataFrame, participles: DataFrame, unknown: DataFrame | None = None, listed: DataFrame | None = None, reverse: DataFrame | None = None) -> DataFrame:
    """G-09, U-01. All grammar findings. docs: doc_id, text."""
    articles = check_articles(words, nouns).join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id").withColumn("text", F.expr("substring(_text, start + 1, end - start)"))
    out = articles.select(*FINDING).unionByName(check_auxiliaries(words, participles).select(*FINDING))
    if unknown is not None and listed is not None:
        out = out.unionByName(germanisms(unknown, listed, reverse).select(*FINDING))
    return out
