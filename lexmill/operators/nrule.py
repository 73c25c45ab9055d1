"""The rule of the final n (N-01 to N-08): where it stays, where it falls, and who is subject to it.

What the next sound asks for is one CASE over the next token; which words are subject is a lookup in a word list and, if
given, in a table of n-rule forms. Lookups are joins, so no text is checked less than another: there is no budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from .tokens import PAUSES, neighbours

# Fixed values of the language.
#: Letters whose name begins with a vowel or d, h, n, t, z.
NAMED_KEEP, NAMED_DROP = "acdefhilmnorstuxyz", "bgjkpqvw"
VOWELS, KEEPING = "aeiouäëéèêîïôöüûàâáíóúœæ", "dhntz"
SPOKEN_DJ = r"(?iu)^(?:jobs?|jobb|jeans|jazz|jeep|jets?|joker|joint|joystick|juice|junk|jumbo|james|john|jack(?!ett)|jam|jingle|junior|jury|jogg|gin|gentleman|gym)"
SPOKEN_TSCH = r"(?iu)^(?:charter|chat|check|chips?|champion|challenge|chart|cheese|chill|chopper|church|coach)"
SPOKEN_WJ = r"(?iu)^(?:one|once|use|user|usa(?![a-z0-9_])|unicef|uni(?:form|on|t|versal|verse)(?![a-z0-9_]))"
SPOKEN_DG = r"(?i)^g(?:entleman|in(?![a-z0-9_])|ym)"
OPTIONAL_BEFORE = "si se säin seng senger sengem sengen sengt sech sou".split()
PAIRS = dict(
    den="de", en="e", een="ee", keen="kee", deen="dee", wien="wie", hien="hie", mäin="mäi", däin="däi", säin="säi", an="a", un="u", vun="vu", wann="wa",
    dann="da", hunn="hu", ginn="gi", sinn="si", kann="ka", schonn="scho", geschwënn="geschwë", jiddereen="jidderee", iergendeen="iergendee", gesinn="gesi",
    stinn="sti", dinn="di", eisen="eise", ären="äre", hiren="hire", iren="ire", mengen="menge", dengen="denge", sengen="senge", dësen="dëse", kengen="kenge",
    dën="dë", fein="fei", schéin="schéi", zwéin="zwéi", nun="nu", hin="hi",
)
#: Forms without n that are no words of their own, and how sure that is.
RESTORED = {
    "high": dict(a="an", u="un", vu="vun", hie="hien", wa="wann", hu="hunn", gi="ginn", ka="kann", scho="schonn", geschwë="geschwënn", kee="keen", wie="wien", mäi="mäin", däi="däin", säi="säin", jidderee="jiddereen", iergendee="iergendeen"),
    "medium": dict(da="dann", ee="een", dee="deen", schéi="schéin", fei="fein", de="den", e="en"),
}
SURE_AT_PAUSE = "hu gi ka scho geschwë hie wie kee".split()
EN_EXCEPTIONS = "examen pollen amen ren den en".split()
FRENCH_ENDING = "(?:ge|che|ce|le|re|se|te|ne|ie|ue|ée|de)$"


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def number_keeps_n(text: Column) -> Column:
    """N-01. Whether a number, read aloud, begins with a vowel or d, h, n, t, z; null if it is none, or a million and more."""
    n = F.regexp_extract(F.regexp_replace(text, f"[.'{P.SPACE}]", ""), "^([0-9]+)", 1).try_cast("bigint")
    below_ten = lambda x: x.isin(0, 1, 2, 3, 8, 9)

    def below_thousand(x: Column) -> Column:
        hundred = F.floor(x / 100)
        return (
            F.when(x < 10, below_ten(x)).when(x < 20, x.isin(10, 11, 12, 13, 18, 19)).when((x < 100) & (x % 10 != 0), below_ten(x % 10)).when(x < 100, x.isin(20, 30, 80, 90)).otherwise((hundred == 1) | below_ten(hundred))
        )

    thousand = F.floor(n / 1000)
    return F.when(n < 1000, below_thousand(n)).when(n < 1_000_000, (thousand == 1) | below_thousand(thousand))


def _said(ctx: str, rule: str = "6.1.1") -> Column:
    return F.struct(F.lit(ctx).alias("ctx"), F.lit(rule).alias("rule"))


def word_context(raw: Column) -> Column:
    """N-02. What a word asks of an n before it: a struct of ctx (keep, drop, optional, unknown) and rule."""
    w = X.straight(raw)
    w = F.when(w.rlike("(?i)^'[a-z]"), X.tail(w)).otherwise(w)
    c, short = F.lower(X.head(w)), F.regexp_extract(w, "^([A-ZÄËÉÖÜ]{2,6})(?:$|[-0-9]|[a-z]{1,2}$)", 1)
    named = lambda x: F.when(x.isin(*NAMED_KEEP), _said("keep")).when(x.isin(*NAMED_DROP), _said("drop"))
    letter = w.rlike(r"^\p{L}[0-9]*$") & c.isin(*NAMED_KEEP, *NAMED_DROP)
    either = lambda cond: F.when(cond, _said("keep")).otherwise(_said("drop"))
    return (
        F.when(w == "", _said("unknown"))
        .when(F.lower(w).isin(*OPTIONAL_BEFORE), _said("optional", "6.2.1"))
        .when(raw == "s", _said("optional", "4.4.1"))
        .when(letter, named(c))
        .when(short != "", F.coalesce(named(F.lower(X.head(short))), _said("unknown")))
        .when(c == "y", _said("unknown"))
        .when(c.isin(*VOWELS) & w.rlike(SPOKEN_WJ), _said("optional"))
        .when(c.isin(*VOWELS, *KEEPING), _said("keep"))
        .when(c == "j", either(w.rlike(SPOKEN_DJ)))
        .when(w.rlike("(?i)^ch"), either(w.rlike(SPOKEN_TSCH)))
        .when(w.rlike("(?iu)^c[eiyéè]"), _said("optional"))
        .when(w.rlike(SPOKEN_DG), _said("keep"))
        .when(c.rlike(r"\p{L}"), _said("drop"))
        .otherwise(_said("unknown"))
    )


def token_context(kind: Column, text: Column, end_is_pause: bool = True) -> Column:
    """N-03. The same for any next token; a null kind is the end of the text."""
    number = number_keeps_n(text)
    return (
        F.when(kind.isNull(), _said("keep", "6.1.2.4") if end_is_pause else _said("unknown"))
        .when((kind == "punct") & text.isin(*PAUSES), _said("keep", "6.1.2.4"))
        .when((kind == "punct") & (text == "-"), _said("unknown", "6.1.2.5"))
        .when(kind == "punct", _said("unknown"))
        .when((kind == "number") & number.isNull(), _said("unknown"))
        .when(kind == "number", F.when(number, _said("keep")).otherwise(_said("drop")))
        .otherwise(word_context(text))
    )


def n_form(with_n: Column, next_word: Column) -> Column:
    """G-07. A form without its final n where the next word lets it fall."""
    return F.when(word_context(next_word)["ctx"] == "drop", F.regexp_replace(with_n, "nn?$", "")).otherwise(with_n)


def known(rows: DataFrame, wordlist: DataFrame, **forms: Column) -> DataFrame:
    """rows plus a boolean for each named form: whether it is in wordlist (form). The list is joined once, over all forms of a row."""
    for name, form in forms.items():
        listed = wordlist.select(F.col("form").alias(f"_{name}")).distinct()
        rows = rows.withColumn(f"_form_{name}", form).join(listed, F.col(f"_form_{name}") == F.col(f"_{name}"), "left").withColumn(name, F.col(f"_{name}").isNotNull()).drop(f"_{name}", f"_form_{name}")
    return rows


FINDING = ["doc_id", "word", "start", "end", "suggestion", "next_word", "direction", "confidence", "rule", "lod_confirmed"]


def check_n_rule(tokens: DataFrame, wordlist: DataFrame, n_forms: DataFrame | None = None, end_is_pause: bool = True) -> DataFrame:
    """N-04 to N-08. tokens as tokenize() gives them; wordlist: form; n_forms: form, n_form (null where the lemma has none).

    Per finding: doc_id, word, start, end, suggestion, next_word, direction (drop-n, add-n), confidence, rule, lod_confirmed.
    """
    near = neighbours(tokens).withColumn("word", X.straight(F.col("text")))
    prefix = F.regexp_extract("word", "^([dDzZ]')", 1)
    rest = F.substring(F.col("word"), F.length(prefix) + 1, F.length("word"))
    near = near.select("*", prefix.alias("prefix"), F.element_at(F.split(rest, "-"), -1).alias("bare"))
    back = {f: (n, c) for c, forms in RESTORED.items() for f, n in forms.items()}
    single = near.where((F.col("bare") != "") & ~F.col("bare").rlike("'$|^'") & ~F.col("hashtag") & ~F.col("word").contains("-")).withColumn("lower", F.lower("bare"))
    ends_n = F.col("lower").endswith("n")
    # Only words that the rule can concern at all are asked what stands after them.
    may_fall = ends_n if n_forms is not None else ends_n & (F.col("lower").isin(*PAIRS) | F.col("lower").rlike("[^e]en$"))
    single = single.where(may_fall | (~ends_n & (F.col("lower").isin(*back) | F.col("lower").rlike("[^e]e$"))))
    # The long CASE stands once, behind a generator that filters are not pushed through and that generates no code of its own, so that it is compiled in parts.
    context = token_context(F.col("next_type"), F.col("next_text"), end_is_pause)
    single = single.select("*", F.stack(F.lit(1), context).alias("c")).where(F.col("c.ctx") == F.when(ends_n, "drop").otherwise("keep"))
    single = single.withColumn("cap", X.capitalised(F.col("bare")) & ~F.col("initial"))
    drop = F.col("c.ctx") == "drop"
    stem = F.expr("substring(bare, 1, length(bare) - 1)")
    single = known(single, wordlist, is_word=F.col("bare"), is_stem=F.when(drop, stem), is_longer=F.when(~drop, F.concat("bare", F.lit("n"))))
    asked = F.when(drop, F.col("bare")).otherwise(F.concat("bare", F.lit("n")))
    if n_forms is None:
        single = single.withColumn("lemma_known", F.lit(False)).withColumn("form", F.lit(None).cast("string"))
    else:
        table = n_forms.groupBy(F.col("form").alias("_asked")).agg(F.min("n_form").alias("form")).withColumn("lemma_known", F.lit(True))
        single = single.withColumn("_key", asked).join(table, F.col("_key") == F.col("_asked"), "left").drop("_key", "_asked").withColumn("lemma_known", F.coalesce("lemma_known", F.lit(False)))
    lower, cap, bare = F.col("lower"), F.col("cap"), F.col("bare")

    # Falling n: who is subject (N-04), and what a lexicon adds (N-05).
    listed = lookup(PAIRS, lower)
    en = lower.rlike("[^e]en$") & (F.length(lower) >= 4) & ~lower.isin(*EN_EXCEPTIONS)
    spared = ((F.lower("prev_word") == "zu") & cap) | (listed.isNotNull() & cap) | (listed.isNull() & (lower.endswith("äin") | (cap & lower.endswith("een")) | (en & cap & ~F.col("is_word"))))
    base = F.when(listed.isNotNull(), X.like_case(bare, listed, all_caps=True)).when(en & F.col("is_stem"), stem)
    sure = F.when(listed.isNotNull(), "high").when(en & F.col("is_stem"), F.when(cap, "low").otherwise("medium"))
    may_ask = (F.coalesce(sure, F.lit("")) != "high") & ~(cap & ~lower.endswith("en"))
    confirmed_fall = drop & may_ask & F.coalesce(F.col("form") != "", F.lit(False))
    fall = F.when(confirmed_fall, X.like_case(bare, F.col("form"), all_caps=True)).otherwise(base)
    fall_sure = F.when(confirmed_fall, "high").when(may_ask & F.col("lemma_known") & (sure == "medium"), "low").otherwise(sure)

    # Missing n (N-06).
    pause = F.col("c.rule") == "6.1.2.4"
    pronoun = ((lower == "de") & F.coalesce(F.col("prev_word").rlike("(?i)(?:s|st|z|x)$"), F.lit(False))) | ((lower == "e") & pause)
    longer = lookup({f: n for f, (n, _) in back.items()}, lower)
    trust = lookup({f: c for f, (_, c) in back.items()}, lower)
    trust = F.when(lower.isin("de", "e") & F.coalesce(F.col("next_text").rlike(r"^\p{Ll}"), F.lit(False)), "low").when(pause & ~lower.isin(*SURE_AT_PAUSE), "low").otherwise(trust)
    open_e = lower.rlike("[^e]e$") & (F.length(lower) >= 4) & (~X.capitalised(bare) | pause) & F.col("is_longer")
    confirmed = F.coalesce(F.lower("form") == lower, F.lit(False))
    weak = F.when(confirmed, "high").when(pause & ~X.capitalised(bare) & ~lower.rlike(FRENCH_ENDING), "medium").otherwise("low")
    stay = X.like_case(bare, F.coalesce(longer, F.when(open_e, F.concat(bare, F.lit("n")))), all_caps=True)
    stay_sure = F.when(longer.isNotNull(), trust).when(open_e, weak)

    # Both in one projection: the tokens are gone through once.
    good = F.when(drop, ~F.coalesce(spared, F.lit(False))).otherwise(~pronoun)
    found = single.select(
        "doc_id", "word", "start", "end", "prefix", "quoted", F.coalesce("next_text", F.lit("(end)")).alias("next_word"), good.alias("good"), F.when(drop, fall).otherwise(stay).alias("suggestion"), F.when(drop, fall_sure).otherwise(stay_sure).alias("confidence"),
        F.when(drop, "drop-n").otherwise("add-n").alias("direction"), F.when(~drop & pause, "6.1.2.4").otherwise("6.1.1").alias("rule"), confirmed_fall.alias("lod_confirmed"),
    ).where("good and suggestion is not null and confidence is not null")
    found = found.select("doc_id", "word", "start", "end", F.concat("prefix", "suggestion").alias("suggestion"), "next_word", "direction", F.when(F.col("quoted"), "low").otherwise(F.col("confidence")).alias("confidence"), "rule", "lod_confirmed")
    return found.unionByName(compounds(tokens, wordlist))


def compounds(tokens: DataFrame, wordlist: DataFrame) -> DataFrame:
    """N-07. The rule between the parts of a word with hyphens."""
    whole = tokens.where("type = 'word'").withColumn("word", X.straight(F.col("text"))).where(F.col("word").contains("-") & ~F.col("word").rlike("^-|-$"))
    parts = F.split("word", "-")
    each = whole.select("doc_id", "start", parts.alias("parts"), F.posexplode(parts).alias("k", "part"))
    each = each.where(F.col("k") < F.size("parts") - 1).withColumn("next", F.col("parts")[F.col("k") + 1])
    offset = F.coalesce(F.length(F.array_join(F.slice("parts", F.lit(1), F.col("k")), "-")) + F.when(F.col("k") > 0, 1).otherwise(0), F.lit(0))
    each = each.withColumn("at", (F.col("start") + offset).cast("int")).withColumn("lower", F.lower("part"))
    each = each.where((F.col("part") != "") & (F.col("next") != "") & F.col("lower").endswith("n") & (word_context(F.col("next"))["ctx"] == "drop"))
    stem = F.expr("substring(part, 1, length(part) - 1)")
    each = known(each, wordlist, is_word=F.col("part"), is_stem=stem)
    listed = lookup(PAIRS, F.col("lower"))
    name = (F.col("k") > 0) & X.capitalised(F.col("part")) & ~F.col("is_word")
    plain = F.col("lower").rlike("[^e]en$") & ~name & F.col("is_word") & F.col("is_stem")
    each = each.withColumn("suggestion", F.coalesce(X.like_case(F.col("part"), listed, all_caps=True), F.when(plain, stem))).where("suggestion is not null")
    return each.select(
        "doc_id", F.col("part").alias("word"), F.col("at").alias("start"), (F.col("at") + F.length("part")).cast("int").alias("end"), "suggestion", F.col("next").alias("next_word"),
        F.lit("drop-n").alias("direction"), F.lit("medium").alias("confidence"), F.lit("6.1.2.5").alias("rule"), F.lit(False).alias("lod_confirmed"),
    )
