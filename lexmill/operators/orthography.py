"""Orthography checks (O-01 to O-19): patterns with guards, judged in the JVM.

All patterns of a text are tried in one projection; texts without a match stop there. The others are dealt out once,
by document and check, and the offsets of matches are running sums of the lengths of matches and of what lies between.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

L = P.LETTER
B, E = P.NOT_BEFORE, P.NOT_AFTER

# Fixed values of the language and of its orthography's paragraphs.
UNITS = "%|€|EUR|mm|cm|km|kg|mg|ml|cl|m²|m³|qm|°C|°F|kW|MHz|GB|MB"
WEEKDAYS = "Méindeg Dënschdeg Mëttwoch Donneschdeg Freideg Samschdeg Sonndeg".split()
DAY_ADVERBS = "méindes dënschdes mëttwochs donneschdes freides samschdes sonndes moies mëttes owes nuets nomëttes mueres".split()
TIME_ADVERBS = "gëschter virgëschter hënt iwwermuer".split()
DAYTIMES = "moien mueren mëtteg mëtten nomëtteg owend nuecht".split()
LINKING = "wann ob wat wou wéi datt dass well wéini firwat déi dat deen wien wéivill soubal nodeems obschonns".split()
SUBORDINATE = "datt dass well ob obschonns obwuel nodeems iwwerdeems soubal esoubal zanterdeems".split()
NO_COMMA_AFTER = "fir ouni ausser sou esou amplaz bis egal jee nodeem och souguer grad just net mee awer ma an a oder respektiv wéi als Sekonnen Minutten Stonnen Deeg Woch Wochen Méint Joer Joren kuerz laang".split()
REPORTING = "sot seet huet freet rifft mengt duecht schreift".split()
SHORTENED = "asw usw etc ca evtl allg".split()


#: Characters before a match that its guards may look at.
NEAR = 64


def title(word: Column) -> Column:
    return F.concat(F.upper(X.head(word)), X.tail(word))


def sentence_start(before: Column) -> Column:
    """The third definition of a sentence's start (W-03): nothing before but quotation marks and brackets, or an end mark before those."""
    bare = F.regexp_replace(before, f"[{P.SPACE}„“\"«»'’(]+$", "")
    return (bare == "") | bare.rlike("[.!?…:]$")


@dataclass(frozen=True)
class Check:
    """One pattern. Span and texts are made from a match m (fields hit, g1, g2, g3, start, before: the last NEAR characters up to the match)."""

    id: str
    rule: str | Callable[[Column], Column]
    pattern: str
    suggestion: Callable[[Column], Column]
    message: str
    confidence: str | Callable[[Column], Column] = "high"
    guard: Callable[[Column], Column] | None = None
    skip: Callable[[Column], Column] | None = None  # characters of the match before the span
    shown: Callable[[Column], Column] | None = None  # the text that the finding shows; the span if None
    needs: tuple[str, ...] = ()  # a text without any of these has no match: most texts are spared the pattern


def _lacks(m: Column, letters: str) -> Column:
    return ~m.rlike(letters)


_SECOND = {"skip": lambda m: F.length(m.g1)}

CHECKS: tuple[Check, ...] = (
    Check(
        "punct-space", lambda m: F.when(m.g3 == "!", "10.2.2").when(m.g3 == "?", "10.2.3").when(m.g3 == ";", "10.3.3").otherwise("10.3.4"),
        f"([{L}0-9)“”\"»])( +|\\u00a0|\\u202f)([!?;:])(?![0-9])", lambda m: m.g3, "no space stands before this mark", **_SECOND, needs=(" !", " ?", " ;", " :", "\u00a0", "\u202f"),
    ),
    Check(
        "abbreviation", "8.5.1", f"(?<![{L}.])((?:[{L}]{{1,2}}\\.){{2,}})(?![{L}])", lambda m: F.rtrim(F.replace(m.g1, F.lit("."), F.lit(". "))),
        "each part of an abbreviation of several words takes a space after its point", guard=lambda m: _lacks(m.g1, f"(?i)^(?:{'|'.join(SHORTENED)})\\."),
    ),
    Check("unit-space", "8.5.1", f"(?<![{L}0-9.,])([0-9]+(?:[.,][0-9]+)?)({UNITS})(?![{L}0-9])", lambda m: F.concat_ws(" ", m.g1, m.g2), "a number and its unit are parted by a space"),
    Check("capitalisation", "8.3", f"{B}({'|'.join(d.lower() for d in WEEKDAYS)}){E}", lambda m: title(m.g1), "weekdays are nouns with a capital letter", needs=("deg", "mëttwoch")),
    Check(
        "capitalisation", "8.3", f"{B}({'|'.join(d.capitalize() for d in DAY_ADVERBS + TIME_ADVERBS)}){E}", lambda m: F.lower(m.g1), "adverbs of time have a small letter",
        lambda m: F.when(F.lower(m.g1).isin(*TIME_ADVERBS), "medium").otherwise("high"), lambda m: ~sentence_start(m.before),
    ),
    Check(
        "capitalisation", "8.3", f"(?iu){B}((?:vir)?gëschter)[{P.SPACE}]+({'|'.join(DAYTIMES)}){E}", lambda m: title(m.g2), "a time of day after gëschter has a capital letter",
        guard=lambda m: ~X.capitalised(m.g2), skip=lambda m: F.length(m.hit) - F.length(m.g2),
    ),
    Check(
        "capitalisation", "8.7.5", f"(?<![.])([.!?])( +)(\\p{{Ll}}[{L}]*)", lambda m: title(m.g3), "a sentence begins with a capital letter", "medium",
        lambda m: _lacks(F.concat(F.right(m.before, F.lit(12)), m.g1), f"(?:^|[{P.SPACE}(.])(?:\\p{{L}}{{1,4}}|{'|'.join(SHORTENED)}|Nr|Tel|Dr|[0-9]+)\\.$") & ((m.g1 == ".") | _lacks(m.g3, f"(?iu)^(?:{'|'.join(REPORTING)})$")),
        skip=lambda m: F.length(m.g1) + F.length(m.g2),
    ),
    Check("e-accent", "2.2.3", f"{B}([{L}]*?)ë(ch|ck|ng|nk|x)([{L}]*)", lambda m: F.concat(m.g1, F.lit("é"), m.g2, m.g3), "é stands before ch, ck, ng, nk and x, never ë", needs=("ë",)),
    Check("e-accent", "2.2.3", f"{B}([{L}]*?)é(sch)([{L}]*)", lambda m: F.concat(m.g1, F.lit("ë"), m.g2, m.g3), "ë stands before sch, never é", needs=("ésch",)),
    Check("eszett", "4.3.4.2", f"[{L}]*ß[{L}]*", lambda m: F.replace(m.hit, F.lit("ß"), F.lit("ss")), "the language has no ß; it writes ss", needs=("ß",)),
    Check("apostrophe", "2.3.3", f"{B}([dDzZ])[{P.SPACE}]*[´`][{P.SPACE}]*([{L}])", lambda m: F.concat(m.g1, F.lit("’"), m.g2), "an apostrophe is meant, not an accent", needs=("´", "`")),
    Check("apostrophe", "10.5.1", f"{B}([dD])(['’]) +(\\p{{Lu}}[{L}]*)", lambda m: F.concat(m.g1, m.g2, m.g3), "the shortened article stands close to its noun", needs=("' ", "’ ")),
    Check("apostrophe", "8.7.5", f"(^|[.!?][{P.SPACE}]+)(['’])T(?=[{P.SPACE}])", lambda m: F.concat(m.g2, F.lit("t")), "a small letter follows an apostrophe that begins a sentence", **_SECOND, needs=("'T", "’T")),
    Check("apostrophe", "2.3.3", f"{B}([zZ])['’]([{L}]+)", lambda m: F.concat(m.g1, F.lit("e "), m.g2), "ze keeps its e in standard texts", "low", lambda m: F.lower(m.g2) != "iessen", needs=("'", "’")),
    Check("linking-s", "4.4.1", f"(?iu){B}({'|'.join(LINKING)})(['’]?s) +(de|du|d['’]){E}", lambda m: F.concat(m.g1, F.lit(" s "), m.g3), "the linking s stands alone"),
    Check("dash", "10.3.5", f"(?<=[{L}.,!?“”\"]) - (?=[{L}„\"])", lambda m: F.lit(" – "), "between words stands a dash, not a hyphen", "medium", needs=(" - ",)),
    Check("quotes", "10.4.1", f"\"([^\"\\n]{{1,200}})\"|«[{P.SPACE}]?([^»\\n]{{1,200}}?)[{P.SPACE}]?»", lambda m: F.concat(F.lit("„"), F.when(m.g1 != "", m.g1).otherwise(m.g2), F.lit("“")), "quotations stand between low and high marks", "low", needs=('"', "«")),
    Check(
        "comma", "10.3.1.3", f"(?iu){B}([{L}]+)( +)({'|'.join(SUBORDINATE)}){E}", lambda m: F.concat(m.g1, F.lit(", "), m.g3), "a comma parts a subordinate clause", "medium",
        lambda m: ~F.lower(m.g1).isin(*[w.lower() for w in NO_COMMA_AFTER]), shown=lambda m: F.concat_ws(" ", m.g1, m.g3),
    ),
)
IDS = tuple(dict.fromkeys(c.id for c in CHECKS))


class _Match:
    """The fields of a match by name, for the functions above."""

    def __init__(self):
        self.hit, self.g1, self.g2, self.g3, self.start = (F.col(n) for n in ("hit", "g1", "g2", "g3", "at"))
        self.before = F.col("before")


def _groups(pattern: str) -> int:
    return len(re.findall(r"(?<!\\)\((?!\?)", pattern))


def check_orthography(docs: DataFrame, only: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """O-19, P-13. Findings of all checks, or of those named: doc_id, check, rule, text, start, end, suggestion, message, confidence.

    Of several findings of one check at one place the first stays (W-07): the order of CHECKS decides.
    """
    checks = [(k, c) for k, c in enumerate(CHECKS) if only is None or c.id in only]
    text = F.col("_text")

    def found(k: int, c: Check) -> Column:
        pattern = F.lit(c.pattern)
        parts = [F.regexp_extract_all(text, pattern, F.lit(g)) if g <= _groups(c.pattern) else F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda _: F.lit("")) for g in range(4)]
        whole = F.struct(F.lit(k).alias("seq"), F.split(text, c.pattern, -1).alias("gap"), *[p.alias(n) for p, n in zip(parts, ("hit", "g1", "g2", "g3"))])
        match = text.rlike(c.pattern)
        if c.needs:
            match = functools.reduce(lambda x, y: x | y, (text.contains(n) for n in c.needs)) & match
        return F.when(match, whole)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    def placed(f: Column) -> Column:
        """The matches of one check with their places and what stands before them: a fold over what lies between, so that no match carries its text along."""
        z = F.slice(F.arrays_zip(f["gap"].alias("gap"), f["hit"].alias("hit"), f["g1"].alias("g1"), f["g2"].alias("g2"), f["g3"].alias("g3")), F.lit(1), F.size(f["hit"]))
        match = "struct<at: int, before: string, hit: string, g1: string, g2: string, g3: string>"
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<{match}>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            at, tail = acc["at"] + F.length(x["gap"]), F.right(F.concat(acc["tail"], x["gap"]), F.lit(NEAR))
            out = F.struct(at.alias("at"), tail.alias("before"), x["hit"].alias("hit"), x["g1"].alias("g1"), x["g2"].alias("g2"), x["g3"].alias("g3"))
            return F.struct((at + F.length(x["hit"])).alias("at"), F.right(F.concat(tail, x["hit"]), F.lit(NEAR)).alias("tail"), F.concat(acc["out"], F.array(out)).alias("out"))

        return F.aggregate(z, start, step, lambda acc: acc["out"])

    hits = rows.select("doc_id", F.explode(F.filter(F.array(*[found(k, c) for k, c in checks]), lambda x: x.isNotNull())).alias("f"))
    each = hits.select("doc_id", F.col("f.seq").alias("seq"), F.explode(placed(F.col("f"))).alias("m")).select("doc_id", "seq", "m.*")

    def pick(value: Callable[[Check, _Match], Column]) -> Column:
        m = _Match()
        out = None
        for k, c in checks:
            case = (F.col("seq") == k, value(c, m))
            out = F.when(*case) if out is None else out.when(*case)
        return out

    as_column = lambda v, m: v(m) if callable(v) else F.lit(v)
    if not checks:
        each = each.where(F.lit(False))
        checks = [(0, CHECKS[0])]
    good = each.where(pick(lambda c, m: c.guard(m) if c.guard else F.lit(True)))
    start = (F.col("at") + pick(lambda c, m: c.skip(m) if c.skip else F.lit(0))).cast("int")
    end = (F.col("at") + F.length("hit")).cast("int")
    out = good.select(
        "doc_id", pick(lambda c, m: F.lit(c.id)).alias("check"), pick(lambda c, m: as_column(c.rule, m)).alias("rule"),
        pick(lambda c, m: c.shown(m) if c.shown else F.substring("hit", (c.skip(m) if c.skip else F.lit(0)) + 1, F.length("hit"))).alias("text"),
        start.alias("start"), end.alias("end"), pick(lambda c, m: c.suggestion(m)).alias("suggestion"),
        pick(lambda c, m: F.lit(c.message)).alias("message"), pick(lambda c, m: as_column(c.confidence, m)).alias("confidence"), "seq",
    )
    first = Window.partitionBy("doc_id", "start", "check").orderBy("seq", "end")
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "seq")


def rule_hints(unknown: DataFrame, word_col: str = "word", suggestions_col: str = "suggestions") -> DataFrame:
    """H-13. unknown plus hints: an array of (rule, hint) for why a word may be misspelt."""
    w = F.regexp_replace(word_col, "^[dDzZ]['’]", "")
    has = lambda p: w.rlike(p)
    bare = F.regexp_replace(w, "(?i)^(.*?)[aeiouäöü]h", "$1")
    conditions = (
        (has("ß"), "4.3.4.2", "ß is written ss"),
        (has("(?i)[aeiouäöü]h(?![aeiouäöüëé])[bcdfgklmnpqrstvwxz]") & ~bare.rlike("(?i)ch|sch|th|ph|rh"), "4.3.1", "no h marks a long vowel"),
        (has("(?i)ie(?![rh])[bcdfgklmnpqstvwxz]") & ~F.exists(suggestions_col, lambda s: s.contains("ie")), "1.2.3", "ie is a diphthong; a long i is ii"),
        (has("ë(?:ch|ck|ng|nk|x)"), "2.2.3", "é stands before ch, ck, ng, nk and x"),
        (has("(?i)ph"), "4.3.6.2", "f is mostly the main spelling"),
        (has(r"^\p{Ll}") & F.exists(suggestions_col, lambda s: (F.lower(s) == F.lower(w)) & X.capitalised(s)), "8.1.1", "nouns have a capital letter"),
        (~has(r"([aeiou])\1") & has("(?:tz|ck)$") & has("au|ei|äi|éi|ou|ie|ue"), "4.1.3", "no doubled consonant follows a diphthong"),
    )
    hints = F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(h).alias("hint"))) for c, r, h in conditions])
    return unknown.withColumn("hints", F.filter(hints, lambda x: x.isNotNull()))
