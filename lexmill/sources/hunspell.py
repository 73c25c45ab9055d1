"""Dictionaries with affix rules (S-14): the forms that a .dic file and the rules of its .aff file make, as one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directives of the format that bear on which forms are words. None of them stands more than once in a file.
OPTIONS = ["SET", "FLAG", "NEEDAFFIX", "PSEUDOROOT", "FORBIDDENWORD", "ONLYINCOMPOUND", "AF"]


@dataclass
class Affixes:
    """rules: flag, suffix (else a prefix), crossing, strip, add, more (the flags of what it makes), fits (a pattern for the word). options: directive to value."""

    rules: DataFrame
    options: dict[str, str]

    def flags(self, text: Column) -> Column:
        """The flags written in a text: single characters, pairs or numbers."""
        kind = self.options.get("FLAG", "")
        if kind == "num":
            return F.filter(F.split(text, ","), lambda f: f != "")
        return F.regexp_extract_all(text, F.lit("(?s)(..)" if kind == "long" else "(?s)(.)"), F.lit(1))


def _cells() -> Column:
    return F.split(F.trim(F.regexp_replace("value", "[ \\t\\r\\x{FEFF}]+", " ")), " ")


def _unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("\\/"), F.lit("/"))


def read_affixes(spark: SparkSession, path: str) -> Affixes:
    """The rules of an .aff file, which is in UTF-8. Suffixes and prefixes; rules for compounds, replacements and sounds are left out, and an alias table of flags is an error."""
    lines = spark.read.text(path).select(_cells().alias("c"))
    named = lines.where(F.get("c", F.lit(0)).isin(OPTIONS)).select(F.get("c", F.lit(0)).alias("k"), F.try_element_at("c", F.lit(2)).alias("v"))
    options = {r["k"]: r["v"] or "" for r in named.groupBy("k").agg(F.first("v").alias("v")).collect()}
    if "AF" in options:
        raise ValueError(f"{path}: aliases of flags (AF) are not supported")
    if options.get("SET", "UTF-8").upper().replace("-", "") != "UTF8":
        raise ValueError(f"{path}: {options['SET']} is not supported; convert the files to UTF-8")
    affix = lines.where(F.get("c", F.lit(0)).isin("SFX", "PFX") & (F.size("c") >= 4)).select((F.get("c", F.lit(0)) == "SFX").alias("suffix"), F.get("c", F.lit(1)).alias("flag"), "c")
    # The line that opens a flag's rules: whether they go with the other kind, and how many there are.
    opens = (F.size("c") == 4) & F.get("c", F.lit(2)).isin("Y", "N") & F.get("c", F.lit(3)).rlike("^[0-9]+$")
    heads = affix.where(opens).groupBy("suffix", "flag").agg(F.max(F.get("c", F.lit(2)) == "Y").alias("crossing"))
    made = Affixes(affix, options)
    added = F.get("c", F.lit(3))
    cut = lambda t: F.when(t == "0", "").otherwise(t)
    slash = F.regexp_instr(added, F.lit("(?<!\\\\)/"))
    body = F.when(slash > 0, F.substring(added, F.lit(1), slash - 1)).otherwise(added)
    more = F.when(slash > 0, made.flags(F.substring(added, slash + 1, F.length(added)))).otherwise(F.array().cast("array<string>"))
    asked = F.replace(F.coalesce(F.try_element_at("c", F.lit(5)), F.lit(".")), F.lit("-"), F.lit("\\-"))
    fits = F.when(F.col("suffix"), F.concat(F.lit("(?s)"), asked, F.lit("$"))).otherwise(F.concat(F.lit("(?s)^"), asked))
    each = affix.where(~opens).select("suffix", "flag", cut(F.get("c", F.lit(2))).alias("strip"), _unescaped(cut(body)).alias("add"), more.alias("more"), fits.alias("fits"))
    made.rules = each.join(heads, ["suffix", "flag"])
    return made


def _derived(words: DataFrame, rules: DataFrame) -> DataFrame:
    """What rules make of words (form, flags): form, given (the word's flags), more, crossing."""
    each = words.select("form", "flags", F.explode("flags").alias("flag")).join(rules, "flag")
    n, k = F.length("form"), F.length("strip")
    holds = F.when(F.col("suffix"), F.endswith("form", "strip")).otherwise(F.startswith("form", "strip"))
    new = F.when(F.col("suffix"), F.concat(F.substring("form", F.lit(1), n - k), "add")).otherwise(F.concat("add", F.substring("form", k + 1, n)))
    return each.where(holds & F.regexp("form", "fits")).select(new.alias("form"), F.col("flags").alias("given"), "more", "crossing")


def read_dictionary(spark: SparkSession, dic: str, aff: str) -> DataFrame:
    """S-14. form: each word of a .dic file and what the affix rules make of it, once.

    A suffix may be followed by one of its own (two deep), and what crossing suffixes made takes crossing prefixes; a prefix's own flags give one more affix. Words that
    need an affix, or stand only in compounds, are no forms themselves; a forbidden form is none, however made. Read once and write the result as a table: checks
    join it as they do a plain list. The forms grow with the dictionary; no part of it is collected, but for the options of the .aff file, one value each.
    """
    affixes = read_affixes(spark, aff)
    line = F.regexp_replace(F.regexp_replace("value", "^\\x{FEFF}", ""), "[ \\t\\r].*$", "")
    bar = F.regexp_instr(line, F.lit("(?<!\\\\)/"))
    form = F.when(bar > 0, F.substring(line, F.lit(1), bar - 1)).otherwise(line)
    flags = F.when(bar > 0, affixes.flags(F.substring(line, bar + 1, F.length(line)))).otherwise(F.array().cast("array<string>"))
    rows = spark.read.text(dic).select(_unescaped(form).alias("form"), flags.alias("flags")).where((F.col("form") != "") & ~F.col("form").rlike("^[0-9]+$"))

    def marked(*names: str) -> Column:
        own = [affixes.options[n] for n in names if affixes.options.get(n)]
        return F.arrays_overlap("flags", F.array(*[F.lit(f) for f in own])) if own else F.lit(False)

    roots = rows.where(~marked("FORBIDDENWORD"))
    suffixes, prefixes = affixes.rules.where("suffix"), affixes.rules.where("not suffix")
    first = _derived(roots, suffixes)
    second = _derived(first.select("form", F.col("more").alias("flags")), suffixes)
    # A suffixed form takes the prefixes of its root and of its suffix.
    crossed = first.where("crossing").select("form", F.array_union("given", "more").alias("flags"))
    both = _derived(crossed, prefixes.where("crossing"))
    before = _derived(roots, prefixes)
    again = _derived(before.select("form", F.col("more").alias("flags")), affixes.rules)
    unfinished = marked("NEEDAFFIX", "PSEUDOROOT", "ONLYINCOMPOUND")
    made = [roots.where(~unfinished).select("form")]
    made += [d.select("form", F.col("more").alias("flags")).where(~unfinished).select("form") for d in (first, second, both, before, again)]
    forms = made[0]
    for d in made[1:]:
        forms = forms.union(d)
    return forms.where("form <> ''").distinct().join(rows.where(marked("FORBIDDENWORD")).select("form"), "form", "left_anti")
