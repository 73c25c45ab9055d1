"""Parallel corpora: TMX, JSON lines, ZIP archives, folders (S-01 to S-07, S-09).

Every reader gives segments (seg_id, text map by language, meta map), ids dense in file and record order; long form and
counts are derived. TMX is read and cleaned in the JVM; JSON lines keep the type of each value, so their short
recursive walk runs in Python over Arrow batches at ingest.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import shared_folder

LANGUAGES = ("lb", "fr", "de", "en")
# Names of the languages in file headers and keys.
ALIASES = {
    "lb": "lb lu ltz lux luxembourgish lëtzebuergesch letzebuergesch luxemburgisch",
    "fr": "fr fra fre french français francais franzoesch franséisch",
    "de": "de deu ger german deutsch däitsch",
    "en": "en eng english englesch",
}
_ALIAS = {name: lang for lang, names in ALIASES.items() for name in names.split()}
SEGMENT = "text map<string,string>, meta map<string,string>"


def language(code: Column) -> Column:
    """S-09. The language of a code or key: as it is, else the first part that names one."""
    table = F.create_map(*[F.lit(x) for kv in _ALIAS.items() for x in kv])
    low = F.lower(X.trimmed(code))
    parts = F.filter(F.transform(F.split(low, "[-_\\s.:/]+"), lambda p: table[p]), lambda p: p.isNotNull())
    return F.coalesce(table[low], F.try_element_at(parts, F.lit(1)))


def _language(code) -> str | None:
    import re

    low = code.strip().lower() if isinstance(code, str) else ""
    return _ALIAS.get(low) or next((_ALIAS[p] for p in re.split(r"[-_\s.:/]+", low) if p in _ALIAS), None)


@F.pandas_udf(T.StringType())
def _numeric_references(texts: pd.Series) -> pd.Series:
    import re

    def one(m) -> str:
        n = int(m[1][1:], 16) if m[1][0] in "xX" else int(m[1])
        return chr(n) if n < 0x110000 else m[0]

    return texts.map(lambda t: re.sub(r"&#([xX][0-9a-fA-F]+|[0-9]+);", one, t) if t and "&#" in t else t)


def entities_decoded(text: Column) -> Column:
    """S-03. The five named references and numeric ones, &amp; last."""
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(c))
    return F.replace(_numeric_references(text), F.lit("&amp;"), F.lit("&"))


def segment_cleaned(raw: Column) -> Column:
    """S-02. A segment without inline markup: code elements go with what they hold, others leave their text."""
    raw = F.regexp_replace(raw, r"<(bpt|ept|ph|it)\b[^>]*>(?s:.*?)</\1>", "")
    raw = F.regexp_replace(raw, r"<(?:bpt|ept|ph|it)\b[^>]*/>", "")
    return X.trimmed(X.collapsed(entities_decoded(F.regexp_replace(raw, "<[^>]+>", ""))))


def _numbered(units: DataFrame, first_id: int = 0) -> DataFrame:
    """Dense ids over file, record (W-10). Ranks within a file are added to the sizes of the files before it, so no single task sees all rows."""
    sizes = units.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    # One row a file: the running total needs one task of that many rows only.
    before = sizes.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("file").orderBy("record")) - 1
    return units.withColumn("own", own).join(before, "file").select((F.col("own") + F.col("first") + first_id).alias("seg_id"), "file", "text", "meta")


def read_tmx(spark: SparkSession, path: str | list[str], first_id: int = 0) -> DataFrame:
    """S-01. Translation units: seg_id, file, text, meta. The last variant of a language wins; units without text take no id."""
    raw = spark.read.option("lineSep", "</tu>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("record"), "value")
    unit = raw.where(F.col("value").rlike("<tu[\\s>]"))
    body = F.regexp_replace("value", r"(?s)^.*?(?=<tu[\s>])", "")
    variants = F.regexp_extract_all(body, F.lit(r"(?s)(<tuv\b.*?</tuv>)"), F.lit(1))
    head = F.regexp_extract(body, r"^<tu\b([^>]*)>", 1)
    attribute = lambda of, name: F.regexp_extract(of, rf"(?s)(?:^|\s){name}\s*=\s*[\"']([^\"']*)[\"']", 1)

    def variant(v: Column) -> Column:
        opening = F.regexp_extract(v, r"(?s)^<tuv\b([^>]*)>", 1)
        code = F.when(attribute(opening, "xml:lang") != "", attribute(opening, "xml:lang")).otherwise(attribute(opening, "lang"))
        return F.struct(language(code).alias("key"), F.regexp_extract(v, r"(?s)<seg[^>]*>(.*?)</seg>", 1).alias("raw"))

    props = F.regexp_extract_all(body, F.lit(r"(?s)<prop\b[^>]*type\s*=\s*[\"']([^\"']*)[\"'][^>]*>[^<]*</prop>"), F.lit(1))
    values = F.regexp_extract_all(body, F.lit(r"(?s)<prop\b[^>]*type\s*=\s*[\"'][^\"']*[\"'][^>]*>([^<]*)</prop>"), F.lit(1))
    meta = F.concat(F.filter(F.zip_with(props, values, lambda k, v: F.struct(k.alias("key"), v.alias("value"))), lambda x: (x["key"] != "") & (x["value"] != "")), F.when(attribute(head, "tuid") != "", F.array(F.struct(F.lit("tuid").alias("key"), attribute(head, "tuid").alias("value")))).otherwise(F.array().cast("array<struct<key: string, value: string>>")))
    flat = unit.select("file", "record", meta.alias("meta"), F.posexplode(F.transform(variants, variant)).alias("ord", "v"))
    flat = flat.select("file", "record", "meta", "ord", F.col("v.key").alias("lang"), segment_cleaned(F.col("v.raw")).alias("said")).where("lang is not null and said <> ''")
    last = flat.groupBy("file", "record", "lang").agg(F.max_by("said", "ord").alias("said"), F.first("meta").alias("meta"))
    units = last.groupBy("file", "record").agg(F.map_from_entries(F.collect_list(F.struct("lang", "said"))).alias("text"), F.first("meta").alias("entries"))
    units = units.withColumn("meta", F.map_from_entries(F.expr("aggregate(entries, cast(array() as array<struct<key: string, value: string>>), (a, x) -> concat(filter(a, y -> y.key <> x.key), array(x)))")))
    return _numbered(units, first_id)


def parse_json_line(line: str) -> tuple[dict, dict] | None:
    """S-04. The texts by language and the metadata of one line, or None for a line that holds none."""
    try:
        record = json.loads(line)
    except ValueError:
        return None
    if not isinstance(record, dict):
        return None
    text, meta = {}, {}

    def first(*names):
        return next((record[n] for n in names if isinstance(record.get(n), str) and record[n].strip()), None)

    for said, code in ((("source", "src"), ("source_lang", "src_lang", "sourceLanguage")), (("target", "tgt"), ("target_lang", "tgt_lang", "targetLanguage"))):
        lang, value = _language(first(*code)), first(*said)
        if lang and value:
            text[lang] = value.strip()

    def walk(node: dict, depth: int) -> None:
        """Keys in their order: a language's first text counts, however deep it stands."""
        for key, value in node.items():
            if isinstance(value, str):
                lang = _language(key)
                if lang and value.strip():
                    text.setdefault(lang, value.strip())
                elif depth == 0 and len(value) < 200:
                    meta[key] = value
            elif isinstance(value, (int, float)) and not isinstance(value, bool) and depth == 0:
                meta[key] = str(int(value)) if float(value).is_integer() else str(value)
            elif isinstance(value, dict) and depth < 2:
                walk(value, depth + 1)

    walk(record, 0)
    return (text, meta) if text else None


def _records(lines: Iterator[tuple[str, int, str]]) -> pd.DataFrame:
    rows = [(f, r, *got) for f, r, line in lines if line.strip() and (got := parse_json_line(line.strip().removeprefix("﻿")))]
    return pd.DataFrame(rows, columns=["file", "record", "text", "meta"])


def read_jsonl(spark: SparkSession, path: str | list[str], first_id: int = 0) -> DataFrame:
    """S-04. Segments of JSON lines in any of the three layouts; lines that are no JSON object, or hold no text, take no id."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("record"), "value")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield _records(zip(p["file"], p["record"], p["value"]))

    return _numbered(raw.mapInPandas(run, f"file string, record long, {SEGMENT}"), first_id)


def read_zip(spark: SparkSession, path: str | list[str], work: str) -> DataFrame:
    """S-05. Segments of archives (a file or several): of their TMX members if it has any, else of its JSON lines; members in order of their names. work: a shared folder for the members."""
    members = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for archive, content in zip(p["path"], p["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = sorted(n for n in z.namelist() if not n.endswith("/") and "__MACOSX" not in n)
                    chosen = [n for n in names if n.lower().endswith(".tmx")] or [n for n in names if n.lower().endswith((".jsonl", ".json"))]
                    yield pd.DataFrame([(archive, n, z.read(n).decode("utf-8-sig")) for n in chosen], columns=["archive", "name", "value"])

    files = members.mapInPandas(run, "archive string, name string, value string")
    tmx = files.where(F.lower("name").endswith(".tmx"))
    tmx.select("value", F.concat(F.lit("m-"), F.regexp_replace("name", "[^A-Za-z0-9]", "_")).alias("member")).write.mode("overwrite").option("lineSep", "\n").partitionBy("member").text(f"{work}/tmx")
    lines = files.where(~F.lower("name").endswith(".tmx"))
    rest = lines.select(F.col("name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("record", "value"))

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield _records(zip(p["file"], p["record"], p["value"]))

    own = _numbered(rest.mapInPandas(parse, f"file string, record long, {SEGMENT}"))
    return own if tmx.limit(1).count() == 0 else read_tmx(spark, f"{work}/tmx")


def read_corpus(spark: SparkSession, path: str, work: str | None = None) -> DataFrame:
    """S-06, S-07. A file by its extension, or a folder: its TMX files if it has any, else its JSON lines, else its archives. work: a shared folder for what archives hold (one of the session's own if None)."""
    work = work or f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    low = path.lower()
    if low.endswith((".tmx", ".xml")):
        return read_tmx(spark, path)
    if low.endswith((".jsonl", ".json")):
        return read_jsonl(spark, path)
    if low.endswith(".zip"):
        return read_zip(spark, path, work)
    listed = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # names only
    zipped = lambda spark, paths: read_zip(spark, paths, work)
    for kinds, read in (((".tmx",), read_tmx), ((".jsonl", ".json"), read_jsonl), ((".zip",), zipped)):
        chosen = sorted(p for p in listed if p.lower().endswith(kinds))
        if chosen:
            return read(spark, chosen)
    raise ValueError(f"no corpus file in {path}: .tmx, .xml, .jsonl, .json or .zip is needed")


def segment_texts(segments: DataFrame) -> DataFrame:
    """D1 in long form: seg_id, lang, text. Write it partitioned by lang."""
    return segments.select("seg_id", F.explode("text").alias("lang", "text"))


def language_counts(texts: DataFrame) -> DataFrame:
    """A-01."""
    return texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
