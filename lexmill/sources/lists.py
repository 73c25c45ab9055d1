"""Word lists, rule books and other small resources (S-11 to S-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

RULE = "id string, title string, path array<string>, page int, text string, examples array<string>, cross_refs array<string>, variants array<struct<main: string, secondary: string>>, subsections array<string>"


def read_germanisms(spark: SparkSession, path: str) -> DataFrame:
    """S-11. german_key, german, lb, note: a line a word, tab separated, # for remarks; the last line of a key counts."""
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), "value").where((X.trimmed(F.col("value")) != "") & ~F.col("value").startswith("#"))
    cells = F.transform(F.split("value", "\t"), X.trimmed)
    rows = raw.select("ord", F.try_element_at(cells, F.lit(1)).alias("german"), F.try_element_at(cells, F.lit(2)).alias("lb"), F.try_element_at(cells, F.lit(3)).alias("note")).where("german <> '' and lb <> ''")
    return rows.groupBy(F.lower("german").alias("german_key")).agg(*[F.max_by(c, "ord").alias(c) for c in ("german", "lb", "note")])


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """S-12. One row a file: text without HTML comments, trimmed."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), X.trimmed(F.regexp_replace("value", r"(?s)<!--.*?-->", "")).alias("text"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """S-13. Rule paragraphs with ord, their place in the book. A malformed line is an error."""
    rows = spark.read.schema(RULE).option("mode", "FAILFAST").json(path).withColumn("_at", F.monotonically_increasing_id())
    # One row a paragraph of a book: a small table by nature.
    return rows.withColumn("ord", F.row_number().over(Window.orderBy("_at")) - 1).drop("_at")


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """S-14, S-15. form: the words of a Hunspell .dic file (its first line, a count, left out) without morphology and affix flags."""
    bare = F.regexp_replace(F.regexp_replace("value", "[ \\t].*$", ""), "(?<!\\\\)/.*$", "")
    return spark.read.text(path).select(bare.alias("form")).where((F.col("form") != "") & ~F.col("form").rlike("^[0-9]+$")).distinct()


def example_words(rules: DataFrame) -> DataFrame:
    """word, id: the examples of each paragraph, whole and by their parts longer than one letter, in small letters."""
    parts = lambda e: F.filter(F.split(e, "[\\s,;/()–-]+"), lambda p: F.length(p) > 1)
    each = rules.select("id", F.explode("examples").alias("e"))
    return each.select("id", F.explode(F.array_distinct(F.concat(F.array(F.col("e")), parts(F.col("e"))))).alias("w")).select(F.lower("w").alias("word"), "id").distinct()
