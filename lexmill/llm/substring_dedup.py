"""Removal of repeated word sequences: compaction of a De Bruijn graph of token k-mers.

A window of k words is an edge from the (k-1)-mer of its first words to that of its last words. Paths are read along the texts.

1. Edges that surely occur once are left out first, as assemblers do: runs of edges that share their minimiser are dealt out by it, and a bucket
   with a single run holds no repeat. Where one run repeats as a whole, alone in its bucket or in equal copies, it is a path piece already
   (see repeats). Runs that share a minimiser with a different run are opened into single edges.
2. Graph: opened edges are grouped by content; the repeated ones, each with its first source coordinates, are the graph's edges, and
   the numbers of them that enter and leave each node are its degrees.
3. Compaction: joins with the degrees and with the following edge tell where a path goes on: the node between has one edge in and one out, and both
   edges first occur side by side. Edges of one path then share one first occurrence, that of the path's head.
4. Source coordinates: a join brings paths back to every place of their edges. Touching places that repeat one source are one span, however
   many paths it runs through; spans are compared with their first occurrence, word by word as SHA-256 digests of both sides, before any word goes.

Edge cases: null and empty texts have no words and lose none, nor does a text with fewer words than a window; rows that repeat an id with the
same text are one document, each with its result; an id with several texts stands for as many documents, and null ids come after
all others (rows with null ids and one text are one document); an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Work, arrow_map, batch, pick
from .repeats import Kind, _rows, open_windows, removed


def split_words(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split()


class Symbols:
    """A text's words as 64-bit hashes."""

    def __init__(self, text: str):
        words = split_words(text)
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def __len__(self) -> int:
        return len(self.hashes)


def source_words(text: str):
    words = split_words(text)
    return lambda start, stop: b" ".join(words[start:stop])


def word_names(symbols: Symbols, start: int, stop: int | None) -> np.ndarray:
    return symbols.hashes[start:stop]


def words_kind(window: int, bits: int = 64) -> Kind:
    return Kind(window, 8 if window >= 16 else 1, 1, Symbols, word_names, source_words, bits=bits)


def _edges(kind: Kind):
    """The edges of open runs: their names, the names of the nodes that they leave and enter, and their source coordinates."""
    node = Kind(kind.window - 1, 1, 1, kind.split, kind.first, kind.source, kind.seed)

    def named(symbols: Symbols, start: int, stop: int) -> tuple[np.ndarray, ...]:
        edge = kind.names(symbols, start, stop + kind.window - 1)[1]
        nodes = node.names(symbols, start, stop + kind.window - 1)[1] if node.window else np.zeros(len(edge) + 1, np.uint64)
        return edge, nodes[:-1], nodes[1:]

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for doc, start, edge, a, b in open_windows(kind, batches, named):
                yield _rows(edge=edge, a=a, b=b, doc=doc, start=start)

        return run

    return make


def path_repeats(kind: Kind, texts: DataFrame, work: Work, name: str) -> DataFrame:
    """Of documents with open stretches (doc, text, where): the spans of repeated paths that also occur earlier, an edge a row."""
    edges = work.table(arrow_map(texts, _edges(kind), "edge long, a long, b long, doc long, start long"), f"{name}-edges")
    place = F.struct("doc", "start")
    graph = edges.groupBy("edge").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    graph = work.table(graph.select("edge", "a", "b", F.col("first.doc").alias("doc"), F.col("first.start").alias("start")), f"{name}-graph")
    ends = graph.select(F.col("a").alias("node"), F.lit(1).alias("leave"), F.lit(0).alias("enter")).union(graph.select("b", F.lit(0), F.lit(1)))
    through = ends.groupBy("node").agg(F.sum("leave").alias("leave"), F.sum("enter").alias("enter")).where("leave = 1 and enter = 1").select("node")
    # The edge before, where its path goes on through a node with one edge in and one out, and where both first occur side by side.
    before = graph.join(through, F.col("b") == F.col("node"), "left_semi").select(F.col("b").alias("from"), F.col("doc").alias("d"), (F.col("start") + 1).alias("s"))
    linked = graph.join(before, (F.col("a") == F.col("from")) & (F.col("doc") == F.col("d")) & (F.col("start") == F.col("s")), "left")
    along = Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("from").isNull(), F.col("start")), ignorenulls=True).over(along)
    paths = linked.select("edge", F.col("doc").alias("first_doc"), F.col("start").alias("first_start"), head.alias("path"))
    # A path starts at its head; an edge further on, so much later in every place.
    paths = work.table(paths.select("edge", "first_doc", "path", (F.col("first_start") - F.col("path")).alias("on")), f"{name}-graph-paths")
    met = edges.select("edge", "doc", "start").join(paths, "edge").where((F.col("doc") != F.col("first_doc")) | (F.col("start") != F.col("path") + F.col("on")))
    # A path's places in one text, as spans: its edges stand side by side there unless the text leaves the path and comes back.
    at = Window.partitionBy("doc", "first_doc", "path", F.col("start") - F.col("on")).orderBy("start")
    met = met.distinct().select("*", (F.col("start") - F.row_number().over(at)).alias("run"))
    spans = met.groupBy("doc", "first_doc", "path", (F.col("start") - F.col("on")).alias("zero"), "run").agg(F.min("start").alias("start"), (F.max("start") + kind.window).alias("stop"))
    return spans.select("doc", "start", "stop", "first_doc", (F.col("path") + F.col("start") - F.col("zero")).alias("first_start"))


def remove_repeated_words(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, bits: int = 64) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, the removed spans (start, stop in words), and with_text the kept words joined by one space."""
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def finish(ids: pa.Array, texts: list[str], stretches: list[np.ndarray]) -> pa.RecordBatch:
        size, gone, kept = [], [], []
        for text, cut in zip(texts, stretches):
            words = split_words(text)
            size.append(len(words))
            for a, z in reversed(cut.tolist()):
                del words[a:z]
            gone.append(size[-1] - len(words))
            kept.append(b" ".join(words))
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return batch(
            doc_id=ids,
            n_words=pa.array(size, pa.int64()),
            n_removed=pa.array(gone, pa.int64()),
            kept_sha256=pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            spans=pa.array([[{"start": a, "stop": z} for a, z in s.tolist()] for s in stretches], spans_type),
            **({"kept": pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string())} if with_text else {}),
        )

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, stop: long>>" + ", kept string" * with_text
    return removed(words_kind(window, bits), rows, Work(docs.sparkSession, "words"), path_repeats, finish, schema)


def without_repeated_words(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs, all columns: a text that loses words becomes its other words, joined by one space (and length_col, if docs has it, their characters); any other stays as it is."""
    done = remove_repeated_words(docs, window, id_col, text_col).where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("kept").alias("_kept")).distinct()
    text = docs[f"`{text_col}`"]
    both = docs.join(done, docs[f"`{id_col}`"].cast("long").eqNullSafe(done["_id"]) & (F.xxhash64(F.coalesce(text, F.lit(""))) == done["_hash"]), "left")
    kept = done["_kept"]
    changed = {text_col: F.coalesce(kept, text)}
    if length_col in docs.columns:
        changed[length_col] = F.when(kept.isNotNull(), F.length(kept).cast(docs.schema[length_col].dataType)).otherwise(docs[f"`{length_col}`"])
    return both.select(*[changed.get(c, docs[f"`{c}`"]).alias(c) for c in docs.columns])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("spans", "text_hash")
