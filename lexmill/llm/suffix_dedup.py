"""Removal of repeated byte strings: suffix buckets refined by bucket pointers.

The start places of texts are suffixes. Their first buckets are 8-grams; a bucket is refined by the identifiers of the buckets that later
offsets of the same suffix are in, 8, 16, 32 and 64 bytes on, and the new identifiers serve the next refinement, up to the depth of a whole
window. An identifier is a 64-bit hash of its content, so that buckets need no ranks that all machines agree on.

1. Suffixes are first told apart at the depth of their window's minimiser, a 32-gram, and dealt out in spans that share it (see repeats). Buckets
   with a single span are done, as are equal spans; only buckets that still hold several different spans are refined.
2. Refinement: the suffixes of open spans are dealt out by their identifiers at the depth of the window, and sorted by identifier, document and
   place; all but the first of a bucket are repeats of that first one.
3. Stretches to be removed are compared with their first occurrence, byte by byte as SHA-256 digests at both coordinates.

Unlike the method of that name in one memory, buckets are not ordered among each other: equality is all that removal asks for, and a
global order would cost a sort of all suffixes.

Edge cases: null and empty texts have no bytes and lose none; a text shorter than the window loses none; rows that repeat an id with the same
text are one document, each with its result; an id with several texts stands for as many documents, and null ids come after all others
(rows with null ids and one text are one document); an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, arrow_map, batch, mixed, pick
from .repeats import FOUND, Kind, _groups, _heads, _later, _rows, _salt, compacted, open_windows, removed


def raw_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def first_buckets(raw: np.ndarray, start: int, stop: int | None) -> np.ndarray:
    """The name of the 8 bytes at each place."""
    part = np.ascontiguousarray(raw[start:stop])
    return mixed(np.lib.stride_tricks.as_strided(part.view(np.uint8)[:8].view("<u8"), (len(part) - 7,), (1,)).copy())


def source_bytes(text: str):
    raw = text.encode("utf-8", "surrogatepass")
    return lambda start, stop: raw[start:stop]


def bytes_kind(window: int, bits: int = 64) -> Kind:
    return Kind(window, 32 if window >= 64 else 8, 8, raw_bytes, first_buckets, source_bytes, bits=bits)


_SUFFIXES = "k long, doc long, start long, first long"


def _send_suffixes(kind: Kind):
    """Open suffixes by their identifiers. One that a worker knows as a repeat passes through: its start is turned over, and it says where its first occurrence is."""

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for doc, start, name in open_windows(kind, batches):
                order, later, head = _later(name, doc, start)
                known, of, keep = order[later], head[later], order[~later]
                yield _rows(
                    k=np.concatenate([_salt(doc[known], start[known]) ^ start[of].astype(np.uint64), name[keep]]),
                    doc=np.concatenate([doc[known], doc[keep]]),
                    start=np.concatenate([~start[known], start[keep]]),
                    first=np.concatenate([doc[of], np.zeros(len(keep), np.int64)]),
                )

        return run

    return make


def _refine(kind: Kind):
    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in _groups(batches):
                known = g["start"] < 0
                k, doc, start = g["k"], g["doc"], np.where(known, ~g["start"], g["start"])
                # Known rows have a key of their own, or at worst come before a bucket: they neither lead nor follow.
                own = np.flatnonzero(~known)
                new = _heads(k[own])
                head = own[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))] if len(own) else own
                later = (doc[own] != doc[head]) | (start[own] != start[head])
                known = np.flatnonzero(known)
                first = (_salt(doc[known], start[known]) ^ k[known].astype(np.uint64)).view(np.int64)
                at = np.concatenate([known, own[later]])
                if len(at):
                    d, a, z, fd, fs = compacted(doc[at], start[at], start[at] + kind.window, np.concatenate([g["first"][known], doc[head[later]]]), np.concatenate([first, start[head[later]]]))
                    yield _rows(doc=d, start=a, stop=z, first_doc=fd, first_start=fs)

        return run

    return make


def refined_repeats(kind: Kind, texts: DataFrame, work: Work, name: str) -> DataFrame:
    """Of documents with open stretches (doc, text, where): the stretches that repeat an earlier one."""
    sent = arrow_map(texts, _send_suffixes(kind), _SUFFIXES)
    return work.table(arrow_map(sent.repartition("k").sortWithinPartitions("k", "doc", "start"), _refine(kind), FOUND), f"{name}-refined")


def remove_repeated_bytes(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, bits: int = 64) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, the removed spans (start, stop in bytes), and with_text the kept bytes. window: 16 at least."""
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def finish(ids: pa.Array, texts: list[str], stretches: list[np.ndarray]) -> pa.RecordBatch:
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        kept = []
        for raw, cut in zip(raws, stretches):
            at, parts = 0, []
            for a, z in cut.tolist():
                parts.append(raw[at:a])
                at = z
            kept.append(b"".join([*parts, raw[at:]]))
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return batch(
            doc_id=ids,
            n_bytes=pa.array(map(len, raws), pa.int64()),
            n_removed=pa.array([len(r) - len(k) for r, k in zip(raws, kept)], pa.int64()),
            n_spans=pa.array(map(len, stretches), pa.int64()),
            kept_sha256=pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            spans=pa.array([[{"start": a, "stop": z} for a, z in s.tolist()] for s in stretches], spans_type),
            **({"kept": pa.array(kept, pa.binary())} if with_text else {}),
        )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>" + ", kept binary" * with_text
    return removed(bytes_kind(window, bits), rows, Work(docs.sparkSession, "suffixes"), refined_repeats, finish, schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("spans", "text_hash")
