"""What byte and word level repeat removal share: dealing out places by content, and comparing what is removed with its source.

Names are 64-bit hashes of content: a place's name at depth 2d is made of its name at depth d and of that at the place d further on, so
that all machines agree on names without ranks. Equal content always has equal names; whether equal names meant equal content is verified.

1. Of each window, its rarest-looking m-gram (the one with the smallest name) is its minimiser. A maximal run of
   windows with one minimiser is a span; only spans are dealt out, by the minimiser: about 2 for every L - m + 2
   windows. Equal windows have equal minimisers, so a window's copies are all in one minimiser's bucket.
2. A bucket with a single span holds no repeat. Equal spans (first and last window have equal names, and so all
   between) are repeats but for the first. First spans of a bucket with several spans stay open.
3. The windows of open spans are for the two operators to settle (refined buckets, or the edges of a graph).
4. Every removed stretch knows where the stretch it repeats stands. Touching ones with the same source are one. The texts of both sides are
   read at their coordinates, and their SHA-256 digests compared. If any differ, all is done again with names made from another seed.

A worker first meets its own repeats: of equal spans, or windows, it sends on the earliest only (the others are stretches that repeat that
one), and a minimiser with several spans is sent on by span; so no key has more rows than there are flushes of workers, however often
its text occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, arrow_map, batch, mixed, parts, seeded, signed

#: Low bits of a key that hold a position: places are named in blocks of fewer than 2 ** PLACE_BITS.
PLACE_BITS = 21
BLOCK = 1 << 20
#: Spans, or windows, that a worker gathers before it sends them on.
FLUSH = 1_000_000
#: Stretches of one document that are read there at once.
ASKED = 20_000
#: Spans of one minimiser in one flush from which on they go by span.
MANY = 4

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def refined(name: np.ndarray, offset: int) -> np.ndarray:
    """Names of a greater depth: of each place's bucket and the bucket offset places later."""
    out = name[:-offset] * _C1
    out ^= out >> np.uint64(29)
    out += name[offset:]
    out *= _C2
    out ^= out >> np.uint64(32)
    return out


class Kind:
    """How texts become symbols: window and m-gram in symbols, the depth of the first names, the functions for both, and the source of a stretch as bytes."""

    def __init__(self, window: int, gram: int, depth: int, split: Callable, first: Callable, source: Callable, seed: int = 0, bits: int = 64):
        self.window, self.gram, self.depth, self.split, self.first, self.source = window, gram, depth, split, first, source
        #: Names are made from the seed. bits: what is left of a first name (tests make collisions by it).
        self.seed, self.mask = seed, np.uint64(2**bits - 1)

    def next(self) -> Kind:
        """The same with other names."""
        return Kind(self.window, self.gram, self.depth, self.split, self.first, self.source, self.seed + 1)

    def names(self, symbols, start: int = 0, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The names of all m-grams and of all windows of symbols[start:stop]."""
        name, depth = self.first(symbols, start, stop), self.depth
        if self.seed:
            name = mixed(name ^ seeded(1, self.seed)[0])
        name = name & self.mask
        gram = name
        while depth * 2 <= self.window:
            name, depth = refined(name, depth), depth * 2
            if depth == self.gram:
                gram = name
        if depth < self.window:
            name = refined(name, self.window - depth)
        return gram, name


def _lowest(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each width neighbours."""
    have = 1
    while have * 2 <= width:
        key, have = np.minimum(key[:-have], key[have:]), have * 2
    return np.minimum(key[: len(key) - (width - have)], key[width - have :]) if have < width else key


def spans(kind: Kind, symbols) -> Iterator[tuple[np.ndarray, ...]]:
    """(minimiser, span name, start, windows) arrays, a block of the text at a time."""
    n = len(symbols) - kind.window + 1
    mask = np.uint64((1 << PLACE_BITS) - 1)
    for a in range(0, n, BLOCK):
        m = min(BLOCK, n - a)
        gram, whole = kind.names(symbols, a, a + m + kind.window - 1)
        key = mixed(gram)
        key = (key & ~mask) | np.arange(len(key), dtype=np.uint64)
        at = (_lowest(key, kind.window - kind.gram + 1) & mask).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.concatenate([start, [m]]))
        name = mixed(whole[start] * _C1 ^ mixed(whole[start + count - 1] + count.astype(np.uint64)))
        yield gram[at[start]], name, start + a, count


def _later(name: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by name, then as they stand (doc, at ascending): the order, which ordered rows are elsewhere than the first of their name, and that first one."""
    order = np.argsort(name, kind="stable")
    n, d, a = name[order], doc[order], at[order]
    new = np.concatenate([[True], n[1:] != n[:-1]]) if len(n) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))
    return order, (d != d[head]) | (a != a[head]), order[head]


def _rows(**columns) -> pa.RecordBatch:
    return batch(**{k: pa.array(signed(v) if v.dtype == np.uint64 else v) for k, v in columns.items()})


def _runs(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Touching or overlapping stretches of a document as one; the input stands by doc and start."""
    if not len(doc):
        return doc, start, stop
    bounds = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]])
    shift = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * (int(stop.max()) + 1)
    most = np.maximum.accumulate(stop + shift) - shift
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > most[:-1])])
    first = np.flatnonzero(new)
    return doc[first], start[first], most[np.concatenate([first[1:] - 1, [len(doc) - 1]])]


def compacted(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, first_doc: np.ndarray, first_start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Touching or overlapping stretches that repeat one another's continuation (the same document, equally far off) as one."""
    if not len(doc):
        return doc, start, stop, first_doc, first_start
    off = first_start - start
    order = np.lexsort((start, off, first_doc, doc))
    doc, start, stop, first_doc, off = doc[order], start[order], stop[order], first_doc[order], off[order]
    # Stretches of one source stand together: number the sources, and join within a number.
    path = np.cumsum(_heads(doc, first_doc, off)) - 1
    size = int(stop.max()) + 1
    p, a, z = _runs(path, start, stop)
    one = np.searchsorted(path * size + start, p * size + a)
    return doc[one], a, z, first_doc[one], a + off[one]


_SENT = "k long, name long, doc long, start long, count int, how byte"
# how a row was sent: as a repeat already known, by its minimiser, by its own name, or to tell that a minimiser has several spans.
KNOWN, BY_GRAM, BY_NAME, TOLD = range(4)
#: A stretch of a document; where the stretch that it repeats is, or open.
_FOUND = "doc long, start long, stop long, first_doc long, first_start long, open boolean"
FOUND = "doc long, start long, stop long, first_doc long, first_start long"


def _salt(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A known row only passes through: its key spreads it, and hides the place of its first occurrence."""
    return mixed(doc.astype(np.uint64) ^ mixed(start.astype(np.uint64)))


def _send_spans(kind: Kind):
    def make():
        def flush(held: list) -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: x[0])
            doc = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[1][2]) for x in held])
            gram, name, start, count = (np.concatenate([x[1][k] for x in held]) for k in range(4))
            order, later, head = _later(name, doc, start)
            known, of = order[later], head[later]
            d, a, z, fd, fs = compacted(doc[known], start[known], start[known] + count[known] - 1 + kind.window, doc[of], start[of])
            if len(d):
                yield _rows(k=_salt(d, a) ^ fs.astype(np.uint64), name=fd, doc=d, start=a, count=(z - a - kind.window + 1).astype(np.int32), how=np.full(len(d), KNOWN, np.int8))
            keep = order[~later]
            name_k = name[keep]
            new = np.concatenate([[True], name_k[1:] != name_k[:-1]])
            own, back, times = np.unique(gram[keep][new], return_inverse=True, return_counts=True)
            many = (times >= MANY)[back][np.cumsum(new) - 1]
            k = np.where(many, name_k, gram[keep])
            yield _rows(k=k, name=name_k, doc=doc[keep], start=start[keep], count=count[keep].astype(np.int32), how=np.where(many, BY_NAME, BY_GRAM).astype(np.int8))
            told = own[times >= MANY]
            if len(told):
                yield _rows(k=told, name=np.zeros(len(told), np.int64), doc=np.zeros(len(told), np.int64), start=np.zeros(len(told), np.int64), count=np.zeros(len(told), np.int32), how=np.full(len(told), TOLD, np.int8))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for b in parts(batches, 2000, 1):
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    symbols = kind.split(text or "")
                    if len(symbols) < kind.window:
                        continue
                    for part in spans(kind, symbols):
                        held.append((doc, part))
                        n += len(part[2])
                        if n >= FLUSH:
                            yield from flush(held)
                            held, n = [], 0
            if held:
                yield from flush(held)

        return run

    return make


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows ordered by their first column, in chunks that never part a value of it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        k = b.column(0).to_numpy()
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut == 0 and len(held) > 1 and held[-2].column(0)[-1].as_py() == k[-1]:
            continue
        if cut or len(held) > 1:
            whole = pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
            held = [b.slice(cut)]
            if whole.num_rows:
                yield {n: whole.column(n).to_numpy() for n in whole.column_names}
    if held:
        whole = pa.Table.from_batches(held)
        yield {n: whole.column(n).to_numpy() for n in whole.column_names}


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Which rows begin a new value of the keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _judge_spans(kind: Kind):
    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in _groups(batches):
                k, name, doc, start, how = g["k"], g["name"], g["doc"], g["start"], g["how"]
                stop = start + g["count"] - 1 + kind.window
                known = how == KNOWN
                told = how == TOLD
                real = ~known & ~told
                new_k, new_name = _heads(k), _heads(k, name)
                group = np.cumsum(new_k) - 1
                several = np.bincount(group, new_name & real, minlength=group[-1] + 1) > 1
                several |= np.bincount(group, told, minlength=group[-1] + 1) > 0
                head = np.maximum.accumulate(np.where(new_name, np.arange(len(k)), 0))
                later = real & ((doc != doc[head]) | (start != start[head]))
                open_ = real & ~later & (several[group] | (how == BY_NAME))
                first_doc = np.where(known, name, doc[head])
                first_start = np.where(known, (_salt(doc, start) ^ k.astype(np.uint64)).view(np.int64), start[head])
                out = known | later | open_
                if out.any():
                    yield _rows(doc=doc[out], start=start[out], stop=stop[out], first_doc=first_doc[out], first_start=first_start[out], open=open_[out])

        return run

    return make


def open_windows(kind: Kind, batches: Iterator[pa.RecordBatch], name: Callable | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Of batches (doc, text, where): flushes of (doc, start, *names) of all windows in open stretches, by doc and start. name(symbols, start, stop): names of the windows that start there."""
    name = name or (lambda symbols, start, stop: (kind.names(symbols, start, stop + kind.window - 1)[1],))
    held, n = [], 0
    for b in parts(batches, 500, 1):
        for doc, text, where in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            symbols = kind.split(text or "")
            w = where.values
            begin, end = w.field(0).to_numpy(), w.field(1).to_numpy() - kind.window + 1
            order = np.argsort(begin, kind="stable")
            for a, z in zip(begin[order].tolist(), np.minimum(end[order], len(symbols) - kind.window + 1).tolist()):
                for x in range(a, z, BLOCK):
                    y = min(z, x + BLOCK)
                    held.append((doc, x, *name(symbols, x, y)))
                    n += y - x
                    if n >= FLUSH:
                        yield _flushed(held)
                        held, n = [], 0
    if held:
        yield _flushed(held)


def _flushed(held: list) -> tuple[np.ndarray, ...]:
    held.sort(key=lambda x: x[:2])
    doc = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[2]) for x in held])
    return doc, np.concatenate([np.arange(x[1], x[1] + len(x[2])) for x in held]), *(np.concatenate(x) for x in list(zip(*held))[2:])


def listed(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy("doc").agg(F.collect_list(F.struct(*columns)).alias("where"))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keyed(rows: DataFrame, work: Work) -> tuple[DataFrame, DataFrame | None]:
    """rows (doc_id, text) with doc: a number for each document, in the order of ids (nulls last). Rows that repeat an id and its text are one document; an id with several texts stands for
    as many, in the order of their hashes. Without such ids, and without nulls, numbers are the ids; else the second result says what they stand for (id, kind: the text's hash, doc)."""
    kinds = rows.select("doc_id", text_hash().alias("h"))
    odd = kinds.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("doc_id is null or low <> high").limit(1).count()
    if not odd:
        return rows.withColumn("doc", F.col("doc_id")), None
    order = kinds.distinct().orderBy(F.col("doc_id").asc_nulls_last(), "h")
    order = work.table(order.select(F.col("doc_id").alias("id"), F.col("h").alias("kind"), F.monotonically_increasing_id().alias("doc")), "keys")
    here = rows.withColumn("h", text_hash())
    return here.join(order, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("kind"))).select("doc_id", "text", "doc"), order


def spans_met(kind: Kind, rows: DataFrame, work: Work, name: str) -> DataFrame:
    """rows: doc, text. The table of stretches that repeat another one, and of those left open."""
    sent = arrow_map(rows.select("doc", "text"), _send_spans(kind), _SENT)
    return work.table(arrow_map(sent.repartition("k").sortWithinPartitions("k", "name", "doc", "start", "count"), _judge_spans(kind), _FOUND), name)


def opened(rows: DataFrame, found: DataFrame) -> DataFrame:
    """doc, text and where (the open stretches) of documents that have any."""
    open_ = listed(found.where("open"), "start", "stop").withColumnRenamed("doc", "d")
    return rows.select("doc", "text").join(open_, F.col("doc") == F.col("d")).select("doc", "text", "where")


def _compact():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for doc, where in zip(b.column(0).to_pylist(), b.column(1)):
                start, stop, first_doc, first_start = (where.values.field(k).to_numpy() for k in range(4))
                made.append(compacted(np.full(len(start), doc, np.int64), start, stop, first_doc, first_start))
            if made:
                yield _rows(**dict(zip(("doc", "start", "stop", "first_doc", "first_start"), map(np.concatenate, zip(*made)))))

    return run


def finished(kind: Kind, rows: DataFrame, repeats: DataFrame, work: Work, finish: Callable, schema: str, name: str) -> DataFrame | None:
    """rows (doc_id, text, doc) given to finish(doc_ids, texts, [merged stretches to remove as (n, 2) arrays]), as a table. Every stretch is compared with its source, by the digests
    of both at their coordinates; None if one differs."""
    paths = work.table(arrow_map(listed(repeats, "start", "stop", "first_doc", "first_start"), _compact, FOUND), f"{name}-paths", small=True)
    sides = paths.select("doc", "start", "stop", F.lit(True).alias("cut")).union(paths.select("first_doc", "first_start", F.col("first_start") + F.col("stop") - F.col("start"), F.lit(False)))
    sides = sides.groupBy("doc", "start", "stop").agg(F.max("cut").alias("cut"))
    # A document that is the source of very many different stretches is read several times, for so many of them each.
    lot = F.when(F.col("cut"), 0).otherwise(F.pmod(F.xxhash64("start", "stop"), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("doc")) / ASKED)))
    lots = sides.withColumn("lot", lot).groupBy("doc", "lot").agg(F.collect_list(F.struct("start", "stop", "cut")).alias("where")).withColumnRenamed("doc", "d")
    lots = work.table(lots, f"{name}-lots", small=True)
    columns = ["doc_id", "text", "doc", "where", text_hash().alias("text_hash")]
    faced = rows.join(lots.where("lot = 0"), F.col("doc") == F.col("d"), "left").select(*columns, F.lit(True).alias("first"))
    faced = faced.union(rows.join(lots.where("lot > 0"), F.col("doc") == F.col("d")).select(*columns, F.lit(False)))

    def make():
        said = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("digest", pa.binary())]))
        none = np.zeros((0, 2), np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts(batches, 500, 1):
                stretches, told = [], []
                texts = [t or "" for t in b.column(1).to_pylist()]
                for text, w in zip(texts, b.column(3)):
                    if not w.is_valid:
                        stretches.append(none)
                        told.append([])
                        continue
                    start, stop = (w.values.field(k).to_numpy() for k in (0, 1))
                    cut = w.values.field(2).to_numpy(zero_copy_only=False)
                    source = kind.source(text)
                    told.append([{"start": a, "stop": z, "digest": hashlib.sha256(source(a, z)).digest()} for a, z in zip(start.tolist(), stop.tolist())])
                    start, stop = start[cut], stop[cut]
                    order = np.argsort(start, kind="stable")
                    _, a, z = _runs(np.zeros(len(order), np.int64), start[order], stop[order])
                    stretches.append(np.stack([a, z], 1))
                done = finish(b.column(0), texts, stretches)
                yield pa.RecordBatch.from_arrays([*done.columns, b.column(2), pa.array(told, said), b.column(4), b.column(5)], names=[*done.schema.names, "doc", "told", "text_hash", "first"])

        return run

    out = work.table(arrow_map(faced, make, f"{schema}, doc long, told array<struct<start: long, stop: long, digest: binary>>, text_hash long, first boolean"), f"{name}-out")
    told = out.select("doc", F.explode("told").alias("t")).select("doc", "t.*").distinct()
    one = told.select(F.col("doc").alias("d1"), F.col("start").alias("s1"), F.col("stop").alias("z1"), F.col("digest").alias("g1"))
    two = told.select(F.col("doc").alias("d2"), F.col("start").alias("s2"), F.col("stop").alias("z2"), F.col("digest").alias("g2"))
    both = paths.join(one, (F.col("doc") == F.col("d1")) & (F.col("start") == F.col("s1")) & (F.col("stop") == F.col("z1")), "left")
    both = both.join(two, (F.col("first_doc") == F.col("d2")) & (F.col("first_start") == F.col("s2")) & (F.col("first_start") + F.col("stop") - F.col("start") == F.col("z2")), "left")
    if both.where(~F.col("g1").eqNullSafe(F.col("g2")) | F.col("g1").isNull()).limit(1).count():
        return None
    return out.where("first").drop("doc", "told", "first")


def removed(kind: Kind, rows: DataFrame, work: Work, settle: Callable, finish: Callable, schema: str) -> DataFrame:
    """rows: doc_id, text. What finish makes of each, and text_hash (see text_hash), without the windows that also start earlier. settle(kind, documents with open stretches, work, name) gives the repeats among open windows (as FOUND).
    Names that stood for different contents show when stretches are compared with their sources: then all is done again with other names."""
    rows, _ = keyed(rows, work)
    while True:
        name = f"seed{kind.seed}"
        found = spans_met(kind, rows, work, f"{name}-found")
        more = settle(kind, opened(rows, found), work, name)
        out = finished(kind, rows, found.where("not open").select("doc", "start", "stop", "first_doc", "first_start").union(more), work, finish, schema, name)
        work.drop(f"{name}-out", "keys")
        if out is not None:
            return out
        kind = kind.next()
