"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

A sketch has BINS coordinates. In round i every shingle is hashed to a bin and a value that is less than all of
later rounds; each bin keeps its least. After the first BINS rounds, round BINS + j sends all shingles to bin j, so no
bin stays empty; large sets fill all bins in a round or two. The share of equal coordinates estimates the Jaccard
similarity with concentration bounds as if each coordinate were hashed on its own.

1. Documents with equal shingle sets become one class, named after its least id.
2. Classes that share a band of ROWS coordinates are candidates. A worker first links its own to the least of them,
   and sends on that one only, so no band has more rows than there are flushes of workers.
3. Candidate pairs are confirmed on the full shingle sets; confirmed links make components.
4. In a band whose members are in several components after that, each member outside the largest is compared, by
   sketch, with all members of other components, in blocks; first its few nearest are confirmed, then, block by block,
   all others that come near enough until one links it. So no candidate pair that would still join two components is
   left out, and none needs a row of its own.

A pair of similarity 0.8 shares no band with a probability of 3e-6, and fails the sketch test with one below 1e-8.

Sets are compared as sets of 64-bit hashes of their shingles; equal sets are told by the SHA-256 digest of all of these.

Edge cases: null and empty texts, and those without a word, have no shingle and are a component each; rows that repeat an id and its
text are one document, each with its result; an id with several texts stands for as many documents; null ids come after all others (a
component without any other id has a null one); ties cannot occur, as the least id names a component; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, arrow_map, mixed, parts, pick, seeded
from .components import components
from .repeats import _C1, _C2, _groups, _heads, _rows, keyed, text_hash

ROWS, BANDS = 5, 32
BINS = ROWS * BANDS
#: Equal coordinates of BINS below which a pair is not near: 0.6 of them, over six deviations below 0.8.
NEAR = BINS * 6 // 10
#: Classes that a worker holds at once; members of a band that are compared at once; nearest that are confirmed first.
FLUSH, BLOCK, NEAREST = 20_000, 1000, 3

_SEED = seeded(2 * BINS, 5)
_LATE = (np.arange(2 * BINS, dtype=np.uint64) << np.uint64(48))[:, None]


def shingles(text: str, size: int) -> np.ndarray:
    """The distinct shingles, as sorted 64-bit hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out = (out ^ (out >> np.uint64(29))) * _C1 + h[k : len(h) - n + 1 + k]
    return np.unique(mixed(out))


def sketch(x: np.ndarray) -> np.ndarray:
    """The BINS coordinates of a set of at least one shingle."""
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    at, step = 0, max(1, min(BINS, 2048 // len(x)))
    while at < BINS:
        h = mixed(x[None, :] ^ _SEED[at : at + step, None])
        np.minimum.at(out, (h % np.uint64(BINS)).astype(np.int64).ravel(), (_LATE[at : at + step] | (h >> np.uint64(16))).ravel())
        at += step
        if out.max() >> np.uint64(48) < BINS:
            return out
    empty = np.flatnonzero(out >> np.uint64(48) >= BINS)
    out[empty] = [(mixed(x ^ _SEED[BINS + j]) >> np.uint64(16)).min() | _LATE[BINS + j, 0] for j in empty]
    return out


def _sketches(size: int):
    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts(batches, 2000, 1):
                n, left, right, coordinates = [], [], [], []
                for text in b.column(1).to_pylist():
                    x = shingles(text or "", size)
                    n.append(len(x))
                    digest = hashlib.sha256(x).digest()
                    left.append(digest[:8])
                    right.append(digest[8:16])
                    coordinates.append(sketch(x).astype(np.uint16).tobytes() if len(x) else None)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array(np.frombuffer(b"".join(left), np.int64)), pa.array(np.frombuffer(b"".join(right), np.int64)), pa.array(coordinates, pa.binary())],
                    names=["doc_id", "n", "left", "right", "sketch"],
                )

        return run

    return make


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BINS)


_SENT = "k long, a long, b long, how byte"
# a candidate pair (a, b); a band k and one of its members a; the same, with others of the band at the same worker.
PAIR, ALONE, LEADS, MEMBER = range(4)


def _send_bands():
    def flush(doc: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(doc, kind="stable")
        doc, s = doc[order], s[order]
        parts = s.reshape(len(s), BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(seeded(BANDS, 9), (len(s), BANDS)).copy()
        for r in range(ROWS):
            key = (key ^ (key >> np.uint64(31))) * _C1 + parts[:, :, r]
        key = mixed(key).ravel()
        order = np.argsort(key, kind="stable")
        row, key = order // BANDS, key[order]
        new = _heads(key)
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        size = np.diff(np.append(np.flatnonzero(new), len(key)))[np.cumsum(new) - 1]
        yield _rows(k=key, a=doc[row], b=doc[row], how=np.where(new, np.where(size > 1, LEADS, ALONE), MEMBER).astype(np.int8))
        pair = np.unique(np.stack([row[head], row])[:, doc[row[head]] != doc[row]], axis=1)
        for at in range(0, pair.shape[1], 20_000):
            a, b = pair[:, at : at + 20_000]
            near = (s[a] == s[b]).sum(1) >= NEAR
            a, b = doc[a[near]], doc[b[near]]
            if len(a):
                yield _rows(k=mixed(a.astype(np.uint64) * _C2 + b.astype(np.uint64)), a=a, b=b, how=np.full(len(a), PAIR, np.int8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, coordinates = [], []
        for b in batches:
            if b.num_rows:
                docs.append(b.column(0).to_numpy())
                coordinates.append(_matrix(b.column(1)))
            if sum(map(len, docs)) >= FLUSH:
                yield from flush(np.concatenate(docs), np.concatenate(coordinates))
                docs, coordinates = [], []
        if docs:
            yield from flush(np.concatenate(docs), np.concatenate(coordinates))

    return run


def _meet_bands():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            k, a, b, how = g["k"], g["a"], g["b"], g["how"]
            new = _heads(k)
            group = np.cumsum(new) - 1
            lead = (how == ALONE) | (how == LEADS)
            several = np.bincount(group, lead, minlength=group[-1] + 1) > 1
            first = np.where(lead, np.arange(len(k)), len(k))
            first = np.minimum.reduceat(first, np.flatnonzero(new))[group]
            member = (how == MEMBER) | (how == LEADS) | (lead & several[group])
            star = lead & (first != np.arange(len(k)))
            star[star] = a[first[star]] != a[star]
            out = member.astype(int) + star + (how == PAIR)
            if out.any():
                yield _rows(
                    k=np.concatenate([k[member], k[star], k[how == PAIR]]),
                    a=np.concatenate([a[member], a[first[star]], a[how == PAIR]]),
                    b=np.concatenate([a[member], a[star], b[how == PAIR]]),
                    how=np.repeat(np.array([MEMBER, PAIR], np.int8), [member.sum(), star.sum() + (how == PAIR).sum()]),
                )

    return run


def _facing(g: dict[str, np.ndarray]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Of rows by (k, p, m): bounds of a group, a probe in it, and the members of other components that come near, with their equal coordinates."""
    bounds = np.append(np.flatnonzero(_heads(g["k"], g["p"], g["m"])), len(g["k"]))
    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        probe, comp = g["probe"][x:y], g["comp"][x:y]
        s = np.frombuffer(b"".join(g["sketch"][x:y]), np.uint16).reshape(-1, BINS)
        others = np.flatnonzero(~probe)
        for i in np.flatnonzero(probe).tolist():
            far = others[comp[others] != comp[i]]
            same = (s[far] == s[i]).sum(1)
            far, same = far[same >= NEAR], same[same >= NEAR]
            if len(far):
                yield x, y, x + i, x + far, same


def _nearest():
    """The NEAREST members of other components of each probe, as pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            found = []
            for _, _, i, far, same in _facing(g):
                other = g["doc"][far]
                other = other[np.lexsort((other, -same))[:NEAREST]]
                found.append(np.stack([np.minimum(other, g["doc"][i]), np.maximum(other, g["doc"][i])]))
            if found:
                a, b = np.unique(np.concatenate(found, 1), axis=1)
                yield _rows(a=a, b=b)

    return run


def _involved():
    """The rows of probes, and of members, that come near to one another: their texts have to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            keep = np.zeros(len(g["k"]), bool)
            for _, _, i, far, _ in _facing(g):
                keep[i] = True
                keep[far] = True
            if keep.any():
                table = pa.table({n: v[keep] for n, v in g.items()}).combine_chunks()
                yield from table.to_batches()

    return run


def _settle(size: int, per_cent: int):
    """Of rows by (k, p, m), with texts: one confirmed link, if there is any, of each probe to each other component in its group."""

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in _groups(batches):
                at, sets, found = -1, {}, []
                for x, _, i, far, same in _facing(g):
                    if x != at:
                        at, sets = x, {}
                    for j in (i, *far.tolist()):
                        if j not in sets:
                            sets[j] = shingles(g["text"][j], size)
                    done = set()
                    for j in far[np.lexsort((g["doc"][far], -same))].tolist():
                        if g["comp"][j] not in done and linked(sets[i], sets[j], per_cent):
                            done.add(g["comp"][j])
                            found.append((g["doc"][i], g["doc"][j]))
                if found:
                    a, b = np.array(found, np.int64).T
                    yield _rows(a=np.minimum(a, b), b=np.maximum(a, b))

        return run

    return make


def linked(x: np.ndarray, y: np.ndarray, per_cent: int) -> bool:
    """Whether two sets (sorted) have per_cent of their union in common."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(small) < per_cent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= per_cent * (len(x) + len(y) - both)


def _confirm(size: int, per_cent: int):
    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, np.ndarray] = {}

            def of(doc: int, text: str) -> np.ndarray:
                if doc not in known:
                    if len(known) > 64:
                        known.clear()
                    known[doc] = shingles(text, size)
                return known[doc]

            for b in batches:
                links = []
                for a, z, left, right in zip(*(b.column(k).to_pylist() for k in range(4))):
                    if linked(of(a, left), shingles(right, size), per_cent):
                        links.append((a, z))
                if links:
                    a, z = np.array(links, np.int64).T
                    yield _rows(a=a, b=z)

        return run

    return make


def near_duplicates(docs: DataFrame, shingle: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. Documents with per_cent of their joint shingles in common are linked. Sound for 80 per cent and more."""
    if per_cent < 80:
        raise ValueError("bands are laid out for similarities of 80 per cent and more")
    out, names = _classified(docs, shingle, per_cent, id_col, text_col)
    if names is None:
        return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")
    own, other = names.select("doc", F.col("id").alias("doc_id")), names.select(F.col("doc").alias("component"), F.col("id").alias("component_id"))
    return out.join(own, "doc").join(other, "component").select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns: of each group of near duplicates the document with the least id, once."""
    out, names = _classified(docs, shingle, per_cent, id_col, text_col)
    kept = out.where("kept").select("doc").distinct()
    own = docs[f"`{id_col}`"].cast("long")
    if names is None:
        chosen = docs.join(kept, own == kept["doc"], "left_semi")
    else:
        kept = names.join(kept, "doc").select("id", "kind")
        chosen = docs.join(kept, own.eqNullSafe(kept["id"]) & (F.xxhash64(F.coalesce(docs[f"`{text_col}`"], F.lit(""))) == kept["kind"]), "left_semi")
    repeated = out.groupBy("doc").count().where("count > 1").limit(1).count()
    return chosen.dropDuplicates([id_col, text_col]) if repeated else chosen


def _classified(docs: DataFrame, shingle: int, per_cent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Per row: doc (its number, see keyed), n_shingles, component (the least number reached), kept; and what numbers stand for."""
    work = Work(docs.sparkSession, "near")
    rows, names = keyed(pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")), work)
    rows = rows.select(F.col("doc").alias("doc_id"), "text")
    drawn = work.table(arrow_map(rows, _sketches(shingle), "doc_id long, n long, left long, right long, sketch binary"), "sketches", scan=True)
    whole = drawn.where("n > 0 and doc_id is not null")
    classes = work.table(whole.groupBy("left", "right").agg(F.min("doc_id").alias("rep")), "classes", small=True)
    member = work.table(drawn.select("doc_id", "n", "left", "right").join(classes, ["left", "right"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("rep")).alias("rep")), "members")
    reps = whole.select("doc_id", "left", "right", "sketch").join(classes, ["left", "right"]).where("doc_id = rep").select(F.col("doc_id").alias("doc"), "sketch")
    sent = arrow_map(reps, _send_bands, _SENT)
    met = work.table(arrow_map(sent.repartition("k").sortWithinPartitions("k", "a"), _meet_bands, _SENT), "bands")
    bands = met.where(F.col("how") == MEMBER).select("k", F.col("a").alias("doc"))
    involved = bands.select("doc").distinct()
    texts = work.table(rows.join(involved, F.col("doc_id") == F.col("doc"), "left_semi").select(F.col("doc_id").alias("doc"), "text").where("text is not null"), "texts")
    shown = drawn.join(involved, F.col("doc_id") == F.col("doc"), "left_semi").where("n > 0")
    shown = work.table(shown.select(F.col("doc_id").alias("doc"), "sketch"), "shown")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        right = pairs.join(texts, pairs.b == texts.doc).select("a", "b", F.col("text").alias("right"))
        both = right.join(texts, right.a == texts.doc).select("a", "b", F.col("text").alias("left"), "right")
        return work.table(arrow_map(both, _confirm(shingle, per_cent), "a long, b long"), name, small=True)

    tried = work.table(met.where(F.col("how") == PAIR).select("a", "b").distinct(), "pairs", small=True)
    links = confirmed(tried, "links")
    label = components(links, work, "components")
    one = shown.dropDuplicates(["doc"])
    for step in ("nearest", "rest"):
        now = work.table(bands.join(label, F.col("doc") == F.col("node"), "left").select("k", "doc", F.coalesce("comp", "doc").alias("comp")).distinct(), f"{step}-now", small=True)
        per = now.groupBy("k", "comp").agg(F.count(F.lit(1)).alias("c"))
        open_ = per.groupBy("k").agg(F.count(F.lit(1)).alias("comps"), F.sum("c").alias("n"), F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main"), F.max("c").alias("most")).where("comps > 1 and n > 2")
        open_ = work.table(open_.select("k", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("ms"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("ps")), f"{step}-open", small=True)
        here = work.table(now.join(open_, "k"), f"{step}-here", small=True)
        mine = lambda of: F.pmod(F.xxhash64("doc"), F.col(of)).cast("int")
        all_ = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        members = here.select("k", all_("ps").alias("p"), mine("ms").alias("m"), F.lit(False).alias("probe"), "doc", "comp")
        probes = here.where("comp <> main").select("k", mine("ps").alias("p"), all_("ms").alias("m"), F.lit(True).alias("probe"), "doc", "comp")
        faced = members.union(probes).join(one, "doc").select(F.xxhash64("k", "p", "m").alias("k"), "p", "m", "probe", "doc", "comp", "sketch")
        met_ = lambda df: df.repartition("k").sortWithinPartitions("k", "p", "m", "doc")
        if step == "nearest":
            pairs = arrow_map(met_(faced), _nearest, "a long, b long").distinct()
            more = confirmed(work.table(pairs.join(tried, ["a", "b"], "left_anti"), f"{step}-pairs", small=True), f"{step}-links")
        else:
            left = work.table(arrow_map(met_(faced), _involved, "k long, p int, m int, probe boolean, doc long, comp long, sketch binary"), f"{step}-involved")
            more = work.table(arrow_map(met_(left.join(texts.dropDuplicates(["doc"]), "doc").select(*left.columns, "text")), _settle(shingle, per_cent), "a long, b long"), f"{step}-links")
        if more.limit(1).count():
            links = links.union(more)
            label = components(links, work, f"{step}-components")
    component = F.coalesce("comp", "rep", "doc_id").alias("component")
    out = work.table(member.join(label, F.col("rep") == F.col("node"), "left").select(F.col("doc_id").alias("doc"), F.col("n").alias("n_shingles"), component), "out")
    work.drop("out", "keys")
    return out.withColumn("kept", F.col("doc") == F.col("component")), names


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)
