"""Nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each quantised by its own k-means of K centroids, so that K * K cells cover the space.
A query sorts the centroids of both halves by distance and walks the pairs in order of their summed distance with a
heap, until the cells that it has met hold enough vectors. The summed distance at which the walk ends says which cells were met, so a query
travels once to each left centroid with such a cell, not once to each cell. Vectors and queries of a left centroid meet in blocks, where
distances are computed exactly on the original vectors in double precision.

How many vectors are enough is found on the sample that the quantisers are fitted on: for PROBES of its vectors the true nearest in
the sample are looked up, and how large a share of the sample the walk meets before it comes to each of them; the share is
that within which RECALL of them lie. In all vectors the nearest lie nearer, so the share errs on the safe side. Clustered vectors need a few
hundredths; directions without any structure in 64 dimensions some 35 per cent, which no order of cells can help.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id;
vectors of each length are an index of their own, as there is no distance between different lengths; rows with equal id and vector are
one row, an id with several vectors stands for as many rows, each a candidate and, where its id asks, a query; a query with fewer than top
candidates gets all; ties go to the smaller id; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Work, arrow_map, batch, pick
from .repeats import _groups, _heads

#: Vectors that the quantisers are fitted on, at most about; rounds of k-means; centroids of a half at most.
SAMPLE, ROUNDS, MOST_CENTROIDS = 20_000, 12, 1024
#: Share of the true nearest that the walk must come to, measured for so many vectors of the sample; vectors that a query must have met at least, for each that is wanted.
RECALL, PROBES, LEAST = 0.96, 300, 20
#: Vectors, and queries, of a left centroid that meet at once.
BLOCK = 2000


def centroids(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = squared(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        for j in range(x.shape[1]):
            s = np.bincount(own, x[:, j], minlength=len(c))
            c[n > 0, j] = s[n > 0] / n[n > 0]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


class Index:
    """The two quantisers and how many vectors each cell holds; bounded by K, not by the data."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right, self.half = left, right, left.shape[1]
        self.size: dict[int, int] = {}

    def cells(self, x: np.ndarray) -> np.ndarray:
        return squared(x[:, : self.half], self.left).argmin(1) * len(self.right) + squared(x[:, self.half :], self.right).argmin(1)

    def walk(self, q: np.ndarray, wanted: int) -> tuple[list[int], list[float]]:
        """The left centroids with a cell that a query meets, and the distance that right centroids may have there. Cells are met in order of the summed distance of their centroid pair, until they hold enough."""
        a, b = squared(q[None, : self.half], self.left)[0], squared(q[None, self.half :], self.right)[0]
        i_of, j_of = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        x, y = a[i_of].tolist(), b[j_of].tolist()
        heap, met, reach = [(x[0] + y[0], 0, 0)], 0, {}
        while heap and met < wanted:
            _, i, j = heapq.heappop(heap)
            n = self.size.get(i_of[i] * len(y) + j_of[j])
            if n:
                met += n
                reach[i_of[i]] = y[j]
            if j + 1 < len(y):
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(x):
                heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        return list(reach), list(reach.values())


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(rows: DataFrame) -> DataFrame:
    """rows: vec_id, v. Those that take part, with their lengths and a hash of the vector, as arrays of doubles; equal rows once."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = rows.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    good = good.where((F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    # Minus zero is zero.
    good = good.withColumn("v", F.transform("v", lambda x: x + 0.0))
    return good.select("vec_id", F.xxhash64("v").alias("h"), F.size("v").alias("d"), "v").groupBy("vec_id", "h", "d").agg(F.min("v").alias("v"))


def enough(x: np.ndarray, index: Index, top: int) -> float:
    """The share of all vectors that a walk meets before it has come to RECALL of the true nearest, in the sample x."""
    if len(x) < 3:
        return 1.0
    ask = np.random.default_rng(3).permutation(len(x))[:PROBES]
    cell = index.cells(x)
    left, right = cell // len(index.right), cell % len(index.right)
    shares = []
    for i in ask:
        far = ((x - x[i]) ** 2).sum(1)
        far[i] = np.inf
        near = np.argpartition(far, min(top, len(x) - 1) - 1)[:top]
        summed = squared(x[i : i + 1, : index.half], index.left)[0][left] + squared(x[i : i + 1, index.half :], index.right)[0][right]
        shares.append(np.searchsorted(np.sort(summed), summed[near], "right") / len(x))
    return float(np.quantile(np.concatenate(shares), RECALL))


def _cell_rows(sent):
    def make():
        index = sent.value

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cell = index.cells(_stack(b.column(1)))
                    yield batch(vec_id=b.column(0), h=b.column(2), v=b.column(1), left=pa.array(cell // len(index.right), pa.int64()), right=pa.array(cell % len(index.right), pa.int64()))

        return run

    return make


def _walks(sent, wanted: int):
    def make():
        index = sent.value

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    left, reach = zip(*(index.walk(q, wanted) for q in _stack(b.column(1))))
                    yield batch(vec_id=b.column(0), h=b.column(2), v=b.column(1), left=pa.array(left, pa.list_(pa.int64())), reach=pa.array(reach, pa.list_(pa.float64())))

        return run

    return make


def _meet(sent, top: int):
    """Of rows (k, p, m, asks, vec_id, h, v, right, reach) by (k, p, m): each query's nearest of this block, of the cells within its reach."""

    def make():
        index = sent.value

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in _groups(batches):
                bounds = np.append(np.flatnonzero(_heads(g["k"], g["p"], g["m"])), len(g["k"]))
                query, said, vec, score = [], [], [], []
                for x, y in zip(bounds[:-1], bounds[1:]):
                    asks, ids = g["asks"][x:y], g["vec_id"][x:y]
                    if asks.all() or not asks.any():
                        continue
                    v = np.stack(g["v"][x:y])
                    h = g["h"][x:y]
                    others, own, kind, right = v[~asks], ids[~asks], h[~asks], g["right"][x:y][~asks]
                    far = np.stack([squared(q[None, index.half :], index.right)[0] for q in v[asks]])
                    for q, hq, vector, reach, b in zip(ids[asks], h[asks], v[asks], g["reach"][x:y][asks], far):
                        at = np.flatnonzero((b[right] <= reach) & ((own != q) | (kind != hq)))
                        d = np.sqrt(((others[at] - vector) ** 2).sum(1))
                        near = np.flatnonzero(d <= np.partition(d, top - 1)[top - 1]) if len(d) > top else np.arange(len(d))
                        near = near[np.lexsort((own[at[near]], d[near]))[:top]]
                        query += [q] * len(near)
                        said += [hq] * len(near)
                        vec += own[at[near]].tolist()
                        score += d[near].tolist()
                if query:
                    yield batch(query_id=pa.array(query, pa.int64()), h=pa.array(said, pa.int64()), vec_id=pa.array(vec, pa.int64()), score=pa.array(score, pa.float64()))

        return run

    return make


def nearest(vectors: DataFrame, queries: Column, top: int = 10, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query (rows of vec_id for which queries holds) and rank: query_id, rank, vec_id, score (Euclidean distance)."""
    spark = vectors.sparkSession
    work = Work(spark, "vectors")
    good = work.table(usable(pick(vectors, vec_id=id_col, v=vector_col)), "usable")
    out = None
    for d, n in sorted((r["d"], r["n"]) for r in good.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()):
        if n > 1:
            part = _nearest(good.where(F.col("d") == d).drop("d"), n, queries, top, sample, work, f"{d}")
            out = part if out is None else out.union(part)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _nearest(good: DataFrame, n: int, queries: Column, top: int, sample: int, work: Work, name: str) -> DataFrame:
    """nearest() among n vectors (vec_id, h, v) of one length."""
    spark = good.sparkSession
    whole = 1 << 30
    # The vectors with the least hashes of their ids, as many as wanted on average; the bound of what the driver gets is twice that.
    drawn = good.select("vec_id", "v").where(F.pmod(F.xxhash64("vec_id"), F.lit(whole)) < min(whole, int(whole * sample / n) + 1)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * sample).collect()
    x = np.array([r["v"] for r in drawn] or [good.first()["v"]])
    # As many cells as vectors, up to the most centroids; each centroid stands on ten vectors of the sample.
    k = int(np.clip(1.1 * np.sqrt(n), 1, min(MOST_CENTROIDS, max(1, len(x) // 10))))
    half = max(1, x.shape[1] // 2)
    right = centroids(x[:, half:], k, 2) if x.shape[1] > half else np.zeros((1, 0))
    index = Index(centroids(x[:, :half], k, 1), right)
    wanted = max(LEAST * top, int(enough(x, index, top) * n) + 1)
    plain = spark.sparkContext.broadcast(index)
    cells = work.table(arrow_map(good.select("vec_id", "v", "h"), _cell_rows(plain), "vec_id long, h long, v array<double>, left long, right long"), f"{name}-cells", scan=True)
    counted = cells.groupBy("left", "right").count().toArrow()  # MOST_CENTROIDS squared rows at most
    index = Index(index.left, index.right)
    cell = counted["left"].to_numpy() * len(right) + counted["right"].to_numpy()
    index.size = dict(zip(cell.tolist(), counted["count"].to_pylist()))
    walks = arrow_map(good.where(queries).select("vec_id", "v", "h"), _walks(spark.sparkContext.broadcast(index), wanted), "vec_id long, h long, v array<double>, left array<long>, reach array<double>")
    asked = work.table(walks.select("vec_id", "h", "v", F.explode(F.arrays_zip("left", "reach")).alias("x")).select("vec_id", "h", "v", "x.left", "x.reach"), f"{name}-asked", scan=True)
    size = cells.groupBy("left").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("ms"))
    blocks = work.table(asked.groupBy("left").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("ps")).join(size, "left"), f"{name}-blocks")
    mine = lambda of: F.pmod(F.xxhash64("vec_id"), F.col(of)).cast("int")
    all_ = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    members = cells.join(blocks, "left").select("left", all_("ps").alias("p"), mine("ms").alias("m"), F.lit(False).alias("asks"), "vec_id", "h", "v", "right", F.lit(0.0).alias("reach"))
    askers = asked.join(blocks, "left").select("left", mine("ps").alias("p"), all_("ms").alias("m"), F.lit(True).alias("asks"), "vec_id", "h", "v", F.lit(0).cast("long").alias("right"), "reach")
    both = members.union(askers).select(F.xxhash64("left", "p", "m").alias("k"), "p", "m", "asks", "vec_id", "h", "v", "right", "reach")
    found = arrow_map(both.repartition("k").sortWithinPartitions("k", "p", "m"), _meet(plain, top), "query_id long, h long, vec_id long, score double")
    order = Window.partitionBy("query_id", "h").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
