"""A quality score: ridge regression on random Fourier features of document statistics, then isotonic calibration.

Statistics cover the whole text. The features cos(Wx + b), with W drawn from a normal distribution, approximate a
Gaussian kernel on the standardised statistics. Each partition of labelled rows adds up its share of the normal
equations; the shares are summed in two levels, so the driver gets a fixed number of matrices. The scores of the
labelled rows are then made probabilities by pooling adjacent violators over their histogram.

Edge cases: a null text counts as empty, and an empty text has a score; null labels are not learned from; several
labels of one id count each; with fewer than two labelled rows every score is the share of label 1 (0.5 without any); an empty table
gives an empty table; repeated rows get equal scores; further columns are ignored; null ids are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, arrow_map, batch, parts, pick
from .language_id import fold

FEATURES, BINS, GROUPS, FOLDS = 192, 512, 16, 4
#: Rows that are worked on at once.
TOGETHER = 1000
RIDGES = (1e-3, 1e-2, 1e-1, 1.0, 10.0)
NAMES = "log_bytes log_words mean_word letters digits upper spaces symbols pipes marks other distinct short long line_words line_repeat capital_words end_marks marked_words log_lines".split()

_ASCII = np.zeros(256, int)
for _k, _cs in enumerate((range(97, 123), range(48, 58), range(65, 91), b" \t\r\n", b"#%&*$@^~<>{}[]\\/=+_`", b"|", b"!?", range(128, 256)), 1):
    for _c in _cs:
        _ASCII[_c] = _k
_MARKED = re.compile(rb"[#%&*$|!]{2,}(?=\s|$)")


def statistics(text: str) -> list[float]:
    """The numbers that a text is judged by, in the order of NAMES."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    kinds = np.bincount(_ASCII, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=9) / n
    words = raw.split()
    m = max(1, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = raw.split(b"\n")
    return [
        np.log1p(len(raw)), np.log1p(len(words)), size.mean(), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8],
        len(set(words)) / m ** 0.8, (size <= 3).mean(), (size >= 12).mean(), np.log1p(m / len(lines)), 1 - len(set(lines)) / len(lines),
        raw.count(b" |") / m, sum(x.endswith((b".", b",")) for x in lines) / len(lines), len(_MARKED.findall(raw)) / m, np.log1p(len(lines)),
    ]


def features(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 1 / np.sqrt(len(NAMES)), (x.shape[1], FEATURES))
    z = np.cos(np.clip((x - mean) / spread, -8, 8) @ w + rng.uniform(0, 2 * np.pi, FEATURES)) * np.sqrt(2 / FEATURES)
    return np.concatenate([z, np.ones((len(x), 1))], 1)


def pool(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to mean values y of weights n (pool adjacent violators)."""
    out: list[list[float]] = []
    for v, w in zip(y, n):
        out.append([v, w, 1])
        while len(out) > 1 and out[-2][0] >= out[-1][0]:
            v2, w2, k2 = out.pop()
            v1, w1, k1 = out.pop()
            out.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, k1 + k2])
    return np.concatenate([np.full(int(k), v) for v, _, k in out]) if out else np.zeros(0)


def _table(x: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([x.column(first + k).to_numpy(zero_copy_only=False) for k in range(len(NAMES))], 1) if x.num_rows else np.zeros((0, len(NAMES)))


def document_statistics(rows: DataFrame, kind: str) -> DataFrame:
    """Per row of (doc_id, text): doc_id and the numbers of NAMES."""

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts(batches, TOGETHER):
                x = np.array([statistics(t or "") for t in b.column(1).to_pylist()]).reshape(-1, len(NAMES))
                yield batch(doc_id=b.column(0), **{k: pa.array(x[:, i], pa.float64()) for i, k in enumerate(NAMES)})

        return run

    return arrow_map(rows, make, f"doc_id {kind}, " + ", ".join(f"{k} double" for k in NAMES))


def _summed(train: DataFrame, mean: np.ndarray, spread: np.ndarray) -> list[np.ndarray]:
    """The normal equations over the rows of each fold of train (fold, label, then NAMES): of (features, label), so that the last row holds the right side and the label's square."""
    width = FEATURES + 2
    schema = "part int, data binary"

    def shares():
        def run(batches):
            total, any_ = np.zeros((FOLDS, width, width)), False
            for b in parts(batches, TOGETHER):
                fold, y = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                z = np.concatenate([features(_table(b, 2), mean, spread), y[:, None]], 1)
                for f in range(FOLDS):
                    own = z[fold == f]
                    total[f] += own.T @ own
                any_ = any_ or len(z) > 0
            if any_:
                yield batch(part=pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), data=pa.array([total.tobytes()], pa.binary()))

        return run

    def sums():
        def run(batches):
            total = None
            for b in batches:
                for x in b.column(1).to_pylist():
                    v = np.frombuffer(x)
                    total = v.copy() if total is None else total + v
            if total is not None:
                yield batch(part=pa.array([0], pa.int32()), data=pa.array([total.tobytes()], pa.binary()))

        return run

    both = sum(np.frombuffer(r["data"]) for r in arrow_map(arrow_map(train, shares, schema).repartition(GROUPS, "part"), sums, schema).collect())
    return list(both.reshape(FOLDS, width, width))


def _solved(equations: np.ndarray, ridge: float) -> np.ndarray:
    a = equations[:-1, :-1]
    return np.linalg.solve(a + ridge * np.eye(len(a)), equations[:-1, -1])


class Fitted:
    """Standardisation, weights and calibration; plain data."""

    def __init__(self, mean, spread, weights, edges, levels):
        self.mean, self.spread, self.weights, self.edges, self.levels = mean, spread, weights, edges, levels

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = features(x, self.mean, self.spread) @ self.weights
        return np.interp(raw, self.edges, self.levels)


def fit(train: DataFrame) -> Fitted | float:
    """train: fold int, label double, then NAMES. A constant where there is nothing to fit.

    The ridge is the one of RIDGES with the least error on folds left out, and scores are calibrated on such folds too.
    """
    s = train.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("y"), *[f(k).alias(f"{f.__name__}_{k}") for k in NAMES for f in (F.avg, F.stddev_pop)]).first()
    if s["n"] < 2 or s["y"] in (0.0, 1.0):
        return 0.5 if s["y"] is None else float(s["y"])
    mean = np.array([s[f"avg_{k}"] for k in NAMES])
    spread = np.array([s[f"stddev_pop_{k}"] for k in NAMES])
    spread[spread < 1e-9] = 1.0
    folds = _summed(train, mean, spread)
    whole = sum(folds)

    def error(ridge: float) -> float:
        left = [np.append(-_solved(whole - f, ridge), 1.0) for f in folds]
        return sum(float(w @ f @ w) for w, f in zip(left, folds))

    ridge = min(RIDGES, key=error)
    weights, left = _solved(whole, ridge), np.stack([_solved(whole - f, ridge) for f in folds], 1)

    def histogram():
        def run(batches):
            n, pos = np.zeros(BINS), np.zeros(BINS)
            for b in parts(batches, TOGETHER):
                fold, y = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                raw = (features(_table(b, 2), mean, spread) @ left)[np.arange(len(y)), fold]
                at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
                n += np.bincount(at, minlength=BINS)
                pos += np.bincount(at, weights=y, minlength=BINS)
            k = np.flatnonzero(n)
            yield batch(bin=pa.array(k, pa.int64()), n=pa.array(n[k], pa.float64()), pos=pa.array(pos[k], pa.float64()))

        return run

    bins = sorted(arrow_map(train, histogram, "bin long, n double, pos double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect())
    at = (np.array([r["bin"] for r in bins]) + 0.5) / BINS * 2 - 0.5
    n, pos = np.array([r["n"] for r in bins]), np.array([r["pos"] for r in bins])
    return Fitted(mean, spread, weights, at, np.clip(pool(pos / n, n), 0, 1))


def score_quality(docs: DataFrame, labels: DataFrame, may_learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, score (0 to 1) and its statistics. may_learn: of which doc_ids labels may be used."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    work = Work(spark, "quality")
    stats = work.table(document_statistics(rows, kind), "statistics", scan=True)
    known = pick(labels, doc_id=id_col, label=label_col).where(may_learn & F.col("label").isNotNull())
    train = work.table(stats.join(known, "doc_id").select(F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), F.col("label").cast("double").alias("label"), *NAMES), "train")
    sent = spark.sparkContext.broadcast(fit(train))

    def make():
        def run(batches):
            for b in parts(batches, TOGETHER):
                x = _table(b, 1)
                score = np.full(len(x), sent.value) if isinstance(sent.value, float) else sent.value.score(x)
                yield batch(doc_id=b.column(0), score=pa.array(score, pa.float64()))

        return run

    return arrow_map(stats, make, f"doc_id {kind}, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score_quality(docs, labels, fold(5) != 0)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
