"""Shared plumbing: column picking, shared work folder, Arrow batch helpers."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed inner names, whatever else the table holds."""
    return df.select(*(df[f"`{source}`"].alias(name) for name, source in columns.items()))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


class Work:
    """Tables of one run in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def table(self, df: DataFrame, name: str, scan: bool = False, small: bool = False) -> DataFrame:
        """df, written and read again. scan: df comes straight from a scan, whose tasks write a file each. Tasks after a shuffle are put together where there are more than sixteen a core
        (small, for tables of ids and labels: four), by two at most (small: eight), so that tables aren't made of very many tiny files."""
        path = f"{self.root}/{name}"
        self.names.append(name)
        if not scan:
            cores, shuffled = self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df = df.coalesce(max(4 * cores, shuffled // 8) if small else max(16 * cores, shuffled // 2))
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keep: str) -> None:
        """Gives the space of all tables back but those that will be read again."""
        jvm = self.spark.sparkContext._jvm
        for name in [n for n in self.names if n not in keep]:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            self.names.remove(name)


def tidy() -> None:
    """Gives memory that a task no longer needs back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow whose worker state is built by make() once a task, on the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make()(batches)
        tidy()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Bytes of texts that a worker turns into Python strings at once.
PART_BYTES = 4 << 20


def parts(batches: Iterator[pa.RecordBatch], rows: int, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many at most, and of PART_BYTES in the text column of this index (a longer text alone): what is made of a batch in Python then stays small."""
    for b in batches:
        at = 0
        size = None if text is None or not b.num_rows else np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < b.num_rows:
            end = min(at + rows, b.num_rows)
            if size is not None:
                before = int(size[at - 1]) if at else 0
                end = max(at + 1, min(end, int(np.searchsorted(size, before + PART_BYTES, "right"))))
            yield b.slice(at, end - at)
            at = end


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1342543DE82EF95) % 2**64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
