"""Answers of an outside service or file server as a table (S-08, S-18 to S-20, K-08): each key is asked for once, by a bounded number of tasks, and kept with its time."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER = "key string, body string, error string, asked_at timestamp, run string"


class Passing(Exception):
    """A failure that may pass (no connection, too many requests, the server's own fault): worth another attempt."""


def attempt(fetch: Callable[[str], str], key: str, attempts: int = 2, pause: float = 0.4) -> tuple[str | None, str | None]:
    """S-18, K-08. (body, None), or (None, what went wrong). Passing failures and those of the connection are tried again; any other is final."""
    said = None
    for n in range(max(1, attempts)):
        try:
            return fetch(key), None
        except (Passing, OSError) as e:
            said = f"{type(e).__name__}: {e}"
            if n + 1 < attempts:
                time.sleep(pause * (n + 1))
        except Exception as e:  # noqa: BLE001 - one key's failure is its row's, not the job's
            return None, f"{type(e).__name__}: {e}"
    return None, said


def kept_answers(spark: SparkSession, folder: str, since: datetime | None = None, run: str | None = None) -> DataFrame:
    """S-19. The latest answer of each key in the folder: those asked for since a time, or all; failures only of the named run, as others are to be asked for again. No folder yet: none."""
    try:
        rows = spark.read.schema(ANSWER).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ANSWER)
    good = F.col("error").isNull() & (F.lit(True) if since is None else F.col("asked_at") >= F.lit(since))
    own = F.lit(False) if run is None else F.col("run") == run
    # An answer counts before a failure.
    order = F.struct(F.col("error").isNull().alias("good"), "asked_at")
    return rows.where(good | own).groupBy("key").agg(*[F.max_by(c, order).alias(c) for c in ("body", "error", "asked_at")])


def look_up(keys: DataFrame, fetch: Callable[[str], str], folder: str, workers: int = 8, attempts: int = 2, pause: float = 0.4, max_age: float | None = None) -> DataFrame:
    """S-08, S-20. keys: key. Per distinct key: key, body, error, asked_at; a null key has no row.

    What the folder holds, and was asked for within max_age seconds if that is given, isn't asked for again. The rest is dealt to at most `workers` tasks at a time, each
    asking for one key after the other, and is added to the folder in one commit; a task that is lost asks again. The folder must be one that all executors reach.
    """
    spark, run = keys.sparkSession, uuid.uuid4().hex
    wanted = keys.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct()
    since = None if max_age is None else datetime.now(timezone.utc) - timedelta(seconds=max_age)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key in batch["key"]:
                body, error = attempt(fetch, key, attempts, pause)
                yield pd.DataFrame({"key": [key], "body": [body], "error": [error], "asked_at": [pd.Timestamp.now(tz="UTC")], "run": [run]})

    missing = wanted.join(kept_answers(spark, folder, since), "key", "left_anti")
    missing.repartition(workers, "key").mapInPandas(ask, ANSWER).write.mode("append").parquet(folder)
    return kept_answers(spark, folder, since, run).join(wanted, "key", "left_semi")
