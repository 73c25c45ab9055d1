"""Connected components by least labels with pointer jumping; every step is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work


def components(edges: DataFrame, work: Work, name: str) -> DataFrame:
    """edges: a long, b long, of which either end may be the smaller. Per node of an edge: node, comp (the least node that it reaches)."""
    both = work.table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b"), f"{name}-edges", small=True)
    label = work.table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp")), f"{name}-0", small=True)
    step = 0
    while True:
        step += 1
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        lower = work.table(label.join(near, F.col("node") == F.col("a")).select("node", F.least("comp", "near").alias("comp"), (F.col("near") < F.col("comp")).alias("moved")), f"{name}-{step}-lower", small=True)
        if not lower.where("moved").limit(1).count():
            work.drop(*(n for n in work.names if not n.startswith(f"{name}-") or n == f"{name}-{step - 1}"))
            return label
        root = lower.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        label = work.table(lower.join(root, "comp").select("node", F.col("root").alias("comp")), f"{name}-{step}", small=True)
