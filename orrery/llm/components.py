"""Connected components of an edge table, by alternating large and small stars on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Saved


def local_forest(edges: DataFrame) -> DataFrame:
    """Each task's edges (a, b) replaced by stars of what it has joined: same components, fewer edges.

    A task forgets what it has seen every 2^18 edges, which bounds its memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def out() -> pa.RecordBatch:
            rows = [(x, r) for x in parent if (r := root(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], ["a", "b"])

        n = 0
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            n += batch.num_rows
            if n >= 1 << 18:
                yield out()
                n = 0
        if parent:
            yield out()

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, saved: Saved) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is its smallest node."""
    edges = saved.keep(local_forest(edges).distinct(), "edges")
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        new = saved.keep(small.where("a != b").distinct(), "edges")
        # done when all edges are stars with a smallest centre: no node has two parents, none is both parent and child
        two = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        chain = new.select("b").distinct().join(new.select("a").distinct(), F.col("a") == F.col("b"), "left_semi").select(F.col("b").alias("a"))
        open_ = two.unionByName(chain).limit(1).count()
        saved.drop(edges)
        edges = new
        if not open_:
            break
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
