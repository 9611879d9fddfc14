"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.workspace import settled

#: Edges (of 16 bytes) up to which one task joins them all at once; above, stars are contracted over the cluster.
ONE_TASK = 200_000


def _at_once(batches):
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = top(u), top(v)
            up[max(a, b)] = min(a, b)
    rows = [(x, top(x)) for x in up]
    for at in range(0, len(rows), 50_000):
        part = [r for r in rows[at : at + 50_000] if r[0] != r[1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in (0, 1)], names=["id", "component"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex hands its larger neighbours to the smallest vertex that it knows."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex hands its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of an edge (a, b) of longs that is not itself the component: the
    smallest vertex that it reaches. Self-loops and repeated edges are allowed; no edges give no rows.

    Up to ``ONE_TASK`` distinct edges are joined in one task, as rounds over the cluster would only cost their start;
    the result is the same. Rounds are few (the stars halve path lengths) and each is written to the shared folder; only a
    count and a checksum of the edges come to the driver."""
    now = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if now.count() <= ONE_TASK:
        return now.coalesce(1).mapInArrow(_at_once, "id long, component long")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0))).first())
        if mark[0] == 0 or mark == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = mark
        now = settled(_small_star(_large_star(now)))
