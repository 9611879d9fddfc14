"""Execution traces from an event log (node, seq, state): state changes in, one record for each node out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled")


def trace(events: DataFrame, run: str, node: str, seq: str, ts: str, state: str) -> DataFrame:
    """(run, node, state, started, ended, retries, completion_order): the last running and the last terminal event, and the
    rank of each node's first terminal event within its run."""
    over = F.col(state).isin(*TERMINAL)
    running = F.col(state) == "running"
    each = events.groupBy(run, node).agg(
        F.max_by(F.when(over, F.col(state)), F.when(over, F.col(seq))).alias("state"),
        F.max_by(F.when(running, F.col(ts)), F.when(running, F.col(seq))).alias("started"),
        F.max_by(F.when(over, F.col(ts)), F.when(over, F.col(seq))).alias("ended"),
        F.count_if(F.col(state) == "retrying").alias("retries"),
        F.min(F.when(over, F.col(seq))).alias("_first"),
    )
    done = each.where("state IS NOT NULL")
    return done.withColumn("completion_order", F.row_number().over(Window.partitionBy(run).orderBy("_first")) - 1).drop("_first")


def scoped(records: DataFrame, ancestors: DataFrame, run: str, node: str) -> DataFrame:
    """Records of the given nodes, ranked anew."""
    kept = records.join(ancestors, node, "left_semi")
    return kept.withColumn("completion_order", F.row_number().over(Window.partitionBy(run).orderBy("completion_order")) - 1)


def only(records: DataFrame, what: str) -> DataFrame:
    """Records that failed, completed, were cancelled or were retried."""
    return records.where("retries > 0") if what == "retried" else records.where(F.col("state") == what)


def run_record(records: DataFrame, run: str, path: str) -> None:
    """Appends one JSON line for each run to a folder: how many nodes ended how, and the trace in order of completion."""
    steps = F.array_sort(F.collect_list(F.struct("completion_order", *[c for c in records.columns if c not in (run, "completion_order")])))
    counts = [F.count_if(F.col("state") == s).alias(s) for s in TERMINAL]
    records.groupBy(run).agg(*counts, steps.alias("trace")).write.mode("append").json(path)


def since(events: DataFrame, seq: str, after: int) -> DataFrame:
    return events.where(F.col(seq) > after)
