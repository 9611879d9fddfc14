"""Conversation history and bounded frame sessions, by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_messages(df: DataFrame, key: str, order: str, depth: int) -> DataFrame:
    """The last 2 * depth messages of each conversation."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2 * depth).drop("_rn")


def within_budget(df: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """Drops the oldest messages until the rest fits or two are left; a message costs bytes / 4 + 1."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    cost = F.expr(f"octet_length({text}) div 4 + 1")
    total = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"_cost": total, "_rn": F.row_number().over(w)}).where((F.col("_cost") <= budget) | (F.col("_rn") <= 2)).drop("_cost", "_rn")


def of_ancestors(messages: DataFrame, ancestors: DataFrame, node: str = "node_id") -> DataFrame:
    """Messages whose node is among the ancestors (column node_id) or unknown."""
    return messages.join(ancestors, node, "left_semi").unionByName(messages.where(F.col(node).isNull()))


def bounded_frames(df: DataFrame, session: list[str], order: list[str], stop: Column, max_frames: int | None = None) -> DataFrame:
    """Frames of each session up to the first that stops it, itself included, and at most so many."""
    w = Window.partitionBy(*session).orderBy(*order)
    before = F.coalesce(F.sum(F.coalesce(stop.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = df.withColumns({"_before": before, "frame_index": F.row_number().over(w) - 1}).where("_before = 0").drop("_before")
    return out if max_frames is None else out.where(F.col("frame_index") < max_frames)
