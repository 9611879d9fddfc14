"""Ordered accumulation and reducers. The order column is always given; nothing depends on how rows arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accumulate(df: DataFrame, scope: list[str], order: list[str], value: str) -> DataFrame:
    """Adds the running list (nulls kept) and count of a value within its scope."""
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.collect_list(F.struct(F.col(value).alias("v"))).over(w)
    return df.withColumns({"accumulated": F.transform(held, lambda x: x.getField("v")), "count": F.count(F.lit(1)).over(w)})


def _in_order(order: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x.getField("v"))


def replace(order: str, value: str) -> Column:
    """The last value."""
    return F.max_by(value, order)


def append(order: str, value: str) -> Column:
    """All values as a list."""
    return _in_order(order, value)


def concat(order: str, value: str, by: str = "\n") -> Column:
    """All texts in order, joined."""
    return F.array_join(_in_order(order, value), by)


def flatten(order: str, value: str) -> Column:
    """All arrays in order, joined."""
    return F.flatten(_in_order(order, value))


def merge_maps(order: str, value: str) -> Column:
    """One map: for each key the last value that was set, an explicit null included."""
    def step(acc, m):
        return F.map_from_entries(F.concat(F.filter(F.map_entries(acc), lambda e: ~F.map_contains_key(m, e.getField("key"))), F.map_entries(m)))

    by_order = lambda x, y: F.when(x.getField("o") < y.getField("o"), -1).when(x.getField("o") > y.getField("o"), 1).otherwise(0)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))), by_order)
    maps = F.transform(pairs, lambda x: x.getField("v"))
    return F.aggregate(F.slice(maps, F.lit(2), F.greatest(F.size(maps) - 1, F.lit(0))), F.get(maps, F.lit(0)), step)


def merge_rows(df: DataFrame, token: list[str], order: str, maps: str, out: str = "merged") -> DataFrame:
    """One map for each token, by key the last value that was set: each key is aggregated by itself, before any list is made."""
    each = df.select(*token, F.col(order).alias("_o"), F.explode_outer(maps).alias("_k", "_v"))
    last = each.groupBy(*token, "_k").agg(F.max_by("_v", "_o").alias("_v"))
    pairs = F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_v")))
    return last.groupBy(*token).agg(F.map_from_entries(pairs).alias(out))


def node_outputs(df: DataFrame, token: list[str], node: str, values: list[str], out: str = "outputs") -> DataFrame:
    """A subgraph's outputs as one map for each token: node to a struct of its values; of repeated nodes any one."""
    one = df.groupBy(*token, node).agg(F.first(F.struct(*values)).alias("_v"))
    return one.groupBy(*token).agg(F.map_from_entries(F.collect_list(F.struct(node, "_v"))).alias(out))


def usage(df: DataFrame, keys: list[str], tokens_in: str, tokens_out: str, latency: str) -> DataFrame:
    """Calls, tokens and mean latency of each key."""
    both = F.coalesce(F.sum(tokens_in), F.lit(0)) + F.coalesce(F.sum(tokens_out), F.lit(0))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), both.alias("tokens"), F.avg(latency).alias("latency"))


def promote(df: DataFrame, step: str, order: str, value: str) -> DataFrame:
    """(key, value): the last value of each step under its own key and under wf:promoted:<step>."""
    last = df.groupBy(step).agg(replace(order, value).alias("value"))
    keys = F.array(F.col(step).cast("string"), F.concat(F.lit("wf:promoted:"), F.col(step).cast("string")))
    return last.select(F.explode(keys).alias("key"), "value")


def quorum(df: DataFrame, token: list[str], vote: str, threshold: int = 1) -> DataFrame:
    """Votes that are exactly true, and whether they reach the threshold."""
    votes = F.count_if(F.coalesce(F.col(vote), F.lit(False)))
    return df.groupBy(*token).agg(votes.alias("votes"), (votes >= threshold).alias("passed"))


def collected(df: DataFrame, token: list[str], order: str, value: str, failed: str, fail: bool = False) -> DataFrame:
    """Results in order, how many came out well, how many failed. A row without a place stands for an empty list: nothing of
    either. With fail, a failed item fails the run."""
    bad, item = F.coalesce(F.col(failed), F.lit(False)), F.col(order).isNotNull()
    good = F.when(item & ~bad, F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    errors = F.count_if(item & bad)
    if fail:
        errors = F.when(errors > 0, F.raise_error(F.lit("an item failed")).cast("long")).otherwise(errors)
    return df.groupBy(*token).agg(F.transform(F.array_sort(F.collect_list(good)), lambda x: x.getField("v")).alias("results"), F.count_if(item & ~bad).alias("count"), errors.alias("errors"))
