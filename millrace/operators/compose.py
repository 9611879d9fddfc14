"""Composition: items of a list, races, fixpoints. Bodies are functions from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import kept


def map_items(df: DataFrame, over: Column, body: Callable[[DataFrame], DataFrame], item: str = "item", index: str = "pos") -> DataFrame:
    """The body over one row for each element; other columns are carried along, the place in the list is kept. An empty or null
    list gives one row without place and item, so that its token is not lost (``reduce.collected`` counts nothing there)."""
    return body(df.select("*", F.posexplode_outer(over).alias(index, item)))


def foreach(df: DataFrame, over: Column) -> DataFrame:
    """Adds loop_index, loop_item and loop_total for each element."""
    return df.withColumn("loop_total", F.size(over)).select("*", F.posexplode(over).alias("loop_index", "loop_item"))


def parallel_keys(df: DataFrame, node: str, index: str) -> DataFrame:
    """Adds the output key of each parallel iteration."""
    return df.withColumn("key", F.concat(F.lit(f"{node}#iter:"), F.col(index).cast("string")))


def race_first(df: DataFrame, token: list[str], finished: list[str], ok: Column | None = None) -> DataFrame:
    """The candidate of each token that succeeded first; failures don't stop the race. Aggregated before the shuffle."""
    return _winner(df if ok is None else df.where(ok), token, F.struct(*finished))


def _winner(df: DataFrame, token: list[str], key: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in token]
    return df.groupBy(*token).agg(F.min_by(F.struct(*rest), key).alias("_w")).select(*token, "_w.*").select(*df.columns)


def race_best(df: DataFrame, token: list[str], score: Column, tie: list[str]) -> DataFrame:
    """The candidate of each token with the best score (a number; null is worst), ties by the least of the tie columns."""
    return _winner(df, token, F.struct(score.isNull().alias("_none"), (-score).alias("_score"), *tie))


def parallel_loop(df: DataFrame, over: Column, body: Callable[[DataFrame], DataFrame], node: str) -> DataFrame:
    """The body for each element side by side, its output key and state; without any element one row, cancelled."""
    each = df.select("*", F.posexplode_outer(over).alias("loop_index", "loop_item"))
    state = F.when(F.col("loop_index").isNull(), "cancelled").otherwise("completed")
    return body(parallel_keys(each, node, "loop_index").withColumn("state", state))


@dataclass(frozen=True)
class Loop:
    """What a loop gathered, and why it ended: until_dry, until, break or max_iterations."""

    collected: DataFrame
    count: int
    iterations: int
    dry_rounds: int
    stopped_by: str


def loop(step: Callable[[DataFrame | None, int], DataFrame], key: Column | None = None, until_dry: int | None = None, until: Callable[[DataFrame, int], bool] | None = None, break_on: Column | None = None, max_iterations: int = 10_000) -> Loop:
    """Runs step(gathered so far, None at first; iteration from 0) and gathers rows whose key (default: the row as JSON) is new.

    After each round, in this order: a round's row with break_on true ends the loop, so do ``until_dry`` rounds in a row without a new
    row, and until(gathered, rounds done). Each round's new rows are written once; counts come back."""
    rounds: list[DataFrame] = []
    so_far, count, dry, n, why = None, 0, 0, 0, "max_iterations"
    while n < max_iterations:
        found = step(so_far, n)
        named = found.withColumn("_key", (key if key is not None else F.to_json(F.struct(*found.columns))).cast("string")).dropDuplicates(["_key"])
        known = reduce(DataFrame.union, [r.select(F.col("_key").alias("_seen")) for r in rounds]) if rounds else None
        new = kept(named if known is None else named.join(known.hint("merge"), F.col("_key").eqNullSafe(F.col("_seen")), "left_anti"))
        rounds.append(new)
        n, added = n + 1, new.count()
        count, dry = count + added, 0 if added else dry + 1
        so_far = reduce(DataFrame.unionByName, rounds).drop("_key")
        if break_on is not None and not new.where(break_on).isEmpty():
            why = "break"
        elif until_dry is not None and dry >= until_dry:
            why = "until_dry"
        elif until is not None and until(so_far, n):
            why = "until"
        else:
            continue
        break
    return Loop(so_far, count, n, dry, why)


def while_(df: DataFrame, guard: Callable[[DataFrame], bool], body: Callable[[DataFrame], DataFrame], most: int = 10_000) -> tuple[DataFrame, int]:
    """The body as long as the guard holds; the rows and how often it ran. More than ``most`` rounds are an error."""
    n = 0
    while guard(df):
        if n == most:
            raise RuntimeError(f"the guard still holds after {most} rounds")
        df, n = kept(body(df)), n + 1
    return df, n


def loop_until_dry(start: DataFrame, step: Callable[[DataFrame], DataFrame], key: str, dry_rounds: int = 1, max_rounds: int = 10_000) -> DataFrame:
    """Gathers rows whose key is new, each step from the rows that the round before found, until so many rounds bring nothing new.

    Adds the round of each row. Each round writes its new rows only. Past ``max_rounds`` it is an error, as rows would be missing.
    What is known is merged, not broadcast: it would go through the driver once a round; ``step`` should join its table likewise."""
    rounds = [kept(start.dropDuplicates([key]).withColumn("round", F.lit(0)))]
    dry = n = 0
    while dry < dry_rounds:
        if n == max_rounds:
            raise RuntimeError(f"still new rows after {max_rounds} rounds")
        n += 1
        known = reduce(DataFrame.unionByName, rounds)
        new = kept(step(rounds[-1].drop("round")).dropDuplicates([key]).join(known.select(key).hint("merge"), key, "left_anti").withColumn("round", F.lit(n)))
        dry = dry + 1 if new.isEmpty() else 0
        if not dry:
            rounds.append(new)
    return reduce(DataFrame.unionByName, rounds)


def poll_until(df: DataFrame, token: list[str], attempt: list[str], done: Column, max_attempts: int) -> DataFrame:
    """Over recorded attempts: attempts used until the first that is done, or timed_out after so many."""
    w = Window.partitionBy(*token).orderBy(*attempt)
    tried = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_attempts)
    first = F.min(F.when(done, F.col("_n")))
    return tried.groupBy(*token).agg(F.coalesce(first, F.max("_n")).alias("attempts_used"), first.isNull().alias("timed_out"))


def repeat(df: DataFrame, times: int, body: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The body applied so often; the plan stays lazy."""
    for _ in range(times):
        df = body(df)
    return df
