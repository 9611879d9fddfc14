"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled by a hash of their id. In that order each gets a virtual finish time: the words of
its source so far, itself included, divided by its source's target; a second pass over the source
follows the first, for targets above the source's size. The mix takes items by finish time up to the
total budget, so each source is cut near its target.

Running sums never need a source, or the whole table, in one task: units are dealt to hash-prefix
buckets, buckets get their offsets from a table of bucket sums, and only one bucket at a time is
summed in order. The items are then range-sorted by finish time over the whole cluster; the sums of the
sorted ranges (one row each) tell in which range the budget ends, and that range alone is summed item by item.
Windows without a partition see one row for each source, or one such range.

Results. Size is the number of words, null texts 0; a document of size 0 is never taken. Sources in code
point order, null last, take the weights in turn. No target exceeds ``most_passes`` times its source's
size; the excess goes to the others by weight until none is above. Rows that agree in id, source and
text are one unit: each of them is taken as often. Null ids sort first. Items that finish at the same time
are taken together or not at all. Empty table: no rows. Very long texts count whole; other columns stay
in ``mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.workspace import cut, fresh, quoted

WEIGHTS = (3, 1, 2)
_UNIT_ROWS = 20_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], percent: int, most_passes: int) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    Sorted by how soon they are full, the sources that are capped stand first; the first that is not
    fixes the level for it and all after it. All but the last division is on integers."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    full = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    before, everything = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    seen = ranked.withColumn("w", w).withColumns({
        "num": F.sum("source_size").over(everything) * percent - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * 100 * most_passes,
        "den": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    fits = F.col("num") * F.col("w") <= F.col("source_size") * 100 * most_passes * F.col("den")
    level = F.min(F.when(fits & (F.col("source_size") > 0), F.struct(F.col("source_size") / F.col("w"), "rank", "num", "den"))).over(everything)
    share = (F.col("w") * F.col("l.num")).cast("double") / (F.col("l.den") * 100)
    cap = (F.col("source_size") * most_passes).cast("double")
    return seen.withColumn("l", level).select("source", "source_size", F.coalesce(F.least(share, cap), cap).alias("target"))


def schedule(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most_passes: int = 2) -> DataFrame:
    """One row for each unit: id, source, tie (hash of the text), rows (how many documents), size, source_size, target,
    finish (of the first pass), copies (how often each of them is taken)."""
    raw = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).alias("source"), F.xxhash64(F.col(quoted(text_col))).alias("tie"), word_count(F.col(quoted(text_col))).alias("size"))
    units = cut(raw.groupBy("id", "source", "tie", "size").agg(F.count("*").alias("rows")).withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null "), F.col("tie").cast("string"))).cast("binary"))))
    n = units.count()
    digits = 0
    while n > _UNIT_ROWS * 16**digits:
        digits += 1
    units = units.withColumn("bucket", F.substring("h", 1, digits + 1)).withColumn("mass", F.col("size") * F.col("rows"))

    sums = units.groupBy("source", "bucket").agg(F.sum("mass").alias("mass"))
    goals = targets(sums.groupBy("source").agg(F.sum("mass").alias("source_size")), weights, percent, most_passes)
    start = F.sum("mass").over(Window.partitionBy("source").orderBy("bucket")) - F.col("mass")
    offsets = cut(sums.withColumn("start", start).drop("mass").join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    o = offsets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start", "source_size", "target")
    so_far = units.withColumn("own", F.sum("mass").over(within)).join(o, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    done = cut(so_far.select("id", "source", "tie", "rows", "size", "mass", "source_size", "target", (F.col("start") + F.col("own")).alias("sum")))

    items = done.where("mass > 0 AND target > 0").select("mass", F.explode(F.array(*[(F.col("sum") + F.col("source_size") * i) / F.col("target") for i in range(most_passes)])).alias("f"))
    total = offsets.select("source", "source_size").distinct().agg(F.sum("source_size")).first()[0] or 0
    end = _end(items, min(percent, 100 * most_passes) * total / 100)
    taken = lambda i: F.lit(1) if end is None else ((F.col("sum") + F.col("source_size") * i) / F.col("target") < F.lit(end)).cast("int")
    copies = F.when(F.col("target") > 0, sum((taken(i) for i in range(most_passes)), F.lit(0))).otherwise(0)
    return done.select("id", "source", "tie", "rows", "size", "source_size", "target", F.when((F.col("mass") > 0) & (F.col("target") > 0), F.col("sum") / F.col("target")).alias("finish"), F.when(F.col("mass") > 0, copies).otherwise(0).alias("copies"))


def _end(items: DataFrame, budget: float) -> float | None:
    """The first finish time at which the items, in order, have more words than the budget; None if they never do."""
    ranged = cut(items.repartitionByRange("f").sortWithinPartitions("f").withColumn("place", F.spark_partition_id()))
    before = 0.0
    for r in sorted(ranged.groupBy("place").agg(F.sum("mass").alias("mass")).collect()):
        if before + r.mass > budget:
            upto = F.sum("mass").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, 0)) + before
            return ranged.where(F.col("place") == r.place).withColumn("upto", upto).where(F.col("upto") > budget).agg(F.min("f")).first()[0]
        before += r.mass
    return None


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most_passes: int = 2) -> DataFrame:
    """The mix: the rows of docs that it takes, each as often as taken."""
    plan = schedule(docs, id_col, source_col, text_col, weights, percent, most_passes).where("copies > 0")
    i, s, t, c, x = fresh(docs.columns, "__id", "__source", "__tie", "__copies", "__nth")
    taken = plan.select(F.col("id").alias(i), F.col("source").alias(s), F.col("tie").alias(t), F.col("copies").alias(c))
    same = F.col(quoted(id_col)).eqNullSafe(F.col(i)) & F.col(quoted(source_col)).eqNullSafe(F.col(s)) & (F.xxhash64(F.col(quoted(text_col))) == F.col(t))
    return docs.join(taken, same).withColumn(x, F.explode(F.sequence(F.lit(1), F.col(c)))).drop(i, s, t, c, x)


def mix_in_order(docs: DataFrame, **how) -> DataFrame:
    """The queue itself: the taken items in order of finish time over the whole cluster (id, source, pass_no, finish)."""
    passes = how.get("most_passes", 2)
    plan = schedule(docs, how.pop("id_col", "doc_id"), how.pop("source_col", "source"), how.pop("text_col", "text"), **how).where("copies > 0")
    items = plan.select("id", "source", F.posexplode(F.slice(F.array(*[F.col("finish") + F.col("source_size") / F.col("target") * i for i in range(passes)]), F.lit(1), F.col("copies"))).alias("pass_no", "finish"))
    return items.orderBy("finish", "source", "id", "pass_no")
