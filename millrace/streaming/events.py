"""Event streams: routing to target nodes, per-batch plans, running state, all by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def read_events(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """The folder's Parquet files as a stream, so many in each micro-batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def route(events: DataFrame, target: str, known: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(events by target node, events for no known node)."""
    return {k: events.where(F.col(target) == k) for k in known}, events.where(~F.coalesce(F.col(target).isin(*known), F.lit(False)))


def run_batches(stream: DataFrame, plan: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Each micro-batch through the plan, until the source has no more; ends like a closed channel."""
    stream.writeStream.foreachBatch(plan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def totals(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Running count, sum and latest event of each key; state lives in Spark's state store."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max("ts").alias("latest"))


def to_table(stream: DataFrame, keys: list[str], folder: str, checkpoint: str) -> DataFrame:
    """The stream's latest row of each key after all available input: each micro-batch writes the keys that it changed as Parquet of its own
    number (run again, it replaces them), so nothing of the state comes to the driver."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/{number}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("_batch", IntegerType())])).parquet(f"{folder}/*")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


def run_routed(stream: DataFrame, target: str, plans: dict[str, Callable[[DataFrame], DataFrame]], folder: str, checkpoint: str) -> DataFrame:
    """Each micro-batch's events through the plan of their target (any node of a flow: see Flow.plan(only_reached=True)); events for an unknown
    target go to the dead letter, and the stream goes on. Returns what was written: the plans' columns, and where (target or ``dead letter``)."""

    def put(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        known, dead = route(held, target, list(plans))
        parts = [plans[k](d).withColumn("where", F.lit(k)) for k, d in known.items()] + [dead.withColumn("where", F.lit("dead letter"))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        out.write.mode("overwrite").parquet(f"{folder}/{number}")
        held.unpersist()

    run_batches(stream, put, checkpoint)
    return stream.sparkSession.read.option("mergeSchema", "true").parquet(f"{folder}/*")


def listen(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """A stream of text files, one event in each line that begins an object; other lines are left out."""
    lines = spark.readStream.text(folder)
    return lines.where(F.ltrim("value").startswith("{")).select(F.from_json("value", schema).alias("e")).select("e.*")
