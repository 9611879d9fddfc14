"""Keyed state: scoped lookups, suspended rows and their responses, memo tables, saved node outputs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scoped_lookup(df: DataFrame, key: str, scope: str, state: DataFrame, out: str = "value") -> DataFrame:
    """The state's value (scope, key, value) for a row's key in its own scope, else in global, else in parent.

    Spark broadcasts a state table that is small enough by its own estimate; else the joins shuffle."""
    level = lambda s, n: state.where(s).select(*([F.col("scope").alias(scope)] if n == 0 else []), F.col("key").alias(key), F.col("value").alias(f"__{n}"))
    own, shared, parent = level("scope NOT IN ('global', 'parent')", 0), level("scope = 'global'", 1), level("scope = 'parent'", 2)
    out_df = df.join(own, [scope, key], "left").join(shared, key, "left").join(parent, key, "left")
    return out_df.withColumn(out, F.coalesce("__0", "__1", "__2")).drop("__0", "__1", "__2")


def suspend(df: DataFrame, waits: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that go on, rows that wait for a response)."""
    w = F.coalesce(waits, F.lit(False))
    return df.where(~w), df.where(w)


def resume(pending: DataFrame, responses: DataFrame, token: str) -> DataFrame:
    """Waiting rows with their responses; without one they stay out."""
    return pending.join(responses, token)


def unanswerable(pending: DataFrame, responses: DataFrame, token: str) -> DataFrame:
    """Responses to rows that do not wait: any at all makes a batch of responses invalid."""
    return responses.join(pending, token, "left_anti")


def submit(pending: DataFrame, responses: DataFrame, token: str) -> DataFrame:
    """resume, all or nothing: a single response to a row that does not wait makes the whole batch an error when it is computed."""
    wrong = unanswerable(pending, responses, token).agg(F.count(F.lit(1)).alias("_wrong"))
    n = wrong.scalar()
    said = F.raise_error(F.concat(n.cast("string"), F.lit(" responses answer no waiting row"))).cast("boolean")
    return resume(pending, responses, token).where(F.when(n > 0, said).otherwise(True))


def layered(*layers: DataFrame) -> DataFrame:
    """(key, value) of run inputs: config, then saved state, then arguments; of equal keys the later layer's value."""
    ranked = [d.select("key", F.col("value"), F.lit(i).alias("_layer")) for i, d in enumerate(layers)]
    out = ranked[0]
    for d in ranked[1:]:
        out = out.union(d)
    return out.groupBy("key").agg(F.max_by("value", "_layer").alias("value"))


def memo(calls: DataFrame, cache: DataFrame, keys: list[str], now: Column, ttl_s: int) -> tuple[DataFrame, DataFrame]:
    """(answered from the cache, still to do); a cached row (key, at, response) lives so many seconds."""
    keyed = calls.withColumn("_key", F.sha2(F.to_json(F.struct(*sorted(keys))), 256))
    live = cache.where(F.unix_timestamp(now) - F.unix_timestamp("at") < ttl_s).select(F.col("key").alias("_key"), "response")
    return keyed.join(live, "_key"), keyed.join(live, "_key", "left_anti")


def snapshot(df: DataFrame, folder: str, run: str, node: str) -> DataFrame:
    """A node's output in a run, computed unless the folder has it complete (Spark marks that), and read back. Another run
    name, or another schema, is another output."""
    spark: SparkSession = df.sparkSession
    shape = hashlib.sha256(df.schema.json().encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/{run}/{node}-{shape}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
