"""The shared folder, and cutting lineage in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where unset, a local master gets a folder of its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if folder is None:
        folder = f"file://{tempfile.gettempdir()}/millrace-{sc.applicationId}"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, what: str) -> str:
    """A name below the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; a lost executor costs nothing that came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame, rows_each: int = 50_000) -> DataFrame:
    """cut(df), in as few partitions as give each so many rows: what reads it next writes as few shuffle files."""
    done = cut(df)
    return done.coalesce(max(1, -(-done.count() // rows_each)))


def table(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: compact where columns repeat values."""
    folder = new_folder(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores in front as it takes to clash with no column (case ignored)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + re.sub("`", "``", name) + "`"
