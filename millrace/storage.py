"""The folder that driver and executors share, and tables kept there between rounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a local master gets a folder of its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if folder is None:
        folder = f"file://{tempfile.gettempdir()}/millrace-{sc.applicationId}"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
