"""Cutting a plan's lineage: its rows are written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, written to the session's checkpoint folder and read from there; what made it is not run again, and a lost executor
    costs a reading. Where spark.checkpoint.dir is unset, a temporary folder serves in local mode; elsewhere that is an error.

    A checkpoint() would keep the size that the plan was guessed to have, a product over its joins: in a loop that number's digits
    double each round and fill the driver. Files have the size that they have."""
    spark = df.sparkSession
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="stratalens-")
        context.setCheckpointDir(where)
    path = f"{where.rstrip('/')}/stratalens-cut/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
