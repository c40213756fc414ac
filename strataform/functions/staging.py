"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """The rows, checkpointed at once in spark.checkpoint.dir; a folder of its own only in a local session where that is unset, as in tests."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)
