"""Cutting lineage, and a place for relations, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where it is unset: the warehouse, or in local mode a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    return tempfile.gettempdir() if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def settled(frame: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"{shared_base(frame.sparkSession)}/hotleaf-checkpoints")
    return frame.checkpoint(eager=True)
