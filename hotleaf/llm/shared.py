"""Cutting lineage in the folder that all executors share, and broadcasts of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotleaf.sources.checkpoints import settled

__all__ = ["settled", "small"]

#: Frames of more bytes (as JSON, which is longer than the rows) are joined by a shuffle.
BROADCAST_BYTES = 48 << 20


def small(frame: DataFrame) -> DataFrame:
    """The frame, marked for a broadcast if its rows, which are counted and measured, have at most BROADCAST_BYTES."""
    size = frame.select(F.octet_length(F.to_json(F.struct("*"))).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    return F.broadcast(frame) if size <= BROADCAST_BYTES else frame
