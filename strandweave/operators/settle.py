"""Steps that are computed once and written, so that plans behind them stay small."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in ``spark.checkpoint.dir``: computed once, safe against lost executors.

    A temporary folder is used only where none is set (local runs). Unlike a cached frame it
    is a leaf of later plans: what led to it isn't planned, printed or computed again.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="strandweave-checkpoint-"))
    return df.checkpoint(eager=True)
