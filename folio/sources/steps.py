"""Cutting lineage between the rounds of an iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame

from folio.sources import scratch


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the shared checkpoint folder: a lost executor costs no more than the step after it."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch.folder(df.sparkSession))
    return df.checkpoint()
