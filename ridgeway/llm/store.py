"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.stage import clean, new_path, shared_dir, stored

__all__ = ["clean", "new_path", "shared_dir", "small_batches", "stored"]


def small_batches(df: DataFrame, rows: int = 1000, size: int = 4 << 20) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most ``rows`` rows and about ``size`` bytes: texts can be very long, and each task holds a batch twice.

    The settings are the session's and stay, because they are read when the plan runs; smaller ones are left alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        have = df.sparkSession.conf.get(key)
        if not have.rstrip("b").lstrip("-").isdigit() or not 0 < int(have.rstrip("b")) <= most:
            df.sparkSession.conf.set(key, str(most))
    return df
