"""Giving up on a request: the jobs that were started for it are ended, those of others go on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def cancellable(spark: SparkSession, request: str) -> Iterator[None]:
    """Jobs that this thread starts inside bear the request's tag."""
    spark.sparkContext.addJobTag(request)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(request)


def cancel(spark: SparkSession, request: str) -> None:
    """End all running jobs of a request, from any thread."""
    spark.sparkContext.cancelJobsWithTag(request)
