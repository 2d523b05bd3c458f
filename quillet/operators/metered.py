"""figures of each stage of a job, taken in the pass that makes its rows."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Stages:
    """Counts rows, and whatever sums are asked for, where a stage's rows pass by, and times actions. Nothing is read again:
    the figures come with the action that runs the plan."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}
        self._took: dict[str, int] = {}

    def metered(self, name: str, df: DataFrame, **sums: Column) -> DataFrame:
        """The rows, observed as stage ``name``; ``sums`` are aggregates over them."""
        self._seen[name] = Observation(name)
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in sums.items()])

    @contextmanager
    def timed(self, name: str):
        """Milliseconds of what the block does."""
        began = time.monotonic()
        try:
            yield
        finally:
            self._took[name] = round((time.monotonic() - began) * 1000)

    def figures(self, spark: SparkSession) -> DataFrame:
        """stage, figure, value of all observed stages; waits for their first action."""
        rows = [(stage, figure, int(value or 0)) for stage, seen in self._seen.items() for figure, value in seen.get.items()]
        return spark.createDataFrame(rows, "stage string, figure string, value long")

    def times(self, spark: SparkSession) -> DataFrame:
        """stage, ms of all timed blocks."""
        return spark.createDataFrame(list(self._took.items()), "stage string, ms long")
