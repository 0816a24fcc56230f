"""Scoring of streams, and moments gathered from micro-batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import Model
from ..operators.moments import Moments, moments_by


def score_stream(stream: DataFrame, model: Model, weights: str = "auto") -> DataFrame:
    """Scores are a projection without state, so a stream is scored like a table."""
    return model.transform(stream, weights, append=True)


class MomentStream:
    """Moments of all rows seen so far; cross-products add up, so the sums over micro-batches are exact.

    A batch that Spark repeats after a failure counts once, by its number.
    """

    def __init__(self, columns):
        self.columns, self.total, self.seen = tuple(columns), None, -1

    def add(self, batch: DataFrame, number: int) -> None:
        if number <= self.seen:
            return
        from pyspark.sql import functions as F

        got = moments_by(batch.withColumn("__all", F.lit(0)), self.columns, key="__all").get(0)
        if got is not None:
            self.total = got if self.total is None else self.total + got
        self.seen = number

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    @property
    def moments(self) -> Moments:
        p = len(self.columns)
        return self.total if self.total is not None else Moments(self.columns, 0, np.zeros(p), np.zeros((p, p)))
