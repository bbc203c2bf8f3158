"""Backwards of a stream and the forwards that they belong to.

Events carry a time. A sample's first backward to arrive is the one that counts; later ones are dropped while the first is remembered, which
is until the watermark has passed it by `delay`. A backward is kept if its sample has a forward at most `within` before or after
it, whichever of the two arrives first. Both states are bounded by the watermark: no sample is remembered for longer than delay and within ask for.

Of several backwards of one sample in the same micro-batch any one is the first; a stream has no order within a micro-batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import SAMPLE


def first_of_each(events: DataFrame, delay: str, keys: Sequence[str] = tuple(SAMPLE), time: str = "ts") -> DataFrame:
    """A stream of the first event of each key (append mode); a stream's watermark is `delay` behind the latest time seen."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def matched(backwards: DataFrame, forwards: DataFrame, delay: str, within: str, time: str = "ts", keys: Sequence[str] = tuple(SAMPLE)) -> DataFrame:
    """A stream of the first backward of every sample that has a forward (append mode), with the columns of the backward.

    One event a sample and phase: what an event holds of tensors should be an array in its row, to be exploded after.
    """
    first = first_of_each(backwards, delay, keys, time).alias("b")
    seen = first_of_each(forwards.select(*keys, time), delay, keys, time).alias("f")
    near = F.expr(f"b.{time} BETWEEN f.{time} - INTERVAL {within} AND f.{time} + INTERVAL {within}")
    on = near
    for k in keys:
        on &= F.col(f"b.{k}") == F.col(f"f.{k}")
    return first.join(seen, on).select("b.*")
