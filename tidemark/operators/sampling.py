"""Which opportunities are sampled, and which rows and modules take part."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import timer
from tidemark.sources.tables import scratch


def always() -> Column:
    return F.lit(True)


def every_n_forwards(n: int, index: str = "forward_index") -> Column:
    """Every n-th opportunity; the first one taken is number n - 1."""
    if isinstance(n, bool) or not isinstance(n, int) or n <= 0:
        raise ValueError(f"every {n!r}-th can't be taken")
    return (F.col(index) + 1) % n == 0


def seconds_of(interval: timedelta | float) -> float:
    found = interval.total_seconds() if isinstance(interval, timedelta) else float(interval)
    if not found > 0:
        raise ValueError(f"a timer of {found} seconds never waits")
    return found


def numbered(kept: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """sample_id of what was taken, from 0, for each run of the keys `by`; without keys, over all rows by ranges of the order."""
    if by:
        return kept.withColumn("sample_id", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long") - 1)
    spark = kept.sparkSession
    path = scratch(spark, "numbered")
    kept.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranges = spark.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row a partition
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranges.join(F.broadcast(sizes), "_range").withColumn("sample_id", (F.col("_before") + nth).cast("long")).drop("_range", "_before")


#: What a decider returns: its state after an opportunity, and whether that is taken.
Decide = Callable[[object, dict], tuple[object, bool]]


def decided(opportunities: DataFrame, decide: Decide, by: Sequence[str], order: Sequence[str], errors: bool = False) -> DataFrame:
    """Opportunities that a decider of one's own takes; its state is carried along a run of the keys `by`, in order, from None.

    One that fails leaves its state as it was and is not taken; with errors, the failures come instead: by, order, error_type, message. A run's
    rows pass through one task, sorted by Spark, a batch at a time: memory doesn't grow with the run.
    """
    by, order = list(by), list(order)
    plain = opportunities.repartition(*by).sortWithinPartitions(*by, *order)
    fields = [opportunities.schema[c] for c in [*by, *order]] + [T.StructField(n, T.StringType()) for n in ("error_type", "message")]
    schema = T.StructType(fields) if errors else opportunities.schema
    columns = opportunities.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            taken, failed = [], []
            for i, row in enumerate(batch.to_pylist()):
                key = tuple(row[b] for b in by)
                if key != now:
                    now, state = key, None
                try:
                    state, yes = decide(state, row)
                except Exception as error:  # noqa: BLE001  whatever a decider of one's own raises
                    yes = False
                    failed.append({**{c: row[c] for c in [*by, *order]}, "error_type": type(error).__name__, "message": str(error)})
                if yes:
                    taken.append(i)
            if errors:
                if failed:
                    kinds = [*(batch.schema.field(c) for c in [*by, *order]), pa.field("error_type", pa.string()), pa.field("message", pa.string())]
                    yield pa.RecordBatch.from_pylist(failed, pa.schema(kinds))
            elif taken:
                yield batch.take(pa.array(taken)).select(columns)

    return plain.mapInArrow(run, schema)


def timed(opportunities: DataFrame, interval: timedelta | float, by: Sequence[str], time: str = "t", start: str = "t0", segment: int = timer.SEGMENT) -> DataFrame:
    """Keys and times of the opportunities taken by a timer: one is taken from `interval` seconds after the start on, and the timer starts anew there.

    start: the time at which a run of the keys `by` began, its least one. A run without start never begins; a null or non-finite time
    is not taken, and of several at one time one is. The choice depends on the one before, yet a run is not one task: see operators/timer.py.
    segment: opportunities that a task holds at once. Null keys are a run of their own.
    """
    return timer.timed_times(opportunities, seconds_of(interval), list(by), time, start, segment)


def by_phase(rows: DataFrame) -> DataFrame:
    """Outputs of forward rows and gradients of backward rows."""
    return rows.where((F.col("state") == "forward_complete") == (F.col("signal") == "outputs"))


def gradient_path(path: Column) -> Column:
    return F.regexp_replace(path, "^output", "grad_output")


def of_rank(rows: DataFrame, policy: str = "zero", rank: str = "source_rank") -> DataFrame:
    """Rows of rank 0 only ("zero"), or all of them ("all")."""
    if policy not in ("zero", "all"):
        raise ValueError(f"{policy!r} is neither zero nor all")
    return rows.where(F.col(rank) == 0) if policy == "zero" else rows


def plain_dtype(dtype: Column) -> Column:
    """A data type's name without the library it comes from."""
    return F.regexp_replace(dtype, r"^\w+\.", "")


def first_of_each(rows: DataFrame, keys: Sequence[str] = ("source_rank", "sample_id", "state"), order: str = "event_seq") -> DataFrame:
    """Rows of the first event of each sample and phase: a second backward of the same sample is ignored."""
    first = F.min(order).over(Window.partitionBy(*keys))
    return rows.withColumn("_first", first).where(F.col(order) == F.col("_first")).drop("_first")
