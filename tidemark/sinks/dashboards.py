"""Statistics as flat metrics of a dashboard, histograms as its buckets, and delivery to several receivers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import clean_prefix, path_segment, tensor_prefix
from tidemark.operators.histograms import dashboard_buckets
from tidemark.operators.sampling import by_phase


def flat_metrics(values: DataFrame, prefix: str = "telemetry") -> DataFrame:
    """name, value, step of statistics in long form: prefix/modules/<module>/call_<i>/<path>/<statistic>. One projection."""
    name = F.concat_ws("/", F.lit(clean_prefix(prefix)), tensor_prefix(F.col("module"), F.col("call_index"), F.col("tensor_path")), path_segment(F.col("metric")))
    rows = by_phase(values) if "state" in values.columns else values
    return rows.select(name.alias("name"), "value", F.col("sample_id").alias("step"))


def durations(events: DataFrame, prefix: str = "telemetry") -> DataFrame:
    """name, value, step of the time that collecting took."""
    kind = F.when(F.col("state") == "forward_complete", "forward_collection_duration_ms").otherwise("total_collection_duration_ms")
    return events.select(F.concat_ws("/", F.lit(clean_prefix(prefix)), F.lit("observer"), kind).alias("name"), F.col("collection_duration_ms").alias("value"), F.col("sample_id").alias("step"))


def flat_histograms(found: DataFrame, prefix: str = "telemetry") -> DataFrame:
    """tag, step, bucket_limits, bucket_counts and moments of histograms."""
    tag: Column = F.concat_ws("/", F.lit(clean_prefix(prefix)), tensor_prefix(F.col("module"), F.col("call_index"), F.col("tensor_path")), F.lit("histograms"), path_segment(F.col("name")))
    out = dashboard_buckets(found.where("bin_edges is not null"))
    return out.select(tag.alias("tag"), F.col("sample_id").alias("step"), "minimum", "maximum", F.col("finite_count").alias("num"), "sum", "sum_squares", "bucket_limits", "bucket_counts")


class Receiver:
    """Something that takes the batches of a stream: started once, then given each batch, then closed."""

    def start(self) -> None: ...

    def receive(self, batch: DataFrame, batch_id: int) -> None:
        raise NotImplementedError

    def close(self) -> None: ...


class Calls(Receiver):
    """A receiver from a function, such as one that hands metrics to a logger."""

    def __init__(self, receive: Callable[[DataFrame, int], None]):
        self._receive = receive

    def receive(self, batch: DataFrame, batch_id: int) -> None:
        self._receive(batch, batch_id)


class FanOut(Receiver):
    """Every batch to every receiver: one that fails keeps none of the others from it, and what failed is raised together.

    A receiver that can't start closes those that have. Closing goes in reverse.
    """

    def __init__(self, *receivers: Receiver):
        if not receivers:
            raise ValueError("there is no receiver")
        self.receivers: Sequence[Receiver] = receivers

    def start(self) -> None:
        begun: list[Receiver] = []
        try:
            for r in self.receivers:
                r.start()
                begun.append(r)
        except BaseException as error:
            failed = [error, *_all(reversed(begun), lambda r: r.close())]
            if len(failed) == 1:
                raise
            raise BaseExceptionGroup("receivers could not start", failed) from error

    def receive(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # one computation for all receivers
        try:
            _raise("receivers failed", _all(self.receivers, lambda r: r.receive(batch, batch_id)))
        finally:
            batch.unpersist()

    def close(self) -> None:
        _raise("receivers could not close", _all(reversed(self.receivers), lambda r: r.close()))


def _all(receivers, call) -> list[Exception]:
    failed = []
    for r in receivers:
        try:
            call(r)
        except Exception as error:  # each receiver gets its turn; _raise() raises what is gathered
            failed.append(error)
    return failed


def _raise(what: str, failed: list[Exception]) -> None:
    if failed:
        raise ExceptionGroup(what, failed)
