"""Bounds on how many series, paths, calls, histograms and errors are kept, and the counters of what is left out.

Places are given in the order of first appearance and never taken back, so what is kept are the first `cap`
identities of each source rank. First appearances are a grouped minimum; the choice is a ranked window whose top-K
Catalyst takes before the shuffle. The kept identities are at most `cap` a rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import PATH, TENSOR, IndicatorConfig
from tidemark.sources.tables import scratch

#: Order of appearance within the rows; columns that are not there are left out.
ARRIVAL = ["event_seq", "module_ord", "module", "call_index", "path_ord", "tensor_path", "metric_ord"]
CALL = ["source_rank", "module", "call_index"]


def admitted(rows: DataFrame, identity: Sequence[str], cap: int) -> DataFrame:
    """The identities that get a place."""
    order = [c for c in ARRIVAL if c in rows.columns]
    seen = rows.groupBy(*identity).agg(F.min(F.struct(*order)).alias("_at"))
    w = Window.partitionBy("source_rank").orderBy("_at", *[c for c in identity if c != "source_rank"])
    return seen.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).select(*identity)


def split(rows: DataFrame, identity: Sequence[str], cap: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose identity has a place, and the others. The identities are written, so both sides join a table of known size and neither ranks anew."""
    path = scratch(rows.sparkSession, "admitted")
    admitted(rows, identity, cap).write.parquet(path)
    kept = rows.sparkSession.read.parquet(path)
    return rows.join(kept, list(identity), "left_semi"), rows.join(kept, list(identity), "left_anti")


@dataclass(frozen=True)
class Bounded:
    """What is kept, and counts of what isn't: rows of observations for calls and paths, identities for series."""

    tensors: DataFrame
    series: DataFrame
    dropped_calls: DataFrame
    dropped_paths: DataFrame
    dropped_series: DataFrame

    def counters(self) -> DataFrame:
        """One row: dropped_module_call_observations, dropped_tensor_path_observations, dropped_series."""
        one = self.dropped_calls.crossJoin(self.dropped_paths).crossJoin(self.dropped_series)  # three single rows
        return one.select("dropped_module_call_observations", "dropped_tensor_path_observations", "dropped_series")


def _count(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias(name))


def bounded(tensors: DataFrame, values: DataFrame, config: IndicatorConfig = IndicatorConfig()) -> Bounded:
    """Calls, then paths of the calls kept, then series of the paths kept.

    tensors: a row a tensor observation (TENSOR keys); values: a row a statistic of it (TENSOR, metric, metric_ord, value).
    """
    calls, no_calls = split(tensors, CALL, config.max_module_calls)
    paths, no_paths = split(calls, PATH, config.max_tensor_paths)
    values = values.where(F.col("metric").isin(*config.temporal_metrics)).join(paths.select(*TENSOR), TENSOR, "left_semi")
    identity = [*PATH, "metric"]
    kept, away = split(values, identity, config.max_series)
    return Bounded(
        paths, kept, _count(no_calls, "dropped_module_call_observations"), _count(no_paths, "dropped_tensor_path_observations"), _count(away.select(*identity).distinct(), "dropped_series")
    )


def bounded_histograms(histograms: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """Histograms of the first `cap` (path, name), and a row with dropped_histogram_observations."""
    kept, away = split(histograms, [*PATH, "name"], cap)
    return kept, _count(away, "dropped_histogram_observations")


def latest_state(tensors: DataFrame, statistics: Sequence[str] = ()) -> DataFrame:
    """A row a path: observations, shape_changes (by the one before), and the last observation's shape and statistics."""
    w = Window.partitionBy(*PATH).orderBy("event_seq")
    rows = tensors.withColumn("_changed", F.coalesce((F.col("shape") != F.lag("shape").over(w)).cast("int"), F.lit(0)))
    last = [F.max_by(c, "event_seq").alias(c) for c in ("sample_id", "shape", *statistics)]
    return rows.groupBy(*PATH).agg(F.count(F.lit(1)).alias("observations"), F.sum("_changed").alias("shape_changes"), *last)


def run_state(events: DataFrame) -> DataFrame:
    """One row: updated_at, samples_observed, backward_samples_observed of rows (sample_id, state, ts)."""
    forward = F.col("state") == "forward_complete"
    return events.agg(
        F.max("ts").alias("updated_at"), F.coalesce(F.max(F.when(forward, F.col("sample_id"))) + 1, F.lit(0)).alias("samples_observed"),
        F.count_if(F.col("state") == "backward_observed").alias("backward_samples_observed"),
    )


def observer_series(events: DataFrame, order: str = "event_seq") -> DataFrame:
    """Durations of collection as series of their own, without bounds: of the forward, and of forward and backward together."""
    name = F.when(F.col("state") == "forward_complete", "forward_collection_duration_ms").otherwise("total_collection_duration_ms")
    return events.select(name.alias("metric"), F.col(order).alias("event_seq"), "sample_id", F.col("collection_duration_ms").alias("value"))


def error_summaries(errors: DataFrame, cap: int = 100, order: Column | str = "ts") -> DataFrame:
    """Errors by (module, probe, error_type, message): count, first_ts, latest_ts; the first `cap` of them to appear.

    A null module is its own. What is beyond the bound is counted by dropped_errors().
    """
    key = ["module", "probe", "error_type", "message"]
    ranked = errors.groupBy(*key).agg(F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("latest_ts"), F.min(order).alias("_at"))
    return ranked.orderBy("_at", *key).limit(cap).drop("_at")


def dropped_errors(errors: DataFrame, cap: int = 100, order: Column | str = "ts") -> DataFrame:
    """One row: occurrences of errors that error_summaries() leaves out."""
    kept = error_summaries(errors, cap, order).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("kept"))
    return errors.agg(F.count(F.lit(1)).alias("all")).crossJoin(kept).select((F.col("all") - F.col("kept")).alias("dropped_error_summaries"))  # two single rows
