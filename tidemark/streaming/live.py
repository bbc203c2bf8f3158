"""The same series from a stream: keyed state that folds every observation once.

Observations arrive as rows of tensors (their elements in an array), which are reduced without a shuffle; then each statistic is
one row to its series' state: some thirty numbers and a ring of the last values, whatever the length of the series. Rows
of a micro-batch are put in the order of event_seq. The state's summary has the columns of operators.indicators.series_of and
the same values. Here the number of series isn't bounded; streaming.bounded gives places to the first ones and holds the state of those only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.numeric import EPS
from tidemark.functions.times import time_text
from tidemark.model import SERIES, TENSOR, IndicatorConfig
from tidemark.operators.indicators import POINTS, names
from tidemark.operators.reduce import long_form, reduce_tensors
from tidemark.sinks import store
from tidemark.sources.tables import scratch

KEYS = "source_rank int, module string, call_index int, signal string, tensor_path string, metric string"
#: Rows of statistics.
VALUES = f"{KEYS}, event_seq bigint, sample_id bigint, value double"
POINT = "struct<value: double, sample_id: bigint, timestamp: string>"
#: Numbers of the state in order, after the four points (each as value and sample_id).
NUMBERS = ["mean", "m2", "square", "x_mean", "sxx", "sxy", "fast", "slow", "change", "volatility2", "gain", "loss", "z", "cusum_up", "cusum_down", "drawdown", "runup"]
STATE = ", ".join(
    ["count bigint", *(f"{p}_{k}" for p in POINTS for k in ("value double", "sample bigint", "time string")), *(f"{n} double" for n in NUMBERS), "rises bigint", "falls bigint", "recent array<double>"]
)
FIELDS = [f.split(" ")[0] for f in STATE.split(", ")]


def output_schema(config: IndicatorConfig) -> str:
    kinds = {n: "bigint" if n.startswith("consecutive") else "double" for n in names(config)}
    return f"{KEYS}, count bigint, warmup_complete boolean, " + ", ".join([*(f"{p} {POINT}" for p in POINTS), *(f"{n} {k}" for n, k in kinds.items())])


def _ratio(a: float | None, b: float | None) -> float | None:
    if a is None or b is None or abs(b) <= EPS:
        return None
    found = a / b
    return found if math.isfinite(found) else None


def begin(x: float, sample: int, time: str | None = None) -> dict:
    s = {"count": 1, "rises": 0, "falls": 0, "recent": [x], **dict.fromkeys(NUMBERS, 0.0), "z": None}
    for p in POINTS:
        s[f"{p}_value"], s[f"{p}_sample"], s[f"{p}_time"] = x, sample, time
    return s | {"mean": x, "square": x * x, "x_mean": float(sample), "fast": x, "slow": x}


def fold(s: dict, x: float, sample: int, config: IndicatorConfig, time: str | None = None) -> None:
    """One more observation."""
    d, n = x - s["latest_value"], s["count"]
    spread = math.sqrt(s["m2"] / n)
    s["z"] = (x - s["mean"]) / spread if spread > EPS else None
    s["count"] = n = n + 1
    gap, step = x - s["mean"], sample - s["x_mean"]
    s["mean"] += gap / n
    s["x_mean"] += step / n
    s["m2"] += gap * (x - s["mean"])
    s["sxx"] += step * (sample - s["x_mean"])
    s["sxy"] += step * (x - s["mean"])
    s["square"] += (x * x - s["square"]) / n
    s["fast"] += config.fast_ema_alpha * (x - s["fast"])
    s["slow"] += config.slow_ema_alpha * (x - s["slow"])
    a, off = config.change_volatility_alpha, d - s["change"]
    s["change"] += a * off
    s["volatility2"] = (1 - a) * (s["volatility2"] + a * off * off)
    s["gain"] += a * (max(d, 0.0) - s["gain"])
    s["loss"] += a * (max(-d, 0.0) - s["loss"])
    if s["z"] is not None:
        s["cusum_up"] = max(0.0, s["cusum_up"] + s["z"] - config.cusum_allowance)
        s["cusum_down"] = max(0.0, s["cusum_down"] - s["z"] - config.cusum_allowance)
    s["rises"] = s["rises"] + 1 if d > 0 else 0
    s["falls"] = s["falls"] + 1 if d < 0 else 0
    for p, here in (("latest", True), ("minimum", x < s["minimum_value"]), ("maximum", x > s["maximum_value"])):
        if here:
            s[f"{p}_value"], s[f"{p}_sample"], s[f"{p}_time"] = x, sample, time
    s["drawdown"] = max(s["drawdown"], s["maximum_value"] - x)
    s["runup"] = max(s["runup"], x - s["minimum_value"])
    s["recent"] = [*s["recent"], x][-(config.pairs + 1) :]


def _autocorrelation(v: list[float]) -> float | None:
    if len(v) < 3:
        return None
    left, right = v[:-1], v[1:]
    a, b = math.fsum(left) / len(left), math.fsum(right) / len(right)
    root = math.sqrt(math.fsum((x - a) ** 2 for x in left) * math.fsum((y - b) ** 2 for y in right))
    return _ratio(math.fsum((x - a) * (y - b) for x, y in zip(left, right, strict=True)), root)


def _reversals(v: list[float]) -> float | None:
    signs = [math.copysign(1, b - a) for a, b in zip(v, v[1:], strict=False) if a != b]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False)) / (len(signs) - 1) if len(signs) > 1 else None


def summary(s: dict, config: IndicatorConfig) -> dict:
    """The columns of a series from its state."""
    n, latest = s["count"], s["latest_value"]
    sd = math.sqrt(s["m2"] / n)
    before = {h: s["recent"][-h - 1] if len(s["recent"]) > h else None for h in config.momentum_horizons}
    out = {
        "mean": s["mean"], "standard_deviation": sd, "root_mean_square": math.sqrt(s["square"]), "coefficient_of_variation": _ratio(sd, abs(s["mean"])),
        "linear_slope_per_sample": _ratio(s["sxy"], s["sxx"]), "slope_r_squared": None if (r := _ratio(s["sxy"] ** 2, s["sxx"] * s["m2"])) is None else min(r, 1.0),
        "fast_ema": s["fast"], "slow_ema": s["slow"], "fast_slow_gap": s["fast"] - s["slow"], "fast_slow_relative_gap": _ratio(s["fast"] - s["slow"], abs(s["slow"])),
        "exponentially_weighted_change_mean": s["change"], "exponentially_weighted_change_volatility": math.sqrt(s["volatility2"]), "latest_z_score": s["z"],
        "historical_range_position": _ratio(latest - s["minimum_value"], s["maximum_value"] - s["minimum_value"]), "maximum_drawdown": s["drawdown"], "maximum_runup": s["runup"],
        "up_down_balance": _ratio(s["gain"] - s["loss"], s["gain"] + s["loss"]), "cusum_positive": s["cusum_up"], "cusum_negative": s["cusum_down"], "cusum_change_score": max(s["cusum_up"], s["cusum_down"]),
        "lag1_autocorrelation": _autocorrelation(s["recent"]), "oscillation_fraction": _reversals(s["recent"][-(config.recent_window + 1) :]), "consecutive_increases": s["rises"], "consecutive_decreases": s["falls"],
        **{f"momentum_{h}_samples": None if b is None else latest - b for h, b in before.items()},
        **{f"relative_momentum_{h}_samples": None if b is None else _ratio(latest - b, abs(b)) for h, b in before.items()},
    }
    points = {p: {"value": s[f"{p}_value"], "sample_id": s[f"{p}_sample"], "timestamp": s[f"{p}_time"]} for p in POINTS}
    return {"count": n, "warmup_complete": n >= config.warm_at, **points, **out}


def stream_series(values: DataFrame, config: IndicatorConfig = IndicatorConfig()) -> DataFrame:
    """A stream of series summaries (update mode) of a stream of SERIES, event_seq, sample_id, value and, where there is one, timestamp (text)."""
    time = F.col("timestamp") if "timestamp" in values.columns else F.lit(None).cast("string")
    kept = values.select(*SERIES, "event_seq", "sample_id", F.col("value").cast("double").alias("value"), time.alias("timestamp"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("event_seq", kind="stable")  # one series' rows of one micro-batch
        s = dict(zip(FIELDS, state.get, strict=True)) if state.exists else None
        if s is not None:
            s["recent"] = list(s["recent"])
        for x, sample, at in zip(rows["value"].tolist(), rows["sample_id"].tolist(), rows["timestamp"].tolist(), strict=True):
            if not math.isfinite(x):
                continue
            at = at if isinstance(at, str) else None
            if s is None:
                s = begin(x, int(sample), at)
            else:
                fold(s, x, int(sample), config, at)
        if s is None:
            return
        state.update(tuple(s[f] for f in FIELDS))
        yield pd.DataFrame([{**dict(zip(SERIES, key, strict=True)), **summary(s, config)}])

    return kept.groupBy(*SERIES).applyInPandasWithState(update, output_schema(config), STATE, "update", GroupStateTimeout.NoTimeout)


def stream_statistics(tensors: DataFrame, config: IndicatorConfig = IndicatorConfig()) -> DataFrame:
    """A stream of statistics in long form of a stream of tensors; narrow."""
    metrics = list(config.temporal_metrics)
    if "ts" not in tensors.columns:
        return long_form(reduce_tensors(tensors, metrics), metrics).drop("metric_ord")
    rows = reduce_tensors(tensors, metrics, keep=[*TENSOR, "ts"]).withColumn("timestamp", time_text(F.col("ts").cast("timestamp")))
    return long_form(rows, metrics, [*TENSOR, "timestamp"]).drop("metric_ord")


def run_to_table(stream: DataFrame, key: Sequence[str], newest: str = "count", mode: str = "update") -> DataFrame:
    """Run a stream of updates (or, in append mode, of new rows) until its input is read, and return the newest row of each key."""
    spark = stream.sparkSession
    out, at = scratch(spark, "stream-out"), scratch(spark, "stream-state")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")  # a batch that is repeated replaces itself

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    return newest_rows(found, key, newest, stream.columns)


def newest_rows(rows: DataFrame, key: Sequence[str], newest: str, columns: Sequence[str]) -> DataFrame:
    whole = F.struct(*columns)
    return rows.groupBy(*key).agg(F.max_by(whole, F.col(newest)).alias("_w")).select("_w.*")


def live_reports(stream: DataFrame, publish: Callable[[DataFrame, int], None], key: Sequence[str] = tuple(SERIES), trigger: dict | None = None):
    """Start a query that keeps the newest summary of every series in versions of a table and calls publish(table, batch_id) after each batch."""
    spark = stream.sparkSession
    root, at = scratch(spark, "live-series"), scratch(spark, "live-state")

    def keep(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id and store.exists(f"{root}/{batch_id - 1}"):
            rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{root}/{batch_id - 1}"))
        newest_rows(rows, key, "count", batch.columns).write.mode("overwrite").parquet(f"{root}/{batch_id}")
        publish(spark.read.schema(batch.schema).parquet(f"{root}/{batch_id}"), batch_id)
        store.remove(f"{root}/{batch_id - 2}")  # a repeated batch needs the version before it, nothing older

    return stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", at).trigger(**(trigger or {"availableNow": True})).start()


def stream_timed(opportunities: DataFrame, seconds: float, by: Sequence[str], time: str = "t", start: str = "t0") -> DataFrame:
    """A stream of the opportunities that a timer takes (append mode); the state of a run is the time at which the next one is due."""
    types = dict(opportunities.dtypes)
    schema = ", ".join([*(f"{b} {types[b]}" for b in by), f"{time} double"])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        due = state.get[0] if state.exists else float(rows[start].min()) + seconds
        kept = []
        for t in rows[time].tolist():
            if t >= due:
                kept.append(t)
                due = t + seconds
        state.update((due,))
        yield pd.DataFrame([dict(zip(by, key, strict=True)) | {time: t} for t in kept], columns=[*by, time])

    kept = opportunities.select(*by, F.col(time).cast("double").alias(time), F.col(start).cast("double").alias(start))
    return kept.groupBy(*by).applyInPandasWithState(update, schema, "due double", "append", GroupStateTimeout.NoTimeout)


HISTOGRAM_OUT = "samples bigint, bin_edges array<double>, bin_counts array<bigint>, finite_count bigint, failed boolean"


def stream_histograms(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A stream of merged histograms (update mode) of a stream of (keys, name, bin_edges, bin_counts, finite_count); a change of edges is final."""
    types = dict(found.dtypes)
    group = [*keys, "name"]
    schema = ", ".join([*(f"{k} {types[k]}" for k in group), HISTOGRAM_OUT])
    fields = ["samples", "bin_edges", "bin_counts", "finite_count", "failed"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(fields, state.get, strict=True)) if state.exists else None
        for rows in batches:
            for edges, counts, n in zip(rows["bin_edges"], rows["bin_counts"], rows["finite_count"], strict=True):
                edges, counts = [float(e) for e in edges], [int(c) for c in counts]
                if s is None:
                    s = {"samples": 1, "bin_edges": edges, "bin_counts": counts, "finite_count": int(n), "failed": False}
                    continue
                s["samples"] += 1
                s["failed"] = bool(s["failed"]) or list(s["bin_edges"]) != edges
                s["bin_counts"] = [a + b for a, b in zip(s["bin_counts"], counts, strict=False)]
                s["finite_count"] += int(n)
        state.update(tuple(s[f] for f in fields))
        yield pd.DataFrame([dict(zip(group, key, strict=True)) | s])

    kept = found.where("bin_edges is not null").select(*group, "bin_edges", "bin_counts", "finite_count")
    return kept.groupBy(*group).applyInPandasWithState(update, schema, HISTOGRAM_OUT, "update", GroupStateTimeout.NoTimeout)
