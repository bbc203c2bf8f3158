"""A stream's telemetry in bounded keyed state, from which a complete report can be read at any time.

Two stateful operators follow one another. Both are transformWithState processors, whose state lies in RocksDB and goes to
the checkpoint as changes; a query that starts with the checkpoint of an earlier one goes on where that ended.

1. Admission, keyed by source rank. Places are given in the order of arrival and never taken back: to the first calls, to the
   first paths of these, to the first series of these, and to the first histograms and errors. A map holds the identities that have a place,
   with the metrics of a path that came too late; what is refused otherwise is only counted. So a rank's state holds at
   most max_module_calls + max_tensor_paths + max_histograms + max_error_summaries entries, however many identities the stream has.
2. Folding, keyed by what has a place: the state of a series (some thirty numbers and a ring of the last values), the observations of a
   path, a histogram's merged counts, an error's occurrences. Its keys are bounded by the admission.

Tensors are reduced before both, without a shuffle: through the admission passes one row a tensor with one number a metric, and series are unpivoted after it.
A rank is one key of the admission, as the places of a rank are given one after another; ranks are what runs in parallel there.

known() is what has been folded up to and with a micro-batch: the state of the batch before, read by the state data source,
without what the batch has changed, and the batch's own rows. Nothing is rewritten: a batch costs the changes in the state store, and one reading of it for a report.

Rows of a micro-batch are taken in the order of event_seq. Durations of collection are series that no bound refuses. A null value is no observation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions.times import time_text
from tidemark.model import METRICS, PATH, SERIES, TENSOR, HistogramConfig, IndicatorConfig
from tidemark.operators import histograms as H
from tidemark.operators.reduce import reduce_tensors
from tidemark.streaming import live

KEYS = ["kind", *PATH, "name"]
KEY_TYPES = "kind string, source_rank int, module string, call_index int, signal string, tensor_path string, name string"
#: A row of telemetry; call_index is 0 where there is none, as pandas makes keys of whole numbers beside nulls into floats. amounts: one number a metric, or the duration; counts, moments: of a histogram, as COUNTS and MOMENTS.
ROW = f"{KEY_TYPES}, event_seq bigint, sample_id bigint, timestamp string, amounts array<double>, shape array<int>, bin_edges array<double>, bin_counts array<bigint>, counts array<bigint>, moments array<double>"
COUNTS = ["finite_count", "nonfinite_count", "underflow_count", "overflow_count"]
MOMENTS = ["minimum", "maximum", "sum", "sum_squares"]
#: Counters of what is refused, in the order of the row that carries them.
DROPPED = ["dropped_module_call_observations", "dropped_tensor_path_observations", "dropped_series", "dropped_histogram_observations", "dropped_error_summaries"]
_TAKEN = ["calls", "paths", "series", "histograms", "errors"]
PLACE = "what string, module string, call_index int, signal string, tensor_path string, name string"
PATH_STATE = "observations bigint, shape_changes bigint, sample_id bigint, shape array<int>"
HISTOGRAM_STATE = "samples bigint, latest_sample bigint, bin_edges array<double>, bin_counts array<bigint>, counts array<bigint>, moments array<double>, failed boolean"
ERROR_STATE = "count bigint, first_ts string, latest_ts string"


def _typed(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of a plain list of columns."""
    return [tuple(c.strip().split(" ", 1)) for c in ddl.split(", ")]


def _rows(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    """df in the form of ROW; what isn't given is null."""
    given = {"kind": F.lit(kind), **columns}
    return df.select(*((given[n] if n in given else F.lit(None)).cast(t).alias(n) for n, t in _typed(ROW)))


def _columns(df: DataFrame, *names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names if n in df.columns}


def metrics_of(config: IndicatorConfig) -> list[str]:
    """The metrics that become series, in canonical order: that in which the places of a tensor's series are given."""
    return [m for m in METRICS if m in config.temporal_metrics]


def tensor_rows(tensors: DataFrame, config: IndicatorConfig = IndicatorConfig()) -> DataFrame:
    """Tensors (TENSOR keys, elements and, where there are some, shape and ts) as one row each with the metrics' values; narrow."""
    metrics = metrics_of(config)
    keep = [c for c in (*TENSOR, "shape", "ts") if c in tensors.columns]
    found = reduce_tensors(tensors, metrics, keep=keep)
    time = {"timestamp": time_text(F.col("ts").cast("timestamp"))} if "ts" in keep else {}
    return _rows(found, "tensor", amounts=F.array(*metrics), **_columns(found, *TENSOR, "shape"), **time)


def histogram_rows(tensors: DataFrame, config: HistogramConfig | H.OwnHistogram) -> DataFrame:
    """The tensors' histograms that are there, as rows; narrow."""
    found = (H.own_histograms if isinstance(config, H.OwnHistogram) else H.tensor_histograms)(tensors, config).where("bin_edges is not null")
    return _rows(found, "histogram", counts=F.array(*COUNTS), moments=F.array(*MOMENTS), **_columns(found, *TENSOR, "name", "bin_edges", "bin_counts"))


def error_rows(errors: DataFrame) -> DataFrame:
    """Errors (module, probe, error_type, message and, where there are some, source_rank, event_seq, ts) as rows."""
    time = {"timestamp": time_text(F.col("ts").cast("timestamp"))} if "ts" in errors.columns else {}
    rank = F.col("source_rank") if "source_rank" in errors.columns else F.lit(0)
    return _rows(errors, "error", source_rank=rank, call_index=F.lit(0), signal=F.col("probe"), tensor_path=F.col("error_type"), name=F.col("message"), **_columns(errors, "module", "event_seq"), **time)


def duration_rows(durations: DataFrame) -> DataFrame:
    """Durations (metric, event_seq, sample_id, value and, where there is one, source_rank; as caps.observer_series gives them) as rows."""
    rank = F.col("source_rank") if "source_rank" in durations.columns else F.lit(0)
    blank = F.lit("")
    return _rows(durations, "duration", source_rank=rank, module=blank, call_index=F.lit(0), signal=blank, tensor_path=blank, name=F.col("metric"), amounts=F.array("value"), **_columns(durations, "event_seq", "sample_id"))


class Admission(StatefulProcessor):
    """Gives the places of one source rank. Rows with a place go on, metrics without one become null; one row carries the counters."""

    def __init__(self, config: IndicatorConfig):
        self.config = config

    def init(self, handle) -> None:
        self.places = handle.getMapState("places", PLACE, "taken string, refused string")
        self.counters = handle.getValueState("counters", ", ".join(f"{n} bigint" for n in (*_TAKEN, *DROPPED)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        order = ["event_seq", "module", "call_index", "tensor_path", "signal", "kind", "name"]
        batch = pd.concat(list(rows)).sort_values(order, kind="stable")
        names, config = [*_TAKEN, *DROPPED], self.config
        n = dict(zip(names, self.counters.get(), strict=True)) if self.counters.exists() else dict.fromkeys(names, 0)
        known: dict[tuple, tuple | None] = {}
        fresh: set[tuple] = set()

        def place(at: tuple) -> tuple | None:
            if at not in known:
                known[at] = self.places.getValue(at)
            return known[at]

        def admitted(at: tuple, what: str, most: int, refusal: str) -> bool:
            if place(at) is None:
                if n[what] >= most:
                    n[refusal] += 1
                    return False
                n[what] += 1
                known[at] = ("0", "0")
                fresh.add(at)
            return True

        kept, amounts = [], []
        columns = [batch[c].tolist() for c in ("kind", "module", "call_index", "signal", "tensor_path", "name", "amounts")]
        for i, (kind, module, call, signal, path, name, numbers) in enumerate(zip(*columns, strict=True)):
            if kind == "error":
                yes = admitted(("error", module, None, signal, path, name), "errors", config.max_error_summaries, DROPPED[4])
            elif kind == "histogram":
                yes = admitted(("histogram", module, int(call), signal, path, name), "histograms", config.max_histograms, DROPPED[3])
            elif kind == "tensor":
                at = ("path", module, int(call), signal, path, None)
                yes = admitted(("call", module, int(call), None, None, None), "calls", config.max_module_calls, DROPPED[0]) and admitted(at, "paths", config.max_tensor_paths, DROPPED[1])
                if yes:
                    numbers = self._series(at, numbers, known, fresh, n)
            else:
                yes = True
            if yes:
                kept.append(i)
                amounts.append(numbers)
        for at in fresh:
            self.places.updateValue(at, known[at])
        self.counters.update(tuple(n[c] for c in names))
        out = batch.iloc[kept].copy()
        out["amounts"] = pd.Series(amounts, index=out.index, dtype=object)
        yield out[[c for c, _ in _typed(ROW)]]
        yield pd.DataFrame([{**dict.fromkeys(c for c, _ in _typed(ROW)), "kind": "counters", "source_rank": key[0], "call_index": 0, "counts": [n[c] for c in DROPPED]}], dtype=object)

    def _series(self, at: tuple, numbers: Sequence[float] | None, known: dict, fresh: set, n: dict) -> list[float | None]:
        """The numbers of the metrics that have a place. Which these are, and which are refused, stands in two bit sets of the path."""
        taken, refused = (int(x, 16) for x in known[at])
        out, before = [], (taken, refused)
        for i, x in enumerate(() if numbers is None else numbers):
            here = x is not None and math.isfinite(x)
            if here and not (taken | refused) >> i & 1:
                if n["series"] < self.config.max_series:
                    n["series"] += 1
                    taken |= 1 << i
                else:
                    n[DROPPED[2]] += 1
                    refused |= 1 << i
            out.append(float(x) if here and taken >> i & 1 else None)
        if (taken, refused) != before:
            known[at] = (f"{taken:x}", f"{refused:x}")
            fresh.add(at)
        return out

    def close(self) -> None:
        pass


def admitted(rows: DataFrame, config: IndicatorConfig = IndicatorConfig()) -> DataFrame:
    """A stream of ROW: what has a place of the stream `rows`, and rows of counters."""
    return rows.groupBy("source_rank").transformWithStateInPandas(Admission(config), ROW, "append", "None")


def unpivoted(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Admitted tensors as a row for the path and one for each metric that has a place; other rows as they are."""
    numbers = [F.struct(F.lit("series").alias("kind"), F.lit(m).alias("name"), F.get("amounts", i).alias("value")) for i, m in enumerate(metrics)]
    path = F.struct(F.lit("path").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("value"))
    series = F.filter(F.array(*numbers), lambda s: s["value"].isNotNull())
    own = F.array(F.struct(F.col("kind"), F.col("name"), F.get("amounts", 0).alias("value")))
    others = [c for c, _ in _typed(ROW) if c not in ("kind", "name", "amounts")]
    items = F.when(F.col("kind") == "tensor", F.concat(F.array(path), series)).otherwise(own)
    return rows.select(*others, F.explode(items).alias("_i")).select("_i.kind", *PATH, "_i.name", *(c for c in others if c not in PATH), "_i.value")


def _out(config: IndicatorConfig) -> str:
    series = live.output_schema(config).split(f"{live.KEYS}, ")[1].replace("struct<value: double, sample_id: bigint, timestamp: string>", "struct<value:double,sample_id:bigint,timestamp:string>")
    inner = lambda ddl: ddl.replace(" ", ":").replace(",:", ",")
    return f"{KEY_TYPES}, series struct<{inner(series)}>, path struct<{inner(PATH_STATE)}>, histogram struct<{inner(HISTOGRAM_STATE)}>, error struct<{inner(ERROR_STATE)}>, counts array<bigint>"


class Folding(StatefulProcessor):
    """Folds the rows of one key into its state and says what that has become."""

    def __init__(self, config: IndicatorConfig):
        self.config = config
        self.columns = [*KEYS, "series", "path", "histogram", "error", "counts"]

    def init(self, handle) -> None:
        self.states = {k: handle.getValueState(k, ddl) for k, ddl in (("series", live.STATE), ("path", PATH_STATE), ("histogram", HISTOGRAM_STATE), ("error", ERROR_STATE))}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("event_seq", kind="stable")
        kind = key[0]
        if kind == "counters":
            yield self._made(key, counts=[max(c) for c in zip(*batch["counts"], strict=True)])
            return
        name = "series" if kind == "duration" else kind
        state = self.states[name]
        old = tuple(state.get()) if state.exists() else None
        new = getattr(self, f"_{name}")(old, batch)
        if new is None:
            return
        state.update(tuple(new.values()))
        yield self._made(key, **{name: live.summary(new, self.config) if name == "series" else new})

    def _made(self, key: tuple, **found) -> pd.DataFrame:
        return pd.DataFrame([{**dict.fromkeys(self.columns), **dict(zip(KEYS, key, strict=True)), **found}], dtype=object)

    def _series(self, old: tuple | None, batch: pd.DataFrame) -> dict | None:
        s = None if old is None else dict(zip(live.FIELDS, old, strict=True))
        if s is not None:
            s["recent"] = list(s["recent"])
        for x, sample, at in zip(batch["value"].tolist(), batch["sample_id"].tolist(), batch["timestamp"].tolist(), strict=True):
            if x is None or not math.isfinite(x):
                continue
            at = at if isinstance(at, str) else None
            if s is None:
                s = live.begin(x, int(sample), at)
            else:
                live.fold(s, x, int(sample), self.config, at)
        return None if s is None else {f: s[f] for f in live.FIELDS}

    def _path(self, old: tuple | None, batch: pd.DataFrame) -> dict:
        n, changes, last, shape = old or (0, 0, None, None)
        shape = None if shape is None else list(shape)
        for sample, found in zip(batch["sample_id"].tolist(), batch["shape"].tolist(), strict=True):
            found = None if found is None else [int(x) for x in found]
            changes += n > 0 and found is not None and shape is not None and found != shape
            n, last, shape = n + 1, int(sample), found
        return {"observations": n, "shape_changes": changes, "sample_id": last, "shape": shape}

    def _histogram(self, old: tuple | None, batch: pd.DataFrame) -> dict:
        samples, last, edges, bins, counts, moments, failed = old or (0, None, None, None, None, None, False)
        for row in batch[["sample_id", "bin_edges", "bin_counts", "counts", "moments"]].itertuples(index=False):
            here = [float(e) for e in row.bin_edges]
            if edges is None:
                edges, bins, counts, moments = here, [int(c) for c in row.bin_counts], [int(c) for c in row.counts], [float(m) for m in row.moments]
            else:
                failed = bool(failed) or list(edges) != here  # final: what is merged then counts no more
                bins = [int(a + b) for a, b in zip(bins, row.bin_counts, strict=False)]
                counts = [int(a + b) for a, b in zip(counts, row.counts, strict=True)]
                low, high, total, squares = moments
                moments = [min(low, float(row.moments[0])), max(high, float(row.moments[1])), total + float(row.moments[2]), squares + float(row.moments[3])]
            samples, last = samples + 1, int(row.sample_id)
        return {"samples": samples, "latest_sample": last, "bin_edges": list(edges), "bin_counts": list(bins), "counts": list(counts), "moments": list(moments), "failed": bool(failed)}

    def _error(self, old: tuple | None, batch: pd.DataFrame) -> dict:
        times = [t if isinstance(t, str) else None for t in batch["timestamp"].tolist()]
        n, first, _ = old or (0, times[0], None)
        return {"count": n + len(batch), "first_ts": first, "latest_ts": times[-1]}

    def close(self) -> None:
        pass


def folded(rows: DataFrame, config: IndicatorConfig = IndicatorConfig()) -> DataFrame:
    """A stream of what every key of the stream `rows` (ROW) has become in a micro-batch: KEYS and the state of its kind (series: its summary)."""
    return unpivoted(admitted(rows, config), metrics_of(config)).groupBy(*KEYS).transformWithStateInPandas(Folding(config), _out(config), "append", "None")


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB, which transformWithState asks for."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Places of the two operators in the query, counted from the sink, and the state variables of the first one.
FOLDING, ADMISSION = 0, 1
PARTS = ["series", "path", "histogram", "error"]


def state_table(spark: SparkSession, checkpoint: str, variable: str, batch_id: int | None = None, operator: int = FOLDING) -> DataFrame:
    """key, value (for the admission's places also user_map_key) of a state variable after a committed batch, by default the last one."""
    reader = spark.read.format("statestore").option("stateVarName", variable).option("operatorId", operator)
    return (reader if batch_id is None else reader.option("batchId", batch_id)).load(checkpoint)


def _as_rows(table: DataFrame, part: str, config: IndicatorConfig) -> DataFrame:
    """A state variable of Folding in the form of folded(): KEYS and the column of its kind."""
    keys = [F.col(f"key.{k}").alias(k) for k in KEYS]
    if part != "series":
        return table.select(*keys, F.col("value").alias(part))
    flat = table.select(*keys, "value.*")
    inner = _out(config).split("series struct<")[1].split(">, path")[0]

    def summarize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            states = frame[live.FIELDS].astype(object).where(frame[live.FIELDS].notna(), None).itertuples(index=False, name=None)
            found = [live.summary({**dict(zip(live.FIELDS, s, strict=True)), "recent": list(s[-1])}, config) for s in states]
            yield pd.DataFrame({**{k: frame[k] for k in KEYS}, "series": pd.Series(found, index=frame.index, dtype=object)})

    return flat.mapInPandas(summarize, f"{KEY_TYPES}, series struct<{inner}>")


def committed(spark: SparkSession, checkpoint: str, config: IndicatorConfig = IndicatorConfig(), batch_id: int | None = None) -> DataFrame:
    """All that is known after a committed batch, by default the last one, in the form of folded()."""
    found = spark.createDataFrame([], _out(config))
    for part in PARTS:
        found = found.unionByName(_as_rows(state_table(spark, checkpoint, part, batch_id), part, config), allowMissingColumns=True)
    counters = state_table(spark, checkpoint, "counters", batch_id, ADMISSION)
    counts = counters.select(F.lit("counters").alias("kind"), F.col("key.source_rank").alias("source_rank"), F.lit(0).alias("call_index"), F.array(*(f"value.{n}" for n in DROPPED)).alias("counts"))
    return found.unionByName(counts, allowMissingColumns=True)


def known(batch: DataFrame, batch_id: int, checkpoint: str, config: IndicatorConfig = IndicatorConfig()) -> DataFrame:
    """All that is known after a micro-batch of folded(), inside its foreachBatch. The batch is read twice, so it should be persisted."""
    if not batch_id:
        return batch
    same = F.lit(True)
    for k in KEYS:
        same &= F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
    old = committed(batch.sparkSession, checkpoint, config, batch_id - 1)
    return old.alias("old").join(batch.select(*KEYS).alias("new"), same, "left_anti").unionByName(batch)


def run_to_state(rows: DataFrame, checkpoint: str, config: IndicatorConfig = IndicatorConfig()) -> DataFrame:
    """Fold a stream of ROW until its input is read, and return all that is then known (see committed())."""
    spark = rows.sparkSession
    with rocksdb(spark):
        query = folded(rows, config).writeStream.outputMode("append").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return committed(spark, checkpoint, config)


def tables(found: DataFrame) -> dict[str, DataFrame]:
    """What is known by kind: `series` (with durations, which have a kind of their own), `path`, `histogram`, `error` and `counters` (a row a rank)."""
    out = {part: found.where(F.col(part).isNotNull()).select(*KEYS, f"{part}.*") for part in PARTS}
    return out | {"counters": found.where("kind = 'counters'").select("source_rank", *(F.get("counts", i).alias(n) for i, n in enumerate(DROPPED)))}


def series_table(found: DataFrame) -> DataFrame:
    """The series of tables() in the form of operators.indicators.series_of; durations are left out."""
    return found.where("kind = 'series'").withColumnRenamed("name", "metric").select(*SERIES, *(c for c in found.columns if c not in KEYS))


def error_table(found: DataFrame) -> DataFrame:
    """The errors of tables() in the form of operators.caps.error_summaries, over all ranks."""
    named = found.select("module", F.col("signal").alias("probe"), F.col("tensor_path").alias("error_type"), F.col("name").alias("message"), "count", "first_ts", "latest_ts")
    return named.groupBy("module", "probe", "error_type", "message").agg(F.sum("count").alias("count"), F.min("first_ts").alias("first_ts"), F.max("latest_ts").alias("latest_ts"))
