"""The whole way from observations to documents in one call, for tables and for streams."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import parsed_time, time_text
from tidemark.model import PATH, TENSOR, HistogramConfig, IndicatorConfig, ReportConfig
from tidemark.operators import caps, histograms, reduce, rules, sampling
from tidemark.operators.indicators import series_of
from tidemark.operators.long_series import series_of_any
from tidemark.plans import report as R
from tidemark.plans.merge import merge_rank_reports, stream_rank_reports
from tidemark.sinks import documents, store
from tidemark.streaming import bounded, live

__all__ = ["Settings", "Analysis", "analyze", "write_report", "stream_reports", "merge_rank_reports", "stream_rank_reports"]


@dataclass(frozen=True)
class Settings:
    """What is looked at, reduced, bounded and reported."""

    reducer: reduce.Reducer | None = None
    indicators: IndicatorConfig = field(default_factory=IndicatorConfig)
    report: ReportConfig = field(default_factory=ReportConfig)
    histograms: tuple[HistogramConfig | histograms.OwnHistogram, ...] = ()
    rules: tuple[rules.Rule, ...] = ()
    #: Every n-th forward, a Column over the rows, or all of them.
    every: int | None = None
    sampler: Column | None = None
    #: A Column over the rows that selects modules.
    modules: Column | None = None
    ranks: str = "zero"
    #: What a run's document says of a sampler of one's own: its type, and settings as JSON values.
    sampling_type: str | None = None
    sampling_settings: Mapping[str, object] = field(default_factory=dict)
    #: What happens when a statistic of one's own fails: raise, warn or ignore; the latter two keep the failures for the report.
    errors: str = "warn"
    #: Series of so many observations or more are cut over many tasks (operators.long_series), with the same results; None: every series is one window.
    long_series: int | None = None

    def __post_init__(self) -> None:
        if self.every is not None and self.sampler is not None:
            raise ValueError("give either every or sampler")
        if self.long_series is not None and self.long_series < 1:
            raise ValueError("long_series must be positive")
        if self.errors not in reduce.POLICIES:
            raise ValueError(f"the error policy is one of {', '.join(reduce.POLICIES)}")
        names = [h.name for h in self.histograms]
        if len(set(names)) != len(names):
            raise ValueError("duplicate histograms")

    def described(self) -> dict:
        """The samplers and reducers of a run as its document names them."""
        if self.sampling_type is not None:
            sampling = {"type": self.sampling_type, "settings": dict(self.sampling_settings)}
        elif self.every is not None:
            sampling = {"type": "every_n_forwards", "settings": {"n": self.every}}
        else:
            sampling = {"type": "always" if self.sampler is None else "custom", "settings": {}}
        what = self.reducer or reduce.default_reducer()
        made = [{"type": h.kind, "settings": h.settings()} for h in self.histograms]
        return {"sampling": sampling, "reducers": [{"type": "statistics", "settings": {"metrics": list(what.names)}}, *made], "ranks": self.ranks}


@dataclass(frozen=True)
class Analysis:
    """Tables of one analysis. The statistics are kept from their first use until release(); the places of what is bounded (caps.bounded), and
    statistics with functions of one's own, are computed and written when the analysis is made, the rest when it is used. errors: failures of such functions."""

    statistics: DataFrame
    values: DataFrame
    series: DataFrame
    state: DataFrame
    histograms: DataFrame | None
    bounded: caps.Bounded
    errors: DataFrame | None = None

    def release(self) -> None:
        self.statistics.unpersist()


def selected(rows: DataFrame, settings: Settings) -> DataFrame:
    """The rows that are sampled and selected: plain filters, so they reach the scan."""
    rows = sampling.of_rank(rows, settings.ranks)
    if "state" in rows.columns:
        rows = sampling.by_phase(rows)
    if settings.every is not None:
        rows = rows.where(sampling.every_n_forwards(settings.every))
    for condition in (settings.sampler, settings.modules):
        rows = rows if condition is None else rows.where(condition)
    return rows


def analyze(tensors: DataFrame, settings: Settings | None = None, timestamp: Column | None = None) -> Analysis:
    """The tables from tensors (TENSOR keys and elements) to series. timestamp: text of an observation's time over TENSOR and ts."""
    settings = settings or Settings()
    what = settings.reducer or reduce.default_reducer()
    rows = selected(tensors, settings)
    keep = [c for c in (*TENSOR, "shape") if c in rows.columns]
    errors = None
    if what.functions:
        statistics, errors = reduce.reduce_with_errors(rows, what, keep, policy=settings.errors, ts="ts" if "ts" in rows.columns else None)
    else:
        statistics = reduce.reduce_tensors(rows, what, keep=keep)
    statistics = statistics.persist()  # every other table comes from it
    values = reduce.long_form(statistics, what.names)
    places = caps.bounded(statistics.select(*TENSOR), values, settings.indicators)
    if settings.long_series is None:
        series = series_of(places.series, settings.indicators, timestamp=timestamp)
    else:
        series = series_of_any(places.series, settings.indicators, timestamp=timestamp, longest=settings.long_series)
    shape = F.col("shape") if "shape" in keep else F.lit(None).cast("array<int>")
    state = caps.latest_state(places.tensors.join(statistics.select(*TENSOR, shape.alias("shape")), TENSOR))
    found = None
    for config in settings.histograms:
        of_tensors = histograms.own_histograms if isinstance(config, histograms.OwnHistogram) else histograms.tensor_histograms
        one = of_tensors(rows, config)
        found = one if found is None else found.unionByName(one)
    return Analysis(statistics, values, series, state, found, places, errors)


def samples_of(series: DataFrame) -> dict:
    """updated_at, samples_observed and backward_samples_observed of a report, from the series: the latest time and sample of outputs, and the most observations of a gradient."""
    forward = F.col("signal") == "outputs"
    one = series.agg(
        F.max(parsed_time(F.col("latest.timestamp"))).alias("at"), F.max(F.when(forward, F.col("latest.sample_id"))).alias("last"), F.max(F.when(~forward, F.col("count"))).alias("backward")
    ).select(time_text(F.col("at")).alias("at"), "last", "backward").first()
    return {"updated_at": one["at"], "samples_observed": 0 if one["last"] is None else one["last"] + 1, "backward_samples_observed": one["backward"] or 0}


def write_report(
    analysis: Analysis, folder: object, settings: Settings | None = None, rank: R.Rank = R.Rank(), *, catalog: DataFrame | None = None, errors: DataFrame | None = None, isolate_rank: bool = False, fresh: bool = True, state: dict | None = None, details: bool = False
) -> str:
    """Publish the report of an analysis; a folder that already holds a run is refused unless fresh is false. state: counters that are known
    better than from the series; details: the snapshot of all series and states too."""
    settings = settings or Settings()
    at = R.rank_folder(folder, rank.rank) if isolate_rank else str(folder)
    if fresh:
        documents.claim(at)
    dropped = analysis.bounded.counters().first().asDict()
    if errors is None and analysis.errors is not None:
        most = settings.indicators.max_error_summaries
        errors = caps.error_summaries(analysis.errors, most, "event_seq")
        dropped |= caps.dropped_errors(analysis.errors, most, "event_seq").first().asDict()
    with R.cached(analysis.series):
        return _written(analysis, at, settings, rank, catalog, errors, dropped, state, details)


def _written(analysis: Analysis, at: str, settings: Settings, rank: R.Rank, catalog: DataFrame | None, errors: DataFrame | None, dropped: dict, state: dict | None, details: bool) -> str:
    kept = None
    if analysis.histograms is not None:
        kept, away = caps.bounded_histograms(analysis.histograms.where("bin_edges is not null"), settings.indicators.max_histograms)
        dropped |= away.first().asDict()
        kept = kept.select(*PATH, "name").distinct()
    state = {**samples_of(analysis.series), **(state or {})}
    made = R.build_report(
        analysis.series, catalog=catalog, rank=rank, config=settings.report, indicators=settings.indicators, rules=settings.rules or None, errors=errors,
        observations=analysis.state, histograms=kept, dropped=dropped, state=state, run=settings.described(),
    )
    if details:
        R.write_details(at, analysis.series, analysis.state, errors)
    return R.publish_report(at, made)


def stream_reports(
    tensors: DataFrame, folder: object, settings: Settings | None = None, rank: R.Rank = R.Rank(), trigger: dict | None = None, also: Sequence[Callable[[DataFrame, int], None]] = (),
    aggregator: Callable[[DataFrame, IndicatorConfig], DataFrame] | None = None, *, errors: DataFrame | None = None, durations: DataFrame | None = None, catalog: DataFrame | None = None, details: bool = False, checkpoint: str | None = None,
):
    """Start a query that keeps the folder's report up to date with a stream of tensors.

    The folder holds a report before the first batch. checkpoint: the folder of the query's state, by default <folder>.checkpoint; where it is already there,
    the run that it belongs to goes on, so a stopped query is started again by the same call. errors, durations: further streams
    (see streaming.bounded); catalog: (module, module_type); details: the snapshot of all series, paths and errors too, after each batch.
    also: further receivers of the table of series; aggregator: from a stream of statistics in long form to one of series summaries (update
    mode), instead of the bounded state: such reports hold series only, and can't go on after a stop.
    """
    settings = settings or Settings()
    config = settings.indicators
    at = checkpoint or f"{str(folder).rstrip('/')}.checkpoint"
    goes_on = aggregator is None and store.exists(at)
    if not goes_on:
        documents.claim(folder)

    def publish(series: DataFrame, batch_id: int, dropped: Mapping[str, int], **more) -> None:
        made = R.build_report(series, catalog=catalog, rank=rank, config=settings.report, indicators=config, rules=settings.rules or None, state=samples_of(series), dropped=dropped, run=settings.described(), **more)
        R.publish_report(folder, made)
        for receive in also:
            receive(series, batch_id)

    if aggregator is not None:
        def series_only(series: DataFrame, batch_id: int) -> None:
            n = series.count()
            kept = series if n <= config.max_series else series.orderBy(F.col("first.sample_id"), *PATH, "metric").limit(config.max_series)
            publish(kept, batch_id, {"dropped_series": n - min(n, config.max_series)})

        return live.live_reports(aggregator(live.stream_statistics(selected(tensors, settings), config), config), series_only, trigger=trigger)

    def complete(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        whole = bounded.known(batch, batch_id, at, config).persist()
        found = bounded.tables(whole)
        series = bounded.series_table(found["series"]).persist()
        paths, failures = found["path"].select(*PATH, "observations", "shape_changes", "sample_id", "shape"), bounded.error_table(found["error"])
        dropped = found["counters"].agg(*(F.sum(n).alias(n) for n in bounded.DROPPED)).first().asDict()
        try:
            publish(series, batch_id, {n: v or 0 for n, v in dropped.items()}, errors=failures, observations=paths, histograms=found["histogram"])
            if details:
                R.write_details(folder, series, paths, failures)
        finally:
            for table in (series, whole, batch):
                table.unpersist()

    rows = selected(tensors, settings)
    telemetry = bounded.tensor_rows(rows, config)
    for one in settings.histograms:
        telemetry = telemetry.unionByName(bounded.histogram_rows(rows, one))
    for one, made in ((errors, bounded.error_rows), (durations, bounded.duration_rows)):
        telemetry = telemetry if one is None else telemetry.unionByName(made(one))
    if not goes_on:
        store.make_folder(at)
        empty = series_of(tensors.sparkSession.createDataFrame([], live.VALUES), config)
        R.publish_report(folder, R.build_report(empty, catalog=catalog, rank=rank, config=settings.report, indicators=config, rules=settings.rules or None, state=samples_of(empty), run=settings.described()))
    with bounded.rocksdb(tensors.sparkSession):
        return bounded.folded(telemetry, config).writeStream.outputMode("append").foreachBatch(complete).option("checkpointLocation", at).trigger(**(trigger or {"availableNow": True})).start()
