"""The registered queries and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import CATEGORIES, METRICS, PATH, SERIES, TEMPORAL_METRICS, HistogramConfig, IndicatorConfig, ReportConfig
from tidemark.operators import caps, histograms, indicators, reduce, rules, sampling
from tidemark.plans import merge, report, sql
from tidemark.sinks import dashboards, documents
from tidemark.sources import adapters as A
from tidemark.sources.tables import scratch, stream_in_order, table
from tidemark.streaming import live

QUERIES: dict = {}
ORACLES: dict = {}
#: Keys of a tensor in the queries' results.
KEYS = sql.TENSOR


def query(oracle: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, and no negative zeros."""
    cols = df.select(*keep) if keep else df
    return cols.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in cols.dtypes))


# Sources of observations.
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events, their changes as gradients, and values with faults as a second call."""
    e = events(spark, sf_dir)
    return A.event_rows(e).unionByName(A.event_change_rows(e)).unionByName(A.faulty_event_rows(e))


def values_of(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Statistics in long form of rows of elements."""
    return reduce.long_form(reduce.reduce_rows(rows, metrics), metrics)


def series(spark: SparkSession, sf_dir: str, metrics: list[str]) -> DataFrame:
    return indicators.series_of(values_of(all_rows(spark, sf_dir), metrics), timestamp=F.lit("1970-01-01T00:00:00Z"))


def all_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.candidates(series(spark, sf_dir, TEMPORAL_METRICS))


SCORED = [*SERIES, "category", "score"]


def scores(found: DataFrame, *more: str) -> DataFrame:
    return rounded(found.withColumn("score", F.col("ranking_score")), *SCORED, *more)


# Projections, filters, samplers.
@query("""with parts as (select distinct p_type as module from part union select distinct split_part(p_type, ' ', 1) as module from part where p_type like '% %'),
  dotted as (select replace(module, ' ', '.') as module from parts)
  select module from dotted d where not exists (select 1 from dotted c where c.module <> d.module and regexp_replace(c.module, '[.]?[^.]*$', '') = d.module)""")
def scan_filter_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "part").select(F.replace("p_type", F.lit(" "), F.lit(".")).alias("module"))
    roots = types.where(F.col("module").contains(".")).select(F.split_part("module", F.lit("."), F.lit(1)).alias("module"))
    return A.leaf_modules(types.union(roots).distinct())


@query("select event_id, row_number() over (order by event_id) - 1 as sample_id from events where (event_id + 1) % 3 = 0")
def sample_every_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = events(spark, sf_dir).select("event_id", F.col("event_id").alias("forward_index")).where(sampling.every_n_forwards(3))
    return sampling.numbered(kept, [], "event_id").select("event_id", "sample_id")


@query("""with recursive t as (select event_type, epoch(ts) as t from events),
  r as (select event_type, epoch(timestamp '2024-01-01') as due, null::double as kept from (select distinct event_type from t)
    union all
    select event_type, kept + 43200 as due, kept from (select r.event_type, min(t.t) as kept from r join t on t.event_type = r.event_type and t.t >= (case when r.kept is null then r.due + 43200 else r.due end) group by r.event_type))
  select event_type, kept as t from r where kept is not null""")
def sample_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = events(spark, sf_dir).select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"))
    times = at.select("event_type", (F.col("us") / 1e6).alias("t"), F.lit(1704067200.0).alias("t0"))
    return sampling.timed(times, 43200, ["event_type"])


@query("select event_id, 'output.' || key as tensor_path, value::double as value from (select event_id, unnest(json_keys(props)) as key, props from events) x, lateral (select json_extract_string(props, '$.' || key) as value) y where try_cast(value as double) is not null")
def pytree_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nested_leaves(events(spark, sf_dir), "props", ["event_id"])


# Point-in-time statistics.
def _stats(name: str, source, source_sql: str, metrics: list[str], digits: int = 6) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(reduce.reduce_rows(source(spark, sf_dir), metrics), *KEYS, *metrics, digits=digits)

    run.__name__ = name
    query(sql.stats_query(source_sql, metrics, digits=digits))(run)


_plain = lambda s, d: A.event_rows(events(s, d))
_faulty = lambda s, d: A.faulty_event_rows(events(s, d))
_stats("stats_moments", _plain, sql.EVENTS, METRICS[:9])
_stats("stats_fractions", _faulty, sql.FAULTS, METRICS[9:13])
_stats("stats_shape", _plain, sql.EVENTS, METRICS[13:15])
_stats("stats_quantiles", _faulty, sql.FAULTS, [*METRICS[15:27]])
_stats("stats_ratios", _plain, sql.EVENTS, METRICS[27:30])
_stats("stats_tail", _faulty, sql.FAULTS, ["tail_fraction_beyond_3_std"])
_stats("stats_entropy", _faulty, sql.FAULTS, METRICS[31:33])
#: Shape is left to stats_shape: of these round numbers it can be a tie of the rounding.
_stats("stats_lineitem", lambda s, d: A.lineitem_rows(table(s, d, "lineitem")), sql.LINEITEM, [m for m in METRICS if m not in ("skewness", "excess_kurtosis")])


@query(sql.stats_query(sql.EMBEDDINGS, METRICS))
def stats_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce.reduce_tensors(A.embedding_tensors(table(spark, sf_dir, "embeddings"))), *KEYS, *METRICS)


@query(f"with {sql.stats(sql.FAULTS)} select {', '.join(KEYS)}, n_unavailable from (select {', '.join(KEYS)}, "
       + " + ".join(f"({m} is null)::bigint" for m in METRICS) + " as n_unavailable from stats)")
def stats_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reduce.reasons(reduce.reduce_rows(_faulty(spark, sf_dir)), METRICS)
    return found.select(*KEYS, F.size("unavailable").cast("long").alias("n_unavailable"))


@query(f"with obs as ({sql.EVENTS}) select {', '.join(KEYS)}, round(avg(abs(value)), 6) as mean_abs, round(max(value) - min(value), 6) as spread from obs group by all")
def stats_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = reduce.combine(reduce.reducer("mean_abs"), reduce.reducer(spread=F.max("x") - F.min("x")))
    return rounded(reduce.reduce_rows(_plain(spark, sf_dir), both), *KEYS, "mean_abs", "spread")


# Histograms.
HIST_CELLS = ["finite_count", "nonfinite_count", "underflow_count", "overflow_count", "minimum", "maximum", "sum", "sum_squares"]


def _cells(df: DataFrame, bins: int, keys: list[str]) -> DataFrame:
    return rounded(df.select(*keys, *(F.get("bin_counts", i).alias(f"bin_{i}") for i in range(bins)), *HIST_CELLS))


def _hist_sql(with_: str, bins: int, keys: list[str], source: str = "hist") -> str:
    return f"with {with_} select {', '.join(keys)}, {', '.join(f'bin_{i}' for i in range(bins))}, {', '.join(HIST_CELLS[:4])}, {', '.join(f'round({c}, 6) + 0.0 as {c}' for c in HIST_CELLS[4:])} from {source}"


@query(_hist_sql(sql.histogram(sql.FAULTS, 1, 4, "20.0", "80.0"), 4, KEYS))
def hist_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(histograms.histograms(_faulty(spark, sf_dir), HistogramConfig(bins=4, value_range=(20.0, 80.0), every_n_samples=1)).where("reason is null"), 4, KEYS)


@query(_hist_sql(sql.histogram(sql.FAULTS, 1, 5, "mn - case when mn = mx then 0.01 * greatest(abs(mn), abs(mx), 1) else 0 end", "mx + case when mn = mx then 0.01 * greatest(abs(mn), abs(mx), 1) else 0 end"), 5, KEYS))
def hist_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(histograms.histograms(_faulty(spark, sf_dir), HistogramConfig(bins=5, every_n_samples=1)).where("reason is null"), 5, KEYS)


@query(_hist_sql(sql.histogram(sql.EVENTS, 10, 4, "20.0", "80.0"), 4, KEYS))
def hist_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(histograms.histograms(_plain(spark, sf_dir), HistogramConfig(bins=4, value_range=(20.0, 80.0), every_n_samples=10)).where("reason is null"), 4, KEYS)


_MERGED = ", ".join(["count(*) as samples", *(f"sum(bin_{i})::bigint as bin_{i}" for i in range(4)), *(f"sum({c})::bigint as {c}" for c in HIST_CELLS[:4]), "min(minimum) as minimum", "max(maximum) as maximum", "sum(sum) as sum", "sum(sum_squares) as sum_squares"])


@query(f"with {sql.histogram(sql.EVENTS, 2, 4, '20.0', '80.0')}, m as (select {', '.join(sql.KEYS)}, {_MERGED} from hist group by {', '.join(sql.KEYS)}) "
       f"select {', '.join(sql.KEYS)}, samples, {', '.join(f'bin_{i}' for i in range(4))}, {', '.join(HIST_CELLS[:4])}, {', '.join(f'round({c}, 4) + 0.0 as {c}' for c in HIST_CELLS[4:])} from m")
def hist_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = histograms.histograms(_plain(spark, sf_dir), HistogramConfig(bins=4, value_range=(20.0, 80.0), every_n_samples=2))
    one = histograms.merged(each, PATH)
    return rounded(one.select(*PATH, "samples", *(F.get("bin_counts", i).alias(f"bin_{i}") for i in range(4)), *HIST_CELLS), digits=4)


# Series and their indicators.
_RMS = ["rms", "mean", "zero_fraction"]


def _series(name: str, columns: list[str], metrics: list[str] = _RMS) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = series(spark, sf_dir, metrics)
        for p in indicators.POINTS:
            if f"{p}_sample" in columns:
                found = found.withColumns({f"{p}_sample": F.col(p)["sample_id"], p: F.col(p)["value"]})
        return rounded(found, *SERIES, *columns)

    run.__name__ = name
    query(sql.series_query(sql.ALL, metrics, columns))(run)


_all = indicators.names()
_series("series_points", ["count", "warmup_complete", *(x for p in indicators.POINTS for x in (p, f"{p}_sample"))])
_series("series_moments", _all[:6])
_series("series_ema", _all[6:10])
_series("series_change", [_all[10], _all[11], "up_down_balance"])
_series("series_zscore", ["latest_z_score"])
_series("series_extremes", ["historical_range_position", "maximum_drawdown", "maximum_runup"])
_series("series_cusum", ["cusum_positive", "cusum_negative", "cusum_change_score"])
_series("series_autocorr", ["lag1_autocorrelation"])
_series("series_oscillation", ["oscillation_fraction"])
_series("series_runs", ["consecutive_increases", "consecutive_decreases"])
_series("series_momentum", _all[24:])


# State, bounds, errors.
@query(f"""with obs as ({sql.LINEITEM}), t as (select {', '.join(KEYS)}, count(*) as shape from obs group by all),
  d as (select *, lag(shape) over (partition by {', '.join(sql.KEYS)} order by sample_id) as before from t)
  select {', '.join(sql.KEYS)}, count(*) as observations, count(*) filter (where shape <> before) as shape_changes, max(sample_id) as sample_id, arg_max(shape, sample_id) as shape from d group by {', '.join(sql.KEYS)}""")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.lineitem_rows(table(spark, sf_dir, "lineitem"))
    tensors = rows.groupBy(*PATH, "event_seq", "sample_id").agg(F.count(F.lit(1)).alias("shape"))
    return caps.latest_state(tensors)


_CAPPED = IndicatorConfig(max_module_calls=4, max_tensor_paths=12, max_series=20, temporal_metrics=("mean", "rms"))


def _bounded(spark: SparkSession, sf_dir: str) -> caps.Bounded:
    stats = reduce.reduce_rows(A.lineitem_rows(table(spark, sf_dir, "lineitem")), ["mean", "rms"])
    path = scratch(spark, "statistics")  # a row a tensor, read for every bound; the source is read once
    stats.write.parquet(path)
    stats = spark.read.schema(stats.schema).parquet(path)
    return caps.bounded(stats.select(*KEYS, "event_seq"), reduce.long_form(stats, ["mean", "rms"]), _CAPPED)


_CAPS_SQL = f"""with obs as ({sql.LINEITEM}), t as (select distinct {', '.join(KEYS)} from obs),
calls as (select module, call_index from t group by all order by min((sample_id, module, call_index)), module limit 4),
t1 as (select t.* from t join calls using (module, call_index)),
paths as (select module, call_index, signal, tensor_path from t1 group by all order by min((sample_id, module, call_index, tensor_path)) limit 12),
t2 as (select t1.* from t1 join paths using (module, call_index, signal, tensor_path)),
idents as (select module, tensor_path, metric, min((sample_id, module, call_index, tensor_path, ord)) as seen from t2, (values ('mean', 0), ('rms', 1)) m(metric, ord) group by all),
kept as (select module, tensor_path, metric from idents order by seen, module, tensor_path, metric limit 20)"""


@query(f"{_CAPS_SQL} select module, tensor_path, metric from kept")
def caps_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounded(spark, sf_dir).series.select("module", "tensor_path", "metric").distinct()


@query(f"{_CAPS_SQL} select (select count(*) from t) - (select count(*) from t1) as dropped_module_call_observations, (select count(*) from t1) - (select count(*) from t2) as dropped_tensor_path_observations, (select count(*) from idents) - 20 as dropped_series")
def caps_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounded(spark, sf_dir).counters()


_ERRORS = "select event_type as module, 'call_' || (event_id % 3) as probe, 'ValueError' as error_type, 'value over ' || (floor(value / 10) * 10)::bigint as message, ts from events where value > 90 or event_id % 50 = 0"


@query(f"with e as ({_ERRORS}), g as (select module, probe, error_type, message, count(*) as count, min(ts) as first_ts, max(ts) as latest_ts from e group by all) select * from g order by first_ts, module, probe, error_type, message limit 25")
def error_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where((F.col("value") > 90) | (F.col("event_id") % 50 == 0))
    level = (F.floor(F.col("value") / 10) * 10).cast("long").cast("string")
    errors = e.select(F.col("event_type").alias("module"), F.concat(F.lit("call_"), (F.col("event_id") % 3).cast("string")).alias("probe"), F.lit("ValueError").alias("error_type"), F.concat(F.lit("value over "), level).alias("message"), "ts")
    return caps.error_summaries(errors, cap=25)


# Rules and rankings.
def _rule(category: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scores(all_candidates(spark, sf_dir).where(F.col("category") == category))

    run.__name__ = f"rule_{category}"
    query(f"with {sql.candidates(sql.ALL)} select {', '.join(SERIES)}, category, round(score, 6) + 0.0 as score from candidates where category = '{category}'")(run)


for _c in CATEGORIES:
    _rule(_c)


@query(f"with {sql.topk(sql.ALL, 5)} select {', '.join(SERIES)}, category, round(score, 6) + 0.0 as score, rank from best")
def topk_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(rules.top_findings(all_candidates(spark, sf_dir), 5), "rank").withColumn("rank", F.col("rank").cast("long"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_findings(spark, sf_dir)


@query(f"with {sql.topk(sql.ALL, 3)} select row_number() over (order by rank, category_ord) as place, category, module, metric, call_index from best")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = rules.top_findings(all_candidates(spark, sf_dir), 3)
    before = F.struct(F.col("rank"), rules.category_ord(F.col("category")))  # at most 3 rows a category
    rows = best.agg(F.sort_array(F.collect_list(F.struct(before.alias("at"), "category", "module", "metric", "call_index"))).alias("r")).select(F.posexplode("r"))
    return rows.select((F.col("pos") + 1).cast("long").alias("place"), "col.category", "col.module", "col.metric", "col.call_index")


@query(f"with {sql.candidates(sql.ALL)} select category, count(score) as candidates from (select unnest({CATEGORIES!r}) as category) left join candidates using (category) group by category")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.candidate_counts(all_candidates(spark, sf_dir), spark)


_RANK_METRICS = ["rms", "finite_fraction"]


@query(f"with {sql.candidates(sql.RANKED, _RANK_METRICS)}, local as (select *, row_number() over (partition by source_rank, category order by score desc, module, call_index, signal, tensor_path, metric) as r from candidates qualify r <= 3), "
       f"best as (select *, row_number() over (partition by category order by score desc, source_rank, module, call_index, signal, tensor_path, metric) as rank from local qualify rank <= 5) select {', '.join(SERIES)}, category, round(score, 6) + 0.0 as score, rank from best")
def merge_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.event_rows(events(spark, sf_dir), source_rank=F.col("user_id") % 4)
    found = rules.candidates(indicators.series_of(values_of(rows, _RANK_METRICS)))
    local = rules.top_findings(found, 3, by=["source_rank"])
    return scores(merge.global_top(local, 5), "rank").withColumn("rank", F.col("rank").cast("long"))


@query("select 4 as expected_ranks, count(distinct user_id % 4) as ranks_present, count(distinct user_id % 4) = 4 as rank_coverage_complete from events")
def rank_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    ranks = e.groupBy((F.col("user_id") % 4).cast("int").alias("rank")).agg(F.max("ts").alias("updated_at"), F.lit(4).alias("world_size"), F.lit(False).alias("truncated"))
    return merge.rank_coverage(ranks).select("expected_ranks", F.size("ranks_present").cast("long").alias("ranks_present"), "rank_coverage_complete")


# Dashboards.
@query(f"with {sql.stats(sql.EVENTS)} " + " union all ".join(f"select 'telemetry/modules/' || module || '/call_0/output.value/{m}' as name, round({m}, 6) + 0.0 as value, sample_id as step from stats" for m in ("mean", "rms", "max_abs")))
def metric_log_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dashboards.flat_metrics(values_of(_plain(spark, sf_dir), ["mean", "rms", "max_abs"])))


@query(f"with {sql.histogram(sql.EVENTS, 10, 4, '20.0', '80.0')} select 'telemetry/modules/' || module || '/call_0/output.value/histograms/distribution' as tag, sample_id as step, finite_count as num, 6 as n_limits, "
       "(underflow_count + bin_0 + bin_1 + bin_2 + bin_3 + overflow_count)::bigint as n_counted, round(greatest(maximum, 80.0), 6) as last_limit from hist")
def tb_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = histograms.histograms(_plain(spark, sf_dir), HistogramConfig(bins=4, value_range=(20.0, 80.0), every_n_samples=10))
    flat = dashboards.flat_histograms(found)
    counted = F.aggregate("bucket_counts", F.lit(0.0), lambda a, x: a + x).cast("long")
    return flat.select("tag", "step", "num", F.size("bucket_limits").alias("n_limits"), counted.alias("n_counted"), F.round(F.element_at("bucket_limits", -1), 6).alias("last_limit"))


# Streams.
_STREAMED = ["rms", "mean", "excess_kurtosis"]
_STREAM_COLUMNS = ["count", "warmup_complete", *indicators.names()]


@query(sql.series_query(sql.VECTORS, _STREAMED, _STREAM_COLUMNS, digits=5))
def stream_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stream_in_order(spark, sf_dir, "embeddings", "vec_id")
    tensors = vectors.select(
        F.lit(0).alias("source_rank"), F.concat(F.lit("label_"), F.col("label").cast("string")).alias("module"), F.lit(0).alias("call_index"), F.lit("outputs").alias("signal"),
        F.lit("output").alias("tensor_path"), F.col("vec_id").alias("event_seq"), F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("elements"),
    )
    config = IndicatorConfig(temporal_metrics=tuple(_STREAMED))
    found = live.run_to_table(live.stream_series(live.stream_statistics(tensors, config), config), SERIES)
    return rounded(found, *SERIES, *_STREAM_COLUMNS, digits=5)


# Documents.
@query(None)
def report_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and counters of a report within 16,000 bytes: the budget is met by a loop over the ranked findings on the driver."""
    config = ReportConfig(max_bytes=16_000)
    made = report.build_report(series(spark, sf_dir, TEMPORAL_METRICS), config=config)
    cover = made["coverage"]
    row = (documents.json_bytes(made), cover["findings_returned"], cover["findings_omitted"], cover["report_truncated_by_byte_budget"])
    return spark.range(1).select(*(F.lit(v).alias(n) for n, v in zip(["bytes", "findings_returned", "findings_omitted", "truncated"], row, strict=True)))

