"""Queries of parts that the others don't reach: one's own samplers, reducers and histograms, times, depth, settings, bounds of reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import api
from tidemark.functions.times import parsed_time, time_text
from tidemark.model import HistogramConfig, ReportConfig
from tidemark.operators import caps, histograms, indicators, reduce, rules, sampling
from tidemark.plans import catalog as C
from tidemark.plans import merge, report, sql
from tidemark.sinks import dashboards
from tidemark.sources import adapters as A
from tidemark.sources.tables import table

query = C.query
_TIME = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"


@query(f"select event_id, {_TIME} as at, event_id % 5 <> 0 as valid from events")
def times_read_and_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth text has no zone and is no time."""
    e = C.events(spark, sf_dir).select("event_id", time_text(F.col("ts").cast("timestamp")).alias("at"))
    text = F.when(F.col("event_id") % 5 == 0, F.substring("at", 1, 19)).otherwise(F.col("at"))
    return e.select("event_id", "at", (time_text(parsed_time(text)).isNotNull()).alias("valid"))


@query(f"select count(distinct user_id % 4)::int as expected_ranks, max({_TIME}) as updated_at, true as complete from events")
def latest_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report a rank, with its last event's time: the merged report has the latest."""
    rows = C.events(spark, sf_dir).groupBy((F.col("user_id") % 4).cast("int").alias("rank")).agg(time_text(F.max("ts").cast("timestamp")).alias("updated_at"))
    found = merge.rank_coverage(rows.select("rank", F.lit(4).alias("world_size"), "updated_at", F.lit(False).alias("truncated")))
    return found.select("expected_ranks", "updated_at", F.col("rank_coverage_complete").alias("complete"))


@query("select event_id, 'output.a.0.b.1.c.0.d' as tensor_path, value from events union all select event_id, 'output.a.0.b.0', user_id::double from events")
def nested_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves seven levels down, beside texts and truth values that are dropped."""
    inner = F.concat(F.lit('{"a": [{"b": ['), F.col("user_id").cast("string"), F.lit(', {"c": [{"d": '), F.col("value").cast("string"), F.lit('}, "text", true]}]}]}'))
    return A.nested_leaves(C.events(spark, sf_dir).select("event_id", inner.alias("j")), "j", ["event_id"])


@query("select event_id, event_type from (select *, row_number() over (partition by event_type order by ts, event_id) as n from events) where n % 7 = 0")
def sample_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampler of one's own with state: every seventh opportunity of a type."""

    def seventh(n: int | None, row: dict) -> tuple[int, bool]:
        n = (n or 0) + 1
        return n, n % 7 == 0

    e = C.events(spark, sf_dir).select("event_id", "event_type", "ts")
    return sampling.decided(e, seventh, ["event_type"], ["ts", "event_id"]).select("event_id", "event_type")


@query("select event_type as module, 'ValueError' as error_type, count(*) as failures from events where event_id % 11 = 3 group by event_type")
def sampler_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of a sampler become rows instead of samples."""

    def picky(state: object, row: dict) -> tuple[object, bool]:
        if row["event_id"] % 11 == 3:
            raise ValueError("not this one")
        return state, True

    e = C.events(spark, sf_dir).select(F.col("event_type").alias("module"), "event_id")
    found = sampling.decided(e, picky, ["module"], ["event_id"], errors=True)
    return found.groupBy("module", "error_type").agg(F.count(F.lit(1)).alias("failures"))


@query(f"with obs as ({sql.EMBEDDINGS}) select {', '.join(C.KEYS)}, round(max(value) - min(value), 6) + 0.0 as span, round(avg(abs(value)), 6) + 0.0 as mean_abs from obs group by all")
def stats_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reducer of one's own as a numpy function, beside a named statistic."""
    what = reduce.combine(reduce.reducer(span=lambda x: x[-1] - x[0]), reduce.reducer("mean_abs"))
    return C.rounded(reduce.reduce_tensors(A.embedding_tensors(table(spark, sf_dir, "embeddings")), what), *C.KEYS, "span", "mean_abs")


_LOW = f"with t as (select module, signal, sample_id, min(value) as low, max(value) - min(value) as span from ({sql.EMBEDDINGS}) group by all)"


@query(f"{_LOW} select module, signal || '/span' as probe, 'ArithmeticError' as error_type, 'too low' as message, count(*) as count, min(sample_id) as first_seq, 0.0::double as total from t where low < -0.3 group by all "
       "union all select module, 'value', 'none', 'none', count(*), min(sample_id), round(sum(span), 5) from t where low >= -0.3 group by module")
def reducer_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statistic of one's own that refuses some tensors: values of the others, and the failures by kind."""

    def span(x):
        if x[0] < -0.3:
            raise ArithmeticError("too low")
        return x[-1] - x[0]

    stats, errors = reduce.reduce_with_errors(A.embedding_tensors(table(spark, sf_dir, "embeddings")), reduce.reducer(span=span), policy="ignore")
    none = F.lit("none")
    good = stats.where("span is not null").groupBy("module").agg(F.lit("value").alias("probe"), none.alias("error_type"), none.alias("message"), F.count("*").alias("count"), F.min("event_seq").alias("first_seq"), F.sum("span").alias("total"))
    bad = errors.groupBy("module", "probe", "error_type", "message").agg(F.count("*").alias("count"), F.min("event_seq").alias("first_seq"), F.lit(0.0).alias("total"))
    return C.rounded(good.unionByName(bad), digits=5)


@query(f"with obs as ({sql.EMBEDDINGS}) select {', '.join(C.KEYS)}, count(*) filter (where value < 0) as bin_0, count(*) filter (where value >= 0) as bin_1, round(min(value), 6) + 0.0 as minimum from obs where sample_id % 3 = 0 group by all")
def hist_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram by a function of one's own, of every third sample."""
    halves = histograms.OwnHistogram("halves", lambda x: ([-1e9, 0.0, 1e9], [int((x < 0).sum()), int((x >= 0).sum())]), every_n_samples=3)
    found = histograms.own_histograms(A.embedding_tensors(table(spark, sf_dir, "embeddings")), halves)
    return C.rounded(found.select(*C.KEYS, F.get("bin_counts", 0).alias("bin_0"), F.get("bin_counts", 1).alias("bin_1"), "minimum"))


@query("""select 'sampling' as part, 'every_n_forwards' as type, '{"n": 4}' as settings union all select 'reducer', 'statistics', '{"metrics": ["mean", "rms"]}'
  union all select 'reducer', 'histogram', '{"bins": 8, "every_n_samples": 2, "name": "h", "value_range": "own"}'""")
def run_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run's document says of its samplers and reducers."""
    made = api.Settings(reducer=reduce.reducer("mean", "rms"), every=4, histograms=(HistogramConfig(name="h", bins=8, every_n_samples=2),)).described()
    rows = [("sampling", made["sampling"]), *(("reducer", r) for r in made["reducers"])]
    return spark.createDataFrame([(part, r["type"], json.dumps(r["settings"], sort_keys=True)) for part, r in rows], "part string, type string, settings string")


@query("select distinct event_type as dtype from events")
def plain_dtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.events(spark, sf_dir).select(sampling.plain_dtype(F.concat(F.lit("torch."), "event_type")).alias("dtype")).distinct()


@query(f"with {sql.series(sql.EVENTS, ['rms', 'mean'])} select (select count(*) from series) as temporal_series, (select count(distinct module) from series) as tensor_paths, "
       f"(select max(sample_id) + 1 from ({sql.EVENTS})) as samples_observed, 0::bigint as backward_samples_observed")
def report_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a report, read back from its document."""
    series = indicators.series_of(C.values_of(A.event_rows(C.events(spark, sf_dir)), ["rms", "mean"])).persist()
    made = json.loads(report.D.json_text(report.build_report(series, config=ReportConfig(), state=api.samples_of(series))))
    names = ["temporal_series", "tensor_paths", "samples_observed", "backward_samples_observed"]
    series.unpersist()
    return spark.createDataFrame([tuple(made["coverage"][n] for n in names)], ", ".join(f"{n} long" for n in names))


@query("""with e as (select 'm' || (user_id % 9) as module, 'E' || (event_id % 4) as error_type, count(*) as n from events group by all)
  select module, error_type, n::bigint as occurrences from e order by module, error_type limit 20""")
def report_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 summaries of errors, as a report takes them."""
    e = C.events(spark, sf_dir).select(
        F.concat(F.lit("m"), (F.col("user_id") % 9).cast("string")).alias("module"), F.lit("outputs").alias("probe"), F.concat(F.lit("E"), (F.col("event_id") % 4).cast("string")).alias("error_type"), F.lit("said").alias("message"), "ts"
    )
    found = report.bounded_errors(caps.error_summaries(e), ReportConfig(max_errors=20))
    return found.select("module", "error_type", F.col("count").alias("occurrences"))


@query(f"with {sql.candidates(sql.ALL, ['rms'])} select category, count(*) as candidates from candidates group by category")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates a category has, whatever the ranking leaves out."""
    found = rules.candidate_counts(rules.candidates(C.series(spark, sf_dir, ["rms"])), spark)
    return found.where("candidates > 0").select("category", "candidates")


_FLAT = sql.histogram(sql.EVENTS, 2, 4, "20.0", "80.0")


@query(f"with {_FLAT} select module, sample_id as step, finite_count as num, bin_0 + bin_1 + bin_2 + bin_3 + underflow_count + overflow_count as counted, round(minimum, 6) + 0.0 as low, round(maximum, 6) + 0.0 as high from hist")
def dashboard_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms as a dashboard takes them: every finite element is in one of the buckets."""
    each = histograms.histograms(A.event_rows(C.events(spark, sf_dir)), HistogramConfig(bins=4, value_range=(20.0, 80.0), every_n_samples=2)).where("reason is null")
    found = dashboards.flat_histograms(each, "run")
    module = F.split_part(F.col("tag"), F.lit("/"), F.lit(3))
    counted = F.aggregate("bucket_counts", F.lit(0).cast("long"), lambda a, c: a + c.cast("long"))
    return C.rounded(found.select(module.alias("module"), F.col("step"), F.col("num").cast("long").alias("num"), counted.alias("counted"), F.col("minimum").alias("low"), F.col("maximum").alias("high")))
