"""Queries of streams with bounded state, and of the documents that follow a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import api
from tidemark.model import HistogramConfig, IndicatorConfig
from tidemark.plans import catalog as C
from tidemark.plans import sql
from tidemark.sources.tables import scratch, stream_in_order, table
from tidemark.streaming import bounded, correlate, live

query = C.query
_METRICS = ["mean", "rms", "excess_kurtosis"]
_FEW = IndicatorConfig(temporal_metrics=tuple(_METRICS), max_module_calls=8, max_tensor_paths=6, max_series=16)

#: Places in the order of arrival: of 10 modules the first 8, of their paths the first 6, of the series of those the first 16.
_PLACES = f"""with {sql.stats(sql.VECTORS)}, t as (select module, sample_id from stats),
calls as (select module from t group by module order by min(sample_id), module limit 8),
t1 as (select t.* from t join calls using (module)),
paths as (select module from t1 group by module order by min(sample_id), module limit 6),
v as (select module, sample_id, metric, ord, x from ({" union all ".join(f"select module, sample_id, '{m}' as metric, {i} as ord, {m} as x from stats" for i, m in enumerate(_METRICS))}) join paths using (module) where x is not null),
idents as (select module, metric, min((sample_id, module, ord)) as seen from v group by all),
kept as (select module, metric from idents order by seen limit 16)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the embeddings as tensors: a module a label, a sample a vector."""
    rows = stream_in_order(spark, sf_dir, "embeddings", "vec_id")
    return rows.select(
        F.lit(0).alias("source_rank"), F.concat(F.lit("label_"), F.col("label").cast("string")).alias("module"), F.lit(0).alias("call_index"), F.lit("outputs").alias("signal"),
        F.lit("output").alias("tensor_path"), F.col("vec_id").alias("event_seq"), F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("elements"),
    )


def _known(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return bounded.tables(bounded.run_to_state(bounded.tensor_rows(vectors(spark, sf_dir), _FEW), scratch(spark, "bounded"), _FEW))


@query(f"{_PLACES} select module, metric, count(*) as count, round(avg(x), 5) + 0.0 as mean, max(sample_id) as latest_sample from v join kept using (module, metric) group by module, metric")
def stream_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series that have a place, from the state of the stream's query."""
    found = bounded.series_table(_known(spark, sf_dir)["series"])
    return C.rounded(found.select("module", "metric", "count", "mean", F.col("latest.sample_id").alias("latest_sample")), digits=5)


@query(f"{_PLACES} select (select count(*) from t) - (select count(*) from t1) as dropped_module_call_observations, (select count(*) from t1) - (select count(*) from t1 join paths using (module)) as dropped_tensor_path_observations, "
       "(select count(*) from idents) - (select count(*) from kept) as dropped_series")
def stream_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the admission has refused."""
    return _known(spark, sf_dir)["counters"].select("dropped_module_call_observations", "dropped_tensor_path_observations", "dropped_series")


_LIVE = f"""with {sql.series(sql.VECTORS.replace('from embeddings', 'from embeddings where (vec_id + 1) % 2 = 0'), ['rms'])}"""


@query(f"""{_LIVE} select (select count(*) from series) as temporal_series, (select count(distinct module) from series) as tensor_paths, (select count(distinct module) from obs where sample_id % 5 = 0) as histograms,
  (select max(latest_sample) + 1 from series) as samples_observed, (select count(*) from series where relative_momentum_20_samples is not null) as long_series, 'every_n_forwards' as sampling, 2::bigint as every, 'histogram' as last_reducer""")
def live_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and settings of the report that a stream of every second vector has led to, read back from its documents."""
    folder = scratch(spark, "live-report")
    settings = api.Settings(indicators=IndicatorConfig(temporal_metrics=("rms",)), every=2, histograms=(HistogramConfig(bins=4, value_range=(-1.0, 1.0), every_n_samples=5),))
    api.stream_reports(vectors(spark, sf_dir).withColumn("forward_index", F.col("sample_id")), folder, settings, details=True).awaitTermination()
    made = spark.read.text(f"{folder}/report.json", wholetext=True)
    at = lambda path, kind="long": F.get_json_object("value", f"$.{path}").cast(kind)
    details = spark.read.json(f"{folder}/details.json/series").agg(F.count("relative_momentum_20_samples").alias("long_series"))  # one row
    return made.crossJoin(details).select(
        *(at(f"coverage.{n}").alias(n) for n in ("temporal_series", "tensor_paths", "histograms", "samples_observed")), "long_series",
        at("run.sampling.type", "string").alias("sampling"), at("run.sampling.settings.n").alias("every"), at("run.reducers[1].type", "string").alias("last_reducer"),
    )


@query("""with e as (select event_id // 6 as sample_id, event_id % 6 as place from events)
  select distinct sample_id::bigint as sample_id from e where place in (0, 3) and sample_id in (select sample_id from e where place = 1 and sample_id % 2 = 0)""")
def stream_backwards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of events as two backwards a sample and a forward for every second one: the samples whose backward counts, once."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.[p]arquet")
    place = F.col("event_id") % 6
    rows = events.select(F.lit(0).alias("source_rank"), F.floor(F.col("event_id") / 6).alias("sample_id"), place.alias("place"), F.col("ts").cast("timestamp").alias("ts"))
    found = correlate.matched(rows.where("place in (0, 3)"), rows.where("place = 1 and sample_id % 2 = 0"), "400 days", "400 days")
    return live.run_to_table(found.withColumn("count", F.lit(1)), ["source_rank", "sample_id"], mode="append").select("sample_id")
