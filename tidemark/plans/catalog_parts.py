"""Queries of the smaller parts: filters, joins, state, names, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import iso_utc, path_segment, truncated
from tidemark.model import PATH, TEMPORAL_METRICS, HistogramConfig, ReportConfig
from tidemark.operators import caps, histograms, indicators, joins, reduce, rules, sampling
from tidemark.plans import catalog as C
from tidemark.plans import merge, report, sql
from tidemark.sources import adapters as A
from tidemark.sources import observations
from tidemark.sources.reports import FINDING, findings_of, rank_reports
from tidemark.sources.tables import scratch, stream_in_order, table
from tidemark.streaming import live

query = C.query


@query("select event_id, event_type from events where user_id % 4 = 0")
def filter_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.events(spark, sf_dir).select("event_id", "event_type", (F.col("user_id") % 4).alias("source_rank"))
    return sampling.of_rank(rows).select("event_id", "event_type")


@query("select event_id, case when user_id % 2 = 0 then 'outputs' else 'output_gradients' end as signal from events where (event_id % 3 = 0) = (user_id % 2 = 0)")
def filter_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_id") % 3 == 0, "forward_complete").otherwise("backward_observed")
    signal = F.when(F.col("user_id") % 2 == 0, "outputs").otherwise("output_gradients")
    return sampling.by_phase(C.events(spark, sf_dir).select("event_id", state.alias("state"), signal.alias("signal"))).select("event_id", "signal")


@query("select event_id from events where value >= 50 and event_type = 'click'")
def filter_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.events(spark, sf_dir).where((F.col("value") >= 50) & sampling.always() & (F.col("event_type") == "click")).select("event_id")


@query("select doc_id, 'grad_output.output' as path, source as segment, case when length(lang || ' ' || source) > 6 then substring(lang || ' ' || source, 1, 5) || '…' else lang || ' ' || source end as short from documents")
def names_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", sampling.gradient_path(F.lit("output.output")).alias("path"), path_segment(F.col("source")).alias("segment"), truncated(F.concat_ws(" ", "lang", "source"), 6).alias("short"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when microsecond(ts) % 1000000 = 0 then '' else '.' || lpad((microsecond(ts) % 1000000)::varchar, 6, '0') end || 'Z' as ts from events")
def iso_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.events(spark, sf_dir).select("event_id", iso_utc(F.col("ts")).alias("ts"))


# Joins.
_GRADIENTS = f"""with f as (select distinct {sql.DAY} as sample_id, event_type as module, 'output.' || (user_id % 3) as tensor_path, user_id % 2 as tensor_id from events),
  first as (select sample_id, module, tensor_id, min(tensor_path) as first_path from f group by all),
  g as (select distinct sample_id, module, tensor_path, (sample_id * 1.5)::double as scale from f where tensor_path <> 'output.2')
  select f.sample_id, f.module, replace(f.tensor_path, 'output', 'grad_output') as tensor_path, scale from f join first using (sample_id, module, tensor_id) join g on g.sample_id = f.sample_id and g.module = f.module and g.tensor_path = first_path"""


@query(_GRADIENTS)
def join_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.events(spark, sf_dir)
    base = [F.lit(0).alias("source_rank"), A.day_of(F.col("ts")).alias("sample_id"), F.col("event_type").alias("module"), F.lit(0).alias("call_index")]
    outputs = e.select(*base, F.concat(F.lit("output."), (F.col("user_id") % 3).cast("string")).alias("tensor_path"), (F.col("user_id") % 2).alias("tensor_id")).distinct()
    gradients = outputs.where("tensor_path <> 'output.2'").drop("tensor_id").distinct().withColumn("scale", F.col("sample_id") * 1.5)
    return joins.bind_gradients(outputs, gradients, ["scale"]).select("sample_id", "module", "tensor_path", "scale")


@query("select event_id as sample_id, a.value, b.value * 2 as gradient from events a left join (select event_id as i, value from events where event_id % 3 = 0) b on b.i = a.event_id")
def join_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.events(spark, sf_dir).select(F.lit(0).alias("source_rank"), F.col("event_id").alias("sample_id"), "value")
    backward = e.where(F.col("sample_id") % 3 == 0).withColumn("gradient", F.col("value") * 2)
    return joins.correlated(e, backward, ["gradient"]).select("sample_id", "value", "gradient")


@query("select event_id as sample_id from events where event_id % 3 = 0 and event_id % 2 = 0")
def join_matching_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.events(spark, sf_dir).select(F.lit(0).alias("source_rank"), F.col("event_id").alias("sample_id"))
    return joins.with_forward(e.where("sample_id % 3 = 0"), e.where("sample_id % 2 = 0")).select("sample_id")


@query("select min(p_name) as module, count(*) as aliases, min(p_name) = max(p_name) as one_name from (select distinct p_brand, p_name from part) group by p_brand")
def module_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("identity"), F.col("p_name").alias("name")).distinct()
    names = names.withColumns({"module_ord": F.dense_rank().over(Window.partitionBy("identity").orderBy("name")), "module_type": F.lit("Part"), "parameter_count": F.lit(0), "trainable_parameter_count": F.lit(0)})
    found = joins.module_catalog(names)
    return found.select("module", F.size("aliases").cast("long").alias("aliases"), (F.get("aliases", 0) == F.element_at("aliases", -1)).alias("one_name"))


@query(f"with {sql.candidates(sql.EVENTS, ['rms'])} select module, 'Events' as module_type, category, round(score, 6) + 0.0 as score from candidates")
def join_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.event_rows(C.events(spark, sf_dir))
    modules = rows.select("module").distinct().withColumn("module_type", F.lit("Events"))
    found = rules.with_modules(rules.candidates(indicators.series_of(C.values_of(rows, ["rms"]))), modules)
    return C.rounded(found.select("module", "module_type", "category", F.col("ranking_score").alias("score")))


@query("select x as rank from range(7) t(x) where x not in (select distinct user_id % 4 from events)")
def missing_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.missing_ranks(C.events(spark, sf_dir).select((F.col("user_id") % 4).cast("int").alias("rank")).distinct(), 7)


# State.
_PHASED = "select event_id, event_id // 2 as sample_id, case when event_id % 2 = 0 then 'forward_complete' else 'backward_observed' end as state, ts, value from events"


def _phased(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_id") % 2 == 0, "forward_complete").otherwise("backward_observed")
    return C.events(spark, sf_dir).select(F.lit(0).alias("source_rank"), F.col("event_id").alias("event_seq"), F.floor(F.col("event_id") / 2).alias("sample_id"), state.alias("state"), "ts", F.col("value").alias("collection_duration_ms"))


@query(f"select max(ts) as updated_at, max(sample_id) filter (where state = 'forward_complete') + 1 as samples_observed, count(*) filter (where state = 'backward_observed') as backward_samples_observed from ({_PHASED})")
def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.run_state(_phased(spark, sf_dir))


@query(f"select case when state = 'forward_complete' then 'forward_collection_duration_ms' else 'total_collection_duration_ms' end as metric, count(*) as count, round(avg(value), 6) + 0.0 as mean, round(stddev_pop(value), 6) + 0.0 as standard_deviation from ({_PHASED}) group by 1")
def observer_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indicators.series_of(caps.observer_series(_phased(spark, sf_dir)), keys=["metric"])
    return C.rounded(found.select("metric", "count", "mean", "standard_deviation"))


@query("with e as (select event_id, user_id % 50 as sample_id from events), k as (select sample_id, min(event_id) as first from e group by 1) select event_id, e.sample_id from e join k on e.sample_id = k.sample_id and event_id = first")
def first_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.events(spark, sf_dir).select(F.lit(0).alias("source_rank"), (F.col("user_id") % 50).alias("sample_id"), F.lit("backward_observed").alias("state"), F.col("event_id").alias("event_seq"))
    return sampling.first_of_each(rows).select(F.col("event_seq").alias("event_id"), "sample_id")


_HISTS = sql.histogram(sql.EVENTS, 2, 4, "20.0", "80.0")


def _hists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.histograms(A.event_rows(C.events(spark, sf_dir)), HistogramConfig(bins=4, value_range=(20.0, 80.0), every_n_samples=2)).where("reason is null")


@query(f"with {_HISTS} select module, sample_id, bin_0, bin_3, round(maximum, 6) + 0.0 as maximum from hist qualify row_number() over (partition by module order by sample_id desc) = 1")
def hist_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = histograms.latest(_hists(spark, sf_dir), PATH)
    return C.rounded(found.select("module", "sample_id", F.get("bin_counts", 0).alias("bin_0"), F.get("bin_counts", 3).alias("bin_3"), "maximum"))


@query(f"with {_HISTS}, kept as (select module from hist group by module order by min((sample_id, module)) limit 3) select (select count(*) from hist join kept using (module)) as kept, (select count(*) from hist) - (select count(*) from hist join kept using (module)) as dropped")
def caps_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _hists(spark, sf_dir).withColumn("event_seq", F.col("sample_id"))
    kept, dropped = caps.bounded_histograms(found, 3)
    return kept.agg(F.count(F.lit(1)).alias("kept")).crossJoin(dropped.withColumnRenamed("dropped_histogram_observations", "dropped"))  # two single rows


@query(f"with {sql.series(sql.ALL, ['rms'])} select module, call_index, signal, " + " + ".join(f"({n} is not null)::bigint" for n in indicators.names()) + " as available from series")
def available_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indicators.indicator_map(C.series(spark, sf_dir, ["rms"]))
    return found.select("module", "call_index", "signal", F.size("indicators").cast("long").alias("available"))


@query(f"with {sql.candidates(sql.ALL, ['rms'])} select module, call_index, signal, category, case category when 'volatility' then 3 when 'oscillation' then 2 when 'regime_change' then 2 else 9 end as evidence from candidates")
def rule_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.candidates(C.series(spark, sf_dir, ["rms"]))
    return found.select("module", "call_index", "signal", "category", F.size("evidence").alias("evidence"))


# Reports of ranks, written and read again.
@query(C.ORACLES["merge_ranks"].replace("r <= 3", "r <= 20"))
def merge_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "rank-reports")
    for rank, text in _rank_texts(spark, sf_dir):
        _write_report(spark, root, rank, text)
    found = merge.global_top(findings_of(rank_reports(spark, root)), 5)
    return C.scores(found, "rank").withColumn("rank", F.col("rank").cast("long"))


def _rank_texts(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    """Four ranks, each with a bounded report."""
    rows = A.event_rows(C.events(spark, sf_dir), source_rank=F.col("user_id") % 4)
    series = indicators.series_of(C.values_of(rows, C._RANK_METRICS), timestamp=F.lit("2024-01-01T00:00:00Z")).persist()
    texts = []
    for rank in range(4):
        made = report.build_report(series.where(F.col("source_rank") == rank), rank=report.Rank(rank, 4), state={"updated_at": "2024-01-01T00:00:00Z"})
        texts.append((rank, report.D.json_text(made)))
    series.unpersist()
    return texts


def _write_report(spark: SparkSession, root: str, rank: int, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/rank-{rank:03d}/report.json", lineSep="\n")


@query(C.ORACLES["merge_ranks"].replace("r <= 3", "r <= 20"))
def merge_arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the global report that a stream keeps: two ranks report, the query stops and goes on when the others have."""
    root, folder = scratch(spark, "rank-reports"), scratch(spark, "global-report")
    for rank, text in _rank_texts(spark, sf_dir):
        _write_report(spark, root, rank, text)
        if rank % 2:
            merge.stream_rank_reports(spark, root, folder, ReportConfig(top_k_per_category=5)).awaitTermination()
    made = spark.read.schema(f"findings array<struct<category: string, findings: array<{FINDING}>>>").json(f"{folder}/global-report.json", multiLine=True)
    found = made.select(F.explode("findings").alias("g")).select(F.explode("g.findings").alias("f")).select("f.*")
    return C.scores(found, "rank").withColumn("rank", F.col("rank").cast("long"))


# Streams.
_TIMED = """with recursive t as (select distinct label, vec_id::double as t from embeddings),
  r as (select label, 0.0::double as due, null::double as kept from (select distinct label from t)
    union all select r.label, null, min(t.t) from r join t on t.label = r.label and t.t >= (case when r.kept is null then 0 else r.kept end) + 25 group by r.label)
  select label, kept as t from r where kept is not null"""


@query(_TIMED)
def stream_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir).select("label", F.col("vec_id").cast("double").alias("t"), F.lit(0.0).alias("t0"))
    found = live.stream_timed(vectors, 25, ["label"]).withColumn("count", F.lit(1))
    return live.run_to_table(found, ["label", "t"], mode="append").select("label", "t")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_in_order(spark, sf_dir, "embeddings", "vec_id")


@query("with x as (select label, unnest(embedding)::double as v from embeddings) select label, (select count(*) from embeddings e where e.label = x.label) as samples, "
       + ", ".join(f"count(*) filter (where v >= {lo} and v {'<=' if i == 3 else '<'} {lo + 0.1}) as bin_{i}" for i, lo in enumerate((-0.2, -0.1, 0.0, 0.1))) + " from x group by label")
def stream_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = [-0.2, -0.1, 0.0, 0.1, 0.2]
    inside = lambda i: F.size(F.filter("embedding", lambda v: (v.cast("double") >= edges[i]) & ((v.cast("double") <= edges[i + 1]) if i == 3 else (v.cast("double") < edges[i + 1])))).cast("long")
    each = _vectors(spark, sf_dir).select("label", F.lit("h").alias("name"), F.array(*map(F.lit, edges)).alias("bin_edges"), F.array(*(inside(i) for i in range(4))).alias("bin_counts"), F.size("embedding").cast("long").alias("finite_count"))
    found = live.run_to_table(live.stream_histograms(each, ["label"]), ["label", "name"], "samples")
    return found.select("label", "samples", *(F.get("bin_counts", i).alias(f"bin_{i}") for i in range(4)))


@query(f"with {sql.values(sql.EVENTS, TEMPORAL_METRICS)} select metric, count(*) as rows from v group by metric")
def temporal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reduce.reduce_rows(A.event_rows(C.events(spark, sf_dir)))
    return reduce.long_form(found, TEMPORAL_METRICS).groupBy("metric").agg(F.count(F.lit(1)).alias("rows"))


@query(f"select 'read' as kind, event_type as module, count(*) as rows, sum(json_extract_string(props, '$.k')::bigint)::bigint as total from events where event_id % 10 <> 0 group by event_type "
       "union all select 'error', event_type, count(*), null from events where event_id % 10 = 0 group by event_type")
def error_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.events(spark, sf_dir).select("event_type", "ts", F.when(F.col("event_id") % 10 == 0, '{"k": ').otherwise(F.col("props")).alias("props"))
    good, bad = observations.parse(e, "props", "k bigint", module=F.col("event_type"), ts=F.col("ts"))
    read = good.groupBy(F.col("event_type").alias("module")).agg(F.count(F.lit(1)).alias("rows"), F.sum("k").alias("total")).withColumn("kind", F.lit("read"))
    failed = caps.error_summaries(bad).select("module", F.col("count").alias("rows"), F.lit(None).cast("long").alias("total"), F.lit("error").alias("kind"))
    return read.unionByName(failed).select("kind", "module", "rows", "total")
