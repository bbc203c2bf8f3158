import json

import pytest
from pyspark.sql import functions as F

from helpers import TENSORS, same, tensor_rows
from tidemark import api
from tidemark.model import PATH, SERIES, HistogramConfig, IndicatorConfig
from tidemark.operators import histograms
from tidemark.operators.indicators import names, series_of
from tidemark.operators.reduce import long_form, reduce_tensors
from tidemark.operators.sampling import timed
from tidemark.sinks.dashboards import Calls, FanOut, flat_metrics
from tidemark.streaming import live

CONFIG = IndicatorConfig(temporal_metrics=("rms", "mean", "zero_fraction"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Five files of observations of two modules, to be read one after another."""
    path = str(tmp_path_factory.mktemp("in"))
    rows = tensor_rows([[i % 7, 1, -i % 5] for i in range(30)], module="a") + tensor_rows([[(i * i) % 11, 0.5] for i in range(30)], module="b")
    for k in range(5):
        spark.createDataFrame([r for r in rows if r[5] // 6 == k], TENSORS).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder):
    return spark.readStream.schema(TENSORS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_equals_batch(spark, folder):
    metrics = list(CONFIG.temporal_metrics)
    batch = {(r["module"], r["metric"]): r for r in series_of(long_form(reduce_tensors(spark.read.parquet(folder), metrics), metrics), CONFIG).collect()}
    found = live.run_to_table(live.stream_series(live.stream_statistics(stream(spark, folder), CONFIG), CONFIG), SERIES).collect()
    assert len(found) == len(batch) == 6
    for r in found:
        want = batch[(r["module"], r["metric"])]
        assert (r["count"], r["warmup_complete"], r["maximum"]["sample_id"]) == (want["count"], want["warmup_complete"], want["maximum"]["sample_id"])
        for n in names(CONFIG):
            assert same(r[n], want[n], 1e-7), (r["module"], r["metric"], n)


def test_timer_and_histograms_of_a_stream(spark, folder):
    due = stream(spark, folder).select("module", F.col("sample_id").cast("double").alias("t"), F.lit(0.0).alias("t0"))
    found = live.run_to_table(live.stream_timed(due, 7, ["module"]).withColumn("count", F.lit(1)), ["module", "t"], mode="append")
    want = timed(spark.read.parquet(folder).select("module", F.col("sample_id").alias("t"), F.lit(0.0).alias("t0")), 7, ["module"])
    assert sorted((r["module"], r["t"]) for r in found.collect()) == sorted((r["module"], r["t"]) for r in want.collect())

    each = histograms.histograms(spark.read.parquet(folder).select(*PATH, "event_seq", "sample_id", F.explode("elements").alias("value")), HistogramConfig(bins=3, value_range=(0.0, 6.0), every_n_samples=1))
    at = folder + "-hist"
    each.coalesce(1).write.parquet(at)
    many = spark.readStream.schema(each.schema).parquet(at)
    one = live.run_to_table(live.stream_histograms(many, PATH), [*PATH, "name"], "samples").collect()
    want = {r["module"]: r["bin_counts"] for r in histograms.merged(each, PATH).collect()}
    assert {r["module"]: r["bin_counts"] for r in one} == want and not any(r["failed"] for r in one)


def test_reports_follow_the_stream(spark, folder, tmp_path):
    seen = []
    query = api.stream_reports(stream(spark, folder), tmp_path / "run", api.Settings(indicators=CONFIG), also=[lambda df, i: seen.append((i, df.count()))])
    query.awaitTermination()
    made = json.loads((tmp_path / "run" / "report.json").read_text())
    assert made["coverage"]["temporal_series"] == 6 and made["coverage"]["findings_returned"] > 0 and seen[-1] == (4, 6)
    assert made["coverage"]["samples_observed"] == 30 and made["coverage"]["dropped_series"] == 0 and made["updated_at"]["status"] == "absent"


def test_an_aggregator_of_ones_own(spark, folder, tmp_path):
    """One that looks at the first module only."""
    first = lambda values, config: live.stream_series(values.where("module = 'a'"), config)
    api.stream_reports(stream(spark, folder), tmp_path / "run", api.Settings(indicators=CONFIG), aggregator=first).awaitTermination()
    assert json.loads((tmp_path / "run" / "report.json").read_text())["coverage"]["temporal_series"] == 3


def test_live_reports_count_what_they_leave_out_and_know_the_time(spark, tmp_path):
    at = str(tmp_path / "in")
    rows = [(*r, f"2024-03-01T00:00:{r[5]:02d}Z") for m in "abc" for r in tensor_rows([[i, 2 * i, 1] for i in range(9)], module=m)]
    rows += [(*r, "2024-03-01T00:01:00Z") for r in tensor_rows([[1, 2]] * 4, module="a", signal="output_gradients", path="grad_output")]
    spark.createDataFrame(rows, TENSORS + ", at string").withColumn("ts", F.to_timestamp("at")).drop("at").coalesce(1).write.parquet(at)
    few = IndicatorConfig(temporal_metrics=("rms", "mean"), max_series=5)
    many = spark.readStream.schema(TENSORS + ", ts timestamp").parquet(at)
    api.stream_reports(many, tmp_path / "run", api.Settings(indicators=few)).awaitTermination()
    made = json.loads((tmp_path / "run" / "report.json").read_text())
    cover = made["coverage"]
    assert (cover["temporal_series"], cover["dropped_series"], cover["samples_observed"], cover["backward_samples_observed"]) == (5, 3, 9, 4)
    assert made["updated_at"] == "2024-03-01T00:01:00.000000Z"


def test_volatility_of_steady_steps_is_the_same_in_stream_and_batch(spark):
    """Steps of 1e9, whose squares leave no digits for their variance."""
    rows = [(0, "m", 0, "outputs", "o", "rms", i, i, 1e9 * i) for i in range(401)]
    df = spark.createDataFrame(rows, "source_rank int, module string, call_index int, signal string, tensor_path string, metric string, event_seq long, sample_id long, value double")
    s = live.begin(0.0, 0)
    for i in range(1, 401):
        live.fold(s, 1e9 * i, i, IndicatorConfig())
    want = live.summary(s, IndicatorConfig())["exponentially_weighted_change_volatility"]
    found = series_of(df).first()["exponentially_weighted_change_volatility"]
    assert want > 0.5 and same(found, want, 1e-6)


def test_fan_out_reaches_all_and_gathers_failures(spark):
    got, closed = [], []

    class Watched(Calls):
        def close(self):
            closed.append(self)

    def bad(df, i):
        raise RuntimeError("no")

    one, two = Watched(bad), Watched(lambda df, i: got.append(df.count()))
    with pytest.raises(ExceptionGroup):
        FanOut(one, two).receive(spark.range(3), 0)
    assert got == [3]
    FanOut(one, two).close()
    assert closed == [two, one]

    class Stuck(Watched):
        def start(self):
            raise RuntimeError("stuck")

    closed.clear()
    with pytest.raises(RuntimeError):
        FanOut(one, Stuck(bad)).start()
    assert closed == [one]


def test_flat_metrics(spark):
    df = spark.createDataFrame([("", 0, "output", "rms", 1.5, 7), ("a.b/c d", 1, "o~x*y", "p99", 2.0, 8)], "module string, call_index int, tensor_path string, metric string, value double, sample_id int")
    assert [(r["name"], r["step"]) for r in flat_metrics(df, " run/ ").orderBy("step").collect()] == [("run/modules/@root/call_0/output/rms", 7), ("run/modules/a.b%2Fc%20d/call_1/o~x%2Ay/p99", 8)]
    with pytest.raises(ValueError):
        flat_metrics(df, " / ")
