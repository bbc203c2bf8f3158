"""Bounded keyed state of streams, against the batch operators."""

import json

import pytest
from pyspark.sql import functions as F

from helpers import TENSORS, same, tensor_rows
from tidemark import api
from tidemark.model import PATH, SERIES, TENSOR, HistogramConfig, IndicatorConfig
from tidemark.operators import caps, histograms
from tidemark.operators.indicators import names, series_of
from tidemark.operators.reduce import long_form, reduce_tensors
from tidemark.streaming import bounded, correlate

METRICS = ("mean", "rms", "skewness")
ROWS = (
    tensor_rows([[i % 7, 1, -i % 5] for i in range(30)], module="a") + tensor_rows([[(i * i) % 11, 0.5] for i in range(30)], module="b")
    + tensor_rows([[1.0, 1.0] if i < 9 else [i, 2] for i in range(12)], module="b", path="late") + tensor_rows([[i, -i] for i in range(20)], module="c", call_index=1)
    + tensor_rows([[i, 2] for i in range(25)], module="a", signal="output_gradients", path="grad_output") + tensor_rows([[], [float("nan")], [3]], module="d")
)


def in_files(spark, path, rows, part=lambda r: r[5] // 10, schema=TENSORS):
    for k in sorted({part(r) for r in rows}):
        spark.createDataFrame([r for r in rows if part(r) == k], schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema=TENSORS):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, rows, config, checkpoint):
    """Run a stream of ROW to its end; the last snapshot from inside foreachBatch, collected."""
    seen = {}

    def look(batch, batch_id):
        batch = batch.persist()
        for name, table in bounded.tables(bounded.known(batch, batch_id, checkpoint, config).cache()).items():
            seen[name] = [r.asDict(recursive=True) for r in table.collect()]
        batch.unpersist()

    with bounded.rocksdb(spark):
        query = bounded.folded(rows, config).writeStream.outputMode("append").foreachBatch(look).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return seen


def by_key(rows, *key):
    return {tuple(r[k] for k in key): r for r in rows}


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in"))
    in_files(spark, path, ROWS)
    return path


CAPS = [IndicatorConfig(temporal_metrics=METRICS[::-1]), IndicatorConfig(temporal_metrics=METRICS[::-1], max_module_calls=3, max_tensor_paths=4, max_series=8)]


@pytest.mark.parametrize("config", CAPS, ids=["wide", "tight"])
def test_bounded_state_equals_the_batch(spark, source, tmp_path, config):
    at = str(tmp_path / "state")
    seen = run(spark, bounded.tensor_rows(stream(spark, source), config), config, at)
    table = spark.read.parquet(source)
    statistics = reduce_tensors(table, list(METRICS))
    kept = caps.bounded(table.select(*TENSOR), long_form(statistics, list(METRICS)), config)
    want = by_key([r.asDict(recursive=True) for r in series_of(kept.series, config).collect()], *SERIES)
    got = by_key([{**r, "metric": r["name"]} for r in seen["series"]], *SERIES)
    assert set(got) == set(want) and len(got) <= config.max_series
    for key, r in got.items():
        assert (r["count"], r["warmup_complete"], r["minimum"]["sample_id"]) == (want[key]["count"], want[key]["warmup_complete"], want[key]["minimum"]["sample_id"])
        for n in names(config):
            assert same(r[n], want[key][n], 1e-7), (key, n)
    dropped = kept.counters().first().asDict()
    (counters,) = seen["counters"]
    assert {k: counters[k] for k in dropped} == dropped and (config is CAPS[0]) == (sum(dropped.values()) == 0)
    paths = caps.latest_state(kept.tensors.join(table.select(*TENSOR, F.lit(None).cast("array<int>").alias("shape")), TENSOR))
    assert {tuple(r[k] for k in PATH): r["observations"] for r in seen["path"]} == {tuple(r[k] for k in PATH): r["observations"] for r in paths.collect()}
    # The state itself is bounded, and the last snapshot is read from it after the end too.
    places = bounded.state_table(spark, at, "places", operator=bounded.ADMISSION).collect()
    assert len([p for p in places if p["user_map_key"]["what"] == "call"]) <= config.max_module_calls and len([p for p in places if p["user_map_key"]["what"] == "path"]) <= config.max_tensor_paths
    end = bounded.tables(bounded.committed(spark, at, config))
    for name in seen:
        assert sorted(map(str, (r.asDict(recursive=True) for r in end[name].collect()))) == sorted(map(str, seen[name])), name


def test_each_rank_has_places_of_its_own(spark, tmp_path):
    rows = [r for k in range(3) for r in tensor_rows([[i, k] for i in range(8)], module=f"m{k}", rank=k) + tensor_rows([[i, k] for i in range(8)], module="x", rank=k)]
    in_files(spark, str(tmp_path / "in"), rows, part=lambda r: r[5] // 3)
    config = IndicatorConfig(temporal_metrics=("rms", "mean"), max_series=3)
    seen = run(spark, bounded.tensor_rows(stream(spark, str(tmp_path / "in")), config), config, str(tmp_path / "state"))
    assert sorted((r["source_rank"], r["module"], r["name"], r["count"]) for r in seen["series"]) == [(k, m, n, 8) for k in range(3) for m, n in (("m%d" % k, "mean"), ("m%d" % k, "rms"), ("x", "mean"))]
    assert sorted((r["source_rank"], r["dropped_series"]) for r in seen["counters"]) == [(0, 1), (1, 1), (2, 1)]


def test_shapes_histograms_errors_and_durations(spark, tmp_path):
    shaped = [(*r, [2, r[5] // 4]) for r in tensor_rows([[i % 5, 1, float("nan")] for i in range(12)], module="a")] + [(*r, None) for r in tensor_rows([[i, 9] for i in range(12)], module="b")]
    in_files(spark, str(tmp_path / "in"), shaped, part=lambda r: r[5] // 5, schema=TENSORS + ", shape array<int>")
    tensors = stream(spark, str(tmp_path / "in"), TENSORS + ", shape array<int>")
    errors = [("a", "p", "E", "m", i, f"2024-01-01 00:00:{i:02d}") for i in range(7)] + [(None, "p", "E", "m", 9, "2024-01-01 00:00:09"), ("z", "p", "E", "other", 11, None), ("a", "p", "E", "m", 12, None)]
    in_files(spark, str(tmp_path / "err"), errors, part=lambda r: r[4] // 5, schema="module string, probe string, error_type string, message string, event_seq long, ts string")
    broken = stream(spark, str(tmp_path / "err"), "module string, probe string, error_type string, message string, event_seq long, ts string").withColumn("ts", F.to_timestamp("ts"))
    spark.createDataFrame([("forward", i, i, float(i)) for i in range(30)], "metric string, event_seq long, sample_id long, value double").coalesce(1).write.parquet(str(tmp_path / "dur"))
    took = stream(spark, str(tmp_path / "dur"), "metric string, event_seq long, sample_id long, value double")
    config = IndicatorConfig(temporal_metrics=("mean",), max_series=1, max_histograms=2, max_error_summaries=2)
    fixed, own = HistogramConfig(name="fixed", bins=3, value_range=(0.0, 6.0), every_n_samples=2), HistogramConfig(name="own", bins=2, every_n_samples=3)
    rows = bounded.tensor_rows(tensors, config).unionByName(bounded.error_rows(broken)).unionByName(bounded.duration_rows(took))
    for h in (fixed, own):
        rows = rows.unionByName(bounded.histogram_rows(tensors, h))
    seen = run(spark, rows, config, str(tmp_path / "state"))
    assert {r["module"]: (r["observations"], r["shape_changes"], r["shape"]) for r in seen["path"]} == {"a": (12, 2, [2, 2]), "b": (12, 0, None)}
    found = by_key(seen["histogram"], "module", "name")
    assert set(found) == {("a", "fixed"), ("a", "own")} and found["a", "own"]["failed"] and found["a", "own"]["samples"] == 4
    want = histograms.merged(histograms.tensor_histograms(spark.read.parquet(str(tmp_path / "in")).where("module = 'a'"), fixed), PATH).first()
    merged = found["a", "fixed"]
    assert (merged["samples"], merged["bin_counts"], merged["counts"], merged["moments"]) == (want["samples"], want["bin_counts"], [want[c] for c in bounded.COUNTS], [want[c] for c in bounded.MOMENTS])
    assert {(r["module"], r["name"]): (r["count"], r["first_ts"], r["latest_ts"]) for r in seen["error"]} == {("a", "m"): (8, "2024-01-01T00:00:00.000000Z", None), (None, "m"): (1, "2024-01-01T00:00:09.000000Z", "2024-01-01T00:00:09.000000Z")}
    (counters,) = seen["counters"]
    assert (counters["dropped_series"], counters["dropped_histogram_observations"], counters["dropped_error_summaries"]) == (1, 10, 1)
    kinds = {(r["kind"], r["name"]): r["count"] for r in seen["series"]}
    assert kinds == {("series", "mean"): 12, ("duration", "forward"): 30}


def test_reports_exist_before_the_first_batch_go_on_and_are_complete(spark, tmp_path):
    folder, checkpoint, source = str(tmp_path / "run"), str(tmp_path / "state"), str(tmp_path / "in")
    config = IndicatorConfig(temporal_metrics=("rms", "mean", "zero_fraction"), max_series=7)
    settings = api.Settings(indicators=config, histograms=(HistogramConfig(name="h", bins=3, value_range=(0.0, 9.0), every_n_samples=1),))
    catalog = spark.createDataFrame([("a", "Linear"), ("b", "ReLU"), ("unseen", "Conv")], "module string, module_type string")
    read = lambda: json.loads((tmp_path / "run" / "report.json").read_text())
    first, second = [r for r in ROWS if r[5] < 12 and r[1] in "ab"], [r for r in ROWS if r[5] >= 12 and r[1] in "ab"]
    spark.createDataFrame([], TENSORS).coalesce(1).write.parquet(source)
    in_files(spark, str(tmp_path / "err"), [("a", "p", "E", "m", i) for i in range(3)], part=lambda r: 0, schema="module string, probe string, error_type string, message string, event_seq long")

    def go():
        errors = stream(spark, str(tmp_path / "err"), "module string, probe string, error_type string, message string, event_seq long")
        query = api.stream_reports(stream(spark, source), folder, settings, checkpoint=checkpoint, errors=errors, catalog=catalog, details=True)
        before = read()
        query.awaitTermination()
        return before

    in_files(spark, source, first)
    before = go()
    assert before["coverage"]["temporal_series"] == 0 and before["coverage"]["samples_observed"] == 0 and "index.md" in {p.name for p in (tmp_path / "run").iterdir()}
    middle = read()
    assert middle["coverage"]["samples_observed"] == 12 and middle["coverage"]["dropped_series"] > 0
    in_files(spark, source, second)
    assert go() == middle  # the document of the stopped run stands until there is a newer one
    made = read()
    table = spark.read.parquet(source)
    one = api.analyze(table, settings)
    batch = json.loads(open(api.write_report(one, tmp_path / "batch", settings, catalog=catalog)).read())
    skip = {"errors_returned", "errors_omitted"}
    assert {k: v for k, v in made["coverage"].items() if k not in skip} == {k: v for k, v in batch["coverage"].items() if k not in skip}
    assert [(g["category"], [(f["module"], f["metric"], round(f["ranking_score"], 6)) for f in g["findings"]]) for g in made["findings"]] == [(g["category"], [(f["module"], f["metric"], round(f["ranking_score"], 6)) for f in g["findings"]]) for g in batch["findings"]]
    assert [(e["module"], e["count"]) for e in made["errors"]] == [("a", 3)] and made["run"] == batch["run"]
    assert {p.name for p in (tmp_path / "run" / "details.json").iterdir()} == {"series", "state", "errors"}
    with pytest.raises(Exception, match="run"):
        api.stream_reports(stream(spark, source), folder, settings, checkpoint=str(tmp_path / "other"))


def test_backwards_of_a_stream_meet_their_forwards_once(spark, tmp_path):
    """Second backwards are dropped, also in later batches; a backward without forward isn't kept; one that comes before its forward is."""
    kinds = "source_rank int, sample_id long, phase string, ts string, note string, part int"
    rows = [
        (0, 1, "f", "00:00", "", 0), (0, 1, "b", "00:01", "first", 0), (0, 2, "b", "00:02", "early", 0), (0, 3, "b", "00:03", "alone", 0), (1, 3, "f", "00:03", "", 0),
        (0, 1, "b", "00:04", "second", 1), (0, 2, "f", "00:05", "", 1), (1, 3, "b", "00:06", "other rank", 1), (0, 4, "f", "00:00", "", 1), (0, 4, "b", "00:59", "too far", 1),
        (1, 3, "b", "00:07", "again", 2), (0, 5, "f", "00:08", "", 2), (0, 5, "b", "00:09", "last", 2),
    ]
    in_files(spark, str(tmp_path / "in"), rows, part=lambda r: r[5], schema=kinds)
    events = stream(spark, str(tmp_path / "in"), kinds).withColumn("ts", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "ts")))
    found = correlate.matched(events.where("phase = 'b'"), events.where("phase = 'f'"), "1 hour", "30 minutes")
    from tidemark.streaming import live

    got = live.run_to_table(found.withColumn("count", F.lit(1)), ["source_rank", "sample_id", "note"], mode="append").collect()
    assert sorted((r["source_rank"], r["sample_id"], r["note"]) for r in got) == [(0, 1, "first"), (0, 2, "early"), (0, 5, "last"), (1, 3, "other rank")]
