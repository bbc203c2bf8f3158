import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import tensor_rows, tensors, values, TENSORS
from tidemark import api
from tidemark.functions.times import parsed_time, time_text
from tidemark.model import CATEGORIES, HistogramConfig, IndicatorConfig, ReportConfig
from tidemark.operators import caps, rules
from tidemark.operators.indicators import series_of
from tidemark.plans import merge, report
from tidemark.sinks import documents as D
from tidemark.sources.reports import rank_reports


def many(spark, modules, numbers=range(1, 26)):
    rows = [(0, f"layer.{m}", 0, "outputs", "output", "rms", i, i, float(x)) for m in range(modules) for i, x in enumerate(numbers)]
    df = spark.createDataFrame(rows, "source_rank int, module string, call_index int, signal string, tensor_path string, metric string, event_seq long, sample_id long, value double")
    return series_of(df, timestamp=F.lit("2024-01-01T00:00:00Z"))


def test_drift_is_found(spark):
    made = report.build_report(series_of(values(spark, range(1, 26))))
    group = {g["category"]: g["findings"] for g in made["findings"]}
    f = group["activation_scale_drift"][0]
    assert (f["ranking_score"], f["first"]["value"], f["latest"]["value"], f["warmup_complete"], f["rank"]) == (24, 1, 25, True, 1)
    assert [e["name"] for e in f["evidence"]][-1] == "relative_change_from_first" and list(group) == CATEGORIES


def test_each_rule_has_its_condition(spark):
    alternating = [1, 2] * 12 + [1]
    rows = (
        values(spark, alternating, module="turns").unionByName(values(spark, [0.2, 0.4], module="zeros", metric="zero_fraction")).unionByName(values(spark, [1.0, 0.5], module="nan", metric="finite_fraction"))
        .unionByName(values(spark, [1.0, 3.0], module="tail", metric="max_to_rms")).unionByName(values(spark, [1.0, 3.0], module="grad", signal="output_gradients")).unionByName(values(spark, [3.0, 1.0], module="none", metric="max_to_rms"))
    )
    found = {(r["module"], r["category"]): r["ranking_score"] for r in rules.candidates(series_of(rows)).collect()}
    assert found[("turns", "oscillation")] == pytest.approx(1) and found[("zeros", "zero_fraction_growth")] == pytest.approx(0.2) and found[("nan", "nonfinite_values")] == 0.5
    assert found[("tail", "heavy_tail_growth")] == 2 and found[("grad", "gradient_scale_change")] == 2 and not [k for k in found if k[0] == "none"] and ("grad", "activation_scale_drift") not in found


def test_ranking_breaks_ties_by_name_and_counts_all(spark):
    found = rules.candidates(many(spark, 5))
    best = rules.top_findings(found, 2).where("category = 'activation_scale_drift'").orderBy("rank").collect()
    assert [r["module"] for r in best] == ["layer.0", "layer.1"]
    counts = {r["category"]: r["candidates"] for r in rules.candidate_counts(found, spark).collect()}
    assert counts["activation_scale_drift"] == 5 and counts["nonfinite_values"] == 0 and len(counts) == 8
    order = [(r["rank"], CATEGORIES.index(r["category"])) for r in rules.round_robin(rules.top_findings(found, 2)).collect()]
    assert order == sorted(order)


def test_byte_budget_is_kept_and_exact(spark):
    made = report.build_report(many(spark, 80), config=ReportConfig(max_bytes=16_000, top_k_per_category=80))
    cover = made["coverage"]
    assert D.json_bytes(made) <= 16_000 and cover["report_truncated_by_byte_budget"] and cover["findings_omitted"] > 0
    assert cover["findings_returned"] == sum(len(g["findings"]) for g in made["findings"]) and cover["findings_returned"] + cover["findings_omitted"] == sum(c["count"] for c in cover["candidates_by_category"])
    # One more finding of the size of the last would not fit.
    assert D.json_bytes(made) > 16_000 - 3_000
    with pytest.raises(ValueError, match="8192 bytes, not 8191"):
        ReportConfig(max_bytes=8191)


def test_errors_are_bounded_and_go_first(spark):
    rows = [(None if i % 2 else "m", "outputs", "RuntimeError", f"{i % 40} " + "x" * 600, i) for i in range(80)]
    errors = spark.createDataFrame(rows, "module string, probe string, error_type string, message string, ts int")
    kept = caps.error_summaries(errors, cap=30)
    assert kept.count() == 30 and sum(r["count"] for r in kept.collect()) == 60 and caps.dropped_errors(errors, 30).first()[0] == 20
    made = report.build_report(many(spark, 1), errors=kept)
    assert made["coverage"]["errors_returned"] == 20 and made["coverage"]["errors_omitted"] == 10 and all(len(e["message"]) == 500 and e["message"].endswith("…") for e in made["errors"])
    small = report.build_report(many(spark, 1), errors=kept, config=ReportConfig(max_bytes=9_000))
    assert small["errors"] == [] and small["coverage"]["errors_omitted"] == 30 and small["coverage"]["report_truncated_by_byte_budget"]


def test_strict_documents(spark, tmp_path):
    with pytest.raises(ValueError):
        D.json_text({"x": float("nan")})
    with pytest.raises(TypeError):
        D.json_text({"x": object()})
    D.publish(tmp_path / "a.json", "an older one")
    path = Path(D.publish(tmp_path / "a.json", D.json_text({"b": 1, "a": "ü"})))
    assert path.read_text() == '{\n  "a": "ü",\n  "b": 1\n}\n' and [p.name for p in tmp_path.iterdir()] == ["a.json"]
    (tmp_path / "stats.json").write_text("{}")
    with pytest.raises(D.RunExistsError):
        D.claim(tmp_path)


def rank_report(spark, folder, rank, world, numbers):
    made = report.build_report(series_of(values(spark, numbers), timestamp=F.lit("2024-01-01T00:00:00Z")), rank=report.Rank(rank, world), state={"updated_at": f"2024-01-0{rank % 9 + 1}T00:00:00Z"})
    return report.publish_report(folder, made, isolate_rank=True)


def test_merging_ranks(spark, tmp_path):
    rank_report(spark, tmp_path, 0, 2, range(1, 26))
    rank_report(spark, tmp_path, 1, 2, [i * i for i in range(1, 26)])
    path, text = merge.merge_rank_reports(spark, str(tmp_path), config=ReportConfig(max_bytes=32_000))
    made = json.loads(Path(path).read_text())
    assert made["coverage"]["ranks_present"] == [0, 1] and made["coverage"]["rank_coverage_complete"] and Path(path).stat().st_size <= 32_000
    drift = next(g["findings"] for g in made["findings"] if g["category"] == "activation_scale_drift")
    assert [f["source_rank"] for f in drift] == [1, 0] and [f["rank"] for f in drift] == [1, 2] and made["updated_at"].startswith("2024-01-02")
    assert "rank 1" in Path(text).read_text()


def test_merging_tells_what_is_missing_or_wrong(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        merge.merge_rank_reports(spark, str(tmp_path))
    rank_report(spark, tmp_path, 1000, 1001, range(1, 26))
    cover = json.loads(Path(merge.merge_rank_reports(spark, str(tmp_path))[0]).read_text())["coverage"]
    assert cover["ranks_present"] == [1000] and not cover["rank_coverage_complete"]
    (tmp_path / "rank-0000").mkdir()
    (tmp_path / "rank-0000" / "report.json").write_text((tmp_path / "rank-1000" / "report.json").read_text())
    with pytest.raises(Exception, match="rank 1000 has 2 reports"):
        merge.merge_rank_reports(spark, str(tmp_path))
    (tmp_path / "rank-0000" / "report.json").write_text('{"updated_at": "x"}')
    with pytest.raises(Exception, match="missing|do not fit"):
        rank_reports(spark, str(tmp_path)).collect()
    ranks = spark.createDataFrame([(0, 2, None, False), (1, 3, None, False)], "rank int, world_size int, updated_at string, truncated boolean")
    with pytest.raises(Exception, match="different sizes"):
        merge.rank_coverage(ranks).collect()
    assert [r["rank"] for r in merge.missing_ranks(ranks, 4).orderBy("rank").collect()] == [2, 3]
    for bad in ((1, 1), (-1, 2), (True, 2)):
        with pytest.raises(ValueError):
            report.Rank(*bad)


def test_caps_count_what_they_leave_out(spark):
    stats = ["mean", "rms"]
    rows = tensor_rows([[1], [2]], path="value_0") + tensor_rows([[1], [2]], path="value_1") + [r for r in tensor_rows([[1], [2]], call_index=1) if r[5] == 1]
    df = spark.createDataFrame(rows, TENSORS)
    one = api.analyze(df, api.Settings(indicators=IndicatorConfig(max_tensor_paths=1, max_module_calls=1, max_series=1, temporal_metrics=tuple(stats))))
    assert one.bounded.counters().first().asDict() == {"dropped_module_call_observations": 1, "dropped_tensor_path_observations": 2, "dropped_series": 1}
    assert [(r["tensor_path"], r["metric"], r["count"]) for r in one.series.collect()] == [("value_0", "mean", 2)]
    all_series = api.analyze(tensors(spark, [[1, 3], [2, 5]]), api.Settings(indicators=IndicatorConfig(max_series=1)))
    assert all_series.bounded.counters().first()["dropped_series"] == 12


def test_state_counts_changes_of_shape(spark):
    rows = spark.createDataFrame([(0, "m", 0, "outputs", "o", i, i, s) for i, s in enumerate([[2, 3], [5, 3], [5, 3]])], "source_rank int, module string, call_index int, signal string, tensor_path string, event_seq long, sample_id long, shape array<int>")
    r = caps.latest_state(rows).first()
    assert (r["observations"], r["shape_changes"], r["shape"]) == (3, 1, [5, 3])
    ev = spark.createDataFrame([(0, "forward_complete", 5, 1.0, 0), (0, "backward_observed", 4, 2.0, 1)], "sample_id int, state string, ts int, collection_duration_ms double, event_seq int")
    assert caps.run_state(ev).first().asDict() == {"updated_at": 5, "samples_observed": 1, "backward_samples_observed": 1}
    assert caps.observer_series(ev).count() == 2


def test_from_tensors_to_documents(spark, tmp_path):
    settings = api.Settings(histograms=(HistogramConfig(bins=4, every_n_samples=5),))
    one = api.analyze(tensors(spark, [[i, -i, 2 * i] for i in range(1, 26)]), settings)
    path = api.write_report(one, tmp_path / "run", settings)
    made = json.loads(Path(path).read_text())
    assert made["updated_at"]["status"] == "absent" and made["run"]["sampling"] == {"type": "always", "settings": {}} and made["run"]["reducers"][1]["settings"]["bins"] == 4
    assert made["coverage"]["temporal_series"] == 13 and made["coverage"]["histograms"] == 1 and made["coverage"]["samples_observed"] == 25
    index = (tmp_path / "run" / "index.md").read_text()
    assert "Activation Scale Drift" in index and len(index) < 10_000
    with pytest.raises(D.RunExistsError):
        api.write_report(one, tmp_path / "run", settings)
    api.write_report(one, tmp_path / "run", settings, fresh=False, details=True)
    lines = [json.loads(x) for f in sorted((tmp_path / "run" / "details.json" / "series").glob("part-*.json")) for x in f.read_text().splitlines()]
    assert [x["metric"] for x in lines] == sorted(x["metric"] for x in lines) and len(lines) == 13
    with pytest.raises(ValueError):
        api.Settings(every=2, sampler=F.lit(True))


def test_size_does_not_grow_with_samples(spark):
    size = [D.json_bytes(report.build_report(api.analyze(tensors(spark, [[1, 2, 3]] * n)).series)) for n in (25, 250)]
    assert size[1] - size[0] < 2_000


def test_one_sample_is_observed(spark, tmp_path):
    """The only sample has number 0."""
    one = api.analyze(tensors(spark, [[1, 2]]))
    assert json.loads(Path(api.write_report(one, tmp_path / "run")).read_text())["coverage"]["samples_observed"] == 1


def test_times_are_compared_as_instants(spark):
    rows = [(0, 3, "2024-01-01T00:00:00Z", False), (1, 3, "2024-01-01T00:00:00.5Z", True), (2, 3, "2024-01-01T01:00:00+02:00", False)]
    ranks = spark.createDataFrame(rows, "rank int, world_size int, updated_at string, truncated boolean")
    assert merge.rank_coverage(ranks).first()["updated_at"] == "2024-01-01T00:00:00.5Z"
    for bad in ("x", "2024-01-01", "2024-01-01T00:00:00", "2024-13-01T00:00:00Z"):
        with pytest.raises(Exception, match="no time with a zone"):
            merge.rank_coverage(ranks.withColumn("updated_at", F.lit(bad))).collect()
    text = spark.createDataFrame([("2024-02-29T23:59:59.25+01:00",), ("1969-12-31T23:59:59Z",), (None,)], "t string")
    assert [r[0] for r in text.select(time_text(parsed_time(F.col("t")))).collect()] == ["2024-02-29T22:59:59.250000Z", "1969-12-31T23:59:59.000000Z", None]
