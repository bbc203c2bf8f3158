import json
import math
import random
import warnings

import pytest
from pyspark.sql import functions as F

from helpers import same, tensors
from tidemark import api
from tidemark.model import METRICS
from tidemark.operators import caps
from tidemark.operators.reduce import combine, default_reducer, long_form, reasons, reduce_rows, reduce_tensors, reduce_with_errors, reducer

NAN, INF = float("nan"), float("inf")
#: Statistics that are elements or counts, so that every way gives the same bits.
EXACT = ["minimum", "maximum", "max_abs", "finite_fraction", "zero_fraction", "negative_fraction", "positive_fraction", "p01", "p05", "p25", "median", "p75", "p95", "p99", "p999", "p99_abs", "p999_abs"]


def exploded(df):
    return df.select(*[c for c in df.columns if c != "elements"], F.explode("elements").alias("value"))


def expected(elements):
    """The profile by plain Python."""
    x = [v for v in elements if math.isfinite(v)]
    n, k = len(elements), len(x)
    out = dict.fromkeys(METRICS)
    if not n:
        return out
    out |= {"finite_fraction": k / n, "zero_fraction": sum(v == 0 for v in elements) / n, "negative_fraction": sum(v < 0 for v in x) / n, "positive_fraction": sum(v > 0 for v in x) / n}
    if not k:
        return out
    mean, size = sum(x) / k, sorted(abs(v) for v in x)
    central = lambda p: sum((v - mean) ** p for v in x) / k
    sd, rms, total = math.sqrt(central(2)), math.sqrt(sum(v * v for v in x) / k), sum(size)

    def quantile(v, q):
        v, at = sorted(v), (len(v) - 1) * q
        low = int(at)
        return v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low)

    out |= {"mean": mean, "std": sd, "rms": rms, "minimum": min(x), "maximum": max(x), "mean_abs": total / k, "l1_norm": total, "l2_norm": math.sqrt(sum(v * v for v in x)), "max_abs": size[-1]}
    for name, q in {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p999": 0.999}.items():
        out[name] = quantile(x, q)
    out |= {"p99_abs": quantile(size, 0.99), "p999_abs": quantile(size, 0.999), "interquartile_range": out["p75"] - out["p25"], "central_98_range": out["p99"] - out["p01"]}
    if sd > 0:
        out |= {"skewness": central(3) / sd**3, "excess_kurtosis": central(4) / sd**4 - 3, "tail_fraction_beyond_3_std": sum(abs(v - mean) > 3 * sd for v in x) / k}
    if rms > 0:
        out |= {"max_to_rms": size[-1] / rms, "p99_abs_to_rms": out["p99_abs"] / rms, "p999_abs_to_rms": out["p999_abs"] / rms}
        h = -sum(v / total * math.log(v / total) for v in size if v)
        out |= {"normalized_magnitude_entropy": h / math.log(max(k, 2)), "effective_magnitude_support_fraction": math.exp(h) / k}
    return out


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    return [[2, 7], [-3e38], [5, 5, -2, -2, 5], [0.25] * 5 + [4.0], [INF, 6, NAN, NAN], [8, 15], [0, 0, 0], [NAN, NAN], [5], [0.0, 1.0, -2.0, NAN, -INF, 0.0], [rng.gauss(0, 1) for _ in range(400)]]


def test_both_forms_agree_with_plain_python(spark, cases):
    df = tensors(spark, cases)
    for found in (reduce_tensors(df), reduce_rows(exploded(df))):
        rows = {r["sample_id"]: r for r in found.collect()}
        for i, elements in enumerate(cases):
            for name, value in expected([float(e) for e in elements]).items():
                assert same(rows[i][name], value, 1e-7), (i, name, rows[i][name], value)


def test_hot_tensors_are_profiled_without_putting_them_together(spark, cases, monkeypatch):
    """Every tensor is hot, and its runs are short: selection by bits gives the same quantiles, tails and moments."""
    monkeypatch.setattr("tidemark.operators.selection.GATHERED", 7)
    df = exploded(tensors(spark, [*cases, [0.0, -0.0, -1e-310, 1e-310, 1e300, -1e300], [1.5] * 60 + [NAN], [math.ldexp(1 + i * 2.0**-52, -3) for i in range(40)]])).repartition(6)
    want = {r["sample_id"]: r for r in reduce_rows(df).collect()}
    got = {r["sample_id"]: r for r in reduce_rows(df, hot=1).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        for name in EXACT if i == max(got) else METRICS:  # of neighbouring doubles only these have digits
            assert same(r[name], want[i][name], 0.0 if name in EXACT else 1e-9), (i, name, r[name], want[i][name])


def test_one_hot_tensor_among_small_ones(spark):
    rows = spark.range(200_000).select(F.lit(0).alias("source_rank"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("m"), (F.col("id") % 50).cast("string"))).alias("module"), F.lit(0).alias("call_index"), F.lit("outputs").alias("signal"),
        F.lit("o").alias("tensor_path"), F.lit(0).cast("long").alias("event_seq"), F.lit(None).cast("long").alias("sample_id"), F.sin(F.col("id") * 0.37).alias("value"))
    names = ["median", "p999", "p99_abs", "tail_fraction_beyond_3_std", "std"]
    found = {r["module"]: r for r in reduce_rows(rows, names, hot=20_000).collect()}
    plain = {r["module"]: r for r in rows.groupBy("module").agg(F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.999).alias("p999"), F.percentile(F.abs("value"), 0.99).alias("p99_abs"), F.stddev_pop("value").alias("std")).collect()}
    assert set(found) == set(plain) and len(found) == 51
    for m, r in plain.items():
        assert all(same(found[m][n], r[n], 1e-12) for n in ("median", "p999", "p99_abs", "std")) and found[m]["tail_fraction_beyond_3_std"] == 0


def test_empty_and_null_tensors_have_nothing(spark):
    for r in reduce_tensors(tensors(spark, [[], None])).collect():
        assert all(r[m] is None for m in METRICS)
    assert reduce_tensors(tensors(spark, [[1]]).limit(0)).count() == 0


def test_known_values(spark):
    r = reduce_tensors(tensors(spark, [[INF, 6, NAN, NAN]])).first()
    assert (r["mean"], r["std"], r["rms"], r["max_abs"]) == (6, 0, 6, 6) and same(r["finite_fraction"], 1 / 4)
    assert same(reduce_tensors(tensors(spark, [[8, 15]])).first()["rms"], 17 / math.sqrt(2))


def test_reducers_combine_and_refuse_repeated_names(spark):
    both = combine(reducer("mean"), reducer(spread=F.max("x") - F.min("x")))
    assert both.names == ["mean", "spread"]
    r = reduce_rows(exploded(tensors(spark, [[2, 9, NAN]])), both).first()
    assert (r["mean"], r["spread"]) == (5.5, 7)
    with pytest.raises(ValueError, match="duplicate metrics"):
        combine(reducer("mean"), reducer("mean"))
    with pytest.raises(ValueError, match="duplicate metrics"):
        reducer("rms", "rms")
    with pytest.raises(ValueError, match="unknown"):
        reducer("no such")
    assert default_reducer().names == METRICS


def test_long_form_and_reasons(spark):
    found = reduce_tensors(tensors(spark, [[NAN]]), ["mean", "finite_fraction"])
    assert [(r["metric"], r["value"]) for r in long_form(found, ["mean", "finite_fraction"]).collect()] == [("finite_fraction", 0.0)]
    r = reasons(found, ["mean", "finite_fraction"]).first()
    assert r["stats_map"] == {"finite_fraction": 0.0} and list(r["unavailable"]) == ["mean"]


def test_functions_as_statistics(spark):
    df = tensors(spark, [[3, 1, 2, NAN], [], [5]])
    what = reducer("mean", middle=lambda x: x[len(x) // 2], top=F.array_max("xs"))
    rows = {r["sample_id"]: r for r in reduce_tensors(df, what).collect()}
    assert (rows[0]["mean"], rows[0]["middle"], rows[0]["top"]) == (2, 2, 3) and rows[1]["middle"] is None and rows[2]["middle"] == 5
    rows = {r["sample_id"]: r for r in reduce_rows(exploded(df), reducer("mean", middle=lambda x: x[len(x) // 2])).collect()}
    assert rows[0]["middle"] == 2 and rows[2]["middle"] == 5


def test_failures_of_functions_have_a_channel(spark):
    import numpy as np

    def picky(x):
        if len(x) and x[0] < 0:
            raise RuntimeError("below zero")
        return x.sum()

    df = tensors(spark, [[1, 2], [-1, 5], [-3, 2], [7, NAN]])
    what = combine(reducer("mean", total=picky), reducer(many=lambda x: x, endless=lambda x: INF))
    with pytest.warns(RuntimeWarning, match="below zero"):
        stats, errors = reduce_with_errors(df, what)
    rows = {r["sample_id"]: r for r in reasons(stats, what.names).collect()}
    assert [rows[i]["total"] for i in range(4)] == [3, None, None, 7] and [rows[i]["mean"] for i in range(4)] == [1.5, 2, -0.5, 7]
    assert rows[1]["unavailable"]["total"] == "RuntimeError: below zero" and "one number" in rows[0]["unavailable"]["many"] and "finite" in rows[0]["unavailable"]["endless"] and "total" not in rows[0]["unavailable"]
    found = {(r["probe"], r["error_type"]): r["count"] for r in caps.error_summaries(errors, order="event_seq").collect()}
    assert found == {("outputs/total", "RuntimeError"): 2, ("outputs/many", "ValueError"): 4}
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        assert reduce_with_errors(df, what, policy="ignore")[1].count() == 6
    with pytest.raises(Exception, match="RuntimeError: below zero"):
        reduce_with_errors(df, reducer(total=picky), policy="raise")
    with pytest.raises(ValueError, match="policy"):
        reduce_tensors(df, what, policy="loud")
    assert np.isfinite(reduce_tensors(df, ["mean"], policy="raise").first()["mean"])


def test_failures_reach_the_report(spark, tmp_path):
    def broken(x):
        raise KeyError("no such part")

    settings = api.Settings(reducer=combine(default_reducer(), reducer(own=broken)), errors="ignore")
    found = api.analyze(tensors(spark, [[i, 1] for i in range(25)], module="a.b"), settings)
    made = json.loads(open(api.write_report(found, tmp_path / "run", settings)).read())
    assert [(e["module"], e["probe"], e["error_type"], e["message"], e["count"]) for e in made["errors"]] == [("a.b", "outputs/own", "KeyError", "'no such part'", 25)]
    assert made["coverage"]["errors_returned"] == 1 and made["coverage"]["findings_returned"] > 0
    found.release()
