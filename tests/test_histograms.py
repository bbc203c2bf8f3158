import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import tensors
from tidemark import api
from tidemark.model import PATH, HistogramConfig
from tidemark.operators import histograms as H
from tidemark.sinks.dashboards import flat_histograms
from test_reduce import exploded

NAN, INF = float("nan"), float("inf")


def found(spark, samples, **config):
    return H.histograms(exploded(tensors(spark, samples)), HistogramConfig(**config))


def counted(x, edges):
    """The histogram by plain Python."""
    good = [v for v in x if math.isfinite(v)]
    last = len(edges) - 2
    counts = [sum(edges[i] <= v < edges[i + 1] or i == last and v == edges[-1] for v in good) for i in range(last + 1)]
    return counts, len(good), len(x) - len(good), sum(v < edges[0] for v in good), sum(v > edges[-1] for v in good)


@pytest.mark.parametrize("seed", range(4))
def test_fixed_edges(spark, seed):
    rng = random.Random(seed)
    x = [rng.choice([rng.uniform(-4, 9), float(rng.randint(-4, 9)), NAN, INF, 7.5, -2.5]) for _ in range(200)]
    r = found(spark, [x], bins=8, value_range=(-2.5, 7.5), every_n_samples=1).first()
    edges = [-2.5 + i * 1.25 for i in range(9)]
    good = [v for v in x if math.isfinite(v)]
    assert r["bin_edges"] == edges
    assert (r["bin_counts"], r["finite_count"], r["nonfinite_count"], r["underflow_count"], r["overflow_count"]) == counted(x, edges)
    assert (r["minimum"], r["maximum"]) == (min(good), max(good)) and math.isclose(r["sum"], math.fsum(good), abs_tol=1e-9) and math.isclose(r["sum_squares"], math.fsum(v * v for v in good))


def test_cadence_takes_the_first_sample(spark):
    assert [r["sample_id"] for r in found(spark, [[1]] * 5, bins=2, every_n_samples=2).orderBy("sample_id").collect()] == [0, 2, 4]


def test_no_finite_values(spark):
    r = found(spark, [[NAN, INF]], bins=2, every_n_samples=1).first()
    assert r["bin_edges"] is None and r["bin_counts"] is None and r["reason"] == H.NO_VALUES


def test_constant_tensors_get_padded_edges(spark):
    r = found(spark, [[10, 10]], bins=2, every_n_samples=1).first()
    assert r["bin_edges"] == [9.9, 10.0, 10.1] and sum(r["bin_counts"]) == 2


def test_every_element_is_counted_on_awkward_edges(spark):
    x = [i / 10 for i in range(-10, 31)]
    r = found(spark, [x], bins=30, value_range=(0.1, 2.2), every_n_samples=1).first()
    edges = r["bin_edges"]
    counts = [sum(edges[i] <= v < edges[i + 1] or (i == 29 and v == edges[30]) for v in x) for i in range(30)]
    assert r["bin_counts"] == counts and sum(counts) + r["underflow_count"] + r["overflow_count"] == r["finite_count"]


def test_merge_adds_up_and_fails_for_good_when_edges_change(spark):
    each = [[0.25 * i - 1.5 for i in range(k, k + 9)] for k in range(3)]
    same = found(spark, each, bins=3, value_range=(-1.5, 0.75), every_n_samples=1)
    r = H.merged(same, PATH).first()
    want = [counted(x, [-1.5, -0.75, 0.0, 0.75]) for x in each]
    assert (r["samples"], r["bin_counts"], r["finite_count"], r["reason"]) == (3, [sum(c) for c in zip(*(w[0] for w in want), strict=True)], 27, None)
    other = found(spark, [[0, 1], [10, 20], [0, 1]], bins=2, every_n_samples=1)
    r = H.merged(other, PATH).first()
    assert r["bin_counts"] is None and r["reason"] == H.EDGES_CHANGED and r["samples"] == 3
    assert H.latest(other, PATH).first()["minimum"] == 0


@pytest.mark.parametrize("bad", [{"bins": 0}, {"every_n_samples": 0}, {"value_range": (1.0, 1.0)}, {"value_range": (0.0, INF)}, {"name": " "}])
def test_configuration_is_checked(bad):
    with pytest.raises(ValueError):
        HistogramConfig(**bad)


def test_next_double(spark):
    x = [0.0, 1.0, -1.0, 2.0**29, -(2.0**29), 3.7, -3.7, 1e-300, -1e-300, 1e300, 5e-324, 8.0, -8.0, 0.1, 7.999999999999999]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", H.next_below(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in rows] == [math.nextafter(v, -INF) for v in x]


def test_buckets_of_dashboards(spark):
    x = [-9, -3, -3, -2.5, 0, 1, 2.5, 3, 40, INF]
    r = flat_histograms(found(spark, [x], bins=2, value_range=(-3.0, 3.0), every_n_samples=1), "a/b/").first()
    assert r["tag"] == "a/b/modules/@root/call_0/output/histograms/distribution"
    assert r["bucket_limits"] == [math.nextafter(-3, -INF), 0, 3, 40] and r["bucket_counts"] == [1, 3, 4, 1] and r["num"] == 9


def test_histograms_of_ones_own(spark):
    def quartiles(x):
        """A histogram of one's own: a bin between neighbouring quartiles."""
        edges = [float(x[int(q * (len(x) - 1))]) for q in (0, 0.25, 0.5, 0.75, 1)]
        return edges, [int(((x >= a) & (x < b)).sum()) for a, b in zip(edges, edges[1:], strict=False)][:-1] + [int((x >= edges[3]).sum())]

    df = tensors(spark, [[1, 2, 3, 4, 5, NAN], [NAN], [7, 7], None])
    shrinking = H.own_histograms(df, H.OwnHistogram("shrinking", lambda x: ([2.0, 1.0], [0]))).where("sample_id = 0").first()
    assert "shrink" in shrinking["reason"]
    rows = {r["sample_id"]: r for r in H.own_histograms(df, H.OwnHistogram("quartiles", quartiles)).collect()}
    assert rows[0]["bin_edges"] == [1, 2, 3, 4, 5] and rows[0]["bin_counts"] == [1, 1, 1, 2] and (rows[0]["finite_count"], rows[0]["nonfinite_count"]) == (5, 1)
    assert rows[1]["reason"] == rows[3]["reason"] == H.NO_VALUES and rows[2]["bin_counts"] == [0, 0, 0, 2]
    broken = H.own_histograms(df, H.OwnHistogram("broken", lambda x: 1 / 0, every_n_samples=2)).orderBy("sample_id").collect()
    assert [r["sample_id"] for r in broken] == [0, 2] and all("ZeroDivisionError" in r["reason"] for r in broken)
    fixed = H.histograms(exploded(df), HistogramConfig(every_n_samples=1))
    assert fixed.columns == H.own_histograms(df, H.OwnHistogram("quartiles", quartiles)).columns
    made = api.analyze(df, api.Settings(histograms=(H.OwnHistogram("quartiles", quartiles),)))
    assert made.histograms.where("reason is null").count() == 2


@pytest.mark.parametrize("config", [{"bins": 7}, {"bins": 30, "value_range": (0.1, 2.2)}])
def test_histograms_of_arrays_and_of_rows_agree(spark, config):
    rng = random.Random(6)
    samples = [[i / 10 for i in range(-10, 31)], [3, 3], [NAN, INF], [rng.gauss(0, 1) for _ in range(300)], [5, NAN, -2, 1e-9], [1e200, 2.0]]
    df, wanted = tensors(spark, samples), HistogramConfig(every_n_samples=1, **config)
    key = lambda r: {c: tuple(r[c]) if isinstance(r[c], list) else r[c] for c in r.asDict()} | {"sum": r["sum"] and round(r["sum"], 6), "sum_squares": r["sum_squares"] and round(r["sum_squares"], 6)}
    by_rows = {r["sample_id"]: key(r) for r in H.histograms(exploded(df), wanted).collect()}
    by_arrays = {r["sample_id"]: key(r) for r in H.tensor_histograms(df, wanted).collect()}
    assert by_rows == by_arrays
