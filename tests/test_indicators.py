import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import same, values
from tidemark.model import IndicatorConfig
from tidemark.operators.indicators import indicator_map, names, series_of
from tidemark.streaming.live import begin, fold, summary

CASES = {
    "line": list(range(1, 26)), "alternating": [1, 2] * 12 + [1], "constant": [3.0] * 30, "one": [7.0], "two": [1.0, 4.0], "plateau": [1, 1, 2, 2, 2, 5, 5, 1, 1, 1],
    "walk": [round(random.Random(1).gauss(0, 1), 2) for _ in range(3)] + [random.Random(i).gauss(5 + (i > 40), 1) for i in range(90)], "ties": [random.Random(i).randint(0, 2) for i in range(60)], "zero": [0.0] * 5,
}


def by_fold(numbers, config):
    s = begin(float(numbers[0]), 0)
    for i, x in enumerate(numbers[1:], 1):
        fold(s, float(x), i, config)
    return summary(s, config)


@pytest.fixture(scope="module")
def rows(spark):
    df = None
    for name, numbers in CASES.items():
        one = values(spark, numbers, module=name)
        df = one if df is None else df.unionByName(one)
    return {r["module"]: r for r in series_of(df).collect()}


def test_a_line(rows):
    r = rows["line"]
    assert (r["count"], r["warmup_complete"], r["first"]["value"], r["latest"]["value"], r["mean"]) == (25, True, 1, 25, 13)
    assert same(r["standard_deviation"], math.sqrt(52)) and same(r["linear_slope_per_sample"], 1) and same(r["slope_r_squared"], 1)
    assert (r["momentum_5_samples"], r["relative_momentum_5_samples"], r["consecutive_increases"], r["maximum_drawdown"], r["maximum_runup"], r["oscillation_fraction"]) == (5, 0.25, 24, 0, 24, 0)
    assert same(r["lag1_autocorrelation"], 1)


def test_alternation(rows):
    r = rows["alternating"]
    assert abs(r["linear_slope_per_sample"]) < 0.01 and same(r["lag1_autocorrelation"], -1) and r["oscillation_fraction"] == 1 and r["consecutive_increases"] == 0


@pytest.mark.parametrize("name", list(CASES))
def test_windows_agree_with_the_fold(rows, name):
    config = IndicatorConfig()
    want = by_fold(CASES[name], config)
    for n in names(config):
        assert same(rows[name][n], want[n], 1e-7), (n, rows[name][n], want[n])
    for p in ("first", "latest", "minimum", "maximum"):
        assert (rows[name][p]["value"], rows[name][p]["sample_id"]) == (want[p]["value"], want[p]["sample_id"]), p


def test_extremes_keep_the_earliest_sample(rows):
    assert rows["plateau"]["minimum"]["sample_id"] == 0 and rows["plateau"]["maximum"]["sample_id"] == 5


def test_null_and_nonfinite_values_are_no_observations(spark):
    df = values(spark, [1, 2, 3]).unionByName(values(spark, [float("nan"), float("inf")]).withColumn("event_seq", F.col("event_seq") + 5))
    assert series_of(df).first()["count"] == 3
    assert series_of(values(spark, [1]).limit(0)).count() == 0


def test_map_holds_only_what_is_there(spark):
    found = indicator_map(series_of(values(spark, [7.0]))).first()["indicators"]
    assert "latest_z_score" not in found and found["mean"] == 7


@pytest.mark.parametrize("bad", [{"fast_ema_alpha": 0}, {"slow_ema_alpha": 1.5}, {"change_volatility_alpha": True}, {"momentum_horizons": ()}, {"momentum_horizons": (0,)}, {"momentum_horizons": (1, 1)}, {"momentum_horizons": (True,)}, {"momentum_horizons": (1.5,)}, {"max_series": 0}, {"recent_window": True}, {"cusum_allowance": -1}, {"temporal_metrics": ("mean", "mean")}])
def test_configuration_is_checked(bad):
    with pytest.raises(ValueError):
        IndicatorConfig(**bad)
