import random

import pytest
from pyspark.sql import functions as F

from helpers import same, tensors, values
from tidemark import api
from tidemark.model import IndicatorConfig
from tidemark.operators import long_series
from tidemark.operators.indicators import POINTS, names, series_of
from test_indicators import CASES

MORE = {
    "long": [random.Random(i).gauss(3 + (i > 300) * 4, 1) for i in range(700)], "far": [5.0 + 1e-6 * (i % 3) for i in range(80)] + [1e9 + i for i in range(80)],
    "falling": [-float(i * i) for i in range(120)], "steps": [float(i // 40) for i in range(200)],
}


def union(spark, cases):
    df = None
    for name, numbers in cases.items():
        one = values(spark, numbers, module=name)
        df = one if df is None else df.unionByName(one)
    return df


def assert_equal(found, want, config=IndicatorConfig(), keys="module"):
    found, want = ({r[keys]: r for r in rows} for rows in (found.collect(), want.collect()))
    assert found.keys() == want.keys()
    for module, r in want.items():
        for c in (*names(config), "count", "warmup_complete"):
            assert same(found[module][c], r[c], 1e-7), (module, c, found[module][c], r[c])
        for p in POINTS:
            assert found[module][p] == r[p], (module, p)


@pytest.mark.parametrize("segments", [1, 13, 60])
def test_segments_agree_with_windows(spark, segments):
    rows = union(spark, CASES | MORE)
    at = F.concat(F.lit("t"), F.col("sample_id").cast("string"))
    assert_equal(long_series.long_series_of(rows, timestamp=at, segments=segments), series_of(rows, timestamp=at))


def test_other_configurations_and_random_cuts(spark):
    config = IndicatorConfig(recent_window=3, momentum_horizons=(2, 7), cusum_allowance=0.1, fast_ema_alpha=1.0)
    cases = {f"case{s}": [random.Random(s * 1000 + i).choice([0.0, 1.0, 1.5, -2.0]) for i in range(random.Random(s).randint(1, 150))] for s in range(8)}
    rows = union(spark, cases)
    assert_equal(long_series.long_series_of(rows, config, segments=random.Random(5).randint(10, 40)), series_of(rows, config), config)


def test_a_series_with_most_rows_lies_in_many_partitions(spark):
    rows = union(spark, {"hot": [float(i % 17) for i in range(4000)], "small": [1.0, 2.0]})
    sizes = [r["count"] for r in long_series.cut(rows, segments=16).groupBy("segment").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 800


def test_nulls_nonfinite_values_null_keys_and_empty_tables(spark):
    odd = values(spark, [1, 2, 3, 5, 8]).unionByName(values(spark, [float("nan"), float("inf")]).withColumn("event_seq", F.col("event_seq") + 9))
    odd = odd.unionByName(values(spark, [7]).withColumn("value", F.lit(None).cast("double")))
    odd = odd.unionByName(odd.withColumn("module", F.lit(None).cast("string")))
    found = long_series.long_series_of(odd, segments=5).collect()
    assert [(r["count"], r["mean"]) for r in found] == [(5, 3.8)] * 2 and {r["module"] for r in found} == {None, ""}
    assert long_series.long_series_of(odd.limit(0), segments=5).count() == 0


def test_only_long_series_are_cut(spark, monkeypatch):
    rows = union(spark, MORE | {"few": [1.0, 2.0, 4.0]})
    cut = []
    real = long_series.cut
    monkeypatch.setattr(long_series, "cut", lambda v, *a: cut.append(v) or real(v, *a))
    assert_equal(long_series.series_of_any(rows, longest=200, segments=9), series_of(rows))
    assert {r["module"] for r in cut[0].select("module").distinct().collect()} == {"long", "steps"}
    cut.clear()
    assert_equal(long_series.series_of_any(rows), series_of(rows))
    assert not cut


def test_an_analysis_cuts_long_series(spark):
    df = tensors(spark, [[i, -i, 2 * i] for i in range(1, 26)])
    want = api.analyze(df).series
    for longest in (25, 26):
        assert_equal(api.analyze(df, api.Settings(long_series=longest)).series, want, keys="metric")
    with pytest.raises(ValueError):
        api.Settings(long_series=0)
