"""Time-series indicators of every series, in one pass of windows over one partitioning.

All windows are partitioned by the series and ordered by event_seq, and the final aggregation groups by the same
keys, so there is one exchange and one sort. Recursions are closed forms over the window: exponential averages are
weighted sums, the variance of changes is the weighted sum of squared distances from their mean (the weight that no change has is that of the 0 which
the recursion begins with), and the one-sided
cumulative sums are random walks reflected at their running minimum.

An indicator is null where its denominator is within 1e-12 of zero, where too few values are there, or where the
result isn't finite. Null and non-finite values are no observations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import EPS, finite, only_finite, ratio
from tidemark.model import SERIES, IndicatorConfig

POINTS = ["first", "latest", "minimum", "maximum"]


def names(config: IndicatorConfig = IndicatorConfig()) -> list[str]:
    """All indicators in order."""
    fixed = [
        "mean", "standard_deviation", "root_mean_square", "coefficient_of_variation", "linear_slope_per_sample", "slope_r_squared", "fast_ema", "slow_ema", "fast_slow_gap",
        "fast_slow_relative_gap", "exponentially_weighted_change_mean", "exponentially_weighted_change_volatility", "latest_z_score", "historical_range_position",
        "maximum_drawdown", "maximum_runup", "up_down_balance", "cusum_positive", "cusum_negative", "cusum_change_score", "lag1_autocorrelation", "oscillation_fraction",
        "consecutive_increases", "consecutive_decreases",
    ]
    return [*fixed, *(f"momentum_{h}_samples" for h in config.momentum_horizons), *(f"relative_momentum_{h}_samples" for h in config.momentum_horizons)]


def weight(alpha: float, first: bool) -> Column:
    """Weight of the value i of n: the first one carries what the recursion was seeded with."""
    left = F.pow(F.lit(1.0 - alpha), (F.col("n") - 1 - F.col("i")).cast("double"))
    return F.when(F.col("i") == 0, left if first else F.lit(0.0)).otherwise(left * alpha)


def steps(values: DataFrame, config: IndicatorConfig = IndicatorConfig(), keys: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """The observations of every series with their place, change, standardized distance from what was before, and walks."""
    part = Window.partitionBy(*keys)
    w = part.orderBy("event_seq")
    run, prev = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    x = F.col("x")
    out = values.withColumn("x", F.col("value").cast("double")).where(finite(F.col("x")))
    out = out.withColumns(
        {
            "i": F.row_number().over(w).cast("long") - 1,
            "n": F.count(F.lit(1)).over(part),
            "p": F.lag("x").over(w),
            "mean_before": F.avg("x").over(prev),
            "std_before": F.stddev_pop("x").over(prev),
            "high": F.max("x").over(run),
            "low": F.min("x").over(run),
            **{f"lag_{h}": F.lag("x", h).over(w) for h in config.momentum_horizons},
        }
    )
    # The exponential mean of all changes, known to every row of the series, so that their variance needs no difference of squares.
    out = out.withColumn("change", F.sum(F.coalesce(weight(config.change_volatility_alpha, False) * (x - F.col("p")), F.lit(0.0))).over(part))
    z = F.when(F.col("std_before") > EPS, (x - F.col("mean_before")) / F.col("std_before"))
    out = out.withColumns({"d": x - F.col("p"), "z": z})
    recent = F.col("i") >= F.greatest(F.col("n") - config.pairs, F.lit(1))
    # Changes are counted as recent by the window of recent values that the signs come from.
    turns = F.col("i") >= F.greatest(F.col("n") - config.recent_window, F.lit(1))
    k = F.lit(config.cusum_allowance)
    sign = F.when((F.col("d") != 0) & turns, F.signum("d"))
    out = out.withColumns(
        {
            "recent": recent,
            "sign": sign,
            "sign_before": F.last(sign, ignorenulls=True).over(prev),
            "up": F.sum(F.coalesce(F.col("z") - k, F.lit(0.0))).over(run),
            "down": F.sum(F.coalesce(-F.col("z") - k, F.lit(0.0))).over(run),
        }
    )
    reflected = lambda c: F.col(c) - F.least(F.lit(0.0), F.min(c).over(run))
    return out.withColumns({"cusum_up": reflected("up"), "cusum_down": reflected("down")})


def series_of(values: DataFrame, config: IndicatorConfig = IndicatorConfig(), keys: Sequence[str] = tuple(SERIES), timestamp: Column | None = None) -> DataFrame:
    """keys, count, warmup_complete, first, latest, minimum, maximum (points), and the indicators: one row a series.

    values: keys, event_seq, sample_id, value. timestamp: text of an observation's time, for the points.
    """
    point = F.struct(F.col("x").alias("value"), F.col("sample_id"), (F.lit(None).cast("string") if timestamp is None else timestamp).alias("timestamp"))
    s = steps(values, config, keys)
    x, d, i, n = F.col("x"), F.col("d"), F.col("i"), F.col("n")
    last = lambda c: F.max(F.when(i == n - 1, c))  # noqa: E731  the value of the last observation
    ew = lambda alpha, c, first=False: F.sum(F.coalesce(weight(alpha, first) * c, F.lit(0.0)))
    recent = F.col("recent")
    a = {
        "count": F.count(F.lit(1)),
        "first": F.min_by(point, i), "latest": F.max_by(point, i), "minimum": F.min_by(point, F.struct(x, i)), "maximum": F.max_by(point, F.struct(x, -i)),
        "mean": F.avg("x"), "standard_deviation": F.stddev_pop("x"), "_square": F.avg(x * x),
        "_slope": F.regr_slope("x", F.col("sample_id").cast("double")), "_sxx": F.regr_sxx("x", F.col("sample_id").cast("double")), "_syy": F.regr_syy("x", F.col("sample_id").cast("double")), "_sxy": F.regr_sxy("x", F.col("sample_id").cast("double")),
        "fast_ema": ew(config.fast_ema_alpha, x, True), "slow_ema": ew(config.slow_ema_alpha, x, True),
        "_change": F.max("change"), "_change2": ew(config.change_volatility_alpha, (d - F.col("change")) * (d - F.col("change"))), "_gain": ew(config.change_volatility_alpha, F.greatest(d, F.lit(0.0))), "_loss": ew(config.change_volatility_alpha, F.greatest(-d, F.lit(0.0))),
        "latest_z_score": last(F.col("z")), "maximum_drawdown": F.max(F.col("high") - x), "maximum_runup": F.max(x - F.col("low")),
        "cusum_positive": last(F.col("cusum_up")), "cusum_negative": last(F.col("cusum_down")),
        "_pairs": F.count_if(recent), "_cov": F.covar_pop(F.when(recent, F.col("p")), F.when(recent, x)), "_vp": F.var_pop(F.when(recent, F.col("p"))), "_vx": F.var_pop(F.when(recent, x)),
        "oscillation_fraction": F.avg(F.when(F.col("sign").isNotNull() & F.col("sign_before").isNotNull(), (F.col("sign") != F.col("sign_before")).cast("double"))),
        "_not_up": F.max(F.when(d <= 0, i)), "_not_down": F.max(F.when(d >= 0, i)),
        **{f"_lag_{h}": last(F.col(f"lag_{h}")) for h in config.momentum_horizons},
    }
    return finished(s.groupBy(*keys).agg(*(c.alias(name) for name, c in a.items())), config, keys)


def finished(out: DataFrame, config: IndicatorConfig = IndicatorConfig(), keys: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """The indicators from the aggregates of every series, one row each; long_series makes the same aggregates."""
    c = F.col
    latest = c("latest")["value"]
    spread = c("maximum")["value"] - c("minimum")["value"]
    root = F.sqrt(c("_vp") * c("_pairs") * c("_vx") * c("_pairs"))
    balance = ratio(c("_gain") - c("_loss"), c("_gain") + c("_loss"))
    made = {
        "root_mean_square": F.sqrt("_square"),
        "coefficient_of_variation": ratio(c("standard_deviation"), F.abs("mean")),
        "linear_slope_per_sample": F.when(c("_sxx") > EPS, c("_slope")),
        "slope_r_squared": F.when(c("_sxx") * c("_syy") > EPS, F.least(c("_sxy") * c("_sxy") / (c("_sxx") * c("_syy")), F.lit(1.0))),
        "fast_slow_gap": c("fast_ema") - c("slow_ema"),
        "fast_slow_relative_gap": ratio(c("fast_ema") - c("slow_ema"), F.abs("slow_ema")),
        "exponentially_weighted_change_mean": c("_change"),
        "exponentially_weighted_change_volatility": F.sqrt(c("_change2") + F.pow(F.lit(1.0 - config.change_volatility_alpha), (c("count") - 1).cast("double")) * c("_change") * c("_change")),
        "historical_range_position": ratio(latest - c("minimum")["value"], spread),
        "up_down_balance": balance,
        "cusum_change_score": F.greatest("cusum_positive", "cusum_negative"),
        "lag1_autocorrelation": F.when((c("count") >= 3) & (root > EPS), c("_cov") * c("_pairs") / root),
        "consecutive_increases": (c("count") - 1 - F.coalesce(c("_not_up"), F.lit(0))).cast("long"),
        "consecutive_decreases": (c("count") - 1 - F.coalesce(c("_not_down"), F.lit(0))).cast("long"),
        **{f"momentum_{h}_samples": latest - c(f"_lag_{h}") for h in config.momentum_horizons},
        **{f"relative_momentum_{h}_samples": ratio(latest - c(f"_lag_{h}"), F.abs(f"_lag_{h}")) for h in config.momentum_horizons},
    }
    out = out.withColumns({k: v if k.startswith("consecutive") else only_finite(v) for k, v in made.items()})
    out = out.withColumn("warmup_complete", c("count") >= config.warm_at)
    return out.select(*keys, "count", "warmup_complete", *POINTS, *names(config))


def indicator_map(series: DataFrame, config: IndicatorConfig = IndicatorConfig()) -> DataFrame:
    """series with the map of the indicators that are there."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, names(config))), F.array(*(F.col(n).cast("double") for n in names(config))))
    return series.withColumn("indicators", F.map_filter(pairs, lambda k, v: v.isNotNull()))
