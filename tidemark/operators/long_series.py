"""Indicators of series too long for one task: a prefix scan over segments in two levels.

cut() deals the observations out by ranges of (series, event_seq), so a long series lies in many partitions and each of its parts, a
segment, is one run in order. The first level looks at each segment alone. What it needs of all that came before is carried in by windows over the
segments, of which a series has at most as many as there are partitions: the number, mean and squared deviations of the values before (merged by
pairs, so nothing cancels), their extremes, and the last value. The second level adds up. Averages are weighted sums whose weights need only
the place from the end; the variance of changes is one within segments and one between them; a one-sided cumulative sum is for a segment
the function c -> max(c + total, total - lowest), composed in order.

The result is that of indicators.series_of, but for the order of additions. Null and non-finite values are no observations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import EPS, finite
from tidemark.model import SERIES, IndicatorConfig
from tidemark.operators.indicators import finished, series_of, weight
from tidemark.sources.tables import scratch

#: From so many observations on a series is cut by series_of_any: what one task sorts without trouble.
LONG = 1 << 20


def cut(values: DataFrame, keys: Sequence[str] = tuple(SERIES), timestamp: Column | None = None, segments: int | None = None) -> DataFrame:
    """_key (the keys), segment, event_seq, sample_id, timestamp, x of the finite values: written once, as the bounds of the ranges come from a sample.

    segments: partitions that all series share, by default the session's shuffle partitions. The table lies in the shared folder (sources.tables.scratch).
    """
    spark = values.sparkSession
    x = F.col("value").cast("double")
    at = F.lit(None).cast("string") if timestamp is None else timestamp
    # A struct is compared with its nulls, so series with null keys are joined like all others.
    rows = values.where(finite(x)).select(F.struct(*keys).alias("_key"), "event_seq", "sample_id", at.alias("timestamp"), x.alias("x"))
    parts = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch(spark, "segments")
    rows.repartitionByRange(parts, "_key", "event_seq").withColumn("segment", F.spark_partition_id()).write.parquet(folder)
    return spark.read.parquet(folder)


def carried(segments: DataFrame) -> DataFrame:
    """_key, segment, size, n (of the whole series), and what comes before the segment: n0, mean0, squares0, high0, low0, last0."""
    x, part = F.col("x"), Window.partitionBy("_key")
    before = part.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    each = segments.groupBy("_key", "segment").agg(
        F.count(F.lit(1)).alias("size"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"), F.max("x").alias("high"), F.min("x").alias("low"), F.max_by(x, "event_seq").alias("last")
    )
    each = each.withColumns({"n0": F.coalesce(F.sum("size").over(before), F.lit(0)), "mean0": F.sum(F.col("size") * F.col("mean")).over(before) / F.sum("size").over(before), "n": F.sum("size").over(part)})
    gap = F.col("mean") - F.col("mean0")
    added = F.col("variance") * F.col("size") + F.coalesce(gap * gap * F.col("size") * F.col("n0") / (F.col("n0") + F.col("size")), F.lit(0.0))
    found = {"squares0": F.sum(added).over(before), "high0": F.max("high").over(before), "low0": F.min("low").over(before), "last0": F.lag("last").over(part.orderBy("segment"))}
    return each.withColumns(found).select("_key", "segment", "size", "n", "n0", "mean0", *found)


def _steps(segments: DataFrame, config: IndicatorConfig) -> DataFrame:
    """Every observation with its place, change and distance from what was before in the whole series, and the walks of its segment."""
    part = Window.partitionBy("_key", "segment")
    w = part.orderBy("event_seq")
    run, prev = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    x, k, n0 = F.col("x"), F.col("k"), F.col("n0")
    local = segments.withColumns(
        {"k": F.row_number().over(w).cast("long") - 1, "p": F.lag("x").over(w), "mean_here": F.avg("x").over(prev), "variance_here": F.var_pop("x").over(prev), "high": F.max("x").over(run), "low": F.min("x").over(run)}
    )
    # The windows above and below and this join share one exchange by (_key, segment).
    out = local.join(carried(segments), ["_key", "segment"])
    gap = F.col("mean_here") - F.col("mean0")
    mean = F.when(n0 == 0, F.col("mean_here")).when(k == 0, F.col("mean0")).otherwise(F.col("mean0") + gap * k / (n0 + k))
    both = F.col("squares0") + F.col("variance_here") * k + gap * gap * n0 * k / (n0 + k)
    deviation = F.sqrt(F.when(n0 == 0, F.col("variance_here")).when(k == 0, F.col("squares0") / n0).otherwise(both / (n0 + k)))
    out = out.withColumns({"i": n0 + k, "p": F.coalesce("p", "last0"), "mean_before": mean, "std_before": deviation, "high": F.greatest("high", "high0"), "low": F.least("low", "low0")})
    out = out.withColumns({"d": x - F.col("p"), "z": F.when(F.col("std_before") > EPS, (x - F.col("mean_before")) / F.col("std_before")), "w": weight(config.change_volatility_alpha, False)})
    allowance = F.lit(config.cusum_allowance)
    out = out.withColumns(
        {
            "up": F.sum(F.coalesce(F.col("z") - allowance, F.lit(0.0))).over(run), "down": F.sum(F.coalesce(-F.col("z") - allowance, F.lit(0.0))).over(run),
            "weights": F.sum(F.when(F.col("d").isNotNull(), F.col("w"))).over(part), "weighted": F.sum(F.col("w") * F.col("d")).over(part),
        }
    )
    away = F.col("d") - F.when(F.col("weights") > 0, F.col("weighted") / F.col("weights")).otherwise(0.0)
    return out.withColumns({"up_low": F.min("up").over(run), "down_low": F.min("down").over(run), "spread": F.sum(F.coalesce(F.col("w") * away * away, F.lit(0.0))).over(part)})


def _moment(pairs: Column, a: str, b: str) -> Column:
    """The mean product of the deviations of two fields of an array of structs; null if it is empty."""
    mean = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, e: s + e[f]) / F.size(pairs)
    return F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0.0), lambda s, e: s + (e[a] - mean(a)) * (e[b] - mean(b))) / F.size(pairs))


def _reflected(total: str, lowest: str) -> Column:
    """The cumulative sum at the end of the series: the segments' functions composed in order."""
    return F.aggregate("_pieces", F.lit(0.0), lambda c, s: F.greatest(c + s[total], s[total] - s[lowest]))


def long_series_of(values: DataFrame, config: IndicatorConfig = IndicatorConfig(), keys: Sequence[str] = tuple(SERIES), timestamp: Column | None = None, segments: int | None = None) -> DataFrame:
    """indicators.series_of with every series over many tasks.

    What is brought together of one series is a row for each of its segments, at most `segments`, and its last config.pairs + 1 values.
    """
    x, i, n, d = F.col("x"), F.col("i"), F.col("n"), F.col("d")
    point = F.struct(x.alias("value"), F.col("sample_id"), F.col("timestamp"))
    last = lambda c: F.max(F.when(i == n - 1, c))
    ew = lambda alpha, c, first=False: F.sum(F.coalesce(weight(alpha, first) * c, F.lit(0.0)))
    sample, alpha = F.col("sample_id").cast("double"), config.change_volatility_alpha
    piece = F.struct("segment", "up", "up_low", "down", "down_low", F.coalesce("weights", F.lit(0.0)).alias("weights"), F.coalesce("weighted", F.lit(0.0)).alias("weighted"), "spread")
    a = {
        "count": F.count(F.lit(1)),
        "first": F.min_by(point, i), "latest": F.max_by(point, i), "minimum": F.min_by(point, F.struct(x, i)), "maximum": F.max_by(point, F.struct(x, -i)),
        "mean": F.avg("x"), "standard_deviation": F.stddev_pop("x"), "_square": F.avg(x * x),
        "_slope": F.regr_slope("x", sample), "_sxx": F.regr_sxx("x", sample), "_syy": F.regr_syy("x", sample), "_sxy": F.regr_sxy("x", sample),
        "fast_ema": ew(config.fast_ema_alpha, x, True), "slow_ema": ew(config.slow_ema_alpha, x, True),
        "_gain": ew(alpha, F.greatest(d, F.lit(0.0))), "_loss": ew(alpha, F.greatest(-d, F.lit(0.0))),
        "latest_z_score": last(F.col("z")), "maximum_drawdown": F.max(F.col("high") - x), "maximum_runup": F.max(x - F.col("low")),
        "_not_up": F.max(F.when(d <= 0, i)), "_not_down": F.max(F.when(d >= 0, i)),
        **{f"_lag_{h}": F.max(F.when(i == n - 1 - h, x)) for h in config.momentum_horizons},
        "_pieces": F.sort_array(F.collect_list(F.when(F.col("k") == F.col("size") - 1, piece))),
        "_tail": F.sort_array(F.collect_list(F.when(i >= n - 1 - config.pairs, F.struct(i.alias("i"), d.alias("d"), F.col("p").alias("p"), x.alias("x"))))),
    }
    out = _steps(cut(values, keys, timestamp, segments), config).groupBy("_key").agg(*(c.alias(name) for name, c in a.items()))
    change = F.aggregate("_pieces", F.lit(0.0), lambda c, s: c + s["weighted"])
    out = out.withColumns({"_change": change, "_recent": F.filter("_tail", lambda e: e["i"] >= F.greatest(F.col("count") - config.pairs, F.lit(1)))})
    between = lambda s: F.when(s["weights"] > 0, s["weights"] * F.pow(s["weighted"] / s["weights"] - F.col("_change"), F.lit(2.0))).otherwise(0.0)
    turns = F.filter("_tail", lambda e: (e["i"] >= F.greatest(F.col("count") - config.recent_window, F.lit(1))) & (e["d"] != 0))
    out = out.withColumns(
        {
            "_change2": F.aggregate("_pieces", F.lit(0.0), lambda c, s: c + s["spread"] + between(s)),
            "cusum_positive": _reflected("up", "up_low"), "cusum_negative": _reflected("down", "down_low"),
            "_pairs": F.size("_recent"), "_cov": _moment(F.col("_recent"), "p", "x"), "_vp": _moment(F.col("_recent"), "p", "p"), "_vx": _moment(F.col("_recent"), "x", "x"),
            "_signs": F.transform(turns, lambda e: F.signum(e["d"])),
        }
    )
    signs, steps = F.col("_signs"), F.size("_signs") - 1
    turned = F.zip_with(F.slice(signs, 1, F.greatest(steps, F.lit(0))), F.slice(signs, 2, F.greatest(steps, F.lit(0))), lambda a, b: (a != b).cast("double"))
    out = out.withColumn("oscillation_fraction", F.when(steps > 0, F.aggregate(turned, F.lit(0.0), lambda s, e: s + e) / steps))
    return finished(out.select("_key.*", *[c for c in out.columns if c != "_key"]), config, keys)


def series_of_any(values: DataFrame, config: IndicatorConfig = IndicatorConfig(), keys: Sequence[str] = tuple(SERIES), timestamp: Column | None = None, longest: int = LONG, segments: int | None = None) -> DataFrame:
    """indicators.series_of, where series with `longest` observations or more are cut into segments.

    Counts the observations of each series first; values is read once more if there is a long one. Both ways give the same results.
    """
    key = F.struct(*keys)
    long = values.where(F.col("value").isNotNull()).groupBy(key.alias("_long")).agg(F.count(F.lit(1)).alias("_count")).where(F.col("_count") >= longest).select("_long").persist()
    try:
        if long.isEmpty():
            return series_of(values, config, keys, timestamp)
        named = values.withColumn("_key", key)
        hot = named.join(long, named["_key"] == long["_long"], "left_semi").drop("_key")
        rest = named.join(long, named["_key"] == long["_long"], "left_anti").drop("_key")
        return series_of(rest, config, keys, timestamp).unionByName(long_series_of(hot, config, keys, timestamp, segments))
    finally:
        long.unpersist()
