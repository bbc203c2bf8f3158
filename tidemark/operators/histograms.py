"""Histograms of tensors with fixed or their own edges, and their exact merge over time.

Bins are closed on the left, the last one on both sides. Elements find their bin in the edge array itself, so that
the counts agree with the edges bit for bit. Counting is one grouped aggregation, combined before the shuffle; only
histograms with edges of their own join the tensor's range first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import finite, linspace, only_finite
from tidemark.model import TENSOR, HistogramConfig
from tidemark.operators.reduce import ragged

#: Why a histogram or its merge is not there.
NO_VALUES = "there are no finite values"
EDGES_CHANGED = "the bin edges changed between samples"


def bin_of(x: Column, edges: Column, bins: int) -> Column:
    """Number of the bin from 0; -1 below, bins above the edges. The arithmetic guess is corrected by the edges beside it."""
    lo, hi = F.get(edges, 0), F.get(edges, bins)
    guess = F.least(F.greatest(F.floor((x - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    corrected = F.when(x < F.get(edges, guess), guess - 1).when((guess < bins - 1) & (x >= F.get(edges, guess + 1)), guess + 1).otherwise(guess)
    return F.when(x < lo, -1).when(x > hi, bins).otherwise(corrected).cast("int")


def own_edges(low: Column, high: Column, bins: int) -> Column:
    """Edges over a tensor's own range; a range of no width is padded."""
    pad = F.when(high == low, F.lit(0.01) * F.greatest(F.abs(low), F.abs(high), F.lit(1.0))).otherwise(F.lit(0.0))
    return linspace(low - pad, high + pad, bins)


def histograms(rows: DataFrame, config: HistogramConfig = HistogramConfig(), keys: Sequence[str] = tuple(TENSOR), value: str = "value") -> DataFrame:
    """keys, name, bin_edges, bin_counts, the counts, minimum, maximum, sum, sum_squares and reason; one row a tensor of an eligible sample."""
    x0 = F.col(value).cast("double")
    rows = rows.where(F.col("sample_id") % config.every_n_samples == 0).select(*keys, only_finite(x0).alias("x"))
    if config.value_range is None:
        ranges = rows.groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high")).select(*(F.col(k).alias(f"r_{k}") for k in keys), own_edges(F.col("low"), F.col("high"), config.bins).alias("edges"))
        on = F.lit(True)
        for k in keys:
            on &= F.col(k).eqNullSafe(F.col(f"r_{k}"))
        rows = rows.join(ranges, on).drop(*(f"r_{k}" for k in keys))
    else:
        lo, hi = config.value_range
        rows = rows.withColumn("edges", F.array(*(F.lit(hi if i == config.bins else lo + i * (hi - lo) / config.bins) for i in range(config.bins + 1))))
    x = F.col("x")
    # One row a bin after the first aggregation, one a tensor after the second: no count a bin is held per element.
    per_bin = rows.groupBy(*keys, F.when(x.isNotNull(), bin_of(x, F.col("edges"), config.bins)).alias("bin")).agg(
        F.count(F.lit(1)).alias("c"), F.first("edges", ignorenulls=True).alias("edges"), F.min("x").alias("mn"), F.max("x").alias("mx"), F.sum("x").alias("s"), F.sum(x * x).alias("ss")
    )
    b = F.col("bin")
    whole = per_bin.groupBy(*keys).agg(
        F.first("edges", ignorenulls=True).alias("edges"), F.map_from_entries(F.collect_list(F.when(b.between(0, config.bins - 1), F.struct("bin", "c")))).alias("by_bin"),
        F.coalesce(F.sum(F.when(b.isNotNull(), F.col("c"))), F.lit(0)).alias("finite_count"), F.coalesce(F.sum(F.when(b.isNull(), F.col("c"))), F.lit(0)).alias("nonfinite_count"),
        F.coalesce(F.sum(F.when(b == -1, F.col("c"))), F.lit(0)).alias("underflow_count"), F.coalesce(F.sum(F.when(b == config.bins, F.col("c"))), F.lit(0)).alias("overflow_count"),
        F.min("mn").alias("minimum"), F.max("mx").alias("maximum"), F.sum("s").alias("sum"), F.sum("ss").alias("sum_squares"),
    )
    there = (F.col("finite_count") > 0) & finite(F.col("sum_squares"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(config.bins - 1)), lambda i: F.coalesce(F.try_element_at("by_bin", i), F.lit(0)).cast("long"))
    numbers = ["finite_count", "nonfinite_count", "underflow_count", "overflow_count"]
    return whole.select(
        *keys, F.lit(config.name).alias("name"), F.when(there, F.col("edges")).alias("bin_edges"), F.when(there, counts).alias("bin_counts"), *numbers,
        *(F.when(there, F.col(c)).alias(c) for c in ("minimum", "maximum", "sum", "sum_squares")), F.when(~there, F.lit(NO_VALUES)).alias("reason"),
    )


#: What a histogram function of one's own returns for sorted finite elements: edges and counts, or null.
Shape = Callable[[np.ndarray], tuple[Sequence[float], Sequence[int]] | None]


@dataclass(frozen=True)
class OwnHistogram:
    """A named histogram by a function of one's own, taken of every n-th sample."""

    name: str
    shape: Shape
    every_n_samples: int = 1
    kind: str = "custom"
    details: Mapping[str, object] = field(default_factory=dict)

    def settings(self) -> dict:
        return {"name": self.name, "every_n_samples": self.every_n_samples, **self.details}


def own_histograms(tensors: DataFrame, config: OwnHistogram, keys: Sequence[str] = tuple(TENSOR), elements: str = "elements") -> DataFrame:
    """The columns of histograms() by config.shape, from tensors as arrays; narrow. A shape that fails, or whose edges shrink or don't fit the counts, gives the reason."""
    rows = tensors.where(F.col("sample_id") % config.every_n_samples == 0).select(*keys, F.col(elements).cast("array<double>").alias("e"))
    numbers = ["finite_count", "nonfinite_count", "underflow_count", "overflow_count"]
    moments = ["minimum", "maximum", "sum", "sum_squares"]
    schema = T.StructType(
        [*rows.schema.fields[:-1], T.StructField("name", T.StringType()), T.StructField("bin_edges", T.ArrayType(T.DoubleType())), T.StructField("bin_counts", T.ArrayType(T.LongType()))]
        + [T.StructField(n, T.LongType()) for n in numbers] + [T.StructField(n, T.DoubleType()) for n in moments] + [T.StructField("reason", T.StringType())]
    )
    name, shape = config.name, config.shape

    def one(x: np.ndarray) -> tuple:
        good = np.sort(x[np.isfinite(x)])
        n = [len(good), len(x) - len(good), 0, 0]
        if not len(good):
            return (name, None, None, *n, *[None] * 4, NO_VALUES)
        try:
            found = shape(good)
            if found is None:
                return (name, None, None, *n, *[None] * 4, "the function gives none")
            edges, counts = [float(v) for v in found[0]], [int(v) for v in found[1]]
        except Exception as error:  # noqa: BLE001  whatever a function of one's own raises
            return (name, None, None, *n, *[None] * 4, f"{type(error).__name__}: {error}")
        if len(edges) != len(counts) + 1 or any(b < a for a, b in zip(edges, edges[1:], strict=False)):
            return (name, None, None, *n, *[None] * 4, "the function's edges shrink or don't fit its counts")
        n[2:] = [int((good < edges[0]).sum()), int((good > edges[-1]).sum())]
        squares = float((good * good).sum())
        if not np.isfinite(squares):
            return (name, None, None, *n, *[None] * 4, NO_VALUES)
        return (name, edges, counts, *n, float(good[0]), float(good[-1]), float(good.sum()), squares, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.list_(pa.float64()), pa.list_(pa.int64()), *[pa.int64()] * 4, *[pa.float64()] * 4, pa.string()]
        for batch in batches:
            flat, sizes = ragged(batch.column(batch.num_columns - 1))
            made = [one(flat[end - size : end]) for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([m[i] for m in made], k) for i, k in enumerate(kinds))], names=schema.names)

    return rows.mapInArrow(run, schema)


def tensor_histograms(tensors: DataFrame, config: HistogramConfig = HistogramConfig(), keys: Sequence[str] = tuple(TENSOR), elements: str = "elements") -> DataFrame:
    """histograms() of tensors as arrays: narrow, as a tensor's range and its elements are in one row."""
    bins, fixed = config.bins, config.value_range

    def shape(x: np.ndarray) -> tuple[list[float], list[int]]:
        if fixed is None:
            pad = 0.01 * max(abs(x[0]), abs(x[-1]), 1.0) if x[0] == x[-1] else 0.0
            low, high = float(x[0] - pad), float(x[-1] + pad)
        else:
            low, high = fixed
        edges = [low + i * (high - low) / bins for i in range(bins)] + [high]
        inside = x[(x >= low) & (x <= high)]
        place = np.minimum(np.searchsorted(edges, inside, "right") - 1, bins - 1)
        return edges, np.bincount(place, minlength=bins).tolist()

    return own_histograms(tensors, OwnHistogram(config.name, shape, config.every_n_samples), keys, elements)


def merged(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, name, samples, latest_sample, bin_edges, bin_counts and the merged moments; null with a reason from the first change of edges on.

    Counts of histograms with the same edges add up bin by bin: one row a bin is shuffled for each task and series.
    """
    found = found.where("bin_edges is not null")
    group = [*keys, "name"]
    over = found.groupBy(*group).agg(
        F.count(F.lit(1)).alias("samples"), F.max("sample_id").alias("latest_sample"), (F.count_distinct("bin_edges") == 1).alias("same"), F.first("bin_edges").alias("bin_edges"),
        *(F.sum(c).alias(c) for c in ("finite_count", "nonfinite_count", "underflow_count", "overflow_count", "sum", "sum_squares")), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"),
    )
    bins = found.select(*group, F.posexplode("bin_counts").alias("pos", "c")).groupBy(*group, "pos").agg(F.sum("c").alias("c"))
    bins = bins.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda s: s["c"]).alias("bin_counts"))
    out = over.join(bins, group)
    cells = ["bin_edges", "bin_counts", "finite_count", "nonfinite_count", "underflow_count", "overflow_count", "sum", "sum_squares", "minimum", "maximum"]
    return out.select(*group, "samples", "latest_sample", *(F.when(F.col("same"), F.col(c)).alias(c) for c in cells), F.when(~F.col("same"), F.lit(EDGES_CHANGED)).alias("reason"))


def latest(found: DataFrame, keys: Sequence[str], order: str = "sample_id") -> DataFrame:
    """The last histogram of each series and name."""
    w = Window.partitionBy(*keys, "name").orderBy(F.desc(order))
    return found.where("bin_edges is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dashboard_buckets(found: DataFrame) -> DataFrame:
    """found with bucket_limits and bucket_counts: the bins with one bucket below and one above them, without a gap.

    The limits beside the outer edges are the next doubles.
    """
    lo, hi = F.get("bin_edges", 0), F.get("bin_edges", F.size("bin_edges") - 1)
    limits = F.concat(F.array(next_below(lo)), F.slice("bin_edges", F.lit(2), F.size("bin_edges") - 1), F.array(F.greatest(F.col("maximum"), -next_below(-hi))))
    counts = F.concat(F.array(F.col("underflow_count").cast("double")), F.transform("bin_counts", lambda c: c.cast("double")), F.array(F.col("overflow_count").cast("double")))
    return found.withColumns({"bucket_limits": limits, "bucket_counts": counts})


def next_below(x: Column) -> Column:
    """The largest double under a finite x.

    Half a unit in the last place less is rounded down to it or back to x; then it is a whole unit less. The logarithm may be
    off by one beside powers of two, which the last case makes good.
    """
    unit = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - 52)
    steps = [x - unit / 2, x - unit, x - unit * 2]
    return F.when(F.abs(x) < 4e-308, x - F.lit(5e-324)).when(steps[0] < x, steps[0]).when(steps[1] < x, steps[1]).otherwise(steps[2])
