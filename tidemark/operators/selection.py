"""Tensors whose elements are rows: packed into sorted runs, and profiled exactly however large one tensor is.

packed() makes one row of the elements that a task has of a tensor, a run; they are written, so that later passes
read runs instead of rows, and moments that are known later are answered on them without another shuffle of elements.

hot_profiles() is for tensors with more elements than a task should hold. Their runs are sorted, each by itself, and stay where they are:
- sums, extremes and counts add up over the runs; central moments and tails follow when mean and deviation are known;
- quantiles are selected by radix. The bits of a double, made to sort like it, are cut into digits of 16 bits. Each pass counts the
  next digit of the elements that lie in a bin that holds a wanted rank, found in a run by binary search, and refines only those
  bins, so after four passes the elements at the wanted ranks are known to the bit.
A pass shuffles counts by tensor and digit, combined before; a tensor with a third of all rows is spread over as many tasks as it has runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.tables import scratch

#: Elements that a task gathers before it makes runs of them, and elements from which on a tensor is hot.
GATHERED, HOT = 1 << 18, 1 << 22
#: Bits of a digit.
DIGIT = 16
_TOP = np.uint64(1 << 63)


def _kept(df: DataFrame, what: str) -> DataFrame:
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(keys: Sequence[str], left: str, right: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def packed(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, elements (in the order of the rows; null as NaN), size: the runs of the rows, written."""
    narrow = rows.select(*keys, F.col(value).cast("double").alias("elements"))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("elements", T.ArrayType(T.DoubleType())), T.StructField("size", T.LongType())])
    by = list(keys)

    def runs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = pa.Table.from_batches(held).group_by(by, use_threads=False).aggregate([("elements", "list")]).combine_chunks()
        lists = found.column("elements_list").chunk(0)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*(found.column(k).chunk(0) for k in by), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sizes.astype(np.int64))], names=[*by, "elements", "size"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= GATHERED:
                yield runs(held)
                held, n = [], 0
        if n:
            yield runs(held)

    return _kept(narrow.mapInArrow(pack, schema), "runs")


def split(runs: DataFrame, keys: Sequence[str], most: int = HOT) -> tuple[DataFrame, DataFrame | None]:
    """(tensors of at most `most` elements as one row of keys and elements each, the runs of the others or None)."""
    sizes = runs.groupBy(*keys).agg(F.sum("size").alias("size")).where(F.col("size") > most).select(*keys)
    whole = lambda df: df.groupBy(*keys).agg(F.flatten(F.collect_list("elements")).alias("elements"))
    hot = _kept(sizes, "hot")  # at most a row for every `most` elements
    if not hot.limit(1).count():
        return whole(runs), None
    meet = lambda how: runs.alias("r").join(hot.alias("h"), same(keys, "r", "h"), how)
    return whole(meet("left_anti")), meet("left_semi")


def sorted_runs(runs: DataFrame) -> DataFrame:
    """The runs with their elements sorted, NaN last, and without negative zeros; written."""
    names = runs.columns
    at = names.index("elements")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            flat = flat[np.lexsort((flat, np.repeat(np.arange(len(sizes)), sizes)))] + 0.0
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            columns = list(batch.columns)
            columns[at] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _kept(runs.mapInArrow(run, runs.schema), "sorted")


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers that sort like the doubles; no NaN."""
    bits = np.ascontiguousarray(x, np.float64).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def double_of(bits: np.ndarray) -> np.ndarray:
    """The doubles of ordered_bits()."""
    return np.where(bits & _TOP, bits & ~_TOP, ~bits).view(np.float64)


def _finite(elements: np.ndarray) -> np.ndarray:
    return elements[np.isfinite(elements)]


def _each(runs: DataFrame, keys: Sequence[str], more: Sequence[str], schema: str, make) -> DataFrame:
    """make(finite elements, all elements, further columns of the run as Python values) gives rows of `schema` for every run; keys come first."""
    rows = runs.select(*keys, *more, "elements")
    fields = T.StructType([*rows.select(*keys).schema.fields, *T.StructType.fromDDL(schema).fields])
    n, own = len(keys), [f.name for f in fields.fields[len(keys) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")  # sums may be infinite, which makes a statistic null
        for batch in batches:
            for i in range(batch.num_rows):
                elements = batch.column(batch.num_columns - 1)[i].values.to_numpy(zero_copy_only=False)
                columns = make(_finite(elements), elements, [batch.column(n + j)[i].as_py() for j in range(len(more))])
                m = len(columns[0])
                if m:
                    yield pa.RecordBatch.from_arrays([*(batch.column(j).take(pa.array(np.full(m, i))) for j in range(n)), *(pa.array(c) for c in columns)], names=[*fields.names[:n], *own])

    return rows.mapInArrow(run, fields)


_SUMS = ["n", "k", "nzero", "nneg", "npos", "s1", "sabs", "sq", "aloga"]


def _sums(x: np.ndarray, elements: np.ndarray, _: list) -> list:
    a = np.abs(x)
    some = a[a > 0]
    counts = [len(elements), len(x), int((elements == 0).sum()), int((x < 0).sum()), int((x > 0).sum())]
    ends = [x.min(), x.max()] if len(x) else [None, None]
    return [[c] for c in counts] + [[float(v)] for v in (x.sum(), a.sum(), (x * x).sum(), (some * np.log(some)).sum())] + [[e] for e in ends]


def _typed(columns: list, kinds: Sequence[pa.DataType]) -> list:
    return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]


def hot_profiles(runs: DataFrame, keys: Sequence[str], quantiles: Sequence[float], abs_quantiles: Sequence[float]) -> DataFrame:
    """keys and the base numbers (operators.reduce.BASE) of the tensors of `runs`."""
    keys, runs = list(keys), sorted_runs(runs)
    kinds = [pa.int64()] * 5 + [pa.float64()] * 6
    ddl = ", ".join([*(f"{c} long" for c in _SUMS[:5]), *(f"{c} double" for c in _SUMS[5:]), "mn double", "mx double"])
    sums = _each(runs, keys, [], ddl, lambda x, e, m: _typed(_sums(x, e, m), kinds)).groupBy(*keys)
    first = _kept(sums.agg(*(F.sum(c).alias(c) for c in _SUMS), F.min("mn").alias("mn"), F.max("mx").alias("mx")), "sums")

    def central(x: np.ndarray, _: np.ndarray, more: list) -> list:
        d = x - more[0] if len(x) else x
        return [pa.array([float((d**p).sum())]) for p in (2, 3, 4)]

    def beyond(x: np.ndarray, _: np.ndarray, more: list) -> list:
        d = x - more[0]  # sorted as x is
        return [pa.array([int(np.searchsorted(d, -3 * more[1], "left") + len(d) - np.searchsorted(d, 3 * more[1], "right"))], pa.int64())]

    with_ = lambda found, *names: runs.alias("r").join(found.alias("f"), same(keys, "r", "f")).select(*(F.col(f"r.{k}").alias(k) for k in keys), *(F.col(f"f.{n}").alias(n) for n in names), F.col("r.elements").alias("elements"))
    means = first.where("k > 0").select(*keys, (F.col("s1") / F.col("k")).alias("mu"), "k")
    powers = _each(with_(means, "mu"), keys, ["mu"], "d2 double, d3 double, d4 double", central).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("d2", "d3", "d4")))
    spread = powers.alias("p").join(means.alias("m"), same(keys, "p", "m")).select(*(F.col(f"p.{k}").alias(k) for k in keys), "mu", "k", F.sqrt(F.col("d2") / F.col("k")).alias("sd"), "d3", "d4")
    spread = _kept(spread, "spread")
    tails = _each(with_(spread, "mu", "sd"), keys, ["mu", "sd"], "ntail long", beyond).groupBy(*keys).agg(F.sum("ntail").alias("ntail"))
    chosen = selected(runs, first, keys, quantiles, abs_quantiles)
    out = first.alias("b")
    for name, table in (("s", spread), ("t", tails), ("c", chosen)):
        out = out.join(table.alias(name), same(keys, "b", name), "left")
    ratio = lambda d, p: F.when(F.col("s.sd") > 0, F.col(f"s.{d}") / F.col("b.k") / F.pow(F.col("s.sd"), F.lit(p)))
    return out.select(
        *(F.col(f"b.{k}").alias(k) for k in keys), *(F.col(f"b.{c}").alias(c) for c in _SUMS[:5]), F.col("t.ntail").alias("ntail"), *(F.when(F.col("b.k") > 0, F.col(f"b.{c}")).alias(c) for c in ("s1", "sabs", "sq")),
        F.col("b.mn").alias("mn"), F.col("b.mx").alias("mx"), F.greatest(F.abs("b.mn"), F.abs("b.mx")).alias("mxabs"), F.col("s.sd").alias("sd"), ratio("d3", 3.0).alias("skew"), (ratio("d4", 4.0) - 3).alias("kurt"), F.col("b.aloga").alias("aloga"),
        F.col("c.q").alias("q"), F.col("c.qabs").alias("qabs"),
    )


def selected(runs: DataFrame, counts: DataFrame, keys: Sequence[str], quantiles: Sequence[float], abs_quantiles: Sequence[float]) -> DataFrame:
    """keys, q, qabs: interpolated quantiles of the elements and of their magnitudes. counts: keys and k, the finite elements."""
    keys = list(keys)
    wanted = [(False, i, p) for i, p in enumerate(quantiles)] + [(True, i, p) for i, p in enumerate(abs_quantiles)]
    made = _targets(counts, wanted)
    # A target: which quantile of what, the rank (from 0) among the elements in its bin, and the bits of the bin.
    state = _kept(made.select(*keys, "size", "i", "p", "high", "rank", F.lit(0).cast("long").alias("bin")), "targets")
    for done in range(0, 64, DIGIT):
        bins = state.groupBy(*keys).agg(F.collect_set(F.struct("size", "bin")).alias("bins"))  # at most two a quantile
        spread = runs.alias("r").join(bins.alias("b"), same(keys, "r", "b")).select(*(F.col(f"r.{k}").alias(k) for k in keys), F.col("b.bins").alias("bins"), F.col("r.elements").alias("elements"))
        counted = _each(spread, keys, ["bins"], "size boolean, bin long, digit int, n long", _counter(done))
        counted = counted.groupBy(*keys, "size", "bin", "digit").agg(F.sum("n").alias("n"))
        whole = Window.partitionBy(*keys, "size", "bin").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        upto = counted.withColumn("upto", F.sum("n").over(whole))
        at = same(keys, "s", "u") & (F.col("s.size") == F.col("u.size")) & (F.col("s.bin") == F.col("u.bin"))
        inside = (F.col("s.rank") < F.col("u.upto")) & (F.col("s.rank") >= F.col("u.upto") - F.col("u.n"))
        state = _kept(
            state.alias("s").join(upto.alias("u"), at & inside).select(
                *(F.col(f"s.{k}").alias(k) for k in keys), F.col("s.size").alias("size"), F.col("s.i").alias("i"), F.col("s.p").alias("p"), F.col("s.high").alias("high"), (F.col("s.rank") - F.col("u.upto") + F.col("u.n")).alias("rank"),
                F.shiftleft(F.col("s.bin"), DIGIT).bitwiseOR(F.col("u.digit").cast("long")).alias("bin"),
            ), "targets",
        )
    values = _as_doubles(state, keys)
    k = counts.select(*keys, "k")
    pairs = values.groupBy(*keys, "size", "i", "p").agg(F.max(F.when(~F.col("high"), F.col("x"))).alias("a"), F.max(F.when(F.col("high"), F.col("x"))).alias("b"))
    place = (F.col("c.k") - 1) * F.col("v.p")
    exact = pairs.alias("v").join(k.alias("c"), same(keys, "v", "c")).select(*(F.col(f"v.{x}").alias(x) for x in keys), F.col("v.size").alias("size"), F.col("v.i").alias("i"), (F.col("v.a") + (F.col("v.b") - F.col("v.a")) * (place - F.floor(place))).alias("x"))
    array = lambda size: F.transform(F.array_sort(F.collect_list(F.when(F.col("size") == size, F.struct("i", "x")))), lambda s: s["x"])
    return exact.groupBy(*keys).agg(array(False).alias("q"), array(True).alias("qabs"))


def _targets(counts: DataFrame, wanted: Sequence[tuple[bool, int, float]]) -> DataFrame:
    """The two ranks between which each wanted quantile lies, for every tensor with finite elements."""
    targets = F.array(*(F.struct(F.lit(size).alias("size"), F.lit(i).alias("i"), F.lit(float(p)).alias("p"), F.lit(high).alias("high")) for size, i, p in wanted for high in (False, True)))
    place = (F.col("k") - 1) * F.col("p")
    rank = F.least(F.floor(place) + F.col("high").cast("long"), F.col("k") - 1)
    return counts.where("k > 0").select(*counts.columns, F.explode(targets).alias("t")).select(*counts.columns, "t.*").withColumn("rank", rank.cast("long"))


def _counter(done: int):
    """Counts of the next digit, of a run's elements (or magnitudes) in the bins of which `done` bits are known."""
    left, shift = np.uint64(64 - done), np.uint64(64 - done - DIGIT)

    def count(x: np.ndarray, _: np.ndarray, more: list) -> list:
        out: list[list] = [[], [], [], []]
        magnitudes = None
        for b in more[0]:
            if b["size"] and magnitudes is None:
                magnitudes = np.sort(np.abs(x))
            bits = ordered_bits(magnitudes if b["size"] else x)
            if done:
                low = np.uint64(b["bin"] % (1 << 64)) << left
                bits = bits[np.searchsorted(bits, low) : np.searchsorted(bits, low + ((np.uint64(1) << left) - np.uint64(1)), "right")]
            digits, n = np.unique((bits >> shift) & np.uint64((1 << DIGIT) - 1), return_counts=True)
            for column, values in zip(out, ([b["size"]] * len(n), [b["bin"]] * len(n), digits.astype(np.int32).tolist(), n.tolist()), strict=True):
                column.extend(values)
        return _typed(out, [pa.bool_(), pa.int64(), pa.int32(), pa.int64()])

    return count


def _as_doubles(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The targets with x, the double whose bits are known by now."""
    schema = T.StructType([*state.schema.fields, T.StructField("x", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(batch.schema.get_field_index("bin")).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(double_of(bits))], names=schema.names)

    return state.mapInArrow(run, schema)
