"""Point-in-time reduction: one tensor's elements to its distribution profile.

Two forms of input give the same columns:
- reduce_rows(): one element a row. One grouped aggregation, combined before the shuffle; statistics that need the elements
  in order go by runs (operators.selection), of which a task shuffles one a tensor.
- reduce_tensors(): one array a row. Narrow: a numpy pass over Arrow batches, no shuffle at all.

Statistics that can't be had are null: all of an empty tensor; all but fractions without finite elements; skewness,
kurtosis and tail fraction without variance; ratios without scale; entropy without magnitude.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import finite, only_finite
from tidemark.model import METRICS, TENSOR
from tidemark.operators import selection
from tidemark.sources.tables import scratch

#: The probabilities of the quantiles.
QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p999": 0.999}
ABS_QUANTILES = {"p99_abs": 0.99, "p999_abs": 0.999}


def _over_scale(name: str) -> str:
    return f"CASE WHEN sq > 0 THEN try_divide({_metric(name)}, sqrt(sq / k)) END"


#: Shannon entropy of the magnitudes' shares, in one pass: ln A - sum(a ln a) / A.
_ENTROPY = "CASE WHEN sabs > 0 THEN greatest(ln(sabs) - coalesce(aloga, 0D) / sabs, 0D) END"


def _metric(name: str) -> str:
    """A statistic from the base columns, as an SQL expression: a plan of many statistics is built from text much faster than from Columns."""
    of = lambda c, x: f"CASE WHEN {c} > 0 THEN {x} END"
    plain = {
        "mean": of("k", "s1 / k"), "std": "sd", "rms": of("k", "sqrt(sq / k)"), "minimum": "mn", "maximum": "mx", "mean_abs": of("k", "sabs / k"), "l1_norm": "sabs", "l2_norm": "sqrt(sq)", "max_abs": "mxabs",
        "finite_fraction": of("n", "k / n"), "zero_fraction": of("n", "nzero / n"), "negative_fraction": of("n", "nneg / n"), "positive_fraction": of("n", "npos / n"), "skewness": of("sd", "skew"), "excess_kurtosis": of("sd", "kurt"),
    }
    if name in plain:
        return plain[name]
    if name in QUANTILES:
        return f"get(q, {list(QUANTILES).index(name)})"
    if name in ABS_QUANTILES:
        return f"get(qabs, {list(ABS_QUANTILES).index(name)})"
    if name == "interquartile_range":
        return f"{_metric('p75')} - {_metric('p25')}"
    if name == "central_98_range":
        return f"{_metric('p99')} - {_metric('p01')}"
    if name.endswith("_to_rms"):
        return _over_scale({"max_to_rms": "max_abs", "p99_abs_to_rms": "p99_abs", "p999_abs_to_rms": "p999_abs"}[name])
    if name == "tail_fraction_beyond_3_std":
        return of("sd", "ntail / k")
    if name == "normalized_magnitude_entropy":
        return f"({_ENTROPY}) / ln(CAST(greatest(k, 2) AS DOUBLE))"
    if name == "effective_magnitude_support_fraction":
        return of("k", f"exp({_ENTROPY}) / k")
    raise ValueError(f"unknown statistic {name!r}")


def _finite_metric(name: str, expression: str | None = None) -> Column:
    """A statistic, or an expression under a name, where it is finite."""
    x = f"CAST({expression or _metric(name)} AS DOUBLE)"
    return F.expr(f"CASE WHEN abs({x}) < CAST('Infinity' AS DOUBLE) THEN {x} END").alias(name)  # neither null nor NaN is less


def _needs(metrics: Sequence[str]) -> set[str]:
    """Which costly parts the statistics need."""
    found = set()
    if set(metrics) & {*QUANTILES, "interquartile_range", "central_98_range"}:
        found.add("q")
    if set(metrics) & {*ABS_QUANTILES, "p99_abs_to_rms", "p999_abs_to_rms"}:
        found.add("qabs")
    if "tail_fraction_beyond_3_std" in metrics:
        found.add("ntail")
    if set(metrics) & {"normalized_magnitude_entropy", "effective_magnitude_support_fraction"}:
        found.add("aloga")
    if "skewness" in metrics:
        found.add("skew")
    if "excess_kurtosis" in metrics:
        found.add("kurt")
    return found


def checked(metrics: Iterable[str]) -> list[str]:
    """The names, which must be known and different."""
    names = list(metrics)
    if len(set(names)) != len(names):
        raise ValueError("duplicate metrics: " + ", ".join(sorted({n for n in names if names.count(n) > 1})))
    for n in names:
        _metric(n)
    return names


@dataclass(frozen=True)
class Reducer:
    """Named statistics of a profile, and aggregates of the user's own: Columns over x (finite elements, else null), and functions of
    the sorted finite elements as a numpy array."""

    metrics: tuple[str, ...] = ()
    custom: tuple[tuple[str, Column], ...] = ()
    functions: tuple[tuple[str, Callable[[np.ndarray], float]], ...] = ()

    @property
    def names(self) -> list[str]:
        return [*self.metrics, *(n for n, _ in self.custom), *(n for n, _ in self.functions)]


def reducer(*metrics: str, **custom: Column | Callable[[np.ndarray], float]) -> Reducer:
    columns = tuple((n, c) for n, c in custom.items() if isinstance(c, Column))
    return Reducer(tuple(checked(metrics)), columns, tuple((n, c) for n, c in custom.items() if not isinstance(c, Column)))


def combine(*reducers: Reducer) -> Reducer:
    """One reducer with the statistics of all; names must differ."""
    names = [n for r in reducers for n in r.names]
    if len(set(names)) != len(names):
        raise ValueError("duplicate metrics: " + ", ".join(sorted({n for n in names if names.count(n) > 1})))
    return Reducer(*(tuple(x for r in reducers for x in getattr(r, part)) for part in ("metrics", "custom", "functions")))


def default_reducer() -> Reducer:
    return reducer(*METRICS)


def reduce_rows(rows: DataFrame, what: Reducer | Sequence[str] = tuple(METRICS), keys: Sequence[str] = tuple(TENSOR), value: str = "value", hot: int = selection.HOT) -> DataFrame:
    """keys and one column a statistic, from rows of single elements.

    Quantiles, tails and functions need the elements in order: their rows are packed into runs, which are written at once. A tensor of more than `hot`
    elements is never put together, whatever its size; but functions of one's own get all elements of a tensor in one task.
    """
    what = what if isinstance(what, Reducer) else reducer(*what)
    needs = _needs(what.metrics)
    if needs & {"q", "qabs", "ntail"} or what.functions:
        return _reduce_runs(rows, what, keys, value, hot)
    x0 = F.col(value).cast("double")
    rows = rows.select(*keys, x0.alias("x0"), only_finite(x0).alias("x"))
    a = F.abs("x")
    aggs = {
        "n": F.count(F.lit(1)), "k": F.count("x"), "s1": F.sum("x"), "sabs": F.sum(a), "sq": F.sum(F.col("x") * F.col("x")), "mn": F.min("x"), "mx": F.max("x"), "mxabs": F.max(a),
        "nzero": F.count_if(F.col("x0") == 0), "nneg": F.count_if(F.col("x") < 0), "npos": F.count_if(F.col("x") > 0), "sd": F.stddev_pop("x"),
    }
    if "skew" in needs:
        aggs["skew"] = F.skewness("x")
    if "kurt" in needs:
        aggs["kurt"] = F.kurtosis("x")
    if "aloga" in needs:
        aggs["aloga"] = F.sum(F.when(a > 0, a * F.log(a)))
    base = rows.groupBy(*keys).agg(*(c.alias(n) for n, c in aggs.items()), *(c.alias(f"own_{n}") for n, c in what.custom))
    return base.select(*keys, *map(_finite_metric, what.metrics), *(_finite_metric(n, f"`own_{n}`") for n, _ in what.custom))


def _reduce_runs(rows: DataFrame, what: Reducer, keys: Sequence[str], value: str, hot: int) -> DataFrame:
    """reduce_rows() for statistics that need a tensor's elements in order: by runs, of which small tensors are put together and large ones aren't."""
    runs = selection.packed(rows, keys, value)
    plain = Reducer(what.metrics, (), what.functions)
    small, large = selection.split(runs, keys, hot if not what.functions else 1 << 62)
    out = reduce_tensors(small, plain, keep=keys)
    if large is not None:
        found = selection.hot_profiles(large, keys, list(QUANTILES.values()), list(ABS_QUANTILES.values()))
        out = out.unionByName(found.select(*keys, *map(_finite_metric, what.metrics)))
    if not what.custom:
        return out
    more = reduce_rows(rows, Reducer((), what.custom), keys, value).select(*(F.col(k).alias(f"m_{k}") for k in keys), *(n for n, _ in what.custom))
    return out.join(more, _same(keys, "m_"), "left").select(*keys, *what.names)


def _same(keys: Sequence[str], prefix: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(prefix + k))
    return on


#: Numbers of a tensor from which all statistics follow; see _metric().
BASE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n", "k", "nzero", "nneg", "npos", "ntail")]
    + [T.StructField(n, T.DoubleType()) for n in ("s1", "sabs", "sq", "mn", "mx", "mxabs", "sd", "skew", "kurt", "aloga")]
    + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("q", "qabs")]
)
#: Elements that a task works on at once; a longer tensor is a piece of its own.
PIECE = 1 << 18


def _quantiles(ordered: np.ndarray, first: np.ndarray, k: np.ndarray, wanted: Iterable[float]) -> np.ndarray:
    """Linearly interpolated quantiles (columns) of the runs of ordered values; NaN where a run is empty."""
    out = np.full((len(k), len(list(wanted))), np.nan)
    some = np.flatnonzero(k)
    for j, q in enumerate(wanted):
        place = (k[some] - 1) * q
        low = np.floor(place).astype(np.int64)
        a, b = ordered[first[some] + low], ordered[first[some] + np.minimum(low + 1, k[some] - 1)]
        out[some, j] = a + (b - a) * (place - low)
    return out


def base_numbers(flat: np.ndarray, sizes: np.ndarray, needs: set[str]) -> dict[str, np.ndarray]:
    """The columns of BASE of tensors whose elements stand one after another; what is null is NaN. One pass over sorted elements."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    good = np.isfinite(flat)
    x, of = flat[good], owner[good]
    total = lambda v: np.bincount(of, v, n).astype(float)  # noqa: E731  without elements it counts in integers
    k = np.bincount(of, minlength=n)
    out = {"n": sizes, "k": k, "nzero": np.bincount(owner[flat == 0], minlength=n), "nneg": np.bincount(of[x < 0], minlength=n), "npos": np.bincount(of[x > 0], minlength=n)}
    none = k == 0
    with np.errstate(all="ignore"):
        size = np.abs(x)
        out |= {"s1": total(x), "sabs": total(size), "sq": total(x * x)}
        d = x - (out["s1"] / k)[of]
        sd = np.sqrt(total(d * d) / k)
        out["sd"] = sd
        if "skew" in needs:
            out["skew"] = total(d**3) / k / sd**3
        if "kurt" in needs:
            out["kurt"] = total(d**4) / k / sd**4 - 3
        if "ntail" in needs:
            out["ntail"] = np.bincount(of[np.abs(d) > 3 * sd[of]], minlength=n)
        if "aloga" in needs:
            out["aloga"] = total(np.where(size > 0, size * np.log(np.where(size > 0, size, 1.0)), 0.0))
    first = np.cumsum(k) - k
    ordered = x[np.lexsort((x, of))]
    ends = np.full((n, 2), np.nan)
    ends[~none] = np.stack([ordered[first[~none]], ordered[(first + k - 1)[~none]]], axis=1)
    out |= {"mn": ends[:, 0], "mx": ends[:, 1], "mxabs": np.maximum(np.abs(ends[:, 0]), np.abs(ends[:, 1]))}
    if "q" in needs:
        out["q"] = _quantiles(ordered, first, k, QUANTILES.values())
    if "qabs" in needs:
        out["qabs"] = _quantiles(size[np.lexsort((size, of))], first, k, ABS_QUANTILES.values())
    for name in ("s1", "sabs", "sq"):
        out[name] = np.where(none, np.nan, out[name])
    return out


def ragged(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Elements of an array of lists one after another, nulls as NaN, and the lists' sizes; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), sizes


def _cut(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `most` elements."""
    begin = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


#: What is done with failures of functions of one's own; characters of a message that are kept; kinds of failures that are warned of.
POLICIES, MESSAGE_CHARS, WARNED = ("raise", "warn", "ignore"), 500, 10
FAILURES = T.StructField("failures", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "error_type", "message")])))


def reduce_tensors(tensors: DataFrame, what: Reducer | Sequence[str] = tuple(METRICS), keep: Sequence[str] = tuple(TENSOR), elements: str = "elements", policy: str = "warn", failures: bool = False) -> DataFrame:
    """keep and one column a statistic, from arrays; nothing is shuffled.

    All statistics come from one numpy pass over the Arrow batches. Own aggregates are Columns over xs, the sorted finite elements, or
    functions of them as a numpy array that give one number. A number that isn't finite is null. A function that fails ends the job under the policy
    raise; else its value is null and, with failures, a column of that name says which function failed, with what and why.
    """
    if policy not in POLICIES:
        raise ValueError(f"the error policy is one of {', '.join(POLICIES)}")
    what = what if isinstance(what, Reducer) else reducer(*what)
    needs = _needs(what.metrics)
    e = F.coalesce(F.col(elements).cast("array<double>"), F.array().cast("array<double>"))
    own = [(f"own_{n}", c) for n, c in what.custom]
    base = tensors.select(*keep, e.alias("e"))
    if own:
        base = base.withColumn("xs", F.array_sort(F.filter("e", finite))).select(*keep, "e", *(c.cast("double").alias(n) for n, c in own))
    else:
        base = base.select(*keep, "e")
    at = len(keep)
    kept = [f for i, f in enumerate(base.schema.fields) if i != at]
    functions = tuple(what.functions)
    schema = T.StructType([*kept, *BASE.fields, *(T.StructField(f"own_{n}", T.DoubleType()) for n, _ in functions), FAILURES])
    failure = pa.list_(pa.struct([(f.name, pa.string()) for f in FAILURES.dataType.elementType]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = ragged(whole.column(at))[1]
            for a, b in _cut(sizes, PIECE):
                batch = whole.slice(a, b - a)
                flat, mine = ragged(batch.column(at))
                found = base_numbers(flat, mine, needs)
                columns = [c for i, c in enumerate(batch.columns) if i != at]
                for f in BASE.fields:
                    v = found.get(f.name)
                    if v is None:
                        columns.append(pa.nulls(b - a, pa.list_(pa.float64()) if f.name in ("q", "qabs") else pa.int64() if f.name == "ntail" else pa.float64()))
                    elif v.ndim == 2:
                        columns.append(pa.ListArray.from_arrays(np.arange(b - a + 1, dtype=np.int32) * v.shape[1], pa.array(v.ravel(), from_pandas=True)))
                    else:
                        columns.append(pa.array(v.astype(np.int64)) if isinstance(f.dataType, T.LongType) else pa.array(v, from_pandas=True))
                ends = np.cumsum(mine)
                failed: list[list[dict]] = [[] for _ in range(b - a)]
                for name, f in functions:
                    made = [_applied(name, f, flat[end - size : end], policy, of) for end, size, of in zip(ends.tolist(), mine.tolist(), failed, strict=True)]
                    columns.append(pa.array(made, pa.float64()))
                columns.append(pa.array(failed, failure))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    found = base.mapInArrow(run, schema)
    custom = [*(n for n, _ in what.custom), *(n for n, _ in functions)]
    return found.select(*keep, *map(_finite_metric, what.metrics), *(_finite_metric(n, f"`own_{n}`") for n in custom), *(["failures"] if failures else []))


def _applied(name: str, f: Callable[[np.ndarray], float], elements: np.ndarray, policy: str, failed: list[dict]) -> float | None:
    try:
        made = f(np.sort(elements[np.isfinite(elements)]))
        if np.ndim(made):
            raise ValueError(f"statistic {name!r} must be one number, not an array")
        found = float(made)
    except Exception as error:  # noqa: BLE001  whatever a function of one's own raises
        if policy == "raise":
            raise
        failed.append({"name": name, "error_type": type(error).__name__, "message": str(error)[:MESSAGE_CHARS]})
        return None
    return found if np.isfinite(found) else None


def reduce_with_errors(tensors: DataFrame, what: Reducer, keep: Sequence[str] = tuple(TENSOR), elements: str = "elements", policy: str = "warn", ts: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(statistics, errors): reduce_tensors() and a row for every failure of a function: module, probe, error_type, message, ts, event_seq, as caps.error_summaries takes them.

    Functions run once: their values and failures are written as one table, which is split after. Under `warn` the driver also warns
    of the kinds of failures that there were, at most WARNED; under `ignore` it says nothing, but the rows are there.
    """
    keep = list(keep)
    both = reduce_tensors(tensors, what, [*keep, *([ts] if ts and ts not in keep else [])], elements, policy, failures=True)
    path = scratch(tensors.sparkSession, "reduced")
    both.write.parquet(path)
    both = tensors.sparkSession.read.schema(both.schema).parquet(path)
    time = F.col(ts) if ts else F.lit(None).cast("timestamp")
    where = {n: F.col(n) if n in both.columns else F.lit(None).cast(kind) for n, kind in (("module", "string"), ("signal", "string"), ("event_seq", "long"))}
    errors = both.where(F.size("failures") > 0).select(where["module"].alias("module"), where["signal"].alias("probe"), time.alias("ts"), where["event_seq"].alias("event_seq"), F.inline("failures"))
    errors = errors.select("module", F.coalesce(F.concat("probe", F.lit("/"), "name"), F.col("name")).alias("probe"), "error_type", "message", "ts", "event_seq")
    if policy == "warn":
        for r in errors.select("probe", "error_type", "message").distinct().limit(WARNED).collect():
            warnings.warn(f"{r['probe']} failed: {r['error_type']}: {r['message']}", RuntimeWarning, stacklevel=2)
    return both.select(*keep, *what.names, "failures"), errors


def long_form(stats: DataFrame, metrics: Sequence[str], keys: Sequence[str] = tuple(TENSOR)) -> DataFrame:
    """keys, metric, metric_ord, value: a row for each available statistic."""
    items = ", ".join(f"struct('{m}' AS metric, {i} AS metric_ord, `{m}` AS value)" for i, m in enumerate(metrics))
    return stats.select(*keys, F.expr(f"explode(filter(array({items}), s -> s.value IS NOT NULL))").alias("s")).select(*keys, "s.*")


def reasons(stats: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """stats with stats_map (available values) and unavailable (name to why: with the column `failures`, what a function failed with)."""
    items = ", ".join(f"struct('{m}' AS name, `{m}` AS value)" for m in metrics)
    why = "'no finite value can be computed from these elements'"
    if "failures" in stats.columns:
        why = f"coalesce(get(filter(failures, f -> f.name = s.name), 0).error_type || ': ' || get(filter(failures, f -> f.name = s.name), 0).message, {why})"
    return stats.withColumns(
        {
            "stats_map": F.expr(f"map_from_entries(filter(array({items}), s -> s.value IS NOT NULL))"),
            "unavailable": F.expr(f"map_from_entries(transform(filter(array({items}), s -> s.value IS NULL), s -> struct(s.name AS name, {why} AS reason)))"),
        }
    )
