"""SQL of the registered queries, put together from common table expressions."""

from __future__ import annotations

from tidemark.model import CATEGORIES, METRICS, TEMPORAL_METRICS

DAY = "date_diff('day', date '2024-01-01', cast(ts as date))"
FAULTY = "case when event_id % 97 = 0 then 'nan'::double when event_id % 101 = 0 then 'infinity'::double when event_id % 89 = 0 then 0.0 else value end"
KEYS = ["source_rank", "module", "call_index", "signal", "tensor_path"]
TENSOR = [*KEYS, "sample_id"]
SERIES = [*KEYS, "metric"]

EVENTS = f"select 0 as source_rank, event_type as module, 0 as call_index, 'outputs' as signal, 'output.value' as tensor_path, {DAY} as sample_id, value from events"
RANKED = EVENTS.replace("0 as source_rank", "user_id % 4 as source_rank")
FAULTS = EVENTS.replace("0 as call_index", "1 as call_index").replace(", value from", f", {FAULTY} as value from")
CHANGES = f"""select 0 as source_rank, event_type as module, 0 as call_index, 'output_gradients' as signal, 'grad_output.value' as tensor_path, {DAY} as sample_id, value - before as value
  from (select *, lag(value) over (partition by event_type order by ts, event_id) as before from events) where before is not null"""
ALL = f"{EVENTS} union all {CHANGES} union all {FAULTS}"
LINEITEM = """select 0 as source_rank, l_returnflag || '_' || l_linestatus as module, 0 as call_index, 'outputs' as signal, 'output.' || name as tensor_path,
    (year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 as sample_id, value
  from (select l_returnflag, l_linestatus, l_shipdate, unnest(['l_extendedprice', 'l_quantity', 'l_discount', 'l_tax']) as name, unnest([l_extendedprice, l_quantity, l_discount, l_tax]) as value from lineitem)"""
EMBEDDINGS = """select 0 as source_rank, 'label_' || label as module, 0 as call_index, 'outputs' as signal, 'output' as tensor_path, n as sample_id, unnest(embedding)::double as value
  from (select *, row_number() over (partition by label order by vec_id) - 1 as n from embeddings)"""
VECTORS = "select 0 as source_rank, 'label_' || label as module, 0 as call_index, 'outputs' as signal, 'output' as tensor_path, vec_id as sample_id, unnest(embedding)::double as value from embeddings"


def stats(obs: str, keys: list[str] = TENSOR) -> str:
    """CTEs up to stats: keys and all statistics."""
    k = ", ".join(keys)
    b = ", ".join(f"b.{x}" for x in keys)
    q = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    made = {
        "mean": "s1 / k", "std": "sd", "rms": "sqrt(sq / k)", "minimum": "mn", "maximum": "mx", "mean_abs": "sa / k", "l1_norm": "sa", "l2_norm": "sqrt(sq)", "max_abs": "ma",
        "finite_fraction": "k / n", "zero_fraction": "nz / n", "negative_fraction": "nneg / n", "positive_fraction": "npos / n", "skewness": "case when sd > 0 then m3 / pow(sd, 3) end",
        "excess_kurtosis": "case when sd > 0 then m4 / pow(sd, 4) - 3 end", **{n: f"q_{n}" for n in q}, "p99_abs": "qa99", "p999_abs": "qa999", "interquartile_range": "q_p75 - q_p25",
        "central_98_range": "q_p99 - q_p01", "max_to_rms": "case when sq > 0 then ma / sqrt(sq / k) end", "p99_abs_to_rms": "case when sq > 0 then qa99 / sqrt(sq / k) end",
        "p999_abs_to_rms": "case when sq > 0 then qa999 / sqrt(sq / k) end", "tail_fraction_beyond_3_std": "case when sd > 0 then nt / k end",
        "normalized_magnitude_entropy": "case when sa > 0 then h / ln(greatest(k, 2)) end", "effective_magnitude_support_fraction": "case when sa > 0 then exp(h) / k end",
    }
    return f"""obs as ({obs}),
fin as (select {k}, value as x0, case when isfinite(value) then value end as x from obs),
b as (select {k}, count(*)::double as n, count(x)::double as k, sum(x) as s1, sum(abs(x)) as sa, sum(x * x) as sq, min(x) as mn, max(x) as mx, max(abs(x)) as ma, stddev_pop(x) as sd,
  count(*) filter (where x0 = 0) as nz, count(*) filter (where x < 0) as nneg, count(*) filter (where x > 0) as npos,
  {", ".join(f"quantile_cont(x, {p}) as q_{n}" for n, p in q.items())}, quantile_cont(abs(x), 0.99) as qa99, quantile_cont(abs(x), 0.999) as qa999 from fin group by all),
c as (select {b}, avg(pow(x - s1 / k, 3)) as m3, avg(pow(x - s1 / k, 4)) as m4, count(*) filter (where abs(x - s1 / k) > 3 * sd) as nt,
  -sum(case when x <> 0 then abs(x) / sa * ln(abs(x) / sa) else 0 end) as h
  from fin join b on {" and ".join(f"fin.{x} = b.{x}" for x in keys)} group by {b}),
stats as (select {b}, {", ".join(f"{e} as {n}" for n, e in made.items())} from b join c on {" and ".join(f"c.{x} = b.{x}" for x in keys)})"""


def stats_query(obs: str, metrics: list[str], keys: list[str] = TENSOR, digits: int = 6) -> str:
    return f"with {stats(obs, keys)} select {', '.join(keys)}, {', '.join(f'round({m}, {digits}) + 0.0 as {m}' for m in metrics)} from stats"


def values(obs: str, metrics: list[str]) -> str:
    """CTEs up to v: SERIES keys, sample_id, x."""
    return f"{stats(obs)},\nv as (select * from (" + " union all ".join(f"select {', '.join(KEYS)}, '{m}' as metric, sample_id, {m} as x from stats" for m in metrics) + ") where x is not null)"


def series(obs: str, metrics: list[str]) -> str:
    """CTEs up to series: keys, count, the points' values and sample_ids, and all indicators."""
    k = ", ".join(SERIES)
    by = lambda frame="": f"over (partition by {k} order by sample_id {frame})"
    run, prev = by("rows between unbounded preceding and current row"), by("rows between unbounded preceding and 1 preceding")
    on = lambda a, b: " and ".join(f"{a}.{x} = {b}.{x}" for x in SERIES)
    ratio = lambda a, b: f"case when abs({b}) > 1e-12 then ({a}) / ({b}) end"
    return f"""{values(obs, metrics)},
w as (select *, row_number() {by()} - 1 as i, count(*) over (partition by {k}) as n, lag(x) {by()} as p, avg(x) {prev} as mb, stddev_pop(x) {prev} as sb, max(x) {run} as hi, min(x) {run} as lo,
  lag(x, 1) {by()} as l1, lag(x, 5) {by()} as l5, lag(x, 20) {by()} as l20 from v),
s as (select *, x - p as d, case when sb > 1e-12 then (x - mb) / sb end as z from w),
rec as (
  with recursive r as (
    select {k}, i, 0.0::double as m, 0.0::double as v2, 0.0::double as g, 0.0::double as l, 0.0::double as cu, 0.0::double as cd, x as fast, x as slow from s where i = 0
    union all
    select {", ".join(f"r.{x}" for x in SERIES)}, s.i, r.m + 0.1 * (s.d - r.m), 0.9 * (r.v2 + 0.1 * pow(s.d - r.m, 2)), r.g + 0.1 * (greatest(s.d, 0) - r.g), r.l + 0.1 * (greatest(-s.d, 0) - r.l),
      case when s.z is null then r.cu else greatest(0, r.cu + s.z - 0.5) end, case when s.z is null then r.cd else greatest(0, r.cd - s.z - 0.5) end,
      r.fast + 0.25 * (s.x - r.fast), r.slow + 0.05 * (s.x - r.slow)
    from r join s on {on("r", "s")} and s.i = r.i + 1)
  select * from r),
nz as (select {k}, i, sign(d) as sg from s where d <> 0 and i >= greatest(n - 20, 1)),
osc as (select {k}, avg(case when sg <> ps then 1.0 else 0.0 end) as f from (select *, lag(sg) over (partition by {k} order by i) as ps from nz) where ps is not null group by all),
a as (select {k}, count(*) as count, arg_min(x, i) as first, arg_min(sample_id, i) as first_sample, arg_max(x, i) as latest, arg_max(sample_id, i) as latest_sample, min(x) as mn, max(x) as mx,
  arg_min(sample_id, (x, i)) as mn_sample, arg_max(sample_id, (x, -i)) as mx_sample,
  avg(x) as mean, stddev_pop(x) as sd, avg(x * x) as sq, regr_slope(x, sample_id) as slope, regr_sxx(x, sample_id) as sxx, regr_syy(x, sample_id) as syy, regr_sxy(x, sample_id) as sxy,
  arg_max(z, i) filter (where i = n - 1) as z, max(hi - x) as dd, max(x - lo) as ru, max(i) filter (where d <= 0) as nu, max(i) filter (where d >= 0) as nd,
  count(*) filter (where i >= greatest(n - 20, 1)) as m, covar_pop(p, x) filter (where i >= greatest(n - 20, 1)) as cv, var_pop(p) filter (where i >= greatest(n - 20, 1)) as vp, var_pop(x) filter (where i >= greatest(n - 20, 1)) as vx,
  max(l1) filter (where i = n - 1) as l1, max(l5) filter (where i = n - 1) as l5, max(l20) filter (where i = n - 1) as l20 from s group by all),
series as (select {", ".join(f"a.{x}" for x in SERIES)}, a.count, a.count >= 21 as warmup_complete, first, first_sample, latest, latest_sample, mn as minimum, mn_sample as minimum_sample, mx as maximum, mx_sample as maximum_sample,
  mean, sd as standard_deviation, sqrt(sq) as root_mean_square, {ratio("sd", "abs(mean)")} as coefficient_of_variation, case when sxx > 1e-12 then slope end as linear_slope_per_sample,
  case when sxx * syy > 1e-12 then least(sxy * sxy / (sxx * syy), 1.0) end as slope_r_squared, fast as fast_ema, slow as slow_ema, fast - slow as fast_slow_gap, {ratio("fast - slow", "abs(slow)")} as fast_slow_relative_gap,
  rec.m as exponentially_weighted_change_mean, sqrt(rec.v2) as exponentially_weighted_change_volatility, z as latest_z_score, {ratio("latest - mn", "mx - mn")} as historical_range_position,
  dd as maximum_drawdown, ru as maximum_runup, {ratio("rec.g - rec.l", "rec.g + rec.l")} as up_down_balance, rec.cu as cusum_positive, rec.cd as cusum_negative, greatest(rec.cu, rec.cd) as cusum_change_score,
  case when a.count >= 3 and sqrt(vp * a.m * vx * a.m) > 1e-12 then cv * a.m / sqrt(vp * a.m * vx * a.m) end as lag1_autocorrelation, osc.f as oscillation_fraction,
  a.count - 1 - coalesce(nu, 0) as consecutive_increases, a.count - 1 - coalesce(nd, 0) as consecutive_decreases,
  {", ".join(f"latest - l{h} as momentum_{h}_samples, {ratio(f'latest - l{h}', f'abs(l{h})')} as relative_momentum_{h}_samples" for h in (1, 5, 20))}
  from a join rec on {on("a", "rec")} and rec.i = a.count - 1 left join osc on {on("a", "osc")})"""


def series_query(obs: str, metrics: list[str], columns: list[str], digits: int = 6) -> str:
    whole = {"count", "warmup_complete", "consecutive_increases", "consecutive_decreases", "first_sample", "latest_sample", "minimum_sample", "maximum_sample"}
    cols = [c if c in whole else f"round({c}, {digits}) + 0.0 as {c}" for c in columns]
    return f"with {series(obs, metrics)} select {', '.join(SERIES)}, {', '.join(cols)} from series"


def candidates(obs: str, metrics: list[str] = TEMPORAL_METRICS) -> str:
    """CTEs up to candidates: the series' keys, category, category_ord and score."""
    change = "case when abs(first) > 1e-12 then (latest - first) / abs(first) end"
    scale = f"greatest(coalesce(abs(fast_slow_relative_gap), 0), coalesce(abs(relative_momentum_5_samples), 0), coalesce(abs(relative_momentum_20_samples), 0), coalesce(abs({change}), 0))"
    rules = {
        "activation_scale_drift": ("signal = 'outputs' and metric = 'rms'", scale),
        "gradient_scale_change": ("signal = 'output_gradients' and metric = 'rms'", scale),
        "heavy_tail_growth": ("signal = 'outputs' and metric in ('max_to_rms', 'p99_abs_to_rms', 'p999_abs_to_rms', 'excess_kurtosis')", change),
        "nonfinite_values": ("metric = 'finite_fraction'", "1 - latest"),
        "zero_fraction_growth": ("metric = 'zero_fraction'", "latest - first"),
        "volatility": ("metric = 'rms' and abs(slow_ema) > 1e-12", "exponentially_weighted_change_volatility / abs(slow_ema)"),
        "oscillation": ("metric = 'rms'", "oscillation_fraction * greatest(-lag1_autocorrelation, 0)"),
        "regime_change": ("metric = 'rms'", "cusum_change_score / sqrt(count)"),
    }
    parts = [f"select {', '.join(SERIES)}, '{c}' as category, {CATEGORIES.index(c)} as category_ord, count, {score} as score from series where {applies}" for c, (applies, score) in rules.items()]
    return f"{series(obs, metrics)},\ncandidates as (select * from ({' union all '.join(parts)}) where score > 0)"


def topk(obs: str, k: int, by: str = "category", tail: str = "") -> str:
    order = "module, call_index, signal, tensor_path, metric"
    return f"{candidates(obs)},\nbest as (select *, row_number() over (partition by {by} order by score desc, {order}) as rank from candidates qualify rank <= {k}){tail}"


def histogram(obs: str, every: int, bins: int, low: str, high: str) -> str:
    """CTEs up to hist: keys, edges, counts and moments; low and high are expressions over mn and mx."""
    k = ", ".join(TENSOR)
    on = " and ".join(f"f.{x} = e.{x}" for x in TENSOR)
    return f"""obs as ({obs}),
f as (select {k}, case when isfinite(value) then value end as x from obs where sample_id % {every} = 0),
e as (select {k}, [case when i = {bins} then hi else lo + i * (hi - lo) / {bins} end for i in range(0, {bins + 1})] as edges from (select {k}, {low} as lo, {high} as hi from (select {k}, min(x) as mn, max(x) as mx from f group by all))),
g as (select f.*, e.edges, case when x is null then null when x < edges[1] then -1 when x > edges[{bins + 1}] then {bins} else least(len(list_filter(edges, lambda t: t <= x)) - 1, {bins - 1}) end as bin from f join e on {on}),
hist as (select {k}, any_value(edges) as bin_edges, {", ".join(f"count(*) filter (where bin = {i}) as bin_{i}" for i in range(bins))}, count(x) as finite_count, count(*) - count(x) as nonfinite_count,
  count(*) filter (where bin = -1) as underflow_count, count(*) filter (where bin = {bins}) as overflow_count, min(x) as minimum, max(x) as maximum, sum(x) as sum, sum(x * x) as sum_squares from g group by {k} having count(x) > 0)"""


ALL_METRICS = METRICS
