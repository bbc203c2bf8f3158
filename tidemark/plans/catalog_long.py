"""Queries of series that one task shouldn't hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import long_series
from tidemark.plans import catalog as C
from tidemark.sources.tables import table

query = C.query

_CHANGES = ["fast_ema", "slow_ema", "exponentially_weighted_change_mean", "exponentially_weighted_change_volatility", "latest_z_score", "lag1_autocorrelation", "oscillation_fraction"]
_MOVES = ["mean", "standard_deviation", "maximum_drawdown", "maximum_runup", "cusum_positive", "cusum_negative", "momentum_5_samples"]


@query(f"""with v as (select coalesce(source, '') as module, doc_id, length(text)::double as x from documents where text is not null),
w as (select *, row_number() over o - 1 as i, count(*) over (partition by module) as n, lag(x) over o as p, lag(x, 5) over o as l5, avg(x) over before as mb, stddev_pop(x) over before as sb, max(x) over run as hi, min(x) over run as lo
  from v window o as (partition by module order by doc_id), before as (partition by module order by doc_id rows between unbounded preceding and 1 preceding), run as (partition by module order by doc_id rows between unbounded preceding and current row)),
s as (select *, x - p as d, case when sb > 1e-12 then (x - mb) / sb end as z, i >= greatest(n - 20, 1) as recent, pow(0.75, n - 1 - i) * case when i = 0 then 1 else 0.25 end as wf, pow(0.95, n - 1 - i) * case when i = 0 then 1 else 0.05 end as ws,
  case when i = 0 then 0 else 0.1 * pow(0.9, n - 1 - i) end as wc from w),
u as (select *, sum(wc * d) over (partition by module) as change, sum(coalesce(z - 0.5, 0)) over run as up, sum(coalesce(-z - 0.5, 0)) over run as down from s window run as (partition by module order by doc_id rows between unbounded preceding and current row)),
r as (select *, up - least(0, min(up) over run) as cu, down - least(0, min(down) over run) as cd from u window run as (partition by module order by doc_id rows between unbounded preceding and current row)),
turns as (select module, avg(case when sg <> ps then 1.0 else 0.0 end) as turned from (select *, lag(sg) over (partition by module order by i) as ps from (select module, i, sign(d) as sg from s where recent and d <> 0)) where ps is not null group by module),
a as (select module, count(*) as count, avg(x) as mean, stddev_pop(x) as standard_deviation, sum(wf * x) as fast_ema, sum(ws * x) as slow_ema, max(change) as m, sum(wc * (d - change) * (d - change)) as v2, max(z) filter (where i = n - 1) as latest_z_score,
  max(hi - x) as maximum_drawdown, max(x - lo) as maximum_runup, max(cu) filter (where i = n - 1) as cusum_positive, max(cd) filter (where i = n - 1) as cusum_negative, max(x) filter (where i = n - 1) as latest, max(l5) filter (where i = n - 1) as l5,
  count(*) filter (where recent) as k, covar_pop(p, x) filter (where recent) as cv, sqrt(var_pop(p) filter (where recent) * var_pop(x) filter (where recent)) as vv, coalesce(max(i) filter (where d <= 0), 0) as nu, coalesce(max(i) filter (where d >= 0), 0) as nd from r group by module),
found as (select a.*, coalesce(m, 0) as exponentially_weighted_change_mean, sqrt(coalesce(v2, 0) + pow(0.9, count - 1) * coalesce(m * m, 0)) as exponentially_weighted_change_volatility, case when count >= 3 and vv * k > 1e-12 then cv / vv end as lag1_autocorrelation,
  turned as oscillation_fraction, latest - l5 as momentum_5_samples, count - 1 - nu as consecutive_increases, count - 1 - nd as consecutive_decreases from a left join turns using (module))
select module, count, consecutive_increases, consecutive_decreases, {", ".join(f"round({c}, 5) + 0.0 as {c}" for c in (*_CHANGES, *_MOVES))} from found""")
def series_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the documents of every source as a series, all cut into segments: a source may hold a third of all documents."""
    docs = table(spark, sf_dir, "documents")
    values = docs.select(F.coalesce("source", F.lit("")).alias("module"), F.col("doc_id").alias("event_seq"), F.col("doc_id").alias("sample_id"), F.char_length("text").cast("double").alias("value"))
    found = long_series.long_series_of(values, keys=["module"])
    return C.rounded(found, "module", "count", "consecutive_increases", "consecutive_decreases", *_CHANGES, *_MOVES, digits=5)
