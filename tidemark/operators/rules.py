"""Diagnostic rules over series, and the ranking of what they find.

Every rule is a score, a condition and the evidence as Columns over a row of series. All rules are evaluated in one
projection and one explode; the best of each category are found by row_number() <= K, which Catalyst turns into a
partial top-K before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import EPS, finite, ratio, relative_change
from tidemark.model import CATEGORIES, SERIES

OUTPUTS, GRADIENTS = "outputs", "output_gradients"
TAIL_METRICS = ["max_to_rms", "p99_abs_to_rms", "p999_abs_to_rms", "excess_kurtosis"]
#: Order of findings within a category, and of merged ones.
ORDER = ["module", "call_index", "signal", "tensor_path", "metric"]
FINDING = [
    "category", "rank", "ranking_score", "ranking_basis", "source_rank", "module", "module_type", "call_index", "signal", "tensor_path", "metric", "observations",
    "warmup_complete", "first", "latest", "minimum", "maximum", "evidence", "interpretation",
]


@dataclass(frozen=True)
class Rule:
    """One category: which series it looks at, their score, and named evidence in order. Only positive finite scores count."""

    category: str
    applies: Column
    score: Column
    evidence: tuple[tuple[str, Column], ...]
    basis: str
    interpretation: str

    def candidate(self) -> Column:
        items = F.array(*(F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in self.evidence))
        row = F.struct(
            F.lit(self.category).alias("category"), self.score.cast("double").alias("ranking_score"), F.lit(self.basis).alias("ranking_basis"),
            F.filter(items, lambda e: e["value"].isNotNull()).alias("evidence"), F.lit(self.interpretation).alias("interpretation"),
        )
        return F.when(self.applies & finite(self.score) & (self.score > 0), row)


def default_rules() -> list[Rule]:
    c = F.col
    first, latest = c("first")["value"], c("latest")["value"]
    change = relative_change(first, latest)
    of = lambda *metrics: c("metric").isin(*metrics)
    named = lambda *names: tuple((n, c(n)) for n in names)
    moved = named("fast_slow_relative_gap", "relative_momentum_5_samples", "relative_momentum_20_samples")
    moved_from_first = (("relative_change_from_first", change),)
    scale = F.greatest(*(F.coalesce(F.abs(v), F.lit(0.0)) for _, v in (*moved, *moved_from_first)))
    scale_evidence = (*moved, *named("latest_z_score", "linear_slope_per_sample", "slope_r_squared", "maximum_drawdown", "maximum_runup"), *moved_from_first)
    nonfinite = F.greatest(1.0 - latest, F.lit(0.0))
    volatility = ratio(c("exponentially_weighted_change_volatility"), F.abs("slow_ema"), EPS)
    cusum = c("cusum_change_score") / F.sqrt(F.greatest(c("count"), F.lit(1)).cast("double"))
    return [
        Rule("activation_scale_drift", (c("signal") == OUTPUTS) & of("rms"), scale, scale_evidence, "the strongest relative movement of the outputs' RMS", "The scale of these outputs moved away from what earlier samples showed."),
        Rule("gradient_scale_change", (c("signal") == GRADIENTS) & of("rms"), scale, scale_evidence, "the strongest relative movement of the output gradients' RMS", "The scale of these gradients moved away from what earlier samples showed."),
        Rule(
            "heavy_tail_growth", (c("signal") == OUTPUTS) & of(*TAIL_METRICS), F.greatest(change, F.lit(0.0)), (*moved, *named("latest_z_score"), *moved_from_first),
            "relative growth of a tail statistic since the first sample", "Large magnitudes weigh more in these outputs than they did at first.",
        ),
        Rule("nonfinite_values", of("finite_fraction"), nonfinite, (("latest_nonfinite_fraction", nonfinite),), "share of elements in the last sample that are not finite", "NaN or infinite elements were seen in this tensor."),
        Rule("zero_fraction_growth", of("zero_fraction"), F.greatest(latest - first, F.lit(0.0)), (("absolute_growth_from_first", latest - first),), "growth of the share of exact zeros since the first sample", "More elements of this tensor are exactly zero than at first."),
        Rule(
            "volatility", of("rms"), volatility, (("relative_change_volatility", volatility), *named("exponentially_weighted_change_volatility", "slow_ema")),
            "weighted volatility of RMS changes over the slow average", "The RMS jumps a lot from sample to sample for its level.",
        ),
        Rule(
            "oscillation", of("rms") & c("oscillation_fraction").isNotNull() & c("lag1_autocorrelation").isNotNull(), c("oscillation_fraction") * F.greatest(-c("lag1_autocorrelation"), F.lit(0.0)),
            named("oscillation_fraction", "lag1_autocorrelation"), "share of reversals times negative autocorrelation", "The RMS keeps turning around between samples.",
        ),
        Rule("regime_change", of("rms"), cusum, (*named("cusum_change_score"), ("normalized_cusum_score", cusum)), "cumulative-sum score over the root of the observations", "The RMS seems to have settled at another level."),
    ]


def category_ord(category: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), category).cast("int")


def candidates(series: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """A row for each rule that a series meets: its columns and the rule's."""
    found = F.filter(F.array(*(r.candidate() for r in (rules or default_rules()))), lambda c: c.isNotNull())
    return series.withColumn("_c", F.explode(found)).select("*", "_c.*").drop("_c")


def top_findings(found: DataFrame, k: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """The k best candidates of each category (and of each group `by`), ranked from 1."""
    w = Window.partitionBy(*by, "category").orderBy(F.desc("ranking_score"), *[c for c in ORDER if c not in by])
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def round_robin(findings: DataFrame) -> DataFrame:
    """Findings in the order in which a report takes them: the best of each category, then the second best, and so on."""
    return findings.orderBy("rank", category_ord(F.col("category")))


def with_modules(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """found with module_type. The catalog has one row a module: Spark broadcasts it if it is small."""
    return found.join(catalog.select("module", "module_type"), "module")


def finding_rows(findings: DataFrame, observations: DataFrame | None = None) -> DataFrame:
    """The columns of a finding. observations: tensor path keys and observations; else the series' count."""
    path = [k for k in SERIES if k != "metric"]
    out = findings.join(observations.select(*path, "observations"), path, "left") if observations is not None else findings.withColumn("observations", F.col("count"))
    return out.select(*FINDING)


def candidate_counts(found: DataFrame, spark) -> DataFrame:
    """category, candidates: a row for each category, also those without any."""
    counts = found.groupBy("category").agg(F.count(F.lit(1)).alias("candidates"))
    names = spark.range(len(CATEGORIES)).select(F.get(F.array(*map(F.lit, CATEGORIES)), F.col("id").cast("int")).alias("category"))
    return names.join(counts, "category", "left").select("category", F.coalesce("candidates", F.lit(0)).alias("candidates"))
