"""Mixing sources to target weights: pivotal dependent rounding (operator 5). DataFrame functions only.

Every source has a target of words; a document's expected copies are its source's target over its
source's size. The whole copies are taken, the fractional ones are rounded by pivotal sampling: two
fractional documents exchange mass, in words, at random and without bias until one is integral; the other goes on.
Documents of like size (a factor of two) meet first, in small groups dealt by hash: one fold a group leaves one
fractional document, the residuals of the groups are grouped again, and so on, a reduction tree of
`fan_in`. Then the residuals of a source's size classes, at most 64, are rounded from the largest to the smallest
so that what one size over- or undershoots the smaller ones make up for: a source of many documents ends within about the size of its
smallest class of its target, one in which a single document holds much of all words within that document's size.

No group holds more than about fan_in rows whatever a source's share of all rows; counts are pre-aggregated. All
randomness comes from hashes of the rows, so reruns agree.

Defined cases: null and empty texts have size 0 and are taken 0 times. The null source is a source of its own,
last in order. Repeated rows are documents of their own. Rows with equal hashes are interchangeable. Without
documents the result is empty. Other columns are ignored, whatever their names; join the result by the id to keep them. A text
of any length is one document; only its number of words counts. The targets come from one row a source, in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import word_count, written

#: Weights of the sources in order, repeating; most copies of a document.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
FAN_IN = 64
_EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target of (source, source_size) rows, one a source.

    Shares by weight of the sum of all sizes, none above `most` times its source's size: what is cut off goes to the others by
    weight until none is above. In the order of cap over weight the cut-off sources come first, so one
    running sum finds them.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.encode("source", "utf-8"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    x = x.withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "cut": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        }
    )
    # The level if this source were the first that is not cut off; it is cut off if that level exceeds its cap.
    x = x.withColumn("level", (F.col("total") - F.col("cut")) / F.col("open"))
    x = x.withColumn("capped", F.col("level") * F.col("w") > F.col("cap"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"]
    return x.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("w")).alias("target"))


#: One step of the fold: state.c is the fractional document so far (null: none), x the next one.
#: s: size, p: fraction, h: hash. The words that may go from one to the other are d1 (x gains) and d2 (c gains).
_STEP = """
aggregate({docs},
  named_struct('c', cast(null as {kind}), 'done', cast(array() as array<{kind}>)),
  (a, x) -> CASE
    WHEN a.c IS NULL THEN named_struct('c', x, 'done', a.done)
    ELSE transform(array(named_struct(
      'd1', least(x.s * (1 - x.p), a.c.s * a.c.p),
      'd2', least(a.c.s * (1 - a.c.p), x.s * x.p),
      'u', shiftrightunsigned(xxhash64(a.c.h, x.h, a.c.i, x.i, {seed}), 11) / 9007199254740992D)),
      m -> transform(array(CASE WHEN m.u * (m.d1 + m.d2) < m.d2 THEN m.d1 ELSE -m.d2 END),
        d -> transform(array(named_struct(
            'x', named_struct('i', x.i, 's', x.s, 'h', x.h, 'p', {x_p}),
            'c', named_struct('i', a.c.i, 's', a.c.s, 'h', a.c.h, 'p', {c_p}))),
          n -> CASE WHEN n.c.p IN (0D, 1D)
            THEN named_struct('c', CASE WHEN n.x.p IN (0D, 1D) THEN cast(null as {kind}) ELSE n.x END,
                              'done', concat(a.done, CASE WHEN n.x.p IN (0D, 1D) THEN array(n.c, n.x) ELSE array(n.c) END))
            ELSE named_struct('c', n.c, 'done', concat(a.done, array(n.x))) END)[0])[0])[0]
  END)
"""


def _rounded(p: str) -> str:
    return f"CASE WHEN {p} < {_EPS} THEN 0D WHEN {p} > 1 - {_EPS} THEN 1D ELSE {p} END"


def fold(docs: str, seed: int, kind: str) -> Column:
    """The pivotal fold over an array of fractional documents."""
    return F.expr(_STEP.format(docs=docs, seed=seed, kind=kind, x_p=_rounded("(x.p + d / x.s)"), c_p=_rounded("(a.c.p - d / a.c.s)")))


#: Residuals of a source from the largest to the smallest: left is what is to be taken of this and the following ones, in words,
#: rest the size of the following ones. One is taken or not by its fraction where both leave a reachable rest.
_TOP = """
aggregate(docs,
  named_struct('left', aggregate(docs, 0D, (t, x) -> t + x.s * x.p), 'rest', aggregate(docs, 0D, (t, x) -> t + x.s), 'done', cast(array() as array<{kind}>)),
  (a, x) -> transform(array(CASE
      WHEN a.left > a.rest - x.s AND x.s > a.left THEN CASE WHEN a.left - (a.rest - x.s) > x.s - a.left THEN 1D ELSE 0D END
      WHEN a.left > a.rest - x.s THEN 1D
      WHEN x.s > a.left THEN 0D
      WHEN shiftrightunsigned(xxhash64(x.h, x.i, {seed}), 11) / 9007199254740992D < x.p THEN 1D ELSE 0D END),
    q -> named_struct('left', a.left - q * x.s, 'rest', a.rest - x.s, 'done', concat(a.done, array(named_struct('i', x.i, 's', x.s, 'h', x.h, 'p', q)))))[0]).done
"""


def mix_rows(docs: DataFrame, size: Column, source_col: str = "source", id_col: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, fan_in: int = FAN_IN, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row a document, copies an integer of at most `most`."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size.cast("long").alias("size"))
    base = written(base, "mix-sizes")  # the texts are read once
    cls = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double"))).cast("int")).otherwise(-1)
    base = base.withColumns({"cls": cls, "i": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))}).withColumn("h", F.xxhash64("i", "size", F.lit(seed)))
    classes = base.groupBy("source", "cls").agg(F.sum("size").alias("class_size"), F.count(F.lit(1)).alias("n")).persist()
    goal = targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")), weights, most)
    goal = goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    deepest = classes.agg(F.max("n")).first()[0] or 0
    plan = classes.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("plan_source"), F.col("cls").alias("plan_cls"), "n", "source_size", "target", "rate"
    )
    joined = base.join(plan, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("cls") == F.col("plan_cls"))).drop("plan_source", "plan_cls")
    # A rate a hair beside an integer is that integer.
    whole = F.floor(F.col("rate") + F.lit(_EPS)).cast("double")
    joined = joined.withColumns({"whole": whole, "p": F.greatest(F.col("rate") - whole, F.lit(0.0))})
    joined = joined.withColumn("p", F.when((F.col("p") < _EPS) | (F.col("size") == 0), F.lit(0.0)).otherwise(F.col("p")))

    id_kind = dict(base.dtypes)["doc_id"]
    kind = f"struct<i:{id_kind},s:double,h:bigint,p:double>"
    doc = F.struct(F.col("doc_id").alias("i"), F.col("size").cast("double").alias("s"), "h", "p")
    keys = ["source", "cls", "n", "whole", "source_size", "target"]
    level = joined.where("p > 0").select(*keys, doc.alias("d"))
    settled = joined.where("p = 0").select(*keys, doc.alias("d"))
    results, rounds = [settled], max(1, math.ceil(math.log(max(deepest, 2), fan_in / 2)))
    for r in range(rounds):
        groups = F.ceil(F.col("n") / F.lit(float(fan_in) * (fan_in / 2) ** r))
        group = F.pmod(F.xxhash64("d.h", "d.i", F.lit(seed + 1 + r)), F.greatest(groups, F.lit(1)))
        folded = level.groupBy(*keys, group.alias("g")).agg(F.sort_array(F.collect_list(F.struct(F.col("d.h").alias("o"), "d"))).alias("rows"))
        folded = folded.withColumn("docs", F.transform("rows", lambda x: x["d"])).withColumn("f", fold("docs", seed + r, kind))
        out = folded.select(*keys, F.explode(F.concat(F.col("f.done"), F.when(F.col("f.c").isNull(), F.expr(f"cast(array() as array<{kind}>)")).otherwise(F.array("f.c")))).alias("d"))
        out = written(out, f"mix-level-{r}")
        results.append(out.where("d.p in (0, 1)"))
        level = out.where("d.p not in (0, 1)")
    by_source = ["source", "source_size", "target", "whole"]
    top = level.groupBy(*by_source).agg(F.sort_array(F.collect_list(F.struct(F.col("d.s").alias("o"), F.col("d.h").alias("t"), "d")), asc=False).alias("rows"))
    top = top.withColumn("docs", F.transform("rows", lambda x: x["d"])).select(*by_source, F.explode(F.expr(_TOP.format(kind=kind, seed=seed))).alias("d"))
    rows = top.select(*by_source, "d")
    for x in results:
        rows = rows.unionByName(x.select(*by_source, "d"))
    return rows.select(
        F.col("d.i").alias("doc_id"), "source", F.col("d.s").cast("long").alias("size"), "source_size", "target",
        F.when(F.col("d.s") > 0, F.col("whole") + F.col("d.p")).otherwise(0.0).cast("long").alias("copies"),
    )


def mix(docs: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken; sizes in words of the text."""
    return mix_rows(docs, word_count(F.col(f"`{text_col}`")), **settings).withColumn("taken", F.col("size") * F.col("copies"))
