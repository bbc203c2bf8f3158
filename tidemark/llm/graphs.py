"""Connected components of a link table by least labels, with written tables between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import written


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of every end of the links (a, b: long).

    Every round takes the least label of the neighbours and then that label's own label, so the
    number of rounds grows with the logarithm of a component's diameter. Minima are pre-aggregated, so a hub with a
    third of all links is no hot group.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("id"), F.least("a", "near").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        step = written(step, "labels")
        above = step.select(F.col("id").alias("component"), F.col("component").alias("further"))
        fresh = written(step.join(above, "component", "left").select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        if not fresh.where("old <> component").limit(1).count():
            return fresh.select("id", "component")
        labels = fresh.select("id", "component")


def joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """comps (id, component) after further links: only the graph of components, without its repeated links, goes through the rounds.

    Links are read again and again and should be written. Where none of them joins two components, the result is comps itself.
    """
    if comps is None:
        return components(links)
    if not links.limit(1).count():
        return comps
    own = lambda c: links.select(F.col(c).alias("id"), F.col(c).alias("component"))
    known = written(comps.union(own("a")).union(own("b")).groupBy("id").agg(F.min("component").alias("component")), "labels")
    of = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"component_{c}"))
    between = links.join(of("a"), "a").join(of("b"), "b").where("component_a <> component_b")
    between = written(between.select(F.least("component_a", "component_b").alias("a"), F.greatest("component_a", "component_b").alias("b")).distinct(), "links")
    if not between.limit(1).count():
        return comps
    further = components(between).select(F.col("id").alias("component"), F.col("component").alias("further"))
    return written(known.join(further, "component", "left").select("id", F.coalesce("further", "component").alias("component")), "labels")
