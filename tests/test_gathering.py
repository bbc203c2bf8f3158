"""What a task gathers of tensors whose elements are rows."""

from pyspark.sql import functions as F

from tidemark.operators import selection


def test_a_task_gathers_few_elements_whatever_it_reads(spark):
    """300,000 rows in one task, of three tensors: runs of a bounded number of elements, and none is lost."""
    rows = spark.range(0, 300_000, 1, 1).select((F.col("id") % 3).alias("module"), F.col("id").cast("double").alias("value"))
    runs = selection.packed(rows, ["module"], "value")
    assert runs.agg(F.max("size")).first()[0] < 95_000 and runs.count() > 3
    whole, hot = selection.split(runs, ["module"])
    assert hot is None
    for r in whole.collect():
        assert sorted(r["elements"]) == [float(i) for i in range(r["module"], 300_000, 3)]
