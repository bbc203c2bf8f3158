"""Small relations for tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

TENSORS = "source_rank int, module string, call_index int, signal string, tensor_path string, event_seq long, sample_id long, elements array<double>"


def tensor_rows(samples, module="", signal="outputs", path="output", call_index=0, rank=0):
    return [(rank, module, call_index, signal, path, i, i, None if e is None else [float(x) for x in e]) for i, e in enumerate(samples)]


def tensors(spark: SparkSession, samples, **where) -> DataFrame:
    return spark.createDataFrame(tensor_rows(samples, **where), TENSORS)


def values(spark: SparkSession, numbers, module="", signal="outputs", path="output", metric="rms", rank=0) -> DataFrame:
    rows = [(rank, module, 0, signal, path, metric, i, i, float(x)) for i, x in enumerate(numbers)]
    return spark.createDataFrame(rows, "source_rank int, module string, call_index int, signal string, tensor_path string, metric string, event_seq long, sample_id long, value double")


def same(a, b, tolerance=1e-9) -> bool:
    if a is None or b is None:
        return a is b
    return math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)
