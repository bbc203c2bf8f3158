"""The lookups between relations of observations, as equi-joins and semi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = ["source_rank", "sample_id"]
CALL = [*SAMPLE, "module", "call_index"]


def bind_gradients(outputs: DataFrame, gradients: DataFrame, columns: list[str]) -> DataFrame:
    """Gradients (CALL, tensor_path of the output they belong to, columns) for every output path that holds the tensor.

    outputs: CALL, tensor_path, tensor_id. A tensor under several paths gives its gradient to each of them: it is
    reduced once and joined back. Gradients of tensors that no forward has recorded are dropped.
    """
    first = outputs.groupBy(*CALL, "tensor_id").agg(F.min("tensor_path").alias("first_path"))
    found = gradients.select(*CALL, F.col("tensor_path").alias("first_path"), *columns).join(first, [*CALL, "first_path"])
    return outputs.select(*CALL, "tensor_id", "tensor_path").join(found, [*CALL, "tensor_id"]).select(*CALL, F.regexp_replace("tensor_path", "^output", "grad_output").alias("tensor_path"), *columns)


def correlated(forward: DataFrame, backward: DataFrame, columns: list[str]) -> DataFrame:
    """Forward rows (SAMPLE keys and what else they have) with the columns of their sample's backward rows; without a backward they are null."""
    return forward.join(backward.select(*SAMPLE, *columns), SAMPLE, "left")


def with_forward(backward: DataFrame, forward: DataFrame) -> DataFrame:
    """Backward rows whose sample has a forward."""
    return backward.join(forward.select(*SAMPLE).distinct(), SAMPLE, "left_semi")


def module_catalog(names: DataFrame) -> DataFrame:
    """A row a module of (identity, name, module_ord, module_type, parameter_count, trainable_parameter_count) rows: its canonical name is the first one, aliases are all in order."""
    item = F.struct("module_ord", "name")
    per = names.groupBy("identity").agg(F.sort_array(F.collect_list(item)).alias("items"), *(F.first(c).alias(c) for c in ("module_type", "parameter_count", "trainable_parameter_count")))
    return per.select(
        F.get("items", 0)["name"].alias("module"), F.transform("items", lambda s: s["name"]).alias("aliases"), F.get("items", 0)["module_ord"].alias("module_ord"), "module_type", "parameter_count", "trainable_parameter_count"
    )
