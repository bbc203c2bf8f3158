"""Observations from JSON text, with a policy for what can't be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: raise: the first bad row fails the query; warn: bad rows go to the errors; ignore: they are left out.
POLICIES = ("raise", "warn", "ignore")


def parse(df: DataFrame, json_col: str, schema: str | T.StructType, policy: str = "warn", probe: str = "outputs", module: Column | None = None, ts: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(df with the fields of the JSON column, errors): errors are rows of operators.caps.error_summaries, empty unless the policy is warn."""
    if policy not in POLICIES:
        raise ValueError(f"the error policy is one of {', '.join(POLICIES)}")
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    known = [c for c in df.columns if c != json_col]
    if policy == "raise":
        return df.withColumn("_j", F.from_json(json_col, fields, {"mode": "FAILFAST"})).select(*known, "_j.*"), _errors(df.where(F.lit(False)), probe, module, ts)
    wide = T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])
    read = df.withColumn("_j", F.from_json(json_col, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    broken = F.col("_j").isNull() | F.col("_j._bad").isNotNull()
    good = read.where(~broken).select(*known, *(F.col(f"_j.`{f.name}`") for f in fields.fields))
    bad = read.where(broken) if policy == "warn" else read.where(F.lit(False))
    return good, _errors(bad, probe, module, ts)


def _errors(bad: DataFrame, probe: str, module: Column | None, ts: Column | None) -> DataFrame:
    none = F.lit(None)
    return bad.select(
        (none.cast("string") if module is None else module).alias("module"), F.lit(probe).alias("probe"), F.lit("ValueError").alias("error_type"), F.lit("the row is no JSON of the expected form").alias("message"),
        (none.cast("timestamp") if ts is None else ts).alias("ts"),
    )
