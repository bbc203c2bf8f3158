"""Sources of observations: the driver's tables and JSON columns as rows of model.ROW_SCHEMA."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAULTS = {"nan": 97, "inf": 101, "zero": 89}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(df: DataFrame, module: Column, sample_id: Column, value: Column, signal: str = "outputs", path: str = "output", call_index: int = 0, source_rank: Column | None = None) -> DataFrame:
    """Any table as rows of elements."""
    return df.select(
        (F.lit(0) if source_rank is None else source_rank).cast("int").alias("source_rank"), module.alias("module"), F.lit(call_index).cast("int").alias("call_index"),
        F.lit(signal).alias("signal"), F.lit(path).alias("tensor_path"), sample_id.cast("long").alias("event_seq"), sample_id.cast("long").alias("sample_id"), value.cast("double").alias("value"),
    )


def day_of(ts: Column) -> Column:
    return F.datediff(ts, F.lit("2024-01-01").cast("date")).cast("long")


def event_rows(events: DataFrame, source_rank: Column | None = None) -> DataFrame:
    """Values of events: a module a type, a sample a day."""
    return rows_of(events, F.col("event_type"), day_of(F.col("ts")), F.col("value"), path="output.value", source_rank=source_rank)


def event_change_rows(events: DataFrame) -> DataFrame:
    """Changes of the values of a type from event to event, as gradients.

    A window holds one day of a type; the first event of a day takes the value before it from a small table, the last value of each day.
    """
    rows = events.select("event_type", "ts", "event_id", F.col("value").cast("double").alias("value"), F.to_date("ts").alias("day"))
    day = Window.partitionBy("event_type", "day").orderBy("ts", "event_id")
    ends = rows.groupBy("event_type", "day").agg(F.max(F.struct("ts", "event_id", "value")).alias("e")).select("event_type", "day", F.struct(F.col("e.value").alias("v")).alias("end"))
    before = ends.select("event_type", "day", F.lag("end").over(Window.partitionBy("event_type").orderBy("day")).alias("end"))  # a row a day
    seen = rows.withColumn("prior", F.lag(F.struct(F.col("value").alias("v"))).over(day)).join(before, ["event_type", "day"], "left")
    changed = seen.select("event_type", "ts", (F.col("value") - F.coalesce("prior", "end")["v"]).alias("change")).where("change is not null")
    return rows_of(changed, F.col("event_type"), day_of(F.col("ts")), F.col("change"), signal="output_gradients", path="grad_output.value")


def faulty(events: DataFrame) -> DataFrame:
    """events with NaN, infinite and zero values at fixed ids."""
    i = F.col("event_id")
    value = F.when(i % FAULTS["nan"] == 0, float("nan")).when(i % FAULTS["inf"] == 0, float("inf")).when(i % FAULTS["zero"] == 0, 0.0).otherwise(F.col("value"))
    return events.withColumn("value", value)


def faulty_event_rows(events: DataFrame) -> DataFrame:
    """Values with faults as a second call of each module."""
    return event_rows(faulty(events)).withColumn("call_index", F.lit(1))


def lineitem_rows(lineitem: DataFrame) -> DataFrame:
    """Four tensor paths a flag and status, a sample a month; the four columns are unpivoted without a shuffle."""
    names = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    month = F.col("month")
    base = lineitem.select(F.concat_ws("_", "l_returnflag", "l_linestatus").alias("module"), ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).alias("month"), *names)
    long = base.unpivot(["module", "month"], names, "name", "value")
    return long.select(
        F.lit(0).alias("source_rank"), "module", F.lit(0).alias("call_index"), F.lit("outputs").alias("signal"), F.concat(F.lit("output."), "name").alias("tensor_path"),
        month.cast("long").alias("event_seq"), month.cast("long").alias("sample_id"), F.col("value").cast("double").alias("value"),
    )


def embedding_tensors(embeddings: DataFrame) -> DataFrame:
    """One tensor a vector: a module a label, samples in the order of vec_id."""
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long") - 1
    return embeddings.select(
        F.lit(0).alias("source_rank"), F.concat(F.lit("label_"), F.col("label").cast("string")).alias("module"), F.lit(0).alias("call_index"), F.lit("outputs").alias("signal"),
        F.lit("output").alias("tensor_path"), n.alias("event_seq"), n.alias("sample_id"), F.col("embedding").cast("array<double>").alias("elements"),
    )


def leaf_modules(catalog: DataFrame, name: str = "module") -> DataFrame:
    """Modules that are no parent of another: a.b has the parent a."""
    parents = catalog.select(F.regexp_replace(name, r"\.?[^.]*$", "").alias(name)).where(F.col(name) != "").distinct()
    return catalog.join(parents, name, "left_anti")


def rank_of_path(path: Column) -> Column:
    """The rank in a path such as .../rank-003/report.json."""
    return F.regexp_extract(path, r"rank-(\d+)", 1).cast("int")


#: Leaves that a task gathers before it hands them on.
_LEAVES = 1 << 16


def _once(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a name stands twice in an object")
    return found


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def leaves_of(text: str | None, prefix: str) -> Iterator[tuple[str, float]]:
    """Paths and values of the numeric leaves of one JSON text, in its order, at any depth that can be read; of what isn't JSON none."""
    try:
        value = json.loads(text, object_pairs_hook=_once, parse_constant=_no_constant) if text is not None else None
    except (ValueError, RecursionError):
        return
    left = [(prefix, value)]
    while left:
        path, value = left.pop()
        if isinstance(value, dict | list):
            items = value.items() if isinstance(value, dict) else enumerate(value)
            left.extend([(f"{path}.{k}", v) for k, v in items][::-1])
        elif isinstance(value, int | float) and not isinstance(value, bool):
            try:
                yield path, float(value)
            except OverflowError:  # a whole number beyond all doubles
                continue


def nested_leaves(df: DataFrame, json_col: str, keys: list[str], prefix: str = "output") -> DataFrame:
    """Numeric leaves of a JSON column as (keys, tensor_path, value): dotted paths, list places from 0; other leaves are dropped.

    One narrow stage that reads each row once, whatever the depth: objects and lists are walked without recursion. Text that isn't
    JSON, an object with a name twice, and null have no leaves.
    """
    rows = df.select(*keys, F.col(json_col).cast("string").alias("_json"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("tensor_path", T.StringType()), T.StructField("value", T.DoubleType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, at: list[int], paths: list[str], values: list[float]) -> pa.RecordBatch:
            rows = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:-1]), pa.array(paths, pa.string()), pa.array(values, pa.float64())], names=schema.names)

        for batch in batches:
            at: list[int] = []
            paths: list[str] = []
            values: list[float] = []
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                for path, value in leaves_of(text.as_py(), prefix):
                    at.append(i)
                    paths.append(path)
                    values.append(value)
                    if len(at) == _LEAVES:
                        yield made(batch, at, paths, values)
                        at, paths, values = [], [], []
            if at:
                yield made(batch, at, paths, values)

    return rows.mapInArrow(walk, schema)
