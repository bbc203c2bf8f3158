"""Helpers shared by the operators: written tables in the shared folder, and Arrow batches cut by bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a task works on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 19
#: Bytes of an Arrow batch, a longer row being one of its own, and the setting of Spark's that bounds them.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Whitespace words: bytes other than space and 0x09-0x0D (a Java pattern).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one of a local session, as in tests. A cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        jvm = context._jsc.sc().getCheckpointDir()
        if jvm.isDefined():
            found = jvm.get()
        elif context.master.split("[")[0] == "local":
            context.setCheckpointDir(found := tempfile.mkdtemp(prefix="tidemark-"))
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found.rstrip("/")


#: The folder for written tables of the surrounding own_tables().
_scope: ContextVar[str] = ContextVar("scope", default="kept")


@contextmanager
def own_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that written() makes inside are deleted at the end: for work whose result is written before it."""
    name = _scope.set(f"scope-{uuid.uuid4().hex[:12]}")
    try:
        yield
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _scope.reset(name)


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidemark-{spark.sparkContext.applicationId}/{_scope.get()}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so lost executors cost no recomputation.

    The tables of an application lie under <shared folder>/tidemark-<application id>; own_tables() removes those made inside it.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{what}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(table: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more, such as the last state of an iteration."""
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._written)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches where the bound is larger: rows alone bound nothing, as texts may be long."""
    found = spark.conf.get(BATCH_SETTING).rstrip("b")
    if not found.isdigit() or not 0 < int(found) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def release() -> None:
    """Give the memory that a task has freed back to the system: Python workers stay between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of bounded size, whose workers keep no memory that they don't use."""
    bounded_batches(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names in any case: what an operator adds replaces a column of the same name."""
    low = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def pieces(batch: pa.RecordBatch, text_at: int, most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in runs of rows with about `most` bytes of text, each with its texts (null: empty)."""
    texts = pc.fill_null(batch.column(text_at).cast(pa.large_string()), "")
    lengths = pc.binary_length(texts).to_pylist()
    begin = size = 0
    for i, n in enumerate(lengths):
        if i > begin and size + n > most:
            yield batch.slice(begin, i - begin), texts.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield batch.slice(begin), texts.slice(begin)


def map_texts(df: DataFrame, text_col: str, added: T.StructType, make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """Every row of df with the added columns, computed from its text by Arrow batches in one narrow stage.

    make() runs once a task and returns the function from texts to arrays in the order of `added`.
    Added columns replace columns of the same name. A null text counts as empty.
    """
    kept = without(df, *added.names)
    at = kept.columns.index(text_col) if text_col in kept.columns else None
    if at is None:
        raise ValueError(f"no text column {text_col!r} among {kept.columns}")
    schema = T.StructType(list(kept.schema.fields) + list(added.fields))
    names = list(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for piece, texts in pieces(batch, at):
                yield pa.RecordBatch.from_arrays([*piece.columns, *compute(texts)], names=names)

    return arrow_map(kept, run, schema)


def word_count(text: Column) -> Column:
    """Whitespace words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
