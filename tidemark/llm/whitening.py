"""Embedding whitening: covariance by MLlib's RowMatrix over exactly centred rows (operator 13).

1. Entries become integers, x = floor(scale * entry) + shift, in one narrow stage, and are written.
2. n and the sums S of every dimension are integers: each task adds its own, an aggregation of one row a task and dimension adds those.
3. n*x - S is an integer too; divided by n it is the centred row, rounded once. RowMatrix.computeGramianMatrix() over these rows,
   divided by n, is the covariance. Its eigenvectors come from numpy's eigh on the driver.
4. The components are broadcast; mapInPandas projects the centred rows on them. Covariance and mean of what comes out are
   measured in the same way and compared to the identity.

On the driver and in the broadcast stand matrices of the vectors' dimension only, never rows.

Defined cases: a vector that is null, or holds a null or an entry that isn't finite, is left out of the fit and the result. A fit has one
dimension: the length that most of the vectors have, the larger of equally frequent ones; vectors of other lengths and empty ones are left out
like invalid ones. Ids may be null or repeated; every row counts. Without vectors the result is empty. A component
without variance (below dimension * 2**-52 of the largest one) projects to 0 and explains 0; it is left out of the identity error, as nothing can scale it to 1.
Entries beyond 2**62, and deviations that no long holds, are errors rather than wrong numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import arrow_map, bounded_batches, written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Rows of a batch that is worked on at once.
ROWS = 4096
_LARGEST = 2.0**62


def integer_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, x (array<long>) of the vectors that hold finite entries only, written."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("entries"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column(1)), pc.greater(pc.fill_null(pc.list_value_length(batch.column(1)), 0), 0)))
            lists = batch.column(1)
            flat = lists.flatten()
            entries = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            bad = np.add.reduceat((~np.isfinite(entries)).astype(np.int64), np.cumsum(lengths) - lengths) if len(lengths) else lengths
            good = bad == 0
            scaled = np.floor(entries[np.repeat(good, lengths)] * scale)
            if len(scaled) and np.abs(scaled).max() >= _LARGEST:
                raise ArithmeticError("an entry is beyond the range of integers")
            offsets = np.concatenate([[0], np.cumsum(lengths[good])]).astype(np.int32)
            x = pa.ListArray.from_arrays(pa.array(offsets), pa.array(scaled.astype(np.int64) + shift))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), x], names=["vec_id", "x"])

    return written(arrow_map(rows, whole, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, x array<long>"), "integers")


def of_one_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows whose x has the most frequent length, and that length; 0 without rows."""
    found = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    d = found[0]["d"] if found else 0
    return rows.where(F.size("x") == d), d


def sums(rows: DataFrame, column: str, d: int) -> list:
    """The sums of the entries by dimension: of one row a task, so that no entry is a row of its own."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for batch in batches:
            total = total + _matrix(batch.column(0), d).sum(axis=0)
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["total"])

    kind = rows.schema[column].dataType.elementType.simpleString()
    each = arrow_map(rows.select(column), added, f"total array<{kind}>").select(F.posexplode("total").alias("k", "part"))
    found = dict(each.groupBy("k").agg(F.sum("part")).collect())  # d rows
    return [found[k] for k in range(d)]


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def covariance(centred: DataFrame, column: str, n: int) -> np.ndarray:
    """The rows' Gramian matrix over n, by RowMatrix."""
    vectors = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector(column).alias("row")), "row")
    return RowMatrix(vectors).computeGramianMatrix().toArray() / n


@dataclass(frozen=True)
class Whitening:
    """A fit: n, the sums of every dimension, all eigenvalues and the unit components that are used, both by falling eigenvalue."""

    n: int
    totals: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        """One column a component: what a centred row is multiplied by."""
        used = self.eigenvalues[: self.components.shape[1]]
        real = self.has_variance
        return self.components * np.where(real, 1 / np.sqrt(np.where(real, used, 1)), 0)

    @property
    def has_variance(self) -> np.ndarray:
        used = self.eigenvalues[: self.components.shape[1]]
        return used > len(self.totals) * 2.0**-52 * max(self.eigenvalues[0], 0)

    @property
    def explained(self) -> list[float]:
        return [float(e) if real else 0.0 for e, real in zip(self.eigenvalues[: self.components.shape[1]] / max(self.eigenvalues.sum(), 2.0**-1000), self.has_variance, strict=True)]


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of the rows (vec_id, x) of d entries each; there must be some."""
    n = rows.count()
    totals = sums(rows, "x", d)

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = centred_integers(_matrix(batch.column(0), d), n, totals) / n
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, d, dtype=np.int32)), pa.array(c.ravel()))], names=["c"])

    values, vectors = np.linalg.eigh(covariance(arrow_map(rows.select("x"), centre, "c array<double>"), "c", n))
    return Whitening(n, totals, values[::-1].copy(), vectors[:, ::-1][:, : min(components, d)].copy())


def centred_integers(x: np.ndarray, n: int, totals: list[int]) -> np.ndarray:
    """n*x - S, exact."""
    if len(x) and max(float(np.abs(x.astype(np.float64)).max()) * n, *(abs(float(t)) for t in totals)) >= _LARGEST:
        raise ArithmeticError("the centred rows are beyond the range of integers")
    return x * n - np.array(totals, np.int64)


def project(rows: DataFrame, found: Whitening) -> DataFrame:
    """vec_id, deviation (the sum of (n*x - S)**2, exact), whitened (array<double>, by component), for every row."""
    bounded_batches(rows.sparkSession)
    model = rows.sparkSession.sparkContext.broadcast((found.n, found.totals, found.weights))  # d * components doubles

    def whiten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, totals, weights = model.value
        for frame in frames:
            for at in range(0, len(frame), ROWS):
                part = frame.iloc[at : at + ROWS]
                c = centred_integers(np.stack(part["x"].to_numpy()), n, totals)
                if (c.astype(np.float64) ** 2).sum(axis=1).max() >= _LARGEST:
                    raise ArithmeticError("a deviation is beyond the range of a long")
                yield pd.DataFrame({"vec_id": part["vec_id"], "deviation": (c * c).sum(axis=1), "whitened": list(c / n @ weights)})

    return rows.select("vec_id", "x").mapInPandas(whiten, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, found: Whitening) -> float:
    """The largest absolute entry of the covariance of `whitened`, centred, minus the identity, over components with variance."""
    k = found.components.shape[1]
    mean = np.array(sums(whitened, "whitened", k)) / found.n

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _matrix(batch.column(0), k) - mean
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, k, dtype=np.int32)), pa.array(c.ravel()))], names=["c"])

    real = found.has_variance
    off = (covariance(arrow_map(whitened.select("whitened"), centre, "c array<double>"), "c", found.n) - np.eye(k))[np.ix_(real, real)]
    return float(np.abs(off).max()) if off.size else 0.0


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for every valid vector and component."""
    integers = integer_rows(vectors, id_col, vector_col, scale, shift)
    rows, d = of_one_length(integers)
    if not d:
        found, table, error = Whitening(0, [], np.zeros(1), np.zeros((0, 0))), integers.select("vec_id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), 0.0
    else:
        found = fit(rows, d, components)
        table = written(project(rows, found), "whitened")
        error = identity_error(table, found)
    explained = F.array(*map(F.lit, found.explained)).cast("array<double>")
    return table.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"),
    )
