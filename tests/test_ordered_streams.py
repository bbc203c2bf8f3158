"""Streams of a table whose files lie in another order than its rows."""

import pytest
from pyspark.sql import functions as F

from helpers import TENSORS, same, tensor_rows
from tidemark.model import SERIES, IndicatorConfig
from tidemark.operators.indicators import names, series_of
from tidemark.operators.reduce import long_form, reduce_tensors
from tidemark.plans import catalog, catalog_parts, catalog_streams
from tidemark.sources.tables import stream_in_order
from tidemark.streaming import live


@pytest.mark.parametrize("rows, batches", [(1000, 1), (15, 4)])
def test_a_stream_comes_in_the_order_of_its_column(spark, tmp_path, rows, batches):
    """Files that hold every third row, the last rows written first; the series are those of the batch, whether one micro-batch holds all or not."""
    config = IndicatorConfig(temporal_metrics=("rms",))
    made = tensor_rows([[(i * i) % 11, i % 5] for i in range(60)], module="a")
    for k in (2, 1, 0):
        spark.createDataFrame([r for r in made if r[5] % 3 == k][::-1], TENSORS).coalesce(1).write.mode("append").parquet(str(tmp_path / "tensors.parquet"))
    stream = stream_in_order(spark, str(tmp_path), "tensors", "sample_id", rows)
    seen = []
    query = stream.writeStream.foreachBatch(lambda b, i: seen.append(b.agg(F.min("sample_id"), F.max("sample_id")).first())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "seen")).start()
    query.awaitTermination()
    assert len(seen) == batches and all(a[1] < b[0] for a, b in zip(seen, seen[1:], strict=False))
    found = live.run_to_table(live.stream_series(live.stream_statistics(stream, config), config), SERIES).first()
    want = series_of(long_form(reduce_tensors(spark.read.parquet(str(tmp_path / "tensors.parquet")), ["rms"]), ["rms"]), config).first()
    assert found["count"] == want["count"] == 60
    assert all(same(found[n], want[n], 1e-7) for n in names(config))


def test_queries_of_streams_do_not_depend_on_files(spark, tmp_path):
    """The vectors in one file and in four, the last rows written first: the same rows."""
    rows = [(i, [((i * 7) % 13) / 13 - 0.5] * 3 + [i / 200], i % 3) for i in range(200)]
    for k in (3, 2, 1, 0):
        part = spark.createDataFrame([r for r in rows if r[0] // 50 == k], "vec_id long, embedding array<float>, label int").coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "many" / "embeddings.parquet"))
    spark.read.parquet(str(tmp_path / "many" / "embeddings.parquet")).coalesce(1).write.parquet(str(tmp_path / "one" / "embeddings.parquet"))
    for query in (catalog.stream_series, catalog_parts.stream_timed, catalog_streams.stream_bounded):
        many, one = (sorted(map(str, query(spark, str(tmp_path / n)).collect())) for n in ("many", "one"))
        assert many == one and many
