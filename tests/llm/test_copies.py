"""Copies of texts in the counts of the quality classifier."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality


@pytest.mark.parametrize("most", [0, 1, 3])
def test_all_copies_count_as_one_text(spark, monkeypatch, most):
    """Whether a text's copies are told by the broadcast or by the join: 9 texts with 2 to 10 copies each, two of them null and empty, and 5 texts without any."""
    texts = [None, "", *(f"text {k} of many words" for k in range(2, 9))]
    rows = [t for k, t in enumerate(texts) for _ in range(k + 2)] + [f"alone {k}" for k in range(5)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    target = spark.range(60).where("id % 3 = 0").select(F.col("id").alias("target_id"))
    found = lambda: sorted(map(tuple, quality.counts(docs, "text", target, "doc_id").collect()))
    want = found()
    monkeypatch.setattr(quality, "MOST_COPIED", most)
    assert found() == want
    once = quality.counts(spark.createDataFrame(list(enumerate({*rows})), docs.schema), "text", target.limit(0), "doc_id")
    raw = {r["bucket"]: r["raw"] for r in once.collect()}
    assert {b: round(n / quality.UNIT, 3) for b, n, _ in want} == {b: round(n / quality.UNIT, 3) for b, n in raw.items()}
