import os

import duckdb
import pytest
from pyspark.sql import functions as F

import brute as B
import corpus_pipeline as P
from tidemark.llm import entries
from test_operators import clashing

TABLES = "documents pages benchmark labels conversations embeddings".split()


@pytest.mark.parametrize("name", list(entries.QUERIES))
def test_every_query_returns_all_rows(spark, tables, name):
    op = name.split("_")[0]
    table = {"op1": "conversations", "op4": "pages", "op11": "pages", "op13": "embeddings"}.get(op, "documents")
    n = spark.read.parquet(f"{tables}/{table}.parquet")
    want = n.select("conv_id").distinct().count() + 1 if table == "conversations" else n.count() * (32 if op == "op13" else 1)
    df = entries.QUERIES[name](spark, tables)
    assert op == "op12" or df.count() == want
    if name in entries.ORACLES:
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{tables}/{t}.parquet'")
        rel = c.execute(entries.ORACLES[name])
        cols = [d[0] for d in rel.description]
        assert sorted(cols) == sorted(df.columns) and sorted(map(str, (tuple(r[x] for x in cols) for r in df.collect()))) == sorted(map(str, rel.fetchall()))


def test_contracts_on_the_test_tables(spark, tables):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    q = {name.split("_")[0]: f for name, f in entries.QUERIES.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in q["op2"](spark, tables).collect()}
    assert got == B.jaccard(docs)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in q["op7"](spark, tables).collect()}
    assert got == {i: (*w[:3], B.sha(w[3])) for (i, _), w in zip(docs, B.repeats([t for _, t in docs], 400), strict=True)}
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in q["op10"](spark, tables).collect()}
    items = [(None if i is None else str(i), t) for i, t in bench]
    want = {i: B.benchmark(t, items) for i, t in docs}
    assert got == {i: (n, len(h), len(x), B.sha(",".join(x)), bool(h)) for i, (n, h, x) in want.items()}
    got = {r["doc_id"]: (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in q["op9"](spark, tables).collect()}
    assert got == {i: (h, n, k, t, round(b, 5)) for i, h, n, k, t, b in B.lm_base(docs)}


def test_suffix_dedup_returns_what_stays(spark, tables):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["text"] for r in entries.QUERIES["op7_suffix_dedup"](spark, tables).select("doc_id", "text").collect()}
    assert got == {i: w[3].decode(errors="ignore") for (i, _), w in zip(docs, B.repeats([t for _, t in docs], 400), strict=True)}


def test_pipeline_against_its_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in P.STAGES:
        kept.append(stage(spark, kept[-1], tables).cache())
        if name != P.STAGES[-1][0]:
            assert kept[-1].columns == columns, name
    rows = [[(r["doc_id"], r["text"]) for r in k.select("doc_id", "text").collect()] for k in kept[:-1]]
    one_each = {c if n else i for i, (n, c) in B.jaccard(rows[1]).items()}
    assert sorted(i for i, _ in rows[2]) == sorted(one_each)
    cut = {i: w[3].decode(errors="ignore") for (i, _), w in zip(rows[2], B.repeats([t for _, t in rows[2]], P.PASSAGE_BYTES, P.PASSAGE_WORDS), strict=True) if w[3] or not w[0]}
    assert {i: t or "" for i, t in rows[3]} == cut
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    assert sorted(i for i, _ in rows[4]) == sorted(i for i, t in rows[3] if not B.benchmark(t, items)[1])
    mixed = {r["doc_id"]: r for r in kept[-1].collect()}
    assert set(mixed) == {i for i, _ in rows[4]} and all(r["taken"] <= 3 * r["size"] for r in mixed.values())
    assert sorted(r["doc_id"] for r in P.run(spark, tables).collect()) == sorted(mixed)


def test_stages_bear_clashing_columns_and_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(40)
    wide = clashing(docs).join(docs.drop("text"), "doc_id").withColumn("_set", F.lit(1))
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, wide, tables).columns == wide.columns
        assert stage(spark, docs.limit(0), tables).count() == 0
    assert P.STAGES[-1][1](spark, wide, tables).count() == 40
    assert os.path.exists(P.__file__)
