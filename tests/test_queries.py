"""Every registered query of the engine against its SQL."""

import math
import os

import duckdb
import pytest

from tidemark.plans import catalog, catalog_long, catalog_more, catalog_parts, catalog_streams  # noqa: F401  the others add their queries

SF = os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        return f"{float(x):.9g}" if isinstance(x, int | float) and not isinstance(x, bool) else str(x)

    return sorted(tuple(value(x) for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = plain(tuple(r[c] for c in cols) for r in df.collect())
    rel = duck.execute(catalog.ORACLES[name])
    have = [d[0] for d in rel.description]
    assert sorted(have) == cols
    want = plain(tuple(r[have.index(c)] for c in cols) for r in rel.fetchall())
    assert found == want and (found or name.startswith("rule"))


def test_every_query_is_known():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 45
