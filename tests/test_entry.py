"""The entry module with and without the corpus operators."""

import importlib
import importlib.abc
import sys

import __spark_entry__ as entry
from tidemark.plans import catalog


def test_oracles_belong_to_queries(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())


class Missing(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tidemark.llm"):
            raise ModuleNotFoundError(name=name)


def test_the_rest_works_without_them(spark, monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("tidemark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    finder = Missing()
    sys.meta_path.insert(0, finder)
    try:
        alone = importlib.reload(entry)
        assert set(alone.queries()) == set(catalog.QUERIES) and alone.queries()["stats_moments"]
    finally:
        sys.meta_path.remove(finder)
        importlib.reload(entry)
