import importlib.util

import __spark_entry__ as entry


def test_queries_without_the_pipeline_operators(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("codeloom.llm") else find(name, *a))
    names = entry.queries()
    assert "deps_reverse" in names and "pipeline" not in names and not any(n.startswith("op1") for n in names)
    assert set(entry.oracle_sql()) <= set(names)
