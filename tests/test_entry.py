import importlib
import sys

import __spark_entry__ as e


def test_names_and_oracles():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100


def test_without_the_optional_subpackage(monkeypatch):
    """As where its folder is gone: importing it fails."""
    monkeypatch.setitem(sys.modules, "framewright.llm", None)
    q, o = e.queries(), e.oracle_sql()
    assert q and not [n for n in q if n.startswith("op") and n[2].isdigit()] and "pipeline" not in q and set(o) <= set(q)
