import importlib.util
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def loaded():
    spec = importlib.util.spec_from_file_location("entry_under_test", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_entry_gives_rows(spark):
    entry = loaded()
    df = entry.entry(spark)
    assert df.columns == ["type", "n", "crops", "chars", "outside"] and df.count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("quire.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quire.llm", None)
    import quire

    monkeypatch.delattr(quire, "llm", raising=False)
    entry = loaded()
    assert entry.llm_queries is None and "block_summary" in entry.queries()
    assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in entry.queries())
