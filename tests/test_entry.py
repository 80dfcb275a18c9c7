import importlib
import sys

import __spark_entry__


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_training_data_operators(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("kotoflow.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "kotoflow.llm", None)
    try:
        entry = importlib.reload(__spark_entry__)
        names = set(entry.queries())
        assert "phoneme_counts" in names and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names)
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_library_does_not_import_llm():
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent / "kotoflow"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "kotoflow.llm" not in p.read_text(encoding="utf-8"), p
