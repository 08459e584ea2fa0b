"""The driver's entry points, with and without the training-text operators."""

from __future__ import annotations

import sys

import __spark_entry__ as entry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "salience" in df.columns


def test_without_training_text_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("convmem.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "convmem.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = entry.queries()
    assert "flagship_top_chunks" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= set(names)


def test_names_are_known_without_a_session():
    """The queries can be listed before Spark has started."""
    import subprocess
    from pathlib import Path

    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
