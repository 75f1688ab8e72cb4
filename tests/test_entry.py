import importlib
import sys


def test_works_without_the_training_data_folders(spark, monkeypatch):
    for name in [m for m in sys.modules if m.startswith("siftwork.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "siftwork.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as entry

    entry = importlib.reload(entry)
    assert entry.llm is None and entry.corpus_pipeline is None
    assert len(entry.queries()) > 60 and set(entry.oracle_sql()) <= set(entry.queries())
    assert not any(k.startswith("op") and k[2].isdigit() for k in entry.queries())
    assert entry.entry(spark).count() > 0
    monkeypatch.undo()
    importlib.reload(entry)
