"""The registry without its optional parts."""

import __spark_entry__ as entry
from souk.registry import queries


def test_registry_without_the_training_data_package(monkeypatch):
    present = entry._present
    monkeypatch.setattr(entry, "_present", lambda m: m != "souk.llm" and present(m))
    assert set(entry.queries()) == set(queries())
    assert not any(k.startswith("op") and k[2].isdigit() for k in entry.oracle_sql())


def test_registry_without_the_pipeline(monkeypatch):
    present = entry._present
    monkeypatch.setattr(entry, "_present", lambda m: m != "corpus_pipeline" and present(m))
    assert "pipeline" not in entry.queries()


def test_emptied_folder_is_no_module(tmp_path, monkeypatch):
    (tmp_path / "souk_emptied").mkdir()
    monkeypatch.syspath_prepend(str(tmp_path))
    assert not entry._present("souk_emptied")
