"""What a worker keeps goes when it keeps something else."""

from feedloom.llm import common


def test_memory_goes_back_with_what_was_kept(monkeypatch):
    released = []
    monkeypatch.setattr(common, "_KEPT", {})
    monkeypatch.setattr(common, "release_memory", lambda: released.append(dict(common._KEPT)))
    assert common.kept(("a",), lambda: 1) == 1 and common.kept(("a",), lambda: 2) == 1
    assert common.kept(("b",), lambda: 3) == 3
    assert released == [{}, {}] and common._KEPT == {("b",): 3}


def test_memory_can_be_released():
    common.release_memory()
