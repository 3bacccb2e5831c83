"""The recording log: the last call of a key wins, before and after a merge."""

import random

import pytest

from proofline.sources import recordings as RL


def _calls(spark, rows):
    return spark.createDataFrame(rows, "kind STRING, key STRING, request STRING, response STRING, position INT")


def test_the_last_call_of_a_key_wins_whenever_runs_are_merged(spark, tmp_path):
    draw = random.Random(5)
    path = str(tmp_path / "log")
    assert RL.read_calls(spark, path).count() == 0 and RL.compact(spark, path) == 0
    wanted = {}
    for step in range(5):
        rows = []
        for position in range(30):
            kind, key = draw.choice("ab"), f"k{draw.randint(0, 20)}"
            response = None if draw.random() < 0.1 else f"{step}/{position}"
            rows.append((kind, key, "{}", response, position))
            wanted[kind, key] = response
        draw.shuffle(rows)
        RL.append_calls(_calls(spark, rows), path)
        if step in (1, 2):
            RL.compact(spark, path)
        got = RL.read_calls(spark, path).collect()
        assert len(got) == len(wanted) and {(r.kind, r.key): r.response for r in got} == wanted
    before = RL.compact(spark, path)
    assert RL.compact(spark, path) == before
    assert {(r.kind, r.key): r.response for r in RL.read_calls(spark, path).collect()} == wanted


def test_a_run_without_its_log_row_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    RL.append_calls(_calls(spark, [("a", "k", "{}", "1", 0)]), path)
    known = RL._log(spark, path)
    RL.append_calls(_calls(spark, [("a", "k", "{}", "2", 0)]), path)
    monkeypatch.setattr(RL, "_log", lambda *_: known)  # a writer that has not seen the second run
    with pytest.raises(Exception, match="already exists"):
        RL.append_calls(_calls(spark, [("a", "k", "{}", "3", 0)]), path)
    monkeypatch.undo()
    assert [r.response for r in RL.read_calls(spark, path).collect()] == ["2"]
