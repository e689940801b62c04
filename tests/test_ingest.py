"""Ingest against a state: plans, edited and failed files, calls at once, deletion of what was replaced."""

import threading
from pathlib import Path

import pytest

from entityspark.operators import ingest


def test_ingest_against_a_state(spark, tmp_path):
    source, state = tmp_path / "in put", str(tmp_path / "state")
    source.mkdir()

    def run(force=False, **texts):
        for name, text in texts.items():
            (source / f"{name}.csv").write_text("email,n\n" + text)
        plan = {r["file_path"].rsplit("/", 1)[-1]: r["action"] for r in ingest.ingest_new(spark, str(source), ["email", "n"], state, force=force).collect()}
        return plan, sorted(r["n"] for r in ingest.current_rows(spark, state).collect())

    assert run(a="x@y.zz,1\n", b="x@y.zz,2\nbad\n", e="") == ({"a.csv": "ingest", "b.csv": "ingest", "e.csv": "ingest"}, ["1"])
    assert run(c="x@y.zz,1\n") == ({"a.csv": "skip", "b.csv": "replace_failed", "c.csv": "skip", "e.csv": "skip"}, ["1"])
    assert run(a="x@y.zz,3\n", b="x@y.zz,2\n")[0] == {"a.csv": "reject", "b.csv": "reject", "c.csv": "skip", "e.csv": "skip"}
    assert run(force=True) == ({"a.csv": "reingest", "b.csv": "reingest", "c.csv": "skip", "e.csv": "skip"}, ["2", "3"])
    assert run()[0]["c.csv"] == "ingest" and run() == ({f"{x}.csv": "skip" for x in "abce"}, ["1", "2", "3"])


def write(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text("email,n\n" + text)


def rows_of(spark, state):
    return sorted(r["n"] for r in ingest.current_rows(spark, state).collect())


def test_only_one_commit_of_a_version(spark, tmp_path):
    state = str(tmp_path / "state")
    assert ingest.commit(spark, state, 1, "a") and not ingest.commit(spark, state, 1, "b") and ingest.commit(spark, state, 2, "c")
    assert ingest.committed(spark, state)[0] == 2
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["commits"]


def test_a_call_that_comes_second_plans_anew(spark, tmp_path, monkeypatch):
    """Another call commits between this one's plan and its commit: nothing is lost, nothing is there twice."""
    source, state = tmp_path / "in", str(tmp_path / "state")
    write(source, a="x@y.zz,1\n", b="x@y.zz,2\n")
    own, calls = ingest.commit, []

    def late(*args):
        calls.append(args)
        if len(calls) == 1:
            monkeypatch.setattr(ingest, "commit", own)
            ingest.ingest_new(spark, str(source / "a.csv"), ["email", "n"], state)
            monkeypatch.setattr(ingest, "commit", late)
        return own(*args)

    monkeypatch.setattr(ingest, "commit", late)
    plan = {r["file_path"].rsplit("/", 1)[-1]: r["action"] for r in ingest.ingest_new(spark, str(source), ["email", "n"], state).collect()}
    assert plan == {"a.csv": "skip", "b.csv": "ingest"} and len(calls) == 2
    assert rows_of(spark, state) == ["1", "2"] and ingest.committed(spark, state)[0] == 2
    monkeypatch.setattr(ingest, "commit", lambda *args: False)
    write(source, c="x@y.zz,3\n")
    with pytest.raises(ingest.Conflict):
        ingest.ingest_new(spark, str(source), ["email", "n"], state, attempts=2)
    assert rows_of(spark, state) == ["1", "2"]


def test_calls_at_once(spark, tmp_path):
    source, state, failed = tmp_path / "in", str(tmp_path / "state"), []
    write(source, a="x@y.zz,1\n", b="x@y.zz,2\n", c="x@y.zz,3\n")

    def run(name):
        try:
            ingest.ingest_new(spark, str(source / f"{name}.csv"), ["email", "n"], state)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=run, args=(n,)) for n in ("a", "b", "c", "a")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and rows_of(spark, state) == ["1", "2", "3"]


def test_replaced_rows_are_deleted(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    write(source, a="x@y.zz,1\n", b="x@y.zz,2\n")
    ingest.ingest_new(spark, str(source), ["email", "n"], state)
    write(source, a="x@y.zz,9\n", c="x@y.zz,3\nbad\n")
    ingest.ingest_new(spark, str(source), ["email", "n"], state, force=True)
    assert rows_of(spark, state) == ["2", "9"]
    assert ingest.vacuum(spark, state) == 1 and rows_of(spark, state) == ["2", "9"]
    stored = spark.read.parquet(f"{state}/rows")
    assert sorted(r["n"] for r in stored.collect()) == ["2", "3", "9"]
    write(source, c="x@y.zz,4\n", a="x@y.zz,8\n")
    ingest.ingest_new(spark, str(source), ["email", "n"], state, force=True)
    assert rows_of(spark, state) == ["2", "4", "8"]
    assert ingest.vacuum(spark, state) == 1 and rows_of(spark, state) == ["2", "4", "8"] and ingest.vacuum(spark, state) == 0
    assert len(list(Path(state, "rows").glob("ingest_id=*"))) == 2
    plan = {r["file_path"].rsplit("/", 1)[-1]: r["action"] for r in ingest.ingest_new(spark, str(source), ["email", "n"], state).collect()}
    assert set(plan.values()) == {"skip"}
