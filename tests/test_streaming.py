"""Completion over a stream: late results, restarts, lists, and work that does not grow with what came earlier."""

import random
from pathlib import Path

import pandas as pd
import pytest

from entityspark.operators import merge
from entityspark.streaming import completion

SCHEMA = "uuid string, record_count long, ord long, name string"
LISTS = SCHEMA + ", tags array<string>"


@pytest.mark.parametrize("lists", [(), ("tags",)])
def test_late_results_reopen_a_key(spark, tmp_path, lists):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [("k", 1, 2, "late", ["b", None]), ("m", 2, 1, "", None), (None, 1, 1, "no key", None), ("o", None, 1, "orphan", ["z"])]
    second = [("k", 2, 1, "early", ["a", "b"]), ("m", 2, 2, "M", []), ("n", 9, 1, "x", ["x"])]
    for k, rows in enumerate((first, second)):  # every run is a restart from the checkpoint
        df = spark.createDataFrame(rows, LISTS)
        df.select(*(LISTS if lists else SCHEMA).replace(" string", "").replace(" long", "").replace(" array<>", "").split(", ")[:4], *lists).write.mode("append").parquet(source)
        completion.run_available(spark, source, LISTS if lists else SCHEMA, out, f"{out}/checkpoint", ["name"], lists)
        got = {r["uuid"]: (r["n_records"], r["name"]) for r in completion.latest(spark, out).collect()}
        assert got == ({"k": (1, "late")}, {"k": (2, "early"), "m": (2, "M")})[k]
    if lists:
        assert {r["uuid"]: r["tags"] for r in completion.latest(spark, out).collect()} == {"k": ["a", "b"], "m": []}
    assert completion.progress(spark, out).first().asDict() == {"n_results": 6, "n_keys": 4, "n_completed": 2, "n_versions": 3}
    seen = spark.createDataFrame([("k", 0)], "uuid string, version long")
    assert {r["uuid"]: r["n_records"] for r in completion.restore(spark, out, seen).collect()} == {"k": 2, "m": 2, "o": 1}
    assert [r["uuid"] for r in completion.finalize(spark, out, seen).collect()] == ["m"]


def test_nothing_to_read(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    completion.run_available(spark, source, SCHEMA, out, f"{out}/checkpoint", ["name"])


@pytest.mark.parametrize("lists, batches", [((), 40), (("tags",), 12)])
def test_work_of_a_batch_stays_flat(spark, tmp_path, lists, batches):
    """Each batch touches five keys of all that there are by then: rows read and states written do not grow."""
    r, source, out, rows = random.Random(1), tmp_path / "in", str(tmp_path / "out"), []
    for b in range(batches):
        part = [(f"k{x}", 1, 1000 * b + i, r.choice(["", "n", "m"]), [r.choice("abc") for _ in range(3)]) for i, x in enumerate(r.sample(range(5 * b + 5), 5))]
        rows += part
        df = spark.createDataFrame(part, LISTS).coalesce(1)
        (df if lists else df.drop("tags")).write.mode("append").parquet(str(source))
    done = completion.run_available(spark, str(source), LISTS if lists else SCHEMA, out, f"{out}/checkpoint", ["name"], lists, max_files=1)
    seen = [p for p in done.recentProgress if p["numInputRows"]]
    assert len(seen) == batches and {p["numInputRows"] for p in seen} == {5}
    assert max(p["stateOperators"][0]["numRowsUpdated"] for p in seen) <= 5
    assert seen[-1]["stateOperators"][0]["numRowsTotal"] == len({x[0] for x in rows}) > 5
    assert [p.name for p in Path(out).iterdir() if p.name != "checkpoint"] == ["entities"]
    every = spark.createDataFrame(rows, LISTS)
    want = {x["uuid"]: x for x in merge.entity_merge(every, "uuid", "ord", ["name"], list(lists)).collect()}
    got = {x["uuid"]: x for x in completion.latest(spark, out).collect()}
    assert {k: (x["n_records"], x["name"], *(x[c] for c in lists)) for k, x in got.items()} == {k: (x["n_records"], x["name"], *(x[c] for c in lists)) for k, x in want.items()}


class Held:
    """A map state and what is asked of it."""

    def __init__(self):
        self.of, self.asked = {}, []

    def getMapState(self, *_):  # noqa: N802
        return self

    def exists(self):
        return bool(self.of)

    def getValue(self, key):  # noqa: N802
        self.asked.append(("get", key[0]))
        return self.of.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.asked.append(("put", key[0]))
        self.of[key] = value


def test_keys_of_a_bucket_are_one_call():
    """One frame for all keys of a call; only the keys that it touches are read and written, each once."""
    merging, held = completion.Merging(["name"], ["tags"]), Held()
    merging.init(held)
    part = lambda keys, order: pd.DataFrame([(f"k{i}", 3.0 if i else None, order, "" if i % 2 else f"n{order}", [f"t{order}", None, "x"]) for i in keys], columns=["uuid", "record_count", "ord", "name", "tags"])
    (first,) = merging.handleInputRows((0,), iter([part(range(1000), 7), part(range(500), 5)]), None)
    assert len(first) == 1000 and sorted(held.asked) == sorted(("put", f"k{i}") for i in range(1000))
    held.asked.clear()
    (late,) = merging.handleInputRows((0,), iter([part((0, 1, 700, 2000), 6)]), None)
    assert sorted(held.asked) == sorted((what, f"k{i}") for what in ("get", "put") for i in (0, 1, 700, 2000))
    got = {r.uuid: (r.n_records, r.record_count, r.name_, r.tags) for r in late.rename(columns={"name": "name_"}).itertuples()}
    assert got["k0"][0] == 3 and pd.isna(got["k0"][1]) and got["k0"][2:] == ("n5", ["t5", "x", "t6", "t7"])
    assert got["k1"] == (3, 3, None, ["t5", "x", "t6", "t7"]) and got["k700"] == (2, 3, "n6", ["t6", "x", "t7"]) and got["k2000"] == (1, 3, "n6", ["t6", "x"])
