"""Ordered identities against one sequential pass."""

import random

import pytest
from pyspark.sql import functions as F

from entityspark.operators import identity

ROWS = "row_id long, ord long, id_values array<string>"


def check(spark, rows, aliases=None):
    given = spark.createDataFrame(rows, ROWS).repartition(5)
    known = None if aliases is None else spark.createDataFrame(list(aliases.items()), "value string, uuid string")
    got = {r["row_id"]: (r["uuid"], r["event"]) for r in identity.assign_identity(given, aliases=known).collect()}
    turns = sorted(rows, key=lambda r: (r[1], r[0]))
    want = identity.sequential(((i, [v for v in values or [] if v is not None]) for i, _, values in turns), aliases)
    want |= {i: (identity.v5(f"row:{i}"), "random") for i, _, values in rows if not any(v is not None for v in values or [])}
    assert got == want
    return got


@pytest.mark.parametrize("values, seed", [(12, 1), (60, 2), (400, 3)])
def test_random_rows(spark, monkeypatch, values, seed):
    monkeypatch.setattr(identity, "RANGE_ROWS", 50)
    r = random.Random(seed)
    rows = [(i, r.randrange(300), [f"v{r.randrange(values)}" for _ in range(r.randrange(4))]) for i in range(300)]
    check(spark, rows)
    check(spark, rows, {f"v{i}": f"u{i % 5}" for i in range(0, values, 3)} | {"absent": "u"})


def test_aliases_come_first(spark):
    """Every value of a row takes over the row's identity, also one found by an alias."""
    got = check(spark, [(1, 1, ["a", "b"]), (2, 2, ["b"]), (3, 3, ["c", "b"])], {"a": "X", "c": "Y"})
    assert got == {1: ("X", "cached"), 2: ("X", "cached"), 3: ("Y", "cached")}
    assert check(spark, [(1, 1, ["a", "b"])], {"b": "Z"}) == {1: ("Z", "cached")}


def test_hot_value_and_long_chains(spark, monkeypatch):
    monkeypatch.setattr(identity, "RANGE_ROWS", 64)
    check(spark, [(i, i, ["shared"] if i % 50 else ["shared", f"w{i}"]) for i in range(500)] + [(900 + i, i, [f"alone{i // 3}"]) for i in range(9)])
    check(spark, [(i, i, [f"own{i}", "shared"]) for i in range(500)])
    check(spark, [(i, i, [f"c{i}", f"c{i + 1}"]) for i in range(300)])  # a new value each row
    check(spark, [(i, 300 - i, [f"c{i}", f"c{i + 1}"]) for i in range(300)])


def test_edges(spark):
    check(spark, [(1, 5, None), (2, 5, []), (3, 5, [None]), (4, 5, ["a", None, "a"]), (5, 5, ["a"]), (6, 0, ["b", "a"])])
    check(spark, [])
    check(spark, [], {"a": "X"})


def test_aliases_carry_over(spark):
    """Two runs with the dictionary between them equal one."""
    r = random.Random(6)
    rows = [(i, i, [f"v{r.randrange(40)}" for _ in range(r.randrange(1, 4))]) for i in range(200)]
    both = {i: x for i, (x, _) in identity.sequential((i, v) for i, _, v in rows).items()}
    known, got = None, {}
    for part in (rows[:120], rows[120:]):
        df = spark.createDataFrame(part, ROWS)
        named = identity.assign_identity(df, aliases=known)
        got |= {x["row_id"]: x["uuid"] for x in named.collect()}
        known = identity.alias_dictionary(df, named, known)
    assert got == both
    last = {}
    for i, _, values in rows:
        last |= dict.fromkeys(values, both[i])
    assert {x["value"]: x["uuid"] for x in known.collect()} == last


def test_other_linkings(spark):
    df = spark.createDataFrame([(1, 1, ["b", "a"]), (2, 2, ["c"]), (3, 3, ["c", "a"])], ROWS)
    run = lambda **k: {r["row_id"]: r["uuid"] for r in identity.assign_identity(df, **k).collect()}
    assert set(run(linking="transitive").values()) == {identity.v5("a")}
    assert run(linking="first_value") == {1: identity.v5("b"), 2: identity.v5("c"), 3: identity.v5("c")}
    assert run(linking="first_value", aliases=df.select(F.lit("a").alias("value"), F.lit("X").alias("uuid")).limit(1)) == {1: "X", 2: identity.v5("c"), 3: "X"}
