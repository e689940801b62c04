"""Nested records: required fields and other rules along array paths, unwrapping and masking, against plain Python."""

import random

from pyspark.sql import functions as F

from entityspark.operators import checks, nested, pii
from entityspark.operators.checks import Constraint

WRAPPED = "struct<value:string,present:boolean>"
SCHEMA = (
    f"row_id long, result struct<`@context`:struct<x:{WRAPPED}>, person:struct<name:{WRAPPED}, age:int, "
    f"friends:array<struct<name:{WRAPPED}, tags:array<array<struct<label:{WRAPPED}>>>>>, home:struct<value:struct<street:{WRAPPED}, rooms:array<struct<n:{WRAPPED}>>>, present:boolean>>, loose:array<{WRAPPED}>>"
)


def made(n=400):
    r = random.Random(8)
    maybe = lambda f: None if r.random() < 0.15 else f()
    wrapped = lambda: maybe(lambda: {"value": maybe(lambda: r.choice("abc")), "present": r.choice([True, True, False, None])})
    many = lambda f: maybe(lambda: [f() for _ in range(r.randrange(4))])
    friend = lambda: maybe(lambda: {"name": wrapped(), "tags": many(lambda: many(lambda: maybe(lambda: {"label": wrapped()})))})
    home = lambda: {"value": maybe(lambda: {"street": wrapped(), "rooms": many(lambda: maybe(lambda: {"n": wrapped()}))}), "present": r.choice([True, True, False])}
    person = lambda: {"name": wrapped(), "age": maybe(lambda: r.randrange(90)), "friends": many(friend), "home": maybe(home)}
    return [(i, maybe(lambda: {"@context": {"x": {"value": None, "present": False}}, "person": maybe(person), "loose": many(wrapped)})) for i in range(n)]


def missing(value, path, is_field):
    """Paths of wrapped fields that are not present, in order."""
    if isinstance(value, list):
        return [p for i, x in enumerate(value) for p in missing(x, f"{path}[{i}]", False)]
    if not isinstance(value, dict):
        return []
    if is_field and {"value", "present"} <= set(value):
        return missing(value["value"], path, False) if value["present"] else [path]
    return [p for k, x in value.items() if k != "@context" for p in missing(x, f"{path}.{k}", True)]


def test_required_fields_at_any_depth(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    rules = checks.required_constraints(df, ["result"])
    assert {k.path for k in rules} == {"result.person.name", "result.person.friends[].name", "result.person.friends[].tags[][].label", "result.person.home", "result.person.home.street", "result.person.home.rooms[].n"}
    got = {}
    for r in checks.described(checks.validate(df, rules)).collect():
        got.setdefault(r["row_id"], []).append(r["path"])
        assert r["rule"] == "required" and r["actual"] is None and r["message"] == f"Required field '{r['path'].rsplit('.', 1)[-1]}' is missing or null"
    assert {i: sorted(p) for i, p in got.items()} == {i: sorted(p) for i, x in rows if (p := missing(x, "result", True))}
    assert checks.validate(df.limit(0), rules).count() == 0


def test_rules_on_items(spark):
    df = spark.createDataFrame(
        [(1, [{"n": 5, "k": ["a", "bb"]}, {"n": None, "k": None}, None], {"u.v": 1}), (2, [], None), (3, None, {"u.v": 9})], "row_id long, a array<struct<n:int,k:array<string>>>, b struct<`u.v`:int>"
    )
    rules = [Constraint("a[].n", required=True, maximum=4), Constraint("a[].k[]", max_length=1), Constraint("a[].k", min_items=3), Constraint("a", required=True)]
    got = {(r["row_id"], r["path"], r["rule"], r["actual"]) for r in checks.validate(df, rules).collect()}
    assert got == {(1, "a[0].n", "range", "5"), (1, "a[1].n", "required", None), (1, "a[0].k[1]", "length", "bb"), (1, "a[0].k", "items", '["a","bb"]'), (3, "a", "required", None)}


def unwrapped(value):
    if isinstance(value, list):
        return [unwrapped(x) for x in value]
    if not isinstance(value, dict):
        return value
    if {"value", "present"} <= set(value):
        return unwrapped(value["value"]) if value["present"] else None
    return {k: unwrapped(x) for k, x in value.items()}


def test_unwrapping_at_any_depth(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    got = df.select("row_id", nested.unwrap(F.col("result"), df.schema["result"].dataType).alias("r")).collect()
    assert {r["row_id"]: r.asDict(True)["r"] for r in got} == {i: unwrapped(x) for i, x in rows}


def test_masking_at_any_depth(spark):
    kind = "row_id long, scope int, people array<struct<email:string,mails:string,deep:struct<m:map<string,array<string>>>,n:int>>, plain string"
    rows = [
        (1, 0, [{"email": "b@c.de", "mails": "b@c.de; x@y.zz,,", "deep": {"m": {"k": ["Ann", None, " "]}}, "n": 1}, None], "Ann"),
        (2, 0, [{"email": " ", "mails": None, "deep": None, "n": None}, {"email": "x@y.zz", "mails": "", "deep": {"m": None}, "n": 2}], None),
        (3, 1, None, "Ann"), (4, 1, [], ""),
    ]
    fields = {"people[].email": ("EMAIL", False), "people[].mails": ("EMAIL", True), "people[].deep": ("NAME", False), "plain": ("NAME", False)}
    df = spark.createDataFrame(rows, kind)
    masked, table = pii.mask_nested(df, fields, "row_id")
    assert masked.schema == df.schema
    got = {r["row_id"]: r.asDict(True) for r in masked.collect()}
    assert got[1]["people"][0] == {"email": "EMAIL_1@GMAIL.COM", "mails": "EMAIL_1@GMAIL.COM, EMAIL_2@GMAIL.COM", "deep": {"m": {"k": ["NAME_1", None, " "]}}, "n": 1}
    assert got[1]["people"][1] is None and got[1]["plain"] == "NAME_1"
    assert got[2]["people"] == [{"email": " ", "mails": None, "deep": None, "n": None}, {"email": "EMAIL_2@GMAIL.COM", "mails": "", "deep": {"m": None}, "n": 2}]
    assert (got[3]["people"], got[3]["plain"], got[4]["people"], got[4]["plain"]) == (None, "NAME_1", [], "")
    back = {r["row_id"]: r.asDict(True) for r in pii.unmask(masked, ["people", "plain"], "row_id", table).collect()}
    want = {r["row_id"]: r.asDict(True) for r in df.collect()}
    want[1]["people"][0]["mails"] = "b@c.de, x@y.zz"  # items are written alike
    assert back == want
    scoped, own = pii.mask_nested(df, {"plain": ("NAME", False)}, "row_id", ["scope"])
    assert {(r["scope"], r["value"], r["placeholder"]) for r in own.collect()} == {(0, "Ann", "NAME_1"), (1, "Ann", "NAME_1")}
    assert [r["plain"] for r in pii.unmask(scoped, ["plain"], "row_id", own, ["scope"]).orderBy("row_id").collect()] == ["Ann", None, "Ann", ""]


def test_placeholders_in_nested_answers(spark):
    table = spark.createDataFrame([("EMAIL_1@GMAIL.COM", "john@example.com"), ("NAME_1", "John Doe")], "placeholder string, value string")
    answer = [(1, {"people": [{"email": "EMAIL_1@GMAIL.COM", "name": "NAME_1", "contacts": None}, {"email": None, "name": "Hello NAME_1, NAME_12!", "contacts": {"primary": "EMAIL_1@GMAIL.COM"}}], "n": 3}), (2, None)]
    df = spark.createDataFrame(answer, "id long, a struct<people:array<struct<email:string,name:string,contacts:map<string,string>>>,n:int>")
    got = {r["id"]: r.asDict(True)["a"] for r in pii.unmask(df, ["a"], "id", table).collect()}
    assert got == {1: {"people": [{"email": "john@example.com", "name": "John Doe", "contacts": None}, {"email": None, "name": "Hello John Doe, NAME_12!", "contacts": {"primary": "john@example.com"}}], "n": 3}, 2: None}
    assert pii.unmask(df, ["a"], "id", table.limit(0)).collect() == df.collect()


def test_batches_are_judged_in_stages(spark):
    inputs = spark.createDataFrame([(b, 10 * b + i) for b in range(4) for i in range(2)], "batch_id long, row_id long")
    results = spark.createDataFrame([(0, 0, "x", 1), (1, 10, None, 1), (1, 11, "x", 9), (2, 20, "x", 9), (2, 21, "x", 1), (9, 90, None, 1)], "batch_id long, row_id long, name string, n int")
    rules = [Constraint("name", required=True), Constraint("n", maximum=5)]
    run = lambda fails: {(r["batch_id"], r["row_id"], r["stage"], r["message"]) for r in checks.validate_batches(inputs, results, rules, fails).collect()}
    lengths = {(0, None, "length", "Expected 2 results, got 1"), (3, None, "length", "Expected 2 results, got 0"), (9, None, "length", "Expected 0 results, got 1")}
    required = {(1, 10, "required", "Required field 'name' is missing or null")}
    assert run(True) == lengths | required | {(2, 20, "schema", "n: expected -inf..5, got 9")}
    assert run(False) == run(True) | {(1, 11, "schema", "n: expected -inf..5, got 9")}
