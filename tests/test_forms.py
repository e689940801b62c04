"""Requests by form of pending fields, what errors are called, and rollups of a run's records."""

import json

import pytest
from pyspark.sql import functions as F

from entityspark.operators import ledger, resolve

SCHEMA = {
    "entities": {
        "person": {"properties": {"name": {"type": "string", "required": True}, "home": {"type": "object", "properties": {"city": {"type": "string"}, "zip": {"type": "string", "pattern": "^[0-9]+$"}}}}},
        "action": {"properties": {"parts": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "number"}, "kind": {"type": "string", "enum": ["a"]}}}}}},
        "none": {},
    }
}


def test_partial_schemas():
    obj = lambda **p: {"type": "object", "properties": p, "required": list(p)}
    assert resolve.partial_schema(SCHEMA, ["person.home.zip", "absent.x"]) == obj(person=obj(home=obj(zip={"type": "string", "pattern": "^[0-9]+$"})))
    assert resolve.partial_schema(SCHEMA, ["action.parts.kind", "person.name"]) == obj(person=obj(name={"type": "string"}), action=obj(parts={"type": "array", "items": obj(kind={"type": "string", "enum": ["a"]})}))
    assert resolve.partial_schema(SCHEMA, ["action.parts"])["properties"]["action"]["properties"]["parts"]["items"] == obj(n={"type": "number"}, kind={"type": "string", "enum": ["a"]})
    whole = resolve.partial_schema(SCHEMA, [])
    assert list(whole["properties"]) == ["person", "action", "none"] and list(whole["properties"]["person"]["properties"]["home"]["properties"]) == ["city", "zip"]


def test_one_call_for_each_form_and_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, ["person.name"] if i % 10 else ["person.home.zip", "person.home.city"]) for i in range(95)] + [(200, [])], "row_id long, pending array<string>").repartition(3)
    batches = resolve.form_batches(rows, 20)
    sizes = {r["batch_id"]: r["count"] for r in batches.groupBy("batch_id").count().collect()}
    assert sizes == {"person.name#0": 20, "person.name#1": 20, "person.name#2": 20, "person.name#3": 20, "person.name#4": 5, "person.home.city,person.home.zip#0": 10, "#0": 1}
    folder = str(tmp_path)

    def resolver(pdf, schema, model, error):
        with open(f"{folder}/{pdf['batch_id'].iloc[0]}", "a") as f:
            f.write(json.dumps(list(schema["properties"])) + "\n")
        return pdf[["row_id"]].assign(keys=",".join(schema["properties"]["person"]["properties"]))

    done = resolve.resolve_forms(batches, SCHEMA, resolver, "row_id long, keys string")
    got = {r["row_id"]: r["keys"] for r in done.collect()}
    assert got == {**{i: "name" if i % 10 else "home" for i in range(95)}, 200: "name,home"}
    assert {p.name: p.read_text().count("\n") for p in tmp_path.iterdir()} == dict.fromkeys(sizes, 1)
    prompts = {r["batch_id"]: r for r in resolve.form_prompts(batches, SCHEMA, "S <<<SCHEMA>>>\nAdditional important rules: x", ["row_id"], "a/b.c.csv").collect()}
    assert set(prompts) == set(sizes) and '"zip"' in prompts["person.home.city,person.home.zip#0"]["instructions"] and '"zip"' not in prompts["person.name#0"]["instructions"]
    assert 'Input file name: "b.c"' in prompts["#0"]["instructions"] and json.loads(prompts["person.name#4"]["records"]) == [{"row_id": i} for i in range(89, 95) if i % 10]
    assert resolve.form_prompts(batches.limit(0), SCHEMA, "", ["row_id"]).count() == 0


class Status(Exception):
    def __init__(self, status):
        super().__init__("s")
        self.status = status


@pytest.mark.parametrize("error, kind", [(ValueError("bad enum"), "validation_error"), (resolve.Invalid("Required field 'x' is missing"), "required_field_error"), (TimeoutError(), "network_error"), (ConnectionError(), "network_error"), (Status(429), "api_error"), (Status(503), "api_error"), (Status(404), "network_error")])
def test_names_of_errors(error, kind):
    assert resolve._kind(error)[0] == kind


def test_rollups(spark):
    logs = spark.createDataFrame(
        [("validation_error", '{"rule":"required","path":"a.b"}'), ("validation_error", '{"rule":"enum","path":"c"}'), ("retry_attempt", '{"action":"failed","error":"api_error"}'), ("batch_outcome", '{"outcome":"failed"}'), ("uuid_event", '{"event":"cached"}'), ("uuid_event", '{"event":"fallback_to_random","reason":"r"}'), ("model_input", "{}"), ("uuid_event", None)],
        "kind string, record string",
    )
    got = {(r["measure"], r["value"]): r["n"] for r in resolve.log_rollups(logs).collect()}
    assert got == {("missing_field", "a.b"): 1, ("retry", "failed"): 1, ("retry_error", "api_error"): 1, ("outcome", "failed"): 1, ("event", "cached"): 1, ("event", "fallback_to_random"): 1, ("fallback", "r"): 1}
    assert resolve.log_rollups(logs.limit(0)).count() == 0
    outcomes = spark.createDataFrame([(i, 10 * (i % 4)) for i in range(12)], "batch_id long, ms long")
    assert [r["batch_id"] for r in resolve.slowest_batches(outcomes, 4).collect()] == [3, 7, 11, 2]


def test_rollups_make_no_record_that_they_do_not_count(spark):
    """What the model was asked is no measure: its rows, here ones that cannot be computed, are not made."""
    dear = F.when(F.col("id") >= 0, F.raise_error(F.lit("computed"))).cast("string")
    mapped = spark.range(4).select(F.col("id").alias("batch_id"), F.array(F.lit("a")).alias("pending"), dear.alias("x"))
    violations = spark.createDataFrame([(1, "a", "required")], "row_id long, path string, rule string")
    attempts = spark.createDataFrame([(0, 1, "failed", "validation_error", "failed", 5), (1, 1, "success", None, None, 5)], "batch_id long, attempt int, status string, error string, action string, ms long")
    events = spark.createDataFrame([(1, "cached", None)], "row_id long, event string, reason string")
    logs = resolve.log_datasets(mapped, violations, attempts, events)
    got = {(r["measure"], r["value"]): r["n"] for r in resolve.log_rollups(logs).collect()}
    assert got == {("missing_field", "a"): 1, ("retry", "failed"): 1, ("retry_error", "validation_error"): 1, ("outcome", "failed"): 1, ("outcome", "success"): 1, ("event", "cached"): 1}
    assert logs.groupBy("kind").count().where("kind = 'model_input'").first()["count"] == 4


def test_counts_of_empty_tables(spark):
    empty = spark.createDataFrame([], "a int, status string")
    assert set(ledger.progress(empty, empty.drop("status"), empty, empty).first()) == {0}
    assert {r["name"]: r["n"] for r in ledger.table_stats({"x": empty, "y": spark.range(3)}).collect()} == {"x": 0, "y": 3}
