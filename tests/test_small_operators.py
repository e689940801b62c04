"""Rule files, overlays, refused batches, nullability and other small operators on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from entityspark.operators import checks, ledger, merge, pii, resolve, rules
from entityspark.sources import files


def test_rules_from_files(spark, tmp_path):
    schema = {"entities": {"p": {"properties": {"a": {"type": "string", "required": True, "enumFromTaxonomy": "kinds"}, "b": {"type": "array", "items": {"type": "string", "enumFromTaxonomy": "absent"}}, "c": {"type": "string"}}}}}
    config = {"fields": {"p.a": {"source": "x", "taxonomy": "kinds"}, "p.z": {"literal": "l"}}, "llm": {"fields": ["p.b"]}}
    for name, content in (("r", config), ("s", schema), ("kinds", [{"notation": "n1", "value": "One"}, {"notation": "n2", "value": "Two"}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(content, indent=1))
    loaded, full = files.load_rules(spark, str(tmp_path / "r.json"), str(tmp_path / "s.json"), str(tmp_path), exclude=["p.c"])
    assert loaded.fields == {"p.a": rules.Rule("x", taxonomy={"n1": "One", "n2": "Two"})} and loaded.required == ("p.a",) and loaded.model_fields == ("p.a",)
    assert full["entities"]["p"]["properties"]["a"] == {"type": "string", "required": True, "enum": ["One", "Two"]} and full["entities"]["p"]["properties"]["b"]["items"] == {"type": "string", "enum": []}
    rows = spark.createDataFrame([(1, "N1 "), (2, "other"), (3, None)], "id long, x string")
    assert [r["mapped"]["p"]["a"] for r in rules.transform_row(rows, loaded).orderBy("id").collect()] == ["One", "other", None]
    assert rules.rules_of({"llm": {"default": False, "fields": ["p.b", "p.q"]}}, schema, include=["p.c"]).model_fields == ("p.b", "p.c")
    for faulty in ({"p.a": {}}, {"p.a": {"source": "x", "transforms": ["no"]}}, {"p.a": {"source": "x", "when": [{"type": "equals"}]}}):
        with pytest.raises(ValueError):
            rules.rules_of({"fields": faulty}, schema)
    with pytest.raises(KeyError):
        rules.rules_of({"fields": {"p.a": {"custom": "f"}}}, schema)


def test_conditions_on_columns(spark):
    row = spark.createDataFrame([("v", None)], "x string, y string").select(*[rules.condition(["x", "y"], {"type": t, "column": c, "value": "v"}).alias(f"{t}{c}") for t in ("columnExists", "equals", "notEmpty", "bogus") for c in ("x", "y", "z")]).first()
    assert list(row) == [True, True, False, True, False, False, True, False, False, False, False, False]


def test_overlay(spark):
    mapped = spark.createDataFrame([(1, 1, ("a", None)), (1, 2, (None, ["r"])), (2, 3, ("c", None)), (2, 4, None)], "batch_id long, row_id long, mapped struct<n:string,l:array<string>>")
    answers = spark.createDataFrame([(1, 1, ("m", ["q"])), (1, 2, ("m", ["q", "s"])), (2, 3, ("m", None)), (3, 9, ("m", None))], "batch_id long, row_id long, answers struct<n:string,l:array<string>>")
    got = {r["row_id"]: tuple(r["result"]) for r in resolve.overlay(mapped, answers).collect()}
    assert got == {1: ("a", ["q"]), 2: ("m", ["r"]), 3: ("m", None), 9: ("m", None)}


def test_results_are_attached_by_batch(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (4, 5)], "batch_id long, row_id long")
    results = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (3, 9, "y"), (4, 5, "z"), (4, 6, "w")], "batch_id long, row_id long, result string")
    found, refused = ledger.attach_results(rows, results)
    assert sorted(map(tuple, found.collect())) == [(1, 1, "x"), (1, 2, None)]
    assert sorted(map(tuple, refused.collect())) == [(2, 1, 0), (3, 0, 1), (4, 1, 2)]


def test_insert_counts(spark):
    rows = lambda *ks: spark.createDataFrame([(k, i) for i, k in enumerate(ks)], "k string, o int")
    assert tuple(ledger.insert_counts(rows("a", "b"), rows("b", "c", "c", "d"), ["k"], "o").first()) == (2, 2)
    assert tuple(ledger.insert_counts(rows("a"), rows("a").limit(0), ["k"], "o").first()) == (0, 0)


def test_nullability_of_a_schema(spark):
    kind = rules.target_struct_type({"entities": {"p": {"properties": {"a": {"type": "string", "required": True}, "l": {"type": "array", "items": {"type": "object", "required": True, "properties": {"k": {"type": "integer", "required": True}, "o": {"type": "string"}}}}}}}})
    paths = [k.path for k in checks.nullability_constraints(kind)]
    assert paths == ["p.a", "p.l[]", "p.l[].k"]
    rows = spark.createDataFrame([(1, '{"p":{"a":null,"l":[{"k":1},null,{"o":"x"}]}}'), (2, '{"p":null}'), (3, '{"p":{"a":"x"}}')], "row_id long, t string").select("row_id", F.from_json("t", kind)["p"].alias("p"))
    assert sorted((r["row_id"], r["path"]) for r in checks.validate(rows, checks.nullability_constraints(kind)).collect()) == [(1, "p.a"), (1, "p.l[1]"), (1, "p.l[2].k")]


def test_masking_switched_off(spark):
    rows = spark.createDataFrame([(1, "Ann", 0)], "id long, n string, s int")
    same, table = pii.mask(rows, {"n": ("NAME", False)}, "id", ["s"], enabled=False)
    assert same.collect() == rows.collect() and table.count() == 0 and table.columns == pii.mask(rows, {"n": ("NAME", False)}, "id", ["s"])[1].columns
    assert pii.unmask(same, ["n"], "id", table, ["s"]).collect() == rows.collect()
    assert pii.mask(rows, {"n": ("NAME", False)}, "id")[0].first()["n"] == "NAME_1"


def test_merged_entities_know_who_they_are(spark):
    rows = spark.createDataFrame([("k", 1, [["a"], None, ["b", "a"]], "x"), ("k", 2, [["c"]], "y"), ("one", 1, None, "z")], "k string, o long, l array<array<string>>, d string")
    got = {r["k"]: r for r in merge.identified(merge.entity_merge(rows, "k", "o", lists=["l"], spans=["d"]), "k").collect()}
    assert (got["k"]["l"], got["k"]["userID"], got["k"]["@id"], got["k"]["first_d"], got["k"]["last_d"]) == (["a", "b", "c"], "k", "k", "x", "y")
    assert (got["one"]["l"], got["one"]["userID"], got["one"]["n_records"]) == ([], None, 1)
