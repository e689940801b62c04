"""Operators on literal rows, and a sample of registered queries against DuckDB."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from entityspark.functions import text as fx
from entityspark.operators import checks, ingest, ledger, merge, pii, resolve, rules, runs
from entityspark.plans import catalog, incremental, registry  # noqa: F401
from entityspark.sources import files

SMALL = "/root/testdata/sf0.001"


def test_transforms(spark):
    df = spark.createDataFrame([(["A", "b", "a", "B", "c"], "a.b", " 1e3 ", " x ")], "u array<string>, s string, n string, t string")
    row = df.select(fx.t_unique(F.col("u")), fx.t_split(F.col("s"), "."), fx.t_to_number(F.col("n")), fx.t_seconds_to_duration(F.lit(2.5)), fx.t_seconds_to_duration(F.lit(-7.0)), fx.js_trim(F.col("t"))).first()
    assert list(row) == [["A", "b", "c"], ["a", "b"], 1000.0, "PT3S", "PT0S", "x"]


def test_trim_and_masking_corner_cases(spark):
    texts = ["\u00a0 x \u3000\ufeff", "", None, " \t", "a b", "é\u2003"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(fx.js_trim(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in got] == ["x", "", None, "", "a b", "é"]
    texts = ["a@b.cd", "a@b.cd\x00 x@y.zz $0 \\", "x [EMAIL]@b.cd", "", "$1 no", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(pii.mask_text(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in got] == ["[EMAIL]", "[EMAIL]\x00 [EMAIL] $0 \\", "x [EMAIL]@b.cd", "", "$1 no", None]


def test_merge_rules_masking_and_checks(spark):
    rows = spark.createDataFrame([("k", 1, "", ["x"]), ("k", 2, "Jane", ["x", "q"]), ("k", 3, "J.", ["y"]), (None, 4, "z", None)], "k string, o long, name string, l array<string>")
    assert merge.entity_merge(rows, "k", "o", ["name"], ["l"]).collect()[0].asDict() == {"k": "k", "n_records": 3, "name": "Jane", "l": ["x", "q", "y"]}
    out = rules.transform_row(rows, rules.RuleSet({"a.b": rules.Rule("name"), "a.c": rules.Rule("absent", fallback="f")}, required=("a.b",))).orderBy("o").collect()
    assert out[0]["missing"] == ["a.b"] and out[0]["mapped"]["a"]["c"] == "f" and out[1]["missing"] == []
    with pytest.raises(ValueError):
        rules.compile_rules(rules.RuleSet({"a": rules.Rule()}))
    text = spark.createDataFrame([("Write to mira.k@mail-host.org, else ring (212) 867-5309 after six",), (None,)], "t string").select(pii.mask_text(F.col("t")).alias("m")).collect()
    assert text[0]["m"] == "Write to [EMAIL], else ring [PHONE] after six" and text[1]["m"] is None
    table = spark.createDataFrame([("EMAIL_1@GMAIL.COM", "a@b.cd"), ("EMAIL_10@GMAIL.COM", "x@y.zz")], "placeholder string, value string")
    masked = spark.createDataFrame([(1, "EMAIL_10@GMAIL.COM, EMAIL_1@GMAIL.COM")], "id long, t string")
    assert pii.unmask(masked, ["t"], "id", table).first()["t"] == "x@y.zz, a@b.cd"
    bad = checks.validate(rows.withColumnRenamed("o", "row_id"), [checks.Constraint("k", required=True), checks.Constraint("name", one_of=("Jane",))]).collect()
    assert {(r["row_id"], r["rule"]) for r in bad} == {(4, "required"), (1, "enum"), (3, "enum"), (4, "enum")}
    plan = ledger.ingest_plan(spark.createDataFrame([("a", "1"), ("b", "9")], "file_path string, file_hash string"), spark.createDataFrame([(1, "a", "1", "completed"), (2, "b", "2", "completed")], "file_id long, file_path string, file_hash string, status string"))
    assert {r["file_path"]: r["action"] for r in plan.collect()} == {"a": "skip", "b": "reject"}


def test_values_empty_after_the_fallback_are_null(spark):
    rows = spark.createDataFrame([(1, " ", ""), (2, "x", "a;b"), (3, None, None)], "o long, name string, tags string")
    rule_set = rules.RuleSet({"name": rules.Rule("name", transforms=("trim",)), "given": rules.Rule("name", fallback="f"), "tags": rules.Rule("tags", transforms=({"type": "split", "delimiter": ";"}, "filterEmpty"))}, required=("name",))
    out = {r["o"]: r for r in rules.transform_row(rows, rule_set).collect()}
    assert [tuple(out[i]["mapped"]) for i in (1, 2, 3)] == [(None, "f", None), ("x", "x", ["a", "b"]), (None, "f", None)]
    assert [out[i]["missing"] for i in (1, 2, 3)] == [["name"], [], ["name"]]


def test_ingest_plan_refuses_edited_files(spark):
    known = spark.createDataFrame([(1, "a", "1", "failed"), (2, "b", "2", "failed"), (3, "c", "3", "completed")], "file_id long, file_path string, file_hash string, status string")
    incoming = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "9"), ("d", "4")], "file_path string, file_hash string")
    plan = lambda force: {r["file_path"]: r["action"] for r in ledger.ingest_plan(incoming, known, force).collect()}
    assert plan(False) == {"a": "replace_failed", "b": "reject", "c": "reject", "d": "ingest"}
    assert plan(True) == {"a": "replace_failed", "b": "reingest", "c": "reingest", "d": "ingest"}


def test_resolver_is_called_once_per_attempt(spark, tmp_path):
    calls = str(tmp_path)

    def resolver(pdf, model, error):
        batch = int(pdf["batch_id"].iloc[0])
        with open(f"{calls}/{batch}", "a") as f:
            f.write(f"{model}\n")
        if batch == 1:
            raise KeyError("gone")
        if batch == 2 and model == "main":
            raise resolve.Invalid("not one of the allowed values")
        if batch == 3:
            raise ConnectionError
        return pdf[["row_id"]].assign(note="n")

    rows = spark.createDataFrame([(i, i // 3, f"v{i}") for i in range(12)], "row_id long, batch_id long, name string")
    done, bad, log = resolve.process_batch(rows, rules.RuleSet({"name": rules.Rule("name")}, model_fields=("note",)), resolver, "row_id long, note string", {"name": ("NAME", False)}, [checks.Constraint("note", required=True)])
    assert done.where("note is not null").count() == 6 and bad.count() == 6 and resolve.batch_outcomes(log).count() == 4
    assert {r["batch_id"]: (r["error"], r["action"]) for r in log.where("status = 'failed'").collect()} == {1: ("network_error", "failed"), 2: ("validation_error", "retry_with_fallback"), 3: ("network_error", "failed")}
    assert {b: (tmp_path / str(b)).read_text().split() for b in range(4)} == {0: ["main"], 1: ["main"], 2: ["main", "fallback"], 3: ["main"]}


def test_placeholders_follow_rows_then_items(spark):
    rows = spark.createDataFrame([(0, ";".join(f"a{i}@x.yz" for i in range(1100))), (1, "late@x.yz;a5@x.yz"), (1 << 40, "last@x.yz")], "row_id long, mails string")
    masked, table = pii.mask_fields(rows, {"mails": ("EMAIL", True)}, "row_id")
    assert {r["value"]: r["n"] for r in table.collect()} == {**{f"a{i}@x.yz": i + 1 for i in range(1100)}, "late@x.yz": 1101, "last@x.yz": 1102}
    assert masked.where("row_id = 1").first()["mails"] == "EMAIL_1101@GMAIL.COM, EMAIL_6@GMAIL.COM"


def test_lists_of_a_key_with_many_records(spark):
    records = spark.range(20_000).selectExpr("'k' as k", "id as o", "if(id = 7, null, array(concat('t', id % 5), null, 'x')) as l", "cast(null as array<string>) as m")
    assert merge.entity_merge(records, "k", "o", [], ["l", "m"]).first().asDict() == {"k": "k", "n_records": 20_000, "l": ["t0", "x", "t1", "t2", "t3", "t4"], "m": []}


@pytest.mark.parametrize("name", ["entity_merge", "identity_components", "transform_row", "pii_unmask", "sync_counts", "validate_all", "batch_outcomes", "ingest_plan", "pii_mask_text", "csv_scan", "incremental_ingest", "pii_text_dictionary", "pii_text_roundtrip", "resume_run", "output_mode", "target_struct_type"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "customer", "documents"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SMALL)
    want = con.sql(registry.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda rows: sorted(map(str, rows))
    assert key(tuple(r[c] for c in columns) for r in got.collect()) == key(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_csv_ingest(spark, tmp_path):
    (tmp_path / "a.csv").write_text('email,name,name\nx@y.zz,old,"a ""q"", b"\n,,\nx@y.zz,older,"a ""q"", b"\n4,5\nX@y.zz,old,c\n,n,\n,n,n\n,m,n\n')
    out = ingest.ingest(spark, str(tmp_path), ["email", "name", "name"])
    rows = {(r["file_row_index"], r["email"], r["name"]) for r in out.rows.collect()}
    assert rows == {(0, "x@y.zz", 'a "q", b'), (2, "X@y.zz", "c"), (3, "", "n"), (4, "", "n")}
    done = out.manifest.collect()[0]
    assert (done["n_duplicates"], done["n_rejected"], done["status"], done["n_random"]) == (1, 1, "failed", 2)
    assert [r["_corrupt"] for r in out.rejected.collect()] == ["4,5"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "b.csv").write_text("email,name,name\n")
    assert ingest.ingest(spark, str(tmp_path / "none"), ["email", "name", "name"]).manifest.count() == 0
    assert files.taxonomy_scan(spark, str(tmp_path / "absent.json")).count() == 0


def test_process_batch_masks_what_the_resolver_sees(spark):
    seen = spark.createDataFrame([(1, 0, "Ann"), (2, 0, None), (3, 1, "Bob")], "row_id long, batch_id long, name string")

    def resolver(pdf, model, error):
        assert not set(pdf["name"].dropna()) & {"Ann", "Bob"}
        return pdf[["row_id"]].assign(note=["hi " + n if n else None for n in pdf["name"]])

    done, bad, log = resolve.process_batch(seen, rules.RuleSet({"p.name": rules.Rule("name")}, model_fields=("p.note",)), resolver, "row_id long, note string", {"name": ("NAME", False)}, [checks.Constraint("note", required=True)])
    assert {r["row_id"]: r["note"] for r in done.collect()} == {1: "hi Ann", 2: None, 3: "hi Bob"}
    assert [r["row_id"] for r in bad.collect()] == [2] and log.where("status = 'failed'").count() == 0


def test_texts_get_numbered_placeholders_and_come_back(spark):
    texts = ["Ask b@c.de or 415-555-2671x, then b@c.de", None, "", "415-555-2671 \x02 \x03\x04 b@c.de9, q@c.de;77 Old Mill Road, \x03", "PHONE_\x02_1 and EMAIL_\x02_1@GMAIL.COM"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("u", F.lit("b@c.de"))
    masked, table = pii.mask_texts(rows, ["t", "u"], "id")
    got = {r["id"]: r for r in masked.collect()}
    assert got[0]["t"] == "Ask EMAIL_1@GMAIL.COM or PHONE_1x, then EMAIL_1@GMAIL.COM"
    assert got[1]["t"] is None and got[2]["t"] == "" and {r["u"] for r in got.values()} == {"EMAIL_1@GMAIL.COM"}
    assert "PHONE_1" in got[3]["t"] and "ADDRESS_1" in got[3]["t"] and "Mill" not in got[3]["t"]
    back = {r["id"]: (r["t"], r["u"]) for r in pii.unmask(masked, ["t", "u"], "id", table).collect()}
    assert back == {i: (t, "b@c.de") for i, t in enumerate(texts)}
    assert pii.mask_texts(rows.limit(0), ["t"], "id")[0].count() == 0


def test_runs_resume_or_start_afresh(spark):
    log = spark.createDataFrame([(1, "f", "o", 1), (2, "old", "o", 1), (3, "old", "o", 1), (4, "f", "p", 1), (5, "old", "o", 1), (5, "f", "o", 2), (6, "f", "o", 1), (7, "f", None, 1)], "run_id long, fingerprint string, output_path string, version int")
    now = spark.createDataFrame([(0, "resume", "o", False), (1, "fresh", "o", True), (2, "auto", "o", True), (3, "resume", "o", True), (4, "auto", "o", True), (5, "auto", "o", True), (6, "resume", "o", False), (7, "auto", None, False)], "run_id long, mode string, output_path string, output_exists boolean").withColumn("fingerprint", F.lit("f"))
    decided = runs.resume_run(now, log)
    got = {r["run_id"]: (r["action"], r["output"]) for r in decided.collect()}
    assert got == {0: ("fresh", "rewrite"), 1: ("fresh", "rewrite"), 2: ("fresh", "rewrite"), 3: ("error", None), 4: ("resume", "rewrite"), 5: ("resume", "append"), 6: ("resume", "rewrite"), 7: ("resume", "append")}
    with pytest.raises(ValueError):
        runs.check_runs(decided)
    rows = spark.createDataFrame([(r, 10 * r + i) for r in (2, 3, 5) for i in range(3)], "run_id long, row_id long")
    done = spark.createDataFrame([(20,), (51,), (51,)], "row_id long")
    assert {r["row_id"] for r in runs.remaining_rows(rows, done, runs.check_runs(decided.where("run_id <> 3"))).collect()} == {20, 21, 22, 50, 52}


def test_target_schema_as_struct(spark):
    schema = {"entities": {"p": {"properties": {"n": {"type": "string", "required": True, "enum": ["a"]}, "l": {"type": "array", "items": {"type": "object", "properties": {"k": {"type": "integer"}}}}, "b": {"type": "boolean"}}}, "q": {}}}
    kind = rules.target_struct_type(schema)
    assert kind.simpleString() == "struct<p:struct<n:string,l:array<struct<k:bigint>>,b:boolean>,q:struct<>>"
    assert [f.nullable for f in kind["p"].dataType] == [False, True, True] and kind["p"].dataType["n"].metadata == {"enum": ["a"]}
    assert {path for path, required, _ in rules.schema_fields(kind) if required} == {"p.n"}
    assert rules.wrap_required_schema(kind)["p"].dataType["n"].dataType.simpleString() == "struct<value:string,present:boolean>"
