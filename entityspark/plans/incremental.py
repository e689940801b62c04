"""Queries over files, state tables and streams: each exports the contacts, then reads them back."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entityspark.functions import text as fx
from entityspark.operators import checks, identity, ingest, ledger, merge, resolve, rules
from entityspark.operators.components import ensure_checkpoint_dir
from entityspark.plans import catalog
from entityspark.plans.registry import query
from entityspark.plans.views import WITH, contacts, keyed, processed
from entityspark.sources import files
from entityspark.streaming import completion

#: The exported header: ``tags`` is there twice, the last one counts.
HEADER = ["tags", "row_id", "primaryEmail", "additionalEmails", "givenName", "tags", "action_type", "action_timeSpent", "obj_published"]
#: Order keys in one exported file, which bounds its size.
FILE_KEYS = 4096
FILE = f"row_id // {FILE_KEYS}"
QUOTED = {"quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def file_of(path: Column) -> Column:
    """The number of an exported file, from its path."""
    return F.regexp_extract(path, "file=([0-9]+)", 1).cast("long")


def write_lines(lines: DataFrame, path: str) -> str:
    """Writes ``(file, ord, line)`` as one text file each, in order."""
    lines.repartition("file").sortWithinPartitions("file", "ord").select("file", "line").write.partitionBy("file").text(path)
    return path


def export(spark: SparkSession, sf_dir: str) -> str:
    """Contacts as CSV files with blank rows, short rows, repeated rows and a repeated header name."""
    rows = contacts(spark, sf_dir).withColumn("file", F.floor(F.col("row_id") / FILE_KEYS))
    cells = [F.lit("old")] + [F.col(c).cast("string").alias(c) for c in HEADER[1:]]
    line = F.to_csv(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)]), QUOTED)
    extra = F.array_compact(F.array(
        F.struct(F.lit(0).alias("k"), line.alias("line")),
        F.when(F.col("row_id") % 97 == 0, F.struct(F.lit(1).alias("k"), F.lit("," * (len(HEADER) - 1)).alias("line"))),
        F.when(F.col("row_id") % 101 == 0, F.struct(F.lit(2).alias("k"), F.concat(F.lit("short,"), F.col("row_id").cast("string")).alias("line"))),
        F.when((F.col("row_id") % 89 == 0) & (F.col("row_id") % 11 != 0), F.struct(F.lit(3).alias("k"), line.alias("line"))),
    ))
    body = rows.select("file", "row_id", F.explode(extra).alias("x")).select("file", (F.col("row_id") * 4 + F.col("x.k")).alias("ord"), "x.line")
    head = rows.select("file").distinct().select("file", F.lit(-1).cast("long").alias("ord"), F.lit(",".join(HEADER)).alias("line"))
    return write_lines(body.unionByName(head), scratch(spark, "contacts"))


def _scanned(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows, the good ones, the malformed ones."""
    rows = files.csv_scan(s, export(s, d), HEADER).withColumn("file", file_of(F.col("file_path")))
    return rows, *files.split_malformed(rows, list(dict.fromkeys(HEADER)))


# scans (2.1)
REPEATED = "(row_id % 89 = 0 AND row_id % 11 <> 0)"
ROWS_SQL = f"exported AS (SELECT *, {FILE} AS file FROM keyed UNION ALL SELECT *, {FILE} FROM keyed WHERE {REPEATED})"
query("csv_scan", f"{WITH.rstrip()}, {ROWS_SQL} SELECT file, row_id, \"primaryEmail\", \"givenName\", \"action_type\" FROM exported")(lambda s, d: _scanned(s, d)[1].select("file", F.col("row_id").cast("long").alias("row_id"), "primaryEmail", "givenName", "action_type"))
query("dup_header", f"{WITH.rstrip()}, {ROWS_SQL} SELECT row_id, tags FROM exported")(lambda s, d: _scanned(s, d)[1].select(F.col("row_id").cast("long").alias("row_id"), "tags"))
query("blank_row_filter", f"{WITH} SELECT {FILE} AS file, count(*) AS n_blank FROM keyed WHERE row_id % 97 = 0 GROUP BY 1")(
    lambda s, d: _scanned(s, d)[0].where(F.col("_corrupt").isNull() & ~files.not_blank(list(dict.fromkeys(HEADER)))).groupBy("file").agg(F.count("*").alias("n_blank")))
query("malformed_rows", f"{WITH} SELECT {FILE} AS file, 'short,' || row_id AS line FROM keyed WHERE row_id % 101 = 0")(lambda s, d: _scanned(s, d)[2].select("file", F.col("_corrupt").alias("line")))
query("nonblank_count", f"{WITH} SELECT {FILE} AS file, cast(sum(1 + (row_id % 101 = 0)::int + {REPEATED}::int) AS bigint) AS n FROM keyed GROUP BY 1")(
    lambda s, d: files.not_blank_count(_scanned(s, d)[0], list(dict.fromkeys(HEADER))).select(file_of(F.col("file_path")).alias("file"), "n"))


BROKEN = "CASE WHEN row_id % 5 = 0 THEN 'a \"' || \"givenName\" || '\",' || chr(10) || chr(10) || tags ELSE tags END"


@query("csv_scan_split", f"{WITH} SELECT {FILE} AS file, row_id, {BROKEN} AS note, \"givenName\" FROM keyed")
def csv_scan_split(s: SparkSession, d: str) -> DataFrame:
    """Files whose cells hold quotes and line breaks, read as large files are: by parts."""
    broken = F.concat(F.lit('a "'), "givenName", F.lit('",\n\n'), "tags")
    rows = contacts(s, d).withColumn("note", F.when(F.col("row_id") % 5 == 0, broken).otherwise(F.col("tags")))
    line = F.to_csv(F.struct(F.col("row_id").cast("string").alias("a"), F.col("note").alias("b"), F.col("givenName").alias("c")), QUOTED)
    body = rows.select(F.floor(F.col("row_id") / FILE_KEYS).alias("file"), F.col("row_id").alias("ord"), line.alias("line"))
    head = rows.select(F.floor(F.col("row_id") / FILE_KEYS).alias("file")).distinct().select("file", F.lit(-1).cast("long").alias("ord"), F.lit("row_id,note,givenName").alias("line"))
    path = write_lines(body.unionByName(head), scratch(s, "broken"))
    found = files.csv_scan(s, f"{path}/file=*", ["row_id", "note", "givenName"], split_bytes=0).where("_corrupt IS NULL")
    return found.select(file_of(F.col("file_path")).alias("file"), F.col("row_id").cast("long").alias("row_id"), "note", "givenName")


@query("multi_file_union", f"{WITH} SELECT row_id, CASE WHEN row_id % 2 = 0 THEN \"givenName\" ELSE '' END AS \"givenName\", CASE WHEN row_id % 2 = 1 THEN tags ELSE '' END AS tags FROM keyed")
def multi_file_union(s: SparkSession, d: str) -> DataFrame:
    """Two exports with different headers read as one."""
    frames = []
    for k, name in enumerate(("givenName", "tags")):
        rows = contacts(s, d).where(f"row_id % 2 = {k}").select(F.col("row_id").cast("string").alias("row_id"), name)
        rows.write.options(**(QUOTED | {"header": "true"})).csv(path := scratch(s, name))
        frames.append(files.csv_scan(s, path, ["row_id", name]))
    return files.multi_file_union(frames).select(F.col("row_id").cast("long").alias("row_id"), "givenName", "tags")


@query("file_content_hash", f"{WITH} SELECT {FILE} AS file, sha256(string_agg(row_id || ',' || obj_published || chr(10), '' ORDER BY row_id)) AS file_hash FROM keyed GROUP BY 1")
def file_content_hash(s: SparkSession, d: str) -> DataFrame:
    lines = contacts(s, d).select(F.floor(F.col("row_id") / FILE_KEYS).alias("file"), F.col("row_id").alias("ord"), F.concat_ws(",", "row_id", "obj_published").alias("line"))
    path = write_lines(lines, scratch(s, "hashed"))
    return files.file_content_hash(s, f"{path}/file=*").select(file_of(F.col("file_path")).alias("file"), "file_hash")


@query("file_hash_streamed", f"{WITH} SELECT {FILE} AS file, sha256(string_agg(row_id || ',' || obj_published || chr(10), '' ORDER BY row_id)) AS file_hash FROM keyed GROUP BY 1")
def file_hash_streamed(s: SparkSession, d: str) -> DataFrame:
    """As ``file_content_hash``, the way files beyond memory take."""
    lines = contacts(s, d).select(F.floor(F.col("row_id") / FILE_KEYS).alias("file"), F.col("row_id").alias("ord"), F.concat_ws(",", "row_id", "obj_published").alias("line"))
    path = write_lines(lines, scratch(s, "hashed"))
    return files.file_content_hash(s, f"{path}/file=*", 0).select(file_of(F.col("file_path")).alias("file"), "file_hash")


@query("taxonomy_scan", f"{WITH} SELECT trim(action_type) AS notation, lower(trim(action_type)) AS value, count(*) AS n FROM keyed WHERE trim(action_type) <> '' GROUP BY ALL")
def taxonomy_scan(s: SparkSession, d: str) -> DataFrame:
    """The distinct action types stored as a taxonomy, read back and joined."""
    kinds = contacts(s, d).select(fx.js_trim(F.col("action_type")).alias("notation")).where("notation <> ''")
    entries = kinds.distinct().select(F.struct("notation", F.lower("notation").alias("value")).alias("e"))
    entries.agg(F.to_json(F.collect_list("e")).alias("value")).write.text(path := scratch(s, "taxonomy"))
    return kinds.join(files.taxonomy_scan(s, path), "notation").groupBy("notation", "value").agg(F.count("*").alias("n"))


# rules from their files (2.1, 2.4)
RULES_FILE = {
    "fields": {
        "person.name": {"source": "givenName", "transforms": ["trim"]}, "person.id": {"source": ["primaryEmail", "additionalEmails"], "transforms": ["trim", "lowercase"]}, "person.unknown": {"literal": "never"},
        "action.type": {"source": "action_type", "taxonomy": "kinds", "fallback": "none"}, "action.note": {"source": "tags", "custom": "backwards", "when": [{"type": "columnExists", "column": "tags"}]},
        "action.absent": {"source": "tags", "when": [{"type": "columnExists", "column": "no_such"}]},
    },
    "llm": {"default": False, "fields": ["person.gender", "person.mood", "nowhere"]},
}
SCHEMA_FILE = {
    "entities": {
        "person": {"properties": {"name": {"type": "string", "required": True}, "id": {"type": "string", "required": True}, "gender": {"type": "string"}, "mood": {"type": "string"}}},
        "action": {"properties": {"type": {"type": "string", "enumFromTaxonomy": "kinds"}, "note": {"type": "string"}, "absent": {"type": "string"}}},
    }
}


@query(
    "rules_from_files",
    f"""{WITH.rstrip()}, m AS (SELECT row_id, nullif(trim("givenName"), '') AS name, lower(trim(CASE WHEN trim("primaryEmail") <> '' THEN "primaryEmail" ELSE "additionalEmails" END)) AS id, CASE WHEN trim(action_type) = '' THEN 'none' WHEN lower(trim(action_type)) IN ('zine', 'a zine') THEN 'A Zine' ELSE action_type END AS type, reverse(tags) AS note FROM keyed)
SELECT row_id, name, nullif(id, '') AS id, type, note, NULL AS absent, 'person.gender,person.mood,action.note' || CASE WHEN name IS NULL THEN ',person.name' ELSE '' END || CASE WHEN id = '' THEN ',person.id' ELSE '' END AS pending, type NOT IN ('A Zine') AS odd FROM m""",
)
def rules_from_files(s: SparkSession, d: str) -> DataFrame:
    """A rule set, its schema and a taxonomy written as files, loaded and applied; types outside the taxonomy are found by the schema's list."""
    folder = scratch(s, "rules")
    for name, content in (("rules", RULES_FILE), ("schema", SCHEMA_FILE), ("taxonomies/kinds", [{"notation": "zine", "value": "A Zine"}])):
        s.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.text(f"{folder}/{name}.json")
    loaded, schema = files.load_rules(s, f"{folder}/rules.json", f"{folder}/schema.json", f"{folder}/taxonomies", include=["action.note", "bogus"], custom={"backwards": F.reverse})
    mapped = rules.transform_row(contacts(s, d), loaded)
    allowed = schema["entities"]["action"]["properties"]["type"]["enum"]
    odd = checks.validate(mapped, [checks.Constraint("mapped.action.type", one_of=tuple(allowed))]).select("row_id", F.lit(True).alias("odd"))
    return mapped.join(odd, "row_id", "left").select("row_id", "mapped.person.name", "mapped.person.id", "mapped.action.type", "mapped.action.note", "mapped.action.absent", F.array_join("pending", ",").alias("pending"), F.coalesce("odd", F.lit(False)).alias("odd"))


@query("entity_merge_identified", f"{WITH.rstrip()}, t AS ({catalog.TAGS_SQL}), n AS (SELECT uuid, count(*) AS n_records FROM keyed WHERE uuid IS NOT NULL GROUP BY uuid) SELECT uuid, CASE WHEN n_records > 1 THEN uuid END AS \"userID\", CASE WHEN n_records > 1 THEN uuid END AS \"@id\", tags FROM n JOIN t USING (uuid)")
def entity_merge_identified(s: SparkSession, d: str) -> DataFrame:
    """Lists in lists united, and the identity of those merged."""
    tags = fx.t_split(F.col("tags"))
    rows = keyed(s, d).withColumn("tag_list", F.array(F.slice(tags, 1, 1), F.slice(tags, 2, 100), F.lit(None).cast("array<string>")))
    return merge.identified(merge.entity_merge(rows, "uuid", "row_id", lists=["tag_list"]), "uuid").select("uuid", "userID", "@id", F.array_join("tag_list", "|").alias("tags"))


# sinks and state tables (2.2)
def _jsonld(s: SparkSession, d: str) -> DataFrame:
    return merge.jsonld_project(catalog._entities(s, d), "uuid", "Person", ["givenName"])


def _read_jsonld(s: SparkSession, path: str) -> DataFrame:
    return s.read.text(path).select(F.get_json_object("value", "$['@id']").alias("uuid"), F.col("value").alias("jsonld"))


@query("jsonld_sink", catalog.SQL["jsonld_project"])
def jsonld_sink(s: SparkSession, d: str) -> DataFrame:
    files.jsonld_sink(_jsonld(s, d), path := scratch(s, "jsonld"))
    return _read_jsonld(s, path)


@query("jsonld_append", catalog.SQL["jsonld_project"])
def jsonld_append(s: SparkSession, d: str) -> DataFrame:
    """One half written, the other appended."""
    path = scratch(s, "jsonld")
    files.jsonld_sink(_jsonld(s, d).where("uuid < '8'"), path)
    files.jsonld_sink(_jsonld(s, d).where("uuid >= '8'"), path, "append")
    return _read_jsonld(s, path)


@query("append_table", f"{WITH} SELECT row_id, uuid FROM keyed")
def append_table(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "rows")
    for k in (0, 1):
        keyed(s, d).where(f"row_id % 2 = {k}").select("row_id", "uuid").write.mode("append").parquet(path)
    return s.read.parquet(path)


def _manifest(s: SparkSession, d: str) -> DataFrame:
    """Statuses of the exported files, appended as they change; every third file fails, the last ones wait."""
    path = scratch(s, "manifest")
    started = contacts(s, d).groupBy(F.floor(F.col("row_id") / FILE_KEYS).alias("file_id")).agg(F.count("*").alias("row_count"))
    for version, status, where in ((1, "pending", "true"), (2, "processing", "file_id % 5 < 4"), (3, "completed", "file_id % 5 < 3 AND file_id % 3 > 0"), (3, "failed", "file_id % 5 < 3 AND file_id % 3 = 0")):
        started.where(where).withColumn("status", F.lit(status)).withColumn("version", F.lit(version)).write.mode("append").parquet(path)
    return ledger.latest_status(s.read.parquet(path))


MANIFEST_SQL = f"manifest AS (SELECT f AS file_id, n AS row_count, CASE WHEN f % 5 = 4 THEN 'pending' WHEN f % 5 = 3 THEN 'processing' WHEN f % 3 = 0 THEN 'failed' ELSE 'completed' END AS status FROM (SELECT {FILE} AS f, count(*) AS n FROM keyed GROUP BY 1))"
STATUSES = ("pending", "processing", "completed", "failed")
query("set_status", f"{WITH.rstrip()}, {MANIFEST_SQL} SELECT file_id, status FROM manifest")(lambda s, d: _manifest(s, d).select("file_id", "status"))
query("file_status_summary", f"{WITH.rstrip()}, {MANIFEST_SQL} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in STATUSES) + " FROM manifest")(
    lambda s, d: _manifest(s, d).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == x).alias(x) for x in STATUSES]))


@query("progress", f"{WITH.rstrip()}, {MANIFEST_SQL} SELECT (SELECT count(*) FROM manifest) AS total_files, (SELECT count(*) FROM manifest WHERE status = 'completed') AS completed_files, (SELECT count(*) FROM manifest WHERE status = 'failed') AS failed_files, (SELECT count(*) FROM keyed) AS total_rows, (SELECT count(*) FROM processed) AS processed_rows, (SELECT count(*) FROM status) AS total_keys, (SELECT count(*) FROM status WHERE status = 'completed') AS completed_keys, (SELECT count(*) FROM status WHERE status IN ('pending', 'processing')) AS pending_keys")
def progress(s: SparkSession, d: str) -> DataFrame:
    return ledger.progress(_manifest(s, d), keyed(s, d), processed(s, d), catalog._counts(s, d))


@query("table_stats", f"{WITH.rstrip()}, {MANIFEST_SQL} SELECT 'files' AS name, count(*) AS n FROM manifest UNION ALL SELECT 'raw_rows', count(*) FROM keyed UNION ALL SELECT 'keys', count(*) FROM status UNION ALL SELECT 'processed_results', count(*) FROM processed UNION ALL SELECT 'merged_output', count(*) FROM status WHERE status = 'completed' UNION ALL SELECT 'rejected', 0")
def table_stats(s: SparkSession, d: str) -> DataFrame:
    merged = catalog._entities(s, d).join(catalog._counts(s, d).where("status = 'completed'"), "uuid", "left_semi")
    return ledger.table_stats({"files": _manifest(s, d), "raw_rows": keyed(s, d), "keys": catalog._counts(s, d), "processed_results": processed(s, d), "merged_output": merged, "rejected": keyed(s, d).where("false")})


# incremental ingest (2.13)
def _ingested(s: SparkSession, d: str) -> ingest.Ingested:
    return ingest.ingest(s, export(s, d), HEADER)


INGEST_SQL = f"ingested AS (SELECT {FILE} AS file, count(*) AS n_rows, count(*) FILTER ({REPEATED}) AS n_duplicates, count(DISTINCT uuid) + count(*) FILTER (uuid IS NULL) AS n_keys, count(*) FILTER (uuid IS NULL) AS n_random, count(*) FILTER (row_id % 101 = 0) AS n_rejected FROM keyed GROUP BY 1)"
@query("incremental_ingest", f"{WITH.rstrip()}, {INGEST_SQL} SELECT *, CASE WHEN n_rejected > 0 THEN 'failed' ELSE 'completed' END AS status, 'ingest' AS action FROM ingested")
def incremental_ingest(s: SparkSession, d: str) -> DataFrame:
    """Exported files ingested into a new state: what was planned, and what its manifest says."""
    plan = ingest.ingest_new(s, f"{export(s, d)}/file=*", HEADER, state := scratch(s, "state"))
    found = ingest.manifest(s, state).join(plan.select("file_path", "action"), "file_path")
    return found.select(file_of(F.col("file_path")).alias("file"), "n_rows", "n_duplicates", "n_keys", "n_random", "n_rejected", "status", "action")


query("ingestion_summary", f"{WITH.rstrip()}, {INGEST_SQL} SELECT file, n_rows, CASE WHEN n_rejected > 0 THEN 'failed' ELSE 'completed' END AS status FROM ingested UNION ALL SELECT NULL, cast(sum(n_rows) AS bigint), count(*) || ' files' FROM ingested")(
    lambda s, d: ingest.ingestion_summary(_ingested(s, d).manifest).select(F.when(F.col("file_path") != "total", F.regexp_extract("file_path", "file=([0-9]+)", 1)).cast("long").alias("file"), "n_rows", "status"))


@query("incremental_state", f"{WITH} SELECT row_id, \"givenName\", CASE WHEN row_id % 3 = 2 THEN 2 ELSE 1 END AS version, CASE WHEN row_id % 3 = 2 THEN 'ingest' ELSE 'skip' END AS action FROM keyed")
def incremental_state(s: SparkSession, d: str) -> DataFrame:
    """Two thirds of the files ingested, then all of them: the known ones are skipped."""
    source, state = scratch(s, "arriving"), scratch(s, "state")
    rows = contacts(s, d).select(F.col("row_id").cast("string").alias("row_id"), "givenName", "primaryEmail", (F.floor(F.col("row_id") / FILE_KEYS) * 3 + F.col("row_id") % 3).alias("file"))
    for where in ("file % 3 < 2", "file % 3 = 2"):
        rows.where(where).repartition("file").write.mode("append").partitionBy("file").options(**(QUOTED | {"header": "true"})).csv(source)
        plan = ingest.ingest_new(s, f"{source}/file=*/*.csv", ["row_id", "givenName", "primaryEmail"], state)
    return ingest.current_rows(s, state).join(plan, "file_path").select(F.col("row_id").cast("long").alias("row_id"), "givenName", F.col("version").cast("int").alias("version"), "action")


# resolver (2.12)
def greet(pdf: pd.DataFrame, model: str, error: str | None) -> pd.DataFrame:
    """An offline resolver that sees masked names only; some batches fail always, some once."""
    batch = int(pdf["batch_id"].iloc[0])
    if batch % 7 == 3 or (batch % 7 == 5 and model == "main"):
        raise ValueError("bad enum")
    return pd.DataFrame({"row_id": pdf["row_id"], "greeting": ["Dear " + name for name in pdf["givenName"]]})


def _processed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = contacts(s, d).withColumn("batch_id", F.floor(F.col("row_id") / 50))
    return resolve.process_batch(rows, catalog.RULES, greet, "row_id long, greeting string", {"givenName": ("NAME", False)}, [checks.Constraint("greeting", required=True)])


@query("process_batch", f"{WITH} SELECT row_id, nullif({catalog.NAME_SQL}, '') AS name, CASE WHEN (row_id // 50) % 7 <> 3 THEN 'Dear ' || \"givenName\" END AS greeting, (row_id // 50) % 7 = 3 AS violated FROM keyed")
def process_batch(s: SparkSession, d: str) -> DataFrame:
    results, violations, _ = _processed(s, d)
    bad = violations.select("row_id", F.lit(True).alias("violated")).distinct()
    return results.select("row_id", "mapped.person.name", "greeting").join(bad, "row_id", "left").select("row_id", "name", "greeting", F.coalesce("violated", F.lit(False)).alias("violated"))


@query("log_datasets", f"{WITH.rstrip()}, b AS (SELECT row_id // 50 AS id, count(*) AS n FROM keyed GROUP BY 1) SELECT 'model_input' AS kind, cast(sum(n) AS bigint) AS n FROM b UNION ALL SELECT 'validation_error', cast(sum(n) FILTER (id % 7 = 3) AS bigint) FROM b UNION ALL SELECT 'retry_attempt', cast(sum(CASE id % 7 WHEN 3 THEN 3 WHEN 5 THEN 1 ELSE 0 END) AS bigint) FROM b UNION ALL SELECT 'batch_outcome', count(*) FROM b UNION ALL SELECT 'uuid_event', cast(sum(n) AS bigint) FROM b")
def log_datasets(s: SparkSession, d: str) -> DataFrame:
    """All five kinds of records, written by kind and counted as read back."""
    results, violations, attempts = _processed(s, d)
    identities = keyed(s, d).select("row_id", "uuid", F.when(F.col("key").isNull(), "fallback_to_random").otherwise("generated").alias("event"))
    resolve.log_datasets(results, violations, attempts, identities).write.partitionBy("kind").parquet(path := scratch(s, "logs"))
    return s.read.parquet(path).groupBy(F.col("kind").cast("string").alias("kind")).agg(F.count("*").alias("n"))


def _logs(s: SparkSession, d: str) -> DataFrame:
    """All records of a run, with identities as assigned."""
    results, violations, attempts = _processed(s, d)
    rows = contacts(s, d)
    named = identity.assign_identity(catalog._valued(s, d))
    return resolve.log_datasets(results, violations, attempts, identity.identity_events(rows, named, rows.columns))


@query(
    "log_rollups",
    f"""{catalog.identity_sql('emails')}, b AS (SELECT row_id // 50 AS id, count(*) AS n FROM keyed GROUP BY 1)
SELECT 'missing_field' AS measure, 'greeting' AS value, cast(sum(n) AS bigint) AS n FROM b WHERE id % 7 = 3
UNION ALL SELECT 'retry', 'retry_with_fallback', cast(sum(CASE id % 7 WHEN 3 THEN 2 WHEN 5 THEN 1 END) AS bigint) FROM b UNION ALL SELECT 'retry', 'failed', count(*) FROM b WHERE id % 7 = 3
UNION ALL SELECT 'retry_error', 'validation_error', cast(sum(CASE id % 7 WHEN 3 THEN 3 WHEN 5 THEN 1 END) AS bigint) FROM b
UNION ALL SELECT 'outcome', CASE id % 7 WHEN 3 THEN 'failed' WHEN 5 THEN 'partial_success' ELSE 'success' END, count(*) FROM b GROUP BY 2
UNION ALL SELECT 'event', CASE event WHEN 'random' THEN 'fallback_to_random' ELSE event END, count(*) FROM ids GROUP BY 2
UNION ALL SELECT 'fallback', 'No valid UUID values found (no email or email columns), generating random UUID', count(*) FROM ids WHERE event = 'random'""",
)
def log_rollups(s: SparkSession, d: str) -> DataFrame:
    return resolve.log_rollups(_logs(s, d))


# streams (2.13)
RESULT = "uuid string, record_count long, ord long, givenName string"


def _results(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Results of rows with the number of results that their key expects."""
    return rows.where("uuid IS NOT NULL").join(expected.select("uuid", "record_count"), "uuid").select("uuid", "record_count", F.col("row_id").alias("ord"), "givenName")


def _streamed(s: SparkSession, d: str, orphan: str = "false") -> str:
    """All processed rows run through the stream in several micro-batches; nobody has announced ``orphan`` keys."""
    source, out = scratch(s, "results"), scratch(s, "stream")
    done = keyed(s, d).join(processed(s, d).select("row_id"), "row_id", "left_semi")
    results = _results(done, catalog._counts(s, d)).withColumn("record_count", F.expr(f"if({orphan}, 0, record_count)"))
    results.repartition(4, "ord").write.parquet(source)
    completion.run_available(s, source, RESULT, out, f"{out}/checkpoint", ["givenName"], max_files=2)
    return out


COMPLETED = f"{WITH.rstrip()}, e AS ({catalog.ENTITY}), done AS (SELECT uuid, n_records, \"givenName\" FROM e JOIN status USING (uuid) WHERE record_count = processed_count)"
query("stream_key_completion", f"{COMPLETED} SELECT * FROM done")(lambda s, d: completion.latest(s, _streamed(s, d)).select("uuid", "n_records", "givenName"))
query("stream_progress", f"{COMPLETED} SELECT (SELECT count(*) FROM processed WHERE uuid IS NOT NULL) AS n_results, (SELECT count(DISTINCT uuid) FROM processed) AS n_keys, (SELECT count(*) FROM done) AS n_completed")(lambda s, d: completion.progress(s, _streamed(s, d)).select("n_results", "n_keys", "n_completed"))
ORPHAN = "uuid >= 'c'"


@query("stream_restore", f"{COMPLETED} SELECT uuid, n_records FROM done WHERE NOT ({catalog.EMITTED}) AND NOT ({ORPHAN}) UNION ALL SELECT uuid, count(*) FROM processed WHERE {ORPHAN} GROUP BY uuid")
def stream_restore(s: SparkSession, d: str) -> DataFrame:
    """A run that stopped before it had emitted every entity: the rest, and keys that nobody had announced."""
    out = _streamed(s, d, ORPHAN)
    return completion.restore(s, out, completion.latest(s, out).where(catalog.EMITTED)).select("uuid", "n_records")


@query("stream_finalize", f"{COMPLETED} SELECT uuid, n_records FROM done WHERE NOT ({catalog.EMITTED})")
def stream_finalize(s: SparkSession, d: str) -> DataFrame:
    """The end of a stream that had emitted some entities: all others that are complete."""
    out = _streamed(s, d)
    return completion.finalize(s, out, completion.latest(s, out).where(catalog.EMITTED)).select("uuid", "n_records")


TAGGED = RESULT + ", tag_list array<string>"


@query("stream_entity_lists", f"{WITH.rstrip()}, t AS ({catalog.TAGS_SQL}), n AS (SELECT uuid, count(*) AS n_records FROM keyed WHERE uuid IS NOT NULL GROUP BY uuid) SELECT uuid, n_records, tags FROM n JOIN t USING (uuid)")
def stream_entity_lists(s: SparkSession, d: str) -> DataFrame:
    """All rows in several micro-batches, the later ones first; lists are united in the order of the rows."""
    source, out = scratch(s, "results"), scratch(s, "stream")
    rows = keyed(s, d).where("uuid IS NOT NULL").join(catalog._counts(s, d).select("uuid", "record_count"), "uuid")
    rows.select("uuid", "record_count", (F.col("row_id")).alias("ord"), "givenName", fx.t_split(F.col("tags")).alias("tag_list")).repartition(4, "ord").write.parquet(source)
    completion.run_available(s, source, TAGGED, out, f"{out}/checkpoint", ["givenName"], ["tag_list"], max_files=2)
    return completion.latest(s, out).select("uuid", "n_records", F.array_join("tag_list", "|").alias("tags"))


@query("stream_upsert_entities", f"{WITH.rstrip()}, e AS ({catalog.ENTITY}) SELECT uuid, n_records, \"givenName\" FROM e")
def stream_upsert_entities(s: SparkSession, d: str) -> DataFrame:
    """Even rows first, which completes their keys; the late odd rows reopen and replace them."""
    source, out = scratch(s, "results"), scratch(s, "stream")
    rows = keyed(s, d)
    for part, seen in ((rows.where("row_id % 2 = 0"), rows.where("row_id % 2 = 0")), (rows.where("row_id % 2 = 1"), rows)):
        expected = seen.where("uuid IS NOT NULL").groupBy("uuid").agg(F.count("*").alias("record_count"))
        _results(part, expected).write.mode("append").parquet(source)
        completion.run_available(s, source, RESULT, out, f"{out}/checkpoint", ["givenName"])
    return completion.latest(s, out).select("uuid", "n_records", "givenName")
