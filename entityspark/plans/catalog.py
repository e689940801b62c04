"""All registered queries of the library with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityspark.functions import text as fx
from entityspark.operators import checks, identity, ledger, merge, pii, resolve, rules, runs
from entityspark.plans import views
from entityspark.plans.registry import QUERIES, SQL, Query, query
from entityspark.plans.views import WITH, contacts, free_text, keyed, processed, read

def over_contacts(name: str, value: Callable[[], Column] | Column, sql: str, where: str = "true") -> None:
    """A query of one computed column over all contacts."""
    make = value if callable(value) else lambda: value
    query(name, f"{WITH} SELECT row_id, {sql} AS value FROM keyed WHERE {where}")(lambda s, d: keyed(s, d).where(where).select("row_id", make().alias("value")))


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


c = lambda n: F.col(n)  # noqa: E731  shorthand for the table below
SPLIT = "list_filter(list_transform(string_split(tags, ','), lambda x: trim(x)), lambda x: x <> '')"
CANON = "CASE lower(trim(action_type)) WHEN 'action_web_read' THEN 'web_read' WHEN 'web_read' THEN 'web_read' WHEN 'newsletter_click' THEN 'newsletter_click' ELSE action_type END"

# scalar functions, predicates and mapping (2.3 - 2.6): name, Spark column, SQL
for _name, _value, _sql in [
    ("t_trim", lambda: fx.js_trim(c("primaryEmail")), 'trim("primaryEmail")'),
    ("t_lowercase", lambda: F.lower(c("primaryEmail")), 'lower("primaryEmail")'),
    ("t_uppercase", lambda: F.upper(c("tags")), "upper(tags)"),
    ("t_split", lambda: joined(fx.t_split(c("tags"))), f"array_to_string({SPLIT}, '|')"),
    ("t_unique", lambda: joined(fx.t_unique(fx.t_split(c("tags")))), f"array_to_string(list_filter({SPLIT}, lambda x, i: list_position(list_transform({SPLIT}, lambda y: lower(y)), lower(x)) = i), '|')"),
    ("t_filter_empty", lambda: joined(fx.t_filter_empty(F.split(c("tags"), ","))), "array_to_string(list_filter(string_split(tags, ','), lambda x: trim(x) <> ''), '|')"),
    ("t_map", lambda: fx.t_map(c("action_type"), {"NewsletterClick": "newsletter_click"}), "CASE WHEN lower(action_type) = 'newsletterclick' THEN 'newsletter_click' ELSE action_type END"),
    ("t_to_number", lambda: fx.t_to_number(c("action_timeSpent")), "TRY_CAST(trim(\"action_timeSpent\") AS double)"),
    ("t_seconds_to_duration", lambda: fx.t_seconds_to_duration(fx.t_to_number(c("action_timeSpent")) / 7), "'PT' || cast(cast(floor(TRY_CAST(trim(\"action_timeSpent\") AS double) / 7 + 0.5) AS bigint) AS varchar) || 'S'"),
    ("transform_chain", lambda: joined(rules.apply_steps(c("tags"), ("trim", "lowercase", "split", "unique"))[0]), "array_to_string(list_filter(list_transform(string_split(lower(tags), ','), lambda x: trim(x)), lambda x, i: x <> '' AND list_position(list_transform(string_split(lower(tags), ','), lambda y: trim(y)), x) = i), '|')"),
    ("split_values", lambda: joined(fx.split_values(c("additionalEmails"))), "array_to_string(list_filter(list_transform(regexp_split_to_array(\"additionalEmails\", '[,|;]+'), lambda x: trim(x)), lambda x: x <> ''), '|')"),
    ("normalize_field_name", lambda: fx.normalize_field_name(c("action_type")), "lower(regexp_replace(action_type, '[^a-zA-Z0-9]', '', 'g'))"),
    ("normalize_pii_key", lambda: fx.normalize_pii_key(c("tags")), "regexp_replace(lower(tags), '\\s+', '', 'g')"),
    ("array_add_if_missing", lambda: joined(fx.add_if_missing(fx.t_split(c("tags")), F.lit("1-URGENT"))), f"array_to_string(CASE WHEN list_contains({SPLIT}, '1-URGENT') THEN {SPLIT} ELSE list_append({SPLIT}, '1-URGENT') END, '|')"),
    ("array_union_ordered", lambda: joined(F.array_distinct(F.concat(fx.t_split(c("tags")), F.array(F.lit("x"), F.upper(F.split(c("tags"), ",")[0]))))), f"array_to_string({SPLIT} || ['x'], '|')"),
    ("strip_result_prefix", lambda: fx.strip_result_prefix(F.concat(F.lit("results."), c("row_id").cast("string"), F.lit(".person.name"))), "'person.name'"),
    ("value_at_path", lambda: F.get_json_object(F.to_json(F.struct(F.struct(c("tags")).alias("person"))), "$.person.tags"), "tags"),
    ("parse_result_json", lambda: F.from_json(F.to_json(F.struct("givenName", "row_id")), "givenName string, row_id bigint")["givenName"], '"givenName"'),
    ("row_to_json", lambda: F.to_json(F.struct("row_id", "tags")), "'{\"row_id\":' || row_id || ',\"tags\":\"' || tags || '\"}'"),
    ("error_type_of", lambda: fx.error_type(F.when(c("row_id") % 4 == 0, "Required field x").when(c("row_id") % 4 == 1, "bad enum"), F.when(c("row_id") % 4 == 2, 429)), "CASE row_id % 4 WHEN 0 THEN 'required_field_error' WHEN 1 THEN 'validation_error' WHEN 2 THEN 'api_error' ELSE 'network_error' END"),
    ("when_not_empty", lambda: rules.condition(["givenName"], {"type": "notEmpty", "column": "givenName"}), "trim(\"givenName\") <> ''"),
    ("when_equals", lambda: rules.condition(["action_type"], {"type": "equals", "column": "action_type", "value": "zine"}), "action_type = 'zine'"),
    ("when_matches", lambda: rules.condition(["tags"], {"type": "matches", "column": "tags", "value": "BUILD|1-"}), "regexp_matches(tags, 'BUILD|1-')"),
    ("when_all", lambda: fx.all_of([rules.condition(["tags", "givenName"], {"type": "notEmpty", "column": "givenName"}), rules.condition(["tags"], {"type": "matches", "column": "tags", "value": "1-"})]), "trim(\"givenName\") <> '' AND regexp_matches(tags, '1-')"),
    ("is_empty_value", lambda: fx.is_blank(c("givenName")), "trim(\"givenName\") = ''"),
    ("check_not_empty", lambda: c("givenName").isNotNull() & (c("givenName") != ""), "\"givenName\" <> ''"),
    ("map_source", lambda: rules.value_of(["givenName"], rules.Rule("givenName"))[0], "CASE WHEN trim(\"givenName\") <> '' THEN \"givenName\" END"),
    ("map_coalesce_sources", lambda: rules.value_of(["givenName", "action_type", "tags"], rules.Rule(["givenName", "action_type", "tags"]))[0], "CASE WHEN trim(\"givenName\") <> '' THEN \"givenName\" WHEN trim(action_type) <> '' THEN action_type ELSE tags END"),
    ("map_literal", lambda: rules.value_of(["tags"], rules.Rule("tags", literal="crm"))[0], "'crm'"),
    ("map_fallback", lambda: rules.value_of(["action_type"], rules.Rule("action_type", fallback="web_read"))[0], "CASE WHEN trim(action_type) = '' THEN 'web_read' ELSE action_type END"),
    ("taxonomy_normalize", lambda: rules.taxonomy_normalize(c("action_type"), views.ACTIONS), CANON),
    ("unwrap_required", lambda: rules.unwrap_required(F.struct(c("tags").alias("value"), (c("row_id") % 2 == 0).alias("present"))), "CASE WHEN row_id % 2 = 0 THEN tags END"),
    ("extract_emails", lambda: joined(c("emails")), "array_to_string(emails, '|')"),
    ("extract_id_values", lambda: joined(fx.id_values(["primaryEmail", "additionalEmails", "givenName"], "givenName")), "CASE WHEN trim(\"givenName\") <> '' THEN lower(trim(\"givenName\")) ELSE array_to_string(emails, '|') END"),
    ("uuid_v5", lambda: c("uuid"), "uuid"),
    ("comma_field_list", lambda: F.when(F.size(fx.t_split(F.nullif(c("additionalEmails"), F.lit("")))) > 0, joined(fx.t_split(c("additionalEmails")))), "CASE WHEN trim(\"additionalEmails\") <> '' THEN array_to_string(list_transform(string_split(\"additionalEmails\", ','), lambda x: trim(x)), '|') END"),
    ("custom_rule", lambda: rules.value_of(["tags"], rules.Rule("tags", custom=lambda x: F.reverse(F.upper(x))))[0], "reverse(upper(tags))"),
]:
    over_contacts(_name, _value, _sql)

RULES = rules.RuleSet(
    {
        "person.name": rules.Rule("givenName", transforms=("trim",)),
        "person.tags": rules.Rule("tags", transforms=("split", "unique")),
        "action.type": rules.Rule("action_type", transforms=({"type": "map", "values": {"newsletterClick": "newsletter_click"}},), fallback="web_read", taxonomy=views.ACTIONS),
        "action.duration": rules.Rule("action_timeSpent", transforms=("toNumber", "secondsToDuration")),
        "action.published": rules.Rule("obj_published", when=({"type": "matches", "column": "tags", "value": "1-|2-"},)),
    },
    required=("person.name", "action.published", "person.userID"),
    model_fields=("person.gender",),
)
NAME_SQL = "trim(\"givenName\")"
TYPE_SQL = "CASE WHEN trim(action_type) = '' THEN 'web_read' WHEN lower(action_type) = 'newsletterclick' THEN 'newsletter_click' WHEN lower(trim(action_type)) IN ('web_read', 'action_web_read') THEN 'web_read' ELSE action_type END"
PUBLISHED_SQL = "CASE WHEN regexp_matches(tags, '1-|2-') THEN obj_published END"
MISSING_SQL = f"list_filter([CASE WHEN {NAME_SQL} = '' THEN 'person.name' END, CASE WHEN {PUBLISHED_SQL} IS NULL THEN 'action.published' END, 'person.userID'], lambda x: x IS NOT NULL)"


@query("transform_row", f"{WITH} SELECT row_id, nullif({NAME_SQL}, '') AS name, {TYPE_SQL} AS type, 'PT' || cast(cast(TRY_CAST(trim(\"action_timeSpent\") AS double) AS bigint) AS varchar) || 'S' AS duration, {PUBLISHED_SQL} AS published, array_to_string({MISSING_SQL}, ',') AS missing FROM keyed")
def transform_row(s: SparkSession, d: str) -> DataFrame:
    out = rules.transform_row(contacts(s, d), RULES)
    return out.select("row_id", "mapped.person.name", "mapped.action.type", "mapped.action.duration", "mapped.action.published", F.array_join("missing", ",").alias("missing"))


@query("nest_paths", f"{WITH} SELECT row_id, {NAME_SQL} AS name FROM keyed")
def nest_paths(s: SparkSession, d: str) -> DataFrame:
    return contacts(s, d).select("row_id", *rules.nest({"person.name": fx.js_trim(F.col("givenName")), "action.at": F.col("obj_published")})).select("row_id", "person.name")


@query("missing_required", f"{WITH} SELECT row_id, len({MISSING_SQL}) AS n_missing FROM keyed")
def missing_required(s: SparkSession, d: str) -> DataFrame:
    return rules.transform_row(contacts(s, d), RULES).select("row_id", F.size("missing").cast("bigint").alias("n_missing"))


@query("pending_fields", f"{WITH} SELECT row_id, array_to_string(['person.gender'] || {MISSING_SQL}, ',') AS pending FROM keyed")
def pending_fields(s: SparkSession, d: str) -> DataFrame:
    return rules.transform_row(contacts(s, d), RULES).select("row_id", F.array_join("pending", ",").alias("pending"))


@query("pending_union", f"{WITH} SELECT row_id // 50 AS batch_id, array_to_string(list_sort(list_distinct(flatten(list({MISSING_SQL})))), ',') AS pending FROM keyed GROUP BY 1")
def pending_union(s: SparkSession, d: str) -> DataFrame:
    out = rules.transform_row(contacts(s, d), RULES).withColumn("batch_id", F.floor(F.col("row_id") / 50))
    return out.groupBy("batch_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("missing")))), ",").alias("pending"))


TARGET = T.StructType().add("person", T.StructType().add("name", "string").add("tags", T.ArrayType(T.StringType()))).add("action", T.StructType().add("type", "string").add("published", "string"))


@query("prune_schema", f"{WITH} SELECT row_id, '{{\"person\":{{' || coalesce('\"name\":\"' || nullif({NAME_SQL}, '') || '\"', '') || '}},\"action\":{{\"type\":\"' || {TYPE_SQL} || '\"}}}}' AS kept FROM keyed")
def prune_schema(s: SparkSession, d: str) -> DataFrame:
    kept = rules.prune_schema(TARGET, ["person.name", "action.type"])
    return rules.transform_row(contacts(s, d), RULES).select("row_id", F.to_json(rules.project(F.col("mapped"), kept)).alias("kept"))


@query("merge_deep", f"{WITH} SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'x' ELSE tags END AS tags, \"givenName\" AS name FROM keyed")
def merge_deep(s: SparkSession, d: str) -> DataFrame:
    df = contacts(s, d).select("row_id", F.struct(F.col("tags"), F.col("givenName").alias("name")).alias("a"), F.struct(F.when(F.col("row_id") % 2 == 0, "x").alias("tags"), F.lit(None).cast("string").alias("name")).alias("b"))
    return df.select("row_id", rules.merge_deep(F.col("a"), F.col("b"), df.schema["a"].dataType).alias("m")).select("row_id", "m.tags", "m.name")


@query("taxonomy_join", f"{WITH} SELECT row_id, {CANON} AS value FROM keyed")
def taxonomy_join(s: SparkSession, d: str) -> DataFrame:
    entries = s.createDataFrame([(k.lower(), v) for n, v in views.ACTIONS.items() for k in (n, v)], "k string, canonical string")
    return contacts(s, d).join(F.broadcast(entries), F.lower(fx.js_trim(F.col("action_type"))) == F.col("k"), "left").select("row_id", F.coalesce("canonical", "action_type").alias("value"))


# rules whose required fields all have one, so that rows can be resolved without a model
SETTLED = rules.RuleSet(RULES.fields, required=("person.name", "action.published"))
SETTLED_SQL = f"trim(\"givenName\") <> '' AND {PUBLISHED_SQL} IS NOT NULL"


@query("split_resolved_pending", f"{WITH} SELECT row_id, {SETTLED_SQL} AS resolved FROM keyed")
def split_resolved_pending(s: SparkSession, d: str) -> DataFrame:
    done, rest = resolve.split_resolved(rules.transform_row(contacts(s, d), SETTLED))
    return done.select("row_id", F.lit(True).alias("resolved")).unionByName(rest.select("row_id", F.lit(False).alias("resolved")))


@query("deterministic_output", f"{WITH} SELECT row_id, nullif({NAME_SQL}, '') AS name, {TYPE_SQL} AS type, {PUBLISHED_SQL} AS published FROM keyed WHERE {SETTLED_SQL}")
def deterministic_output(s: SparkSession, d: str) -> DataFrame:
    done, _ = resolve.split_resolved(rules.transform_row(contacts(s, d), SETTLED))
    return done.select("row_id", "mapped.person.name", "mapped.action.type", "mapped.action.published")


@query(
    "wrap_required",
    f"""{WITH} SELECT row_id, '{{"person":{{"name":{{' || CASE WHEN {NAME_SQL} <> '' THEN '"value":"' || {NAME_SQL} || '",' ELSE '' END || '"present":' || ({NAME_SQL} <> '') || '}}}},"action":{{"type":"' || {TYPE_SQL} || '","published":{{'
  || coalesce('"value":"' || {PUBLISHED_SQL} || '",', '') || '"present":' || ({PUBLISHED_SQL} IS NOT NULL) || '}}}}}}' AS wrapped FROM keyed""",
)
def wrap_required(s: SparkSession, d: str) -> DataFrame:
    """Mapped rows with their required values as {value, present}."""
    kept = {p: RULES.fields[p] for p in ("person.name", "action.type", "action.published")}
    return rules.transform_row(contacts(s, d), rules.RuleSet(kept, SETTLED.required), wrap=True).select("row_id", F.to_json("mapped").alias("wrapped"))


@query(
    "overlay_deterministic",
    f"""{WITH.rstrip()}, got AS (SELECT row_id, row_id // 50 AS batch_id FROM keyed WHERE (row_id // 50) % 3 > 0 OR row_id % 5 <> 0), sizes AS (SELECT row_id // 50 AS batch_id, count(*) AS n, count(*) FILTER ((row_id // 50) % 3 > 0 OR row_id % 5 <> 0) AS m FROM keyed GROUP BY 1)
SELECT k.row_id, CASE WHEN n = m AND {NAME_SQL} <> '' THEN {NAME_SQL} ELSE 'model name' END AS name, CASE WHEN n = m THEN {TYPE_SQL} ELSE 'model' END AS type, CASE WHEN n = m THEN coalesce({PUBLISHED_SQL}, 'some day') ELSE 'some day' END AS published
FROM keyed k JOIN got USING (row_id) JOIN sizes USING (batch_id)""",
)
def overlay_deterministic(s: SparkSession, d: str) -> DataFrame:
    """Rule values over a model's; a third of the batches lost answers and keep what the model said."""
    kept = {p: RULES.fields[p] for p in ("person.name", "action.type", "action.published")}
    mapped = rules.transform_row(contacts(s, d), rules.RuleSet(kept)).withColumn("batch_id", F.floor(F.col("row_id") / 50))
    said = F.struct(F.struct(F.lit("model name").alias("name")).alias("person"), F.struct(F.lit("model").alias("type"), F.lit("some day").alias("published")).alias("action"))
    answers = mapped.where("batch_id % 3 > 0 OR row_id % 5 <> 0").select("batch_id", "row_id", said.alias("answers"))
    return resolve.overlay(mapped, answers).select("row_id", "result.person.name", "result.action.type", "result.action.published")


query("uuid_random", f"{WITH} SELECT row_id, {views._UUID} AS uuid FROM (SELECT row_id, sha1(unhex('{fx.NAMESPACE}') || encode('row:' || row_id)) AS h FROM keyed WHERE key IS NULL)")(
    lambda s, d: identity.assign_identity(_valued(s, d), "first_value").where("event = 'random'").select("row_id", "uuid"))
query("row_hash", f"{WITH} SELECT row_id, sha256('{{' || coalesce('\"uuid\":\"' || uuid || '\",', '') || '\"rawData\":{{\"tags\":\"' || tags || '\",\"action_type\":\"' || action_type || '\"}}}}') AS value FROM keyed")(
    lambda s, d: keyed(s, d).select("row_id", fx.row_hash(F.col("uuid"), ["tags", "action_type"]).alias("value")))
query("pii_passthrough", f"{WITH} SELECT row_id, \"givenName\", \"primaryEmail\", \"additionalEmails\", tags, cast(0 AS bigint) AS n_placeholders FROM keyed")(lambda s, d: _passed(s, d))


def _passed(s: SparkSession, d: str) -> DataFrame:
    """Masking switched off: rows as they are, an empty dictionary."""
    rows, table = pii.mask(contacts(s, d), FIELDS, "row_id", enabled=False)
    return rows.select("row_id", "givenName", "primaryEmail", "additionalEmails", "tags", F.lit(table.count()).cast("long").alias("n_placeholders"))


EXISTING = "row_id % 2 = 0 AND row_id % 3 > 0"
query("insert_ignore", f"{WITH} SELECT \"givenName\", action_type, min(row_id) AS row_id FROM keyed k WHERE row_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM keyed o WHERE o.row_id % 2 = 0 AND o.row_id % 3 > 0 AND o.\"givenName\" = k.\"givenName\" AND o.action_type = k.action_type) GROUP BY ALL")(
    lambda s, d: ledger.insert_ignore(contacts(s, d).where(EXISTING), contacts(s, d).where("row_id % 2 = 1"), ["givenName", "action_type"], "row_id").select("givenName", "action_type", "row_id"))
query("insert_counts", f"{WITH.rstrip()}, added AS (SELECT DISTINCT \"givenName\", action_type FROM keyed WHERE row_id % 2 = 1 EXCEPT SELECT \"givenName\", action_type FROM keyed WHERE {EXISTING}) SELECT (SELECT count(*) FROM added) AS inserted, (SELECT count(*) FROM keyed WHERE row_id % 2 = 1) - (SELECT count(*) FROM added) AS ignored")(
    lambda s, d: ledger.insert_counts(contacts(s, d).where(EXISTING), contacts(s, d).where("row_id % 2 = 1"), ["givenName", "action_type"], "row_id"))


@query("attach_results", f"{WITH.rstrip()}, b AS (SELECT *, row_id // 50 AS batch_id FROM keyed) SELECT batch_id, row_id, uuid, 'done ' || obj_published AS result, NULL AS n_results FROM b WHERE batch_id % 4 > 0 UNION ALL SELECT batch_id, NULL, NULL, NULL, count(*) FILTER (row_id % 5 <> 0) FROM b WHERE batch_id % 4 = 0 GROUP BY 1")
def attach_results(s: SparkSession, d: str) -> DataFrame:
    """Results of batches, a quarter of which lost some and are refused."""
    rows = keyed(s, d).withColumn("batch_id", F.floor(F.col("row_id") / 50))
    results = rows.where("batch_id % 4 > 0 OR row_id % 5 <> 0").select("batch_id", "row_id", F.concat(F.lit("done "), "obj_published").alias("result"))
    found, refused = ledger.attach_results(rows.select("batch_id", "row_id", "uuid"), results)
    return found.withColumn("n_results", F.lit(None).cast("long")).unionByName(refused.select("batch_id", "n_results"), allowMissingColumns=True)


# joins, counts and states (2.8 - 2.10)
@query("unprocessed_rows", f"{WITH} SELECT row_id FROM keyed WHERE row_id NOT IN (SELECT row_id FROM processed)")
def unprocessed_rows(s: SparkSession, d: str) -> DataFrame:
    return ledger.unprocessed_rows(keyed(s, d), processed(s, d)).select("row_id")


@query("unprocessed_count", f"{WITH} SELECT count(*) AS n FROM keyed WHERE row_id % 5 = 0")
def unprocessed_count(s: SparkSession, d: str) -> DataFrame:
    return keyed(s, d).join(processed(s, d), "row_id", "left_anti").agg(F.count("*").alias("n"))


@query("processed_rows", f"{WITH} SELECT k.row_id, k.uuid, p.result_id FROM keyed k JOIN processed p USING (row_id) WHERE k.uuid IS NOT NULL")
def processed_rows(s: SparkSession, d: str) -> DataFrame:
    return keyed(s, d).where("uuid IS NOT NULL").select("row_id", "uuid").join(processed(s, d).drop("uuid"), "row_id")


def _counts(s: SparkSession, d: str) -> DataFrame:
    return ledger.sync_counts(keyed(s, d), processed(s, d))


query("sync_counts", f"{WITH} SELECT * FROM status")(_counts)
query("key_fully_processed", f"{WITH} SELECT uuid, record_count = processed_count AS complete FROM status")(lambda s, d: _counts(s, d).select("uuid", F.expr("record_count = processed_count").alias("complete")))
query("key_completion", f"{WITH} SELECT count(*) AS n_completed FROM status WHERE status = 'completed'")(lambda s, d: _counts(s, d).where("status = 'completed'").agg(F.count("*").alias("n_completed")))
query("key_status_summary", f"{WITH} SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed FROM status")(
    lambda s, d: _counts(s, d).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == x).alias(x) for x in ("pending", "processing", "completed")]))
query("filter_by_status", f"{WITH} SELECT uuid FROM status WHERE status IN ('pending', 'processing')")(lambda s, d: _counts(s, d).where(F.col("status").isin("pending", "processing")).select("uuid"))
EMITTED = "substr(uuid, 1, 1) < '4'"
query("ready_for_merge", f"{WITH} SELECT uuid FROM status WHERE record_count = processed_count AND NOT ({EMITTED})")(lambda s, d: ledger.ready_for_merge(_counts(s, d), _counts(s, d).where(EMITTED)).select("uuid"))
query("reconcile_orphans", f"{WITH} SELECT uuid, count(*) AS processed_count FROM processed WHERE uuid NOT IN (SELECT uuid FROM keyed WHERE uuid IS NOT NULL AND file_id <> 0) GROUP BY uuid")(
    lambda s, d: ledger.reconcile_orphans(keyed(s, d).where("file_id <> 0"), processed(s, d).where("uuid IS NOT NULL")))
query("drop_missing_key", f"{WITH} SELECT row_id, uuid FROM keyed WHERE uuid IS NOT NULL")(lambda s, d: keyed(s, d).where("uuid IS NOT NULL").select("row_id", "uuid"))
query("range_scan", f"{WITH} SELECT row_id FROM keyed WHERE row_id BETWEEN 100 AND 900")(lambda s, d: keyed(s, d).where(F.col("row_id").between(100, 900)).select("row_id").orderBy("row_id"))
query("rows_per_key_file", f"{WITH} SELECT file_id, uuid, count(*) AS n FROM keyed WHERE uuid IS NOT NULL GROUP BY file_id, uuid")(lambda s, d: keyed(s, d).where("uuid IS NOT NULL").groupBy("file_id", "uuid").agg(F.count("*").alias("n")))
query("row_counts", f"{WITH} SELECT file_id, count(*) AS n FROM keyed GROUP BY file_id")(lambda s, d: contacts(s, d).groupBy("file_id").agg(F.count("*").alias("n")))
query("next_index", f"{WITH} SELECT coalesce(max(row_id), -1) + 1 AS next_index FROM keyed")(lambda s, d: contacts(s, d).agg((F.coalesce(F.max("row_id"), F.lit(-1)) + 1).alias("next_index")))
query("distinct_keys", f"{WITH} SELECT DISTINCT uuid FROM keyed WHERE file_id = 1 AND uuid IS NOT NULL")(lambda s, d: keyed(s, d).where("file_id = 1 AND uuid IS NOT NULL").select("uuid").distinct())
query("random_uuid_count", f"{WITH} SELECT file_id, count(*) FILTER (uuid IS NULL) AS n_random FROM keyed GROUP BY file_id")(lambda s, d: keyed(s, d).groupBy("file_id").agg(F.count_if(F.col("uuid").isNull()).alias("n_random")))
query("source_value", f"{WITH} SELECT file_id, uuid, arg_min(coalesce(nullif(trim(CASE WHEN row_id % 3 = 0 THEN action_type ELSE '' END), ''), nullif(\"primaryEmail\", ''), nullif(\"additionalEmails\", ''), 'unknown'), row_id) AS source_value FROM keyed WHERE uuid IS NOT NULL GROUP BY file_id, uuid")(lambda s, d: _source_values(s, d))


def _source_values(s: SparkSession, d: str) -> DataFrame:
    """What named each person first in each file; some rows have a key column, some no address in the main column."""
    rows = keyed(s, d).withColumn("member", F.when(F.col("row_id") % 3 == 0, fx.js_trim(F.col("action_type"))).otherwise(""))
    value = identity.source_value(["member", "primaryEmail", "additionalEmails", "tags", "userID"], "member")
    return rows.where("uuid IS NOT NULL").groupBy("file_id", "uuid").agg(F.min_by(value, "row_id").alias("source_value"))


query("duplicate_count", f"{WITH} SELECT file_id, count(*) - count(DISTINCT tags || '|' || action_type) AS duplicates FROM keyed GROUP BY file_id")(
    lambda s, d: contacts(s, d).groupBy("file_id").agg((F.count("*") - F.countDistinct(F.concat_ws("|", "tags", "action_type"))).alias("duplicates")))
query("dedup_rows", f"{WITH} SELECT file_id, tags, action_type, min(row_id) AS row_id FROM keyed GROUP BY ALL")(lambda s, d: ledger.dedup_rows(contacts(s, d), "file_id", ["tags", "action_type"], "row_id").select("file_id", "tags", "action_type", "row_id"))
query("file_row_index", f"{WITH} SELECT row_id, row_number() OVER (PARTITION BY file_id ORDER BY row_id) - 1 AS file_row_index FROM keyed")(
    lambda s, d: ledger.file_row_index(contacts(s, d), "file_id", "row_id").select("row_id", F.col("file_row_index").cast("bigint").alias("file_row_index")))
query("global_row_index", f"{WITH} SELECT row_id, row_number() OVER (ORDER BY file_id, row_id) - 1 AS global_row_index FROM keyed")(lambda s, d: ledger.global_row_index(contacts(s, d), "file_id", "row_id").select("row_id", "global_row_index"))
query("fixed_batches", f"{WITH} SELECT row_id // 100 AS batch_id, min(row_id) AS first_row, max(row_id) AS last_row, count(*) AS n FROM keyed GROUP BY 1")(
    lambda s, d: ledger.fixed_batches(contacts(s, d), 100, "row_id").groupBy("batch_id").agg(F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"), F.count("*").alias("n")))
query("ordered_scan", f"{WITH} SELECT row_id, uuid FROM keyed ORDER BY row_id")(lambda s, d: keyed(s, d).select("row_id", "uuid").orderBy("row_id"))
query("limit_n", f"{WITH} SELECT row_id FROM keyed ORDER BY row_id LIMIT 20")(lambda s, d: contacts(s, d).select("row_id").orderBy("row_id").limit(20))
query("set_union_values", f"{WITH} SELECT emails[1] AS value FROM keyed WHERE key IS NOT NULL UNION SELECT lower(trim(tags)) FROM keyed")(lambda s, d: keyed(s, d).where("key IS NOT NULL").select(F.col("key").alias("value")).union(contacts(s, d).select(F.lower(fx.js_trim(F.col("tags"))))).distinct())
query("set_minus", f"{WITH} SELECT DISTINCT uuid FROM keyed WHERE uuid IS NOT NULL AND uuid NOT IN (SELECT uuid FROM processed WHERE uuid IS NOT NULL)")(lambda s, d: keyed(s, d).where("uuid IS NOT NULL").select("uuid").distinct().join(processed(s, d), "uuid", "left_anti"))
query("upsert_latest", f"{WITH} SELECT row_id, CASE WHEN row_id % 5 <> 0 THEN 'done' ELSE 'new' END AS state FROM keyed")(lambda s, d: ledger.upsert_latest(contacts(s, d).select("row_id", F.lit("new").alias("state")), processed(s, d).select("row_id", F.lit("done").alias("state")), ["row_id"]))
query("delete_keys", f"{WITH} SELECT row_id, uuid FROM keyed WHERE row_id % 5 = 0")(lambda s, d: keyed(s, d).select("row_id", "uuid").join(processed(s, d).select("row_id"), "row_id", "left_anti"))
ENTITY = "SELECT uuid, count(*) AS n_records, arg_min(\"givenName\", row_id) FILTER (\"givenName\" <> '') AS \"givenName\", min(obj_published) AS first_published FROM keyed WHERE uuid IS NOT NULL GROUP BY uuid"


def _entities(s: SparkSession, d: str) -> DataFrame:
    merged = merge.entity_merge(keyed(s, d).withColumn("tag_list", fx.t_split(F.col("tags"))), "uuid", "row_id", ["givenName"], ["tag_list"])
    return merged


TAGS_SQL = f"SELECT uuid, string_agg(tag, '|' ORDER BY o) AS tags FROM (SELECT uuid, tag, min(row_id * 10 + pos) AS o FROM (SELECT uuid, row_id, unnest({SPLIT}) AS tag, generate_subscripts({SPLIT}, 1) AS pos FROM keyed WHERE uuid IS NOT NULL) GROUP BY uuid, tag) GROUP BY uuid"
query("entity_merge", f"{WITH.rstrip()}, e AS ({ENTITY}), t AS ({TAGS_SQL}) SELECT uuid, n_records, \"givenName\", tags FROM e JOIN t USING (uuid)")(lambda s, d: _entities(s, d).select("uuid", "n_records", "givenName", joined(F.col("tag_list")).alias("tags")))
query("collect_children", f"{WITH} SELECT uuid, string_agg(obj_published, '|' ORDER BY row_id) AS published FROM keyed WHERE uuid IS NOT NULL GROUP BY uuid")(
    lambda s, d: merge.entity_merge(keyed(s, d), "uuid", "row_id", children=["obj_published"]).select("uuid", joined(F.col("obj_published")).alias("published")))
query("jsonld_project", f"{WITH.rstrip()}, e AS ({ENTITY}) SELECT uuid, '{{\"@context\":\"https://schema.org/\",\"@type\":\"Person\",\"@id\":\"' || uuid || '\"' || coalesce(',\"givenName\":\"' || \"givenName\" || '\"', '') || '}}' AS jsonld FROM e")(
    lambda s, d: merge.jsonld_project(_entities(s, d), "uuid", "Person", ["givenName"]))
query("jsonld_project_array", f"{WITH} SELECT uuid, '[' || string_agg('{{\"@type\":\"Action\",\"published\":\"' || obj_published || '\"}}', ',' ORDER BY row_id) || ']' AS jsonld FROM keyed WHERE uuid IS NOT NULL GROUP BY uuid")(
    lambda s, d: merge.entity_merge(keyed(s, d).withColumn("actions", F.struct(F.col("obj_published").alias("published"))), "uuid", "row_id", children=["actions"]).select("uuid", F.to_json(merge.jsonld_array(F.col("actions"), "Action", ["published"])).alias("jsonld")))
query("merged_with_status", f"{WITH.rstrip()}, e AS ({ENTITY}) SELECT uuid, n_records, status FROM e JOIN status USING (uuid)")(lambda s, d: _entities(s, d).select("uuid", "n_records").join(_counts(s, d).select("uuid", "status"), "uuid"))
query("unwritten_outputs", f"{WITH} SELECT uuid, record_count AS version FROM status WHERE NOT ({EMITTED})")(
    lambda s, d: ledger.unwritten_outputs(_counts(s, d).select("uuid", F.col("record_count").alias("version")), _counts(s, d).where(EMITTED).select("uuid", F.col("record_count").alias("version"))))
query("invalidate_outputs", f"{WITH} SELECT uuid FROM status")(
    lambda s, d: ledger.unwritten_outputs(_counts(s, d).withColumn("version", F.col("record_count")), ledger.invalidate_outputs(_counts(s, d).where(EMITTED).withColumn("version", F.col("record_count")))).select("uuid"))
query("merged_counts", f"{WITH} SELECT count(*) AS total, count(*) FILTER ({EMITTED}) AS written, count(*) FILTER (NOT ({EMITTED})) AS unwritten FROM status")(
    lambda s, d: _counts(s, d).agg(F.count("*").alias("total"), F.count_if(F.expr(EMITTED)).alias("written"), F.count_if(~F.expr(EMITTED)).alias("unwritten")))
query("cascade_delete", f"{WITH} SELECT k.uuid, count(*) AS record_count, count(p.row_id) AS processed_count FROM keyed k LEFT JOIN processed p USING (row_id) WHERE file_id <> 1 AND k.uuid IS NOT NULL GROUP BY k.uuid")(
    lambda s, d: (lambda x: ledger.sync_counts(x[0], x[1]).select("uuid", "record_count", "processed_count"))(ledger.cascade_delete(keyed(s, d), processed(s, d), _counts(s, d), [1])))
query("reingest_edited", f"{WITH} SELECT count(*) AS n, count(DISTINCT uuid) AS n_keys FROM keyed WHERE file_id <> 1 OR row_id % 2 = 0")(
    lambda s, d: ledger.cascade_delete(keyed(s, d), processed(s, d), _counts(s, d), [1])[0].unionByName(keyed(s, d).where("file_id = 1 AND row_id % 2 = 0")).agg(F.count("*").alias("n"), F.countDistinct("uuid").alias("n_keys")))
@query("ingest_plan", "SELECT DISTINCT 'f' || o_custkey || '.csv' AS file_path, CASE o_custkey % 5 WHEN 0 THEN 'skip' WHEN 1 THEN 'replace_failed' WHEN 2 THEN 'reject' WHEN 3 THEN 'reject' ELSE 'ingest' END AS action FROM orders")
def ingest_plan(s: SparkSession, d: str) -> DataFrame:
    """Equal content done and failed, edited content of a done and of a failed file, and new files."""
    files = read(s, d, "orders").select("o_custkey").distinct()
    path = F.concat(F.lit("f"), F.col("o_custkey").cast("string"), F.lit(".csv"))
    incoming = files.select(path.alias("file_path"), F.sha2(path, 256).alias("file_hash"))
    known = files.where("o_custkey % 5 < 4").select(
        F.col("o_custkey").alias("file_id"), path.alias("file_path"),
        F.when((F.col("o_custkey") % 5).isin(2, 3), F.concat(F.lit("older"), path)).otherwise(F.sha2(path, 256)).alias("file_hash"),
        F.when((F.col("o_custkey") % 5).isin(1, 3), "failed").otherwise("completed").alias("status"),
    )
    return ledger.ingest_plan(incoming, known).select("file_path", "action")


# identity (2.6)
COMPONENTS = (
    f"{WITH.rstrip()}, pairs AS (SELECT DISTINCT emails[1] AS a, unnest(emails) AS b FROM keyed WHERE len(emails) > 0), both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), "
    "hop1 AS (SELECT DISTINCT x.a, y.b FROM both_ways x JOIN both_ways y ON x.b = y.a), hop2 AS (SELECT DISTINCT x.a, y.b FROM hop1 x JOIN hop1 y ON x.b = y.a), hop3 AS (SELECT DISTINCT x.a, y.b FROM hop2 x JOIN hop2 y ON x.b = y.a), "
    "labels AS (SELECT a, min(b) AS component FROM hop3 GROUP BY a) SELECT row_id, component FROM keyed JOIN labels ON emails[1] = a"
)


def _valued(s: SparkSession, d: str) -> DataFrame:
    return keyed(s, d).select("row_id", F.col("row_id").alias("ord"), F.col("emails").alias("id_values"))


query("identity_components", COMPONENTS)(lambda s, d: identity.identity_components(_valued(s, d)))
def identity_sql(values: str, aliases: str = "SELECT NULL AS value, NULL AS uuid WHERE false") -> str:
    """``WITH`` up to ``ids`` (row_id, uuid, event): rows point to the last earlier row with their first known value."""
    return (
        WITH.rstrip().replace("WITH", "WITH RECURSIVE", 1) + f""", vals AS (SELECT row_id, {values} AS v FROM keyed), aliases AS ({aliases}),
occ AS (SELECT row_id, value, min(pos) AS pos FROM (SELECT row_id, generate_subscripts(v, 1) AS pos, unnest(v) AS value FROM vals) GROUP BY row_id, value),
pred AS (SELECT row_id, pos, lag(row_id) OVER (PARTITION BY value ORDER BY row_id) AS prev, a.uuid AS alias FROM occ LEFT JOIN aliases a USING (value)),
via AS (SELECT row_id, arg_min({{'prev': prev, 'alias': alias}}, pos) AS x FROM pred WHERE prev IS NOT NULL OR alias IS NOT NULL GROUP BY row_id),
own AS (SELECT row_id, h, x, {views._UUID} AS uuid FROM (SELECT row_id, sha1(unhex('{fx.NAMESPACE}') || encode(coalesce(v[1], 'row:' || row_id))) AS h FROM vals) LEFT JOIN via USING (row_id)),
up AS (SELECT row_id, CASE WHEN x IS NULL THEN uuid ELSE x.alias END AS uuid FROM own WHERE x.prev IS NULL UNION ALL SELECT v.row_id, up.uuid FROM via v JOIN up ON v.x.prev = up.row_id),
ids AS (SELECT row_id, up.uuid, CASE WHEN len(v) = 0 THEN 'random' WHEN own.x IS NULL THEN 'generated' ELSE 'cached' END AS event FROM up JOIN own USING (row_id) JOIN vals USING (row_id))"""
    )


KNOWN_SQL = "SELECT 'user' || c_custkey || '@example.com' AS value, 'known-' || c_custkey AS uuid FROM customer WHERE c_custkey % 5 = 0"


def _known(s: SparkSession, d: str) -> DataFrame:
    """Identities of an earlier run for a fifth of the customers' addresses."""
    key = F.col("c_custkey").cast("string")
    return read(s, d, "customer").where("c_custkey % 5 = 0").select(F.concat(F.lit("user"), key, F.lit("@example.com")).alias("value"), F.concat(F.lit("known-"), key).alias("uuid"))


query("assign_identity", f"{identity_sql('emails')} SELECT row_id, uuid, event FROM ids")(lambda s, d: identity.assign_identity(_valued(s, d)))
query("assign_identity_aliases", f"{identity_sql('emails', KNOWN_SQL)} SELECT row_id, uuid, event FROM ids")(lambda s, d: identity.assign_identity(_valued(s, d), aliases=_known(s, d)))


@query("alias_dictionary", f"{identity_sql('emails', KNOWN_SQL)}, now AS (SELECT value, arg_max(uuid, row_id) AS uuid FROM occ JOIN ids USING (row_id) GROUP BY value) SELECT value, uuid FROM now UNION ALL SELECT value, uuid FROM aliases WHERE value NOT IN (SELECT value FROM now)")
def alias_dictionary(s: SparkSession, d: str) -> DataFrame:
    rows, known = _valued(s, d), _known(s, d)
    return identity.alias_dictionary(rows, identity.assign_identity(rows, aliases=known), known)


@query(
    "identity_events",
    f"""{identity_sql("CASE WHEN row_id % 4 = 0 THEN emails ELSE ['m' || row_id // 8, 'm' || row_id % 1000] END")}
SELECT row_id, CASE event WHEN 'random' THEN 'fallback_to_random' ELSE event END AS event, array_to_string(v, '|') AS input_values, uuid FROM ids JOIN vals USING (row_id)
UNION ALL SELECT row_id, 'column_empty', array_to_string(emails, '|'), NULL FROM keyed WHERE row_id % 4 = 0 UNION ALL SELECT row_id, 'column_missing', array_to_string(emails, '|'), NULL FROM keyed""",
)
def identity_events(s: SparkSession, d: str) -> DataFrame:
    """Rows identified by a member column, empty in a quarter of them, or else by address; and what a missing column gives."""
    member = F.when(F.col("row_id") % 4 == 0, " ").otherwise(F.concat(F.lit("M"), F.floor(F.col("row_id") / 8).cast("string"), F.lit(", m"), (F.col("row_id") % 1000).cast("string")))
    rows = contacts(s, d).withColumn("member", member)
    valued = rows.select("row_id", F.col("row_id").alias("ord"), fx.id_values(rows.columns, "member").alias("id_values"))
    named = identity.assign_identity(valued)
    found = identity.identity_events(rows, named, rows.columns, "member")
    absent = identity.identity_events(contacts(s, d), named, contacts(s, d).columns, "customer_no").where("event = 'column_missing'")
    return found.unionByName(absent).select("row_id", "event", joined(F.col("input_values")).alias("input_values"), "uuid")


# masking (2.7)
FREE_TEXT = "WITH free_text AS (SELECT doc_id, coalesce(text, '') || chr(10) || doc_id || ' Maple Grove Street' AS text FROM documents)"
VALID_SQL = {
    "EMAIL": "len(string_split(m, '@')) = 2 AND split_part(m, '@', 1) <> '' AND contains(split_part(m, '@', -1), '.') AND left(split_part(m, '@', -1), 1) <> '.' AND right(m, 1) <> '.' AND length(split_part(m, '@', -1)) > 3",
    "PHONE": "length(regexp_replace(m, '\\D', '', 'g')) BETWEEN 10 AND 15",
    "ADDRESS": "regexp_matches(m, '\\d') AND length(trim(m, E' \\t\\n\\r')) > 10",
}


def detected_sql(kind: str) -> str:
    return f"list_filter(regexp_extract_all(text, '{pii.KINDS[kind][0]}'), lambda m: {VALID_SQL[kind]})"


def masked_sql() -> str:
    """One pass a kind, each over the text of the one before."""
    passes, source = [], "free_text"
    for kind, (pattern, _) in pii.KINDS.items():
        valid = VALID_SQL[kind].replace("m,", "x[2],").replace("(m", "(x[2]")
        pieces = f"list_transform(list_zip(regexp_split_to_array(text, '{pattern}'), regexp_extract_all(text, '{pattern}')), lambda x: coalesce(x[1], '') || CASE WHEN x[2] IS NULL THEN '' WHEN {valid} THEN '[{kind}]' ELSE x[2] END)"
        passes.append(f"masked_{kind.lower()} AS (SELECT doc_id, array_to_string({pieces}, '') AS text FROM {source})")
        source = f"masked_{kind.lower()}"
    return ", ".join(passes)


for _kind, _pattern in (("email", pii.EMAIL), ("phone", pii.PHONE), ("address", pii.ADDRESS)):
    query(f"pii_detect_{_kind}", f"{FREE_TEXT} SELECT doc_id, array_to_string({detected_sql(_kind.upper())}, '|') AS found FROM free_text")(lambda s, d, k=_kind.upper(): free_text(s, d).select("doc_id", joined(pii.detect(F.col("text"), k)).alias("found")))
query("pii_mask_text", f"{FREE_TEXT}, {masked_sql()} SELECT doc_id, sha256(text) AS masked_sha256 FROM masked_address")(lambda s, d: free_text(s, d).select("doc_id", F.sha2(pii.mask_text(F.col("text")), 256).alias("masked_sha256")))
query("pii_report", f"{FREE_TEXT} SELECT " + ", ".join(f"cast(sum(len({detected_sql(k)})) AS bigint) AS {k.lower()}" for k in pii.KINDS) + " FROM free_text")(lambda s, d: free_text(s, d).agg(*[F.sum(F.size(pii.detect(F.col("text"), k))).alias(k.lower()) for k in pii.KINDS]))
FIELDS = {"givenName": ("NAME", False), "primaryEmail": ("EMAIL", False), "additionalEmails": ("EMAIL", True)}
NAMES_SQL = "numbered AS (SELECT \"givenName\" AS value, 'NAME_' || row_number() OVER (ORDER BY min(row_id)) AS placeholder FROM keyed WHERE trim(\"givenName\") <> '' GROUP BY \"givenName\")"
query("pii_mask_fields", f"{WITH.rstrip()}, {NAMES_SQL} SELECT row_id, coalesce(placeholder, \"givenName\") AS \"givenName\" FROM keyed LEFT JOIN numbered ON \"givenName\" = value")(lambda s, d: pii.mask_fields(contacts(s, d), {"givenName": ("NAME", False)}, "row_id")[0].select("row_id", "givenName"))
query("pii_dictionary", f"{WITH.rstrip()}, {NAMES_SQL} SELECT value, placeholder FROM numbered")(lambda s, d: pii.mask_fields(contacts(s, d), {"givenName": ("NAME", False)}, "row_id")[1].select("value", "placeholder"))
query("pii_scope", f"{WITH} SELECT file_id, \"givenName\" AS value, 'NAME_' || row_number() OVER (PARTITION BY file_id ORDER BY min(row_id)) AS placeholder FROM keyed WHERE trim(\"givenName\") <> '' GROUP BY file_id, \"givenName\"")(
    lambda s, d: pii.mask_fields(contacts(s, d), {"givenName": ("NAME", False)}, "row_id", ["file_id"])[1].select("file_id", "value", "placeholder"))
MULTI_SQL = (
    "items AS (SELECT row_id, 0 AS field, 0 AS pos, \"givenName\" AS value, 'NAME' AS template FROM keyed WHERE trim(\"givenName\") <> '' UNION ALL SELECT row_id, 1, 0, \"primaryEmail\", 'EMAIL' FROM keyed WHERE trim(\"primaryEmail\") <> '' "
    "UNION ALL SELECT row_id, 2, generate_subscripts(v, 1), unnest(v), 'EMAIL' FROM (SELECT row_id, list_filter(list_transform(regexp_split_to_array(\"additionalEmails\", '[,|;]+'), lambda x: trim(x)), lambda x: x <> '') AS v FROM keyed)), "
    "firsts AS (SELECT value, arg_min(template, (row_id, field, pos)) AS template, min((row_id, field, pos)) AS o FROM items GROUP BY value), "
    "named AS (SELECT value, template || '_' || row_number() OVER (PARTITION BY template ORDER BY o) || CASE template WHEN 'EMAIL' THEN '@GMAIL.COM' ELSE '' END AS placeholder FROM firsts), "
    "multi AS (SELECT row_id, string_agg(placeholder, ', ' ORDER BY pos) AS masked FROM items JOIN named USING (value) WHERE field = 2 GROUP BY row_id)"
)
query("pii_mask_multi", f"{WITH.rstrip()}, {MULTI_SQL} SELECT row_id, coalesce(masked, \"additionalEmails\") AS \"additionalEmails\" FROM keyed LEFT JOIN multi USING (row_id)")(lambda s, d: pii.mask_fields(contacts(s, d), FIELDS, "row_id")[0].select("row_id", "additionalEmails"))
@query("pii_unmask", f"{WITH} SELECT row_id, \"givenName\" FROM keyed")
def pii_unmask(s: SparkSession, d: str) -> DataFrame:
    masked, table = pii.mask_fields(contacts(s, d), {"givenName": ("NAME", False)}, "row_id")
    return pii.unmask(masked.select("row_id", "givenName"), ["givenName"], "row_id", table)


TEXT_DICTIONARY_SQL = (
    "found AS (SELECT doc_id, 0 AS kind, generate_subscripts(v, 1) AS pos, unnest(v) AS value, 'EMAIL' AS template FROM (SELECT doc_id, {EMAIL} AS v FROM free_text) "
    "UNION ALL SELECT doc_id, 1, generate_subscripts(v, 1), unnest(v), 'PHONE' FROM (SELECT doc_id, {PHONE} AS v FROM masked_email) "
    "UNION ALL SELECT doc_id, 2, generate_subscripts(v, 1), unnest(v), 'ADDRESS' FROM (SELECT doc_id, {ADDRESS} AS v FROM masked_phone))"
)
for _kind in pii.KINDS:
    TEXT_DICTIONARY_SQL = TEXT_DICTIONARY_SQL.replace(f"{{{_kind}}}", detected_sql(_kind))


@query(
    "pii_text_dictionary",
    f"""{FREE_TEXT}, {masked_sql()}, {TEXT_DICTIONARY_SQL}, firsts AS (SELECT value, arg_min(template, (doc_id, kind, pos)) AS template, min((doc_id, kind, pos)) AS o FROM found GROUP BY value)
SELECT value, template || '_' || row_number() OVER (PARTITION BY template ORDER BY o) || CASE template WHEN 'EMAIL' THEN '@GMAIL.COM' ELSE '' END AS placeholder FROM firsts""",
)
def pii_text_dictionary(s: SparkSession, d: str) -> DataFrame:
    return pii.mask_texts(free_text(s, d), ["text"], "doc_id")[1].select("value", "placeholder")


@query("pii_text_roundtrip", f"{FREE_TEXT}, {masked_sql()}, {TEXT_DICTIONARY_SQL}, n AS (SELECT doc_id, count(*) AS n FROM found GROUP BY 1) SELECT doc_id, sha256(text) AS text_sha256, coalesce(n, 0) AS n_masked FROM free_text LEFT JOIN n USING (doc_id)")
def pii_text_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Free text masked, its placeholders counted, and restored."""
    masked, table = pii.mask_texts(free_text(s, d).select("doc_id", "text"), ["text"], "doc_id")
    counted = masked.withColumn("n_masked", F.size(F.regexp_extract_all("text", F.lit(pii.PLACEHOLDER), F.lit(0))).cast("bigint"))
    return pii.unmask(counted, ["text"], "doc_id", table).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "n_masked")


# runs (2.13)
RUN_SQL = (
    "runs AS (SELECT DISTINCT row_id // 50 AS run_id FROM keyed), decided AS (SELECT run_id, CASE WHEN run_id % 4 = 0 OR run_id % 3 = 2 THEN 'fresh' "
    "WHEN run_id % 4 = 1 THEN 'resume' WHEN run_id % 3 = 1 THEN 'error' ELSE 'fresh' END AS action FROM runs)"
)


def _runs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a run each 50, and what is decided of the runs: a quarter new, a quarter unchanged, the others changed."""
    rows = contacts(s, d).withColumn("run_id", F.floor(F.col("row_id") / 50))
    ids = rows.select("run_id").distinct()
    path = lambda changed: F.concat(F.lit("out"), F.when(changed, "_old").otherwise(""), F.col("run_id").cast("string")).alias("output_path")
    log = ids.where("run_id % 4 > 0").select("run_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"), path(F.col("run_id") % 5 == 0))
    log = log.withColumn("fingerprint", runs.fingerprint(F.when((F.col("version") == 2) & (F.col("run_id") % 4 == 1), 50).otherwise(10)))
    mode = F.element_at(F.array(F.lit("auto"), F.lit("resume"), F.lit("fresh")), (F.col("run_id") % 3 + 1).cast("int"))
    current = ids.select("run_id", runs.fingerprint(F.lit(50)).alias("fingerprint"), path(F.lit(False)), mode.alias("mode"), (F.col("run_id") % 7 > 0).alias("output_exists"))
    return rows, runs.resume_run(current, log)


@query("resume_run", f"{WITH.rstrip()}, {RUN_SQL} SELECT run_id, action, count(*) FILTER (action = 'fresh' OR (action = 'resume' AND row_id % 5 = 0)) AS n_remaining FROM keyed JOIN decided ON run_id = row_id // 50 GROUP BY run_id, action")
def resume_run(s: SparkSession, d: str) -> DataFrame:
    rows, decided = _runs(s, d)
    left = runs.remaining_rows(rows, processed(s, d), decided).groupBy("run_id").agg(F.count("*").alias("n"))
    return decided.join(left, "run_id", "left").select("run_id", "action", F.coalesce("n", F.lit(0)).alias("n_remaining"))


query("output_mode", f"{WITH.rstrip()}, {RUN_SQL} SELECT run_id, CASE WHEN action = 'error' THEN NULL WHEN action = 'resume' AND run_id % 5 <> 0 AND run_id % 7 <> 0 THEN 'append' ELSE 'rewrite' END AS output FROM decided")(lambda s, d: _runs(s, d)[1].select("run_id", "output"))

TARGET_SCHEMA = {"entities": {"person": {"properties": {"name": {"type": "string", "required": True}, "tags": {"type": "array", "items": {"type": "string"}}}}, "action": {"properties": {"seconds": {"type": "number"}, "place": {"type": "object", "properties": {"row": {"type": "integer", "required": True}}}}}}}


@query("target_struct_type", f"{WITH} SELECT row_id, \"givenName\" AS name, 1 AS n_tags, TRY_CAST(trim(\"action_timeSpent\") AS double) AS seconds, row_id AS place_row FROM keyed")
def target_struct_type(s: SparkSession, d: str) -> DataFrame:
    """Results as JSON text, read with the struct of a target schema."""
    person = F.struct(F.col("givenName").alias("name"), F.array("tags").alias("tags"))
    action = F.struct(fx.t_to_number(F.col("action_timeSpent")).alias("seconds"), F.struct(F.col("row_id").alias("row")).alias("place"))
    read_back = F.from_json(F.to_json(F.struct(person.alias("person"), action.alias("action"))), rules.target_struct_type(TARGET_SCHEMA))
    return contacts(s, d).select("row_id", read_back.alias("r")).select("row_id", "r.person.name", F.size("r.person.tags").alias("n_tags"), "r.action.seconds", F.col("r.action.place.row").alias("place_row"))


@query("v_nullable", f"{WITH} SELECT row_id, 'r.person.name' AS path FROM keyed WHERE trim(\"givenName\") = '' UNION ALL SELECT row_id, 'r.action.place.row' FROM keyed WHERE row_id % 9 = 0 AND row_id % 10 > 0")
def v_nullable(s: SparkSession, d: str) -> DataFrame:
    """Nulls, anywhere in results, that the target schema does not allow; below a place that is absent nothing is asked for."""
    kind = rules.target_struct_type(TARGET_SCHEMA)
    place = F.when(F.col("row_id") % 10 > 0, F.struct(F.when(F.col("row_id") % 9 > 0, F.col("row_id")).alias("row")))
    said = F.struct(F.struct(F.when(~fx.is_blank(F.col("givenName")), F.col("givenName")).alias("name")).alias("person"), F.struct(place.alias("place")).alias("action"))
    results = contacts(s, d).select("row_id", F.from_json(F.to_json(said, {"ignoreNullFields": "false"}), kind).alias("r"))
    return checks.validate(results, checks.nullability_constraints(T.StructType([T.StructField("r", kind)]))).select("row_id", "path")


# data quality (2.11)
CHECKS = {
    "v_required": (checks.Constraint("uuid", required=True), "uuid IS NULL"),
    "v_type": (checks.Constraint("timeSpent", kind="double"), "TRY_CAST(trim(\"action_timeSpent\") AS double) IS NULL"),
    "v_enum": (checks.Constraint("action_type", one_of=("zine", "newsletterClick")), "action_type NOT IN ('zine', 'newsletterClick')"),
    "v_min_max": (checks.Constraint("row_id", minimum=10, maximum=500), "row_id NOT BETWEEN 10 AND 500"),
    "v_string_length": (checks.Constraint("tags", min_length=3, max_length=30), "length(tags) > 30"),
    "v_array_size": (checks.Constraint("emails", min_items=1, max_items=2), "len(emails) NOT BETWEEN 1 AND 2"),
    "v_email_format": (checks.Constraint("trimmed", format="email"), "trim(\"primaryEmail\") = ''"),
    "v_pattern": (checks.Constraint("action_type", pattern="^[a-z]+$"), "NOT regexp_matches(action_type, '^[a-z]+$')"),
    "v_format": (checks.Constraint("obj_published", format="date"), "NOT regexp_matches(obj_published, '^\\d{4}-\\d{2}-\\d{2}$')"),
}


def _checked(s: SparkSession, d: str, constraints: list[checks.Constraint]) -> DataFrame:
    df = keyed(s, d).withColumn("timeSpent", fx.js_trim(F.col("action_timeSpent"))).withColumn("trimmed", fx.js_trim(F.col("primaryEmail")))
    return checks.validate(df, constraints)


for _name, (_constraint, _sql) in CHECKS.items():
    query(_name, f"{WITH} SELECT row_id FROM keyed WHERE {_sql}")(lambda s, d, k=_constraint: _checked(s, d, [k]).select("row_id"))
query("validate_all", f"{WITH} " + " UNION ALL ".join(f"SELECT '{k.path}' AS path, count(*) AS n FROM keyed WHERE {q} HAVING count(*) > 0" for k, q in (CHECKS[x] for x in ("v_required", "v_type", "v_enum", "v_min_max"))))(
    lambda s, d: _checked(s, d, [CHECKS[x][0] for x in ("v_required", "v_type", "v_enum", "v_min_max")]).groupBy("path").agg(F.count("*").alias("n")))
query("v_row_mapping", f"{WITH} SELECT row_id, 'action_type' AS path FROM keyed WHERE {CHECKS['v_enum'][1]}")(lambda s, d: _row_mapping(s, d))


def _row_mapping(s: SparkSession, d: str) -> DataFrame:
    """Errors as a validator of whole batches reports them, taken back to their rows."""
    placed = checks.places(contacts(s, d).select("row_id", F.floor(F.col("row_id") / 50).alias("batch_id")))
    errors = _checked(s, d, [CHECKS["v_enum"][0]]).join(placed, "row_id").select("batch_id", F.concat(F.lit("results."), F.col("place").cast("string"), F.lit("."), "path").alias("path"))
    return checks.row_mapping(errors, placed).select("row_id", "path")


query("v_batch_length", f"{WITH} SELECT row_id // 50 AS batch_id, count(*) AS expected, count(*) FILTER (row_id % 5 <> 0) AS actual FROM keyed GROUP BY 1 HAVING count(*) <> count(*) FILTER (row_id % 5 <> 0)")(
    lambda s, d: checks.batch_length(*[x.withColumn("batch_id", F.floor(F.col("row_id") / 50)) for x in (contacts(s, d), processed(s, d))]))
query("v_required_policy", f"{WITH} SELECT row_id FROM keyed WHERE row_id // 5 NOT IN (SELECT row_id // 5 FROM keyed WHERE uuid IS NULL)")(
    lambda s, d: checks.required_policy(keyed(s, d).withColumn("batch_id", F.floor(F.col("row_id") / 5)), _checked(s, d, [CHECKS["v_required"][0]]), "drop_batch").select("row_id"))
query("required_error_count", f"{WITH} SELECT row_id // 50 AS batch_id, cast(sum(len({MISSING_SQL})) AS bigint) AS errors FROM keyed GROUP BY 1")(
    lambda s, d: rules.transform_row(contacts(s, d), RULES).groupBy(F.floor(F.col("row_id") / 50).alias("batch_id")).agg(F.sum(F.size("missing")).alias("errors")))


# resolver (2.12): an offline one that fails some batches once and some always
class Busy(Exception):
    status = 429


def offline(pdf: pd.DataFrame, model: str, error: str | None) -> pd.DataFrame:
    batch = int(pdf["batch_id"].iloc[0])
    if batch % 7 == 3 or (batch % 7 == 5 and model == "main"):
        raise ValueError("bad enum")
    return pd.DataFrame({"row_id": pdf["row_id"], "gender": ["f" if r % 2 else "m" for r in pdf["row_id"]]})


def moody(pdf: pd.DataFrame, model: str, error: str | None) -> pd.DataFrame:
    """As ``offline``, with batches that are always too busy, and some that break."""
    batch = int(pdf["batch_id"].iloc[0])
    if batch % 7 == 4:
        raise Busy("later")
    if batch % 7 == 2:
        raise KeyError("no such column")
    return offline(pdf, model, error)


def _resolved(s: SparkSession, d: str, resolver: resolve.Resolver = offline) -> DataFrame:
    return resolve.resolve_pending(contacts(s, d).select("row_id", F.floor(F.col("row_id") / 50).alias("batch_id")), resolver, "row_id long, gender string")


query("resolve_pending", f"{WITH} SELECT row_id, CASE WHEN row_id % 2 = 1 THEN 'f' ELSE 'm' END AS gender FROM keyed WHERE (row_id // 50) % 7 <> 3")(lambda s, d: _resolved(s, d).where("status = 'success'").select("row_id", "gender"))
@query(
    "attempt_log",
    f"""{WITH.rstrip()}, b AS (SELECT DISTINCT row_id // 50 AS batch_id FROM keyed)
SELECT batch_id, cast(i AS integer) AS attempt, CASE batch_id % 7 WHEN 2 THEN 'network_error' WHEN 4 THEN 'api_error' ELSE 'validation_error' END AS error,
  CASE WHEN batch_id % 7 = 2 OR i = 3 THEN 'failed' WHEN batch_id % 7 = 4 THEN 'retry_same' ELSE 'retry_with_fallback' END AS action
FROM b, generate_series(1, 3) g(i) WHERE batch_id % 7 = 3 OR (batch_id % 7 = 5 AND i = 1) OR (batch_id % 7 = 4 AND i <= 3) OR (batch_id % 7 = 2 AND i = 1)""",
)
def attempt_log(s: SparkSession, d: str) -> DataFrame:
    return _resolved(s, d, moody).where("status = 'failed'").select("batch_id", "attempt", "error", "action")


query("batch_outcomes", f"{WITH} SELECT DISTINCT row_id // 50 AS batch_id, CASE (row_id // 50) % 7 WHEN 3 THEN 'failed' WHEN 5 THEN 'partial_success' ELSE 'success' END AS outcome, cast(CASE (row_id // 50) % 7 WHEN 3 THEN 3 WHEN 5 THEN 2 ELSE 1 END AS bigint) AS attempts FROM keyed")(lambda s, d: resolve.batch_outcomes(_resolved(s, d)).drop("ms"))
@query(
    "retry_ladder",
    f"""{WITH.rstrip()}, b AS (SELECT DISTINCT row_id // 50 AS batch_id FROM keyed)
SELECT batch_id, cast(CASE WHEN batch_id % 7 IN (3, 4) THEN 3 WHEN batch_id % 7 = 5 THEN 2 ELSE 1 END AS bigint) AS attempts,
  CASE batch_id % 7 WHEN 2 THEN 'failed' WHEN 3 THEN 'retry_with_fallback,retry_with_fallback,failed' WHEN 4 THEN 'retry_same,retry_same,failed' WHEN 5 THEN 'retry_with_fallback' ELSE '' END AS steps
FROM b""",
)
def retry_ladder(s: SparkSession, d: str) -> DataFrame:
    """What was done after each failed attempt, in order, per batch."""
    tries = _resolved(s, d, moody).groupBy("batch_id", "attempt").agg(F.max("action").alias("action"))
    steps = F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("attempt", "action"))), lambda x: x["action"]))
    return tries.groupBy("batch_id").agg(F.max("attempt").cast("bigint").alias("attempts"), F.array_join(steps, ",").alias("steps"))


FORM_SIZE = 40
FORMS = f"forms AS (SELECT row_id, obj_published, array_to_string(list_sort(['person.gender'] || {MISSING_SQL}), ',') AS pending_key FROM keyed), batches AS (SELECT *, pending_key || '#' || (row_number() OVER (PARTITION BY pending_key ORDER BY row_id) - 1) // {FORM_SIZE} AS batch_id FROM forms)"
FORM_SCHEMA = {"entities": {"person": {"properties": {"name": {"type": "string"}, "gender": {"type": "string", "enum": ["f", "m"]}, "userID": {"type": "string", "required": True}, "tags": {"type": "array", "items": {"type": "string"}}}}, "action": {"properties": {"published": {"type": "string"}, "type": {"type": "string"}}}}}
FORM_TEMPLATE = "Fill this in: <<<SCHEMA>>> Additional important rules: none"


def _form_batches(s: SparkSession, d: str) -> DataFrame:
    return resolve.form_batches(rules.transform_row(contacts(s, d), RULES), FORM_SIZE)


query("group_by_pending", f"{WITH.rstrip()}, {FORMS} SELECT pending_key, count(*) AS n, count(DISTINCT batch_id) AS n_batches FROM batches GROUP BY 1")(
    lambda s, d: _form_batches(s, d).groupBy("pending_key").agg(F.count("*").alias("n"), F.countDistinct("batch_id").alias("n_batches")))
HAS = "list_contains(string_split(pending_key, ','), '{}')"
ACTION_FORM = "CASE WHEN " + HAS.format("action.published") + " THEN ',\"action\":{\"type\":\"object\",\"properties\":{\"published\":{\"type\":\"string\"}},\"required\":[\"published\"]}' ELSE '' END"
FORM_JSON = (
    "'{\"type\":\"object\",\"properties\":{\"person\":{\"type\":\"object\",\"properties\":{' || CASE WHEN " + HAS.format("person.name") + " THEN '\"name\":{\"type\":\"string\"},' ELSE '' END || "
    "'\"gender\":{\"type\":\"string\",\"enum\":[\"f\",\"m\"]},\"userID\":{\"type\":\"string\"}},\"required\":[' || CASE WHEN " + HAS.format("person.name") + " THEN '\"name\",' ELSE '' END || '\"gender\",\"userID\"]}' || "
    + ACTION_FORM + " || '},\"required\":[\"person\"' || CASE WHEN " + HAS.format("action.published") + " THEN ',\"action\"' ELSE '' END || ']}'"
)


@query(
    "render_prompt",
    f"""{WITH.rstrip()}, {FORMS} SELECT batch_id, 'Fillthisin:' || {FORM_JSON} || 'Additionalimportantrules:Inputfilename:"contacts"ThisfilenamemayprovidecontextforfieldslikedataSource-youcaninferappropriatevaluesfromit.none' AS instructions,
  '[' || string_agg('{{"row_id":' || row_id || ',"obj_published":"' || obj_published || '"}}', ',' ORDER BY row_id) || ']' AS records FROM batches GROUP BY batch_id, pending_key""",
)
def render_prompt(s: SparkSession, d: str) -> DataFrame:
    """Prompts of all batches of all forms; white space of the instructions is left out of the comparison."""
    found = resolve.form_prompts(_form_batches(s, d), FORM_SCHEMA, FORM_TEMPLATE, ["row_id", "obj_published"], "in/contacts.csv")
    return found.select("batch_id", F.regexp_replace("instructions", r"\s+", "").alias("instructions"), "records")


def by_form(pdf: pd.DataFrame, schema: dict, model: str, error: str | None) -> pd.DataFrame:
    """An offline resolver that says what it was asked for; a third of the batches are too much for the main model."""
    if model == "main" and int(pdf["row_id"].min()) % 3 == 0:
        raise resolve.Invalid("Required field 'gender' is missing or null")
    asked = [f"{entity}.{name}" for entity, spec in schema["properties"].items() for name in spec["properties"]]
    return pd.DataFrame({"row_id": pdf["row_id"], "asked": ",".join(sorted(asked)), "n": len(pdf)})


@query(
    "resolve_forms",
    f"""{WITH.rstrip()}, {FORMS}, sizes AS (SELECT batch_id, count(*) AS n, min(row_id) % 3 = 0 AS odd FROM batches GROUP BY 1)
SELECT row_id, pending_key AS asked, n, CASE WHEN odd THEN 2 ELSE 1 END AS attempt, odd AS missed FROM batches JOIN sizes USING (batch_id)""",
)
def resolve_forms(s: SparkSession, d: str) -> DataFrame:
    tries = resolve.resolve_forms(_form_batches(s, d).select("row_id", "pending_key", "batch_id"), FORM_SCHEMA, by_form, "row_id long, asked string, n long")
    missed = tries.where("error = 'required_field_error'").select("batch_id", F.lit(True).alias("missed"))
    return tries.where("status = 'success'").join(missed, "batch_id", "left").select("row_id", "asked", "n", "attempt", F.coalesce("missed", F.lit(False)).alias("missed"))


LINKED = f"{identity_sql('emails')}, linked AS (SELECT k.* EXCLUDE (uuid), i.uuid FROM keyed k JOIN ids i USING (row_id) WHERE key IS NOT NULL)"


@query(
    "entity_pipeline",
    f"""{LINKED}, e AS ({ENTITY.replace("FROM keyed", "FROM linked")}), t AS ({TAGS_SQL.replace("FROM keyed", "FROM linked")}), x AS (SELECT uuid, max(obj_published) AS last_published FROM linked GROUP BY uuid)
SELECT uuid, n_records, "givenName" AS name, tags, first_published, last_published FROM e JOIN t USING (uuid) JOIN x USING (uuid)""",
)
def entity_pipeline(s: SparkSession, d: str) -> DataFrame:
    """Contacts to entities: linked identity, mapping, merge."""
    rows = keyed(s, d).where("key IS NOT NULL").drop("uuid").withColumn("tag_list", fx.t_split(F.col("tags")))
    linked = rows.join(identity.assign_identity(_valued(s, d)).select("row_id", "uuid"), "row_id")
    merged = merge.entity_merge(linked, "uuid", "row_id", ["givenName"], ["tag_list"], spans=["obj_published"])
    return merged.select("uuid", "n_records", F.col("givenName").alias("name"), joined(F.col("tag_list")).alias("tags"), F.col("first_obj_published").alias("first_published"), F.col("last_obj_published").alias("last_published"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
