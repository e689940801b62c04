"""Batch resolution of pending fields by a pluggable function, with retries and logs."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityspark.operators import checks, ledger, pii, rules
from entityspark.operators.components import stored

Resolver = Callable[[pd.DataFrame, str, str | None], pd.DataFrame]


def group_by_pending(rows: DataFrame, pending: str = "pending") -> DataFrame:
    """Adds ``pending_key``: one request form per distinct set of pending fields."""
    return rows.withColumn("pending_key", F.array_join(F.array_sort(pending), ","))


def split_resolved(rows: DataFrame, pending: str = "pending") -> tuple[DataFrame, DataFrame]:
    return rows.where(F.size(pending) == 0), rows.where(F.size(pending) > 0)


def render_prompt(rows: DataFrame, template: str, batch: str = "batch_id", order: str = "row_id") -> DataFrame:
    """``(batch_id, prompt)``: the template with the batch's records as JSON, in order."""
    records = F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*[c for c in rows.columns if c != batch]).alias("r")))), lambda s: s["r"])
    return rows.groupBy(batch).agg(F.replace(F.lit(template), F.lit("{records}"), F.to_json(records)).alias("prompt"))


class Invalid(ValueError):
    """An answer that the caller's checks refuse; worth another try with the fallback model."""


def _kind(e: Exception) -> tuple[str, str]:
    """What an error is, as ``functions.text.error_type`` names it, and what follows: the same again, another model, or nothing."""
    if isinstance(e, ValueError):
        return "required_field_error" if "required field" in str(e).lower() else "validation_error", "retry_with_fallback"
    status = getattr(e, "status", None)
    busy = status is not None and (status == 429 or status >= 500)
    return ("api_error", "retry_same") if busy else ("network_error", "failed")


def resolve_pending(rows: DataFrame, resolver: Resolver, schema: str, batch: str = "batch_id", retries: int = 2) -> DataFrame:
    """Calls ``resolver(batch, model, error)`` per batch; returns ``batch_id, attempt, status, error, action, ms`` and the result rows.

    ``schema`` declares the resolver's columns; a failed attempt is a row with nulls there. An
    error with status 429 or 5xx is tried again as it is; an invalid answer (a ValueError) is
    tried with the fallback model and the error's text; any other error ends the batch at once.
    After ``retries`` more tries the batch has failed. The attempts are made here and stored once,
    however many plans read them.
    """
    names = [x.split()[0] for x in schema.split(",")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        model, error, log, key = "main", None, [], pdf[batch].iloc[0]
        for attempt in range(1, retries + 2):
            began = time.monotonic()
            spent = lambda since=began: round(1000 * (time.monotonic() - since))
            try:
                result = resolver(pdf, model, error)
                ms = spent()
                log += [{**r, batch: key, "attempt": attempt, "status": "success", "ms": ms} for r in result.to_dict("records")]
                break
            except Exception as e:  # noqa: BLE001  the resolver's failures are data here
                kind, action = _kind(e)
                action = action if attempt <= retries else "failed"
                log.append({batch: key, "attempt": attempt, "status": "failed", "error": kind, "action": action, "ms": spent()})
                if action == "failed":
                    break
                if action == "retry_with_fallback":
                    model, error = "fallback", str(e)
        columns = [batch, "attempt", "status", "error", "action", "ms", *names]
        return pd.DataFrame({c: pd.Series([r.get(c) for r in log], dtype=object) for c in columns})

    return stored(rows.groupBy(batch).applyInPandas(one, f"{batch} {rows.schema[batch].dataType.simpleString()}, attempt int, status string, error string, action string, ms long, {schema}"), "attempts")


def batch_outcomes(log: DataFrame, batch: str = "batch_id") -> DataFrame:
    """success, failed, or partial_success (after a failed attempt), with the number of attempts and their time."""
    ok, bad = F.max((F.col("status") == "success").cast("int")), F.max((F.col("status") == "failed").cast("int"))
    outcome = F.when((ok == 1) & (bad == 1), "partial_success").when(ok == 1, "success").otherwise("failed")
    of_attempt = log.groupBy(batch, "attempt").agg(F.max("status").alias("status"), F.max("ms").alias("ms"))
    return of_attempt.groupBy(batch).agg(outcome.alias("outcome"), F.max("attempt").cast("bigint").alias("attempts"), F.sum("ms").alias("ms"))


def slowest_batches(outcomes: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` batches that took longest."""
    return outcomes.orderBy(F.col("ms").desc(), "batch_id").limit(n)


def partial_schema(schema: dict, paths: list[str]) -> dict:
    """The parts of a target schema under paths, as a JSON schema of nested objects; the fields asked for are required.

    Unknown paths are left out; no paths: all of it.
    """
    tree: dict = {}
    for path in paths:
        at = tree
        for step in path.split("."):
            at = at.setdefault(step, {})

    def part(properties: dict, wanted: dict) -> dict:
        names = [n for n in properties if not wanted or n in wanted]
        return {"type": "object", "properties": {n: one(properties[n], wanted.get(n, {})) for n in names}, "required": names}

    def one(spec: dict, wanted: dict) -> dict:
        kept = {k: v for k, v in spec.items() if k not in ("properties", "items", "required")}
        if "properties" in spec:
            return kept | part(spec["properties"], wanted)
        return kept | {"items": one(spec["items"], wanted)} if "items" in spec else kept

    return part({name: {"type": "object", "properties": entity.get("properties", {})} for name, entity in schema["entities"].items()}, tree)


def form_batches(rows: DataFrame, size: int, pending: str = "pending", row_id: str = "row_id") -> DataFrame:
    """Adds ``pending_key`` and ``batch_id``: batches of ``size`` rows that have the same fields pending, in the order of ``row_id``, a number.

    A batch is named by its form and its number. Rows are numbered by ranges, so a form that
    nearly all rows have is many tasks.
    """
    keyed = ledger.file_row_index(group_by_pending(rows, pending), "pending_key", row_id)
    return keyed.withColumn("batch_id", F.concat("pending_key", F.lit("#"), F.floor(F.col("file_row_index") / size).cast("string"))).drop("file_row_index")


#: Where the schema goes in a template, and after which words the file is named (fixed values).
SCHEMA_PLACE, RULES_PLACE = "<<<SCHEMA>>>", "Additional important rules:"


def form_prompts(batches: DataFrame, schema: dict, template: str, columns: list[str], file_name: str | None = None, row_id: str = "row_id") -> DataFrame:
    """``(batch_id, pending_key, instructions, records)``: what a model is asked for each batch of ``form_batches``.

    ``instructions`` is the template with the partial schema of the batch's form, made once for each form, and what the
    file is called; ``records`` are the given columns of its rows as JSON, in order.
    """
    named = template
    if file_name:
        stem = file_name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        named = template.replace(RULES_PLACE, f'{RULES_PLACE}\n\nInput file name: "{stem}"\nThis filename may provide context for fields like dataSource - you can infer appropriate values from it.\n\n', 1)

    def filled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [named.replace(SCHEMA_PLACE, json.dumps(partial_schema(schema, [p for p in k.split(",") if p]), indent=2), 1) for k in part["pending_key"]]
            yield pd.DataFrame({"pending_key": part["pending_key"], "instructions": texts})

    forms = batches.select("pending_key").distinct().mapInPandas(filled, "pending_key string, instructions string")
    records = F.transform(F.array_sort(F.collect_list(F.struct(row_id, F.struct(*columns).alias("r")))), lambda x: x["r"])
    of_batch = batches.groupBy("batch_id", "pending_key").agg(F.to_json(records).alias("records"))
    return of_batch.join(forms, "pending_key").select("batch_id", "pending_key", "instructions", "records")


FormResolver = Callable[[pd.DataFrame, dict, str, str | None], pd.DataFrame]


def resolve_forms(batches: DataFrame, schema: dict, resolver: FormResolver, result: str, retries: int = 2) -> DataFrame:
    """``resolve_pending`` of ``form_batches``: one call of ``resolver(batch, partial schema, model, error)`` for each form and batch."""

    def one(pdf: pd.DataFrame, model: str, error: str | None) -> pd.DataFrame:
        paths = [p for p in pdf["pending_key"].iloc[0].split(",") if p]
        return resolver(pdf.drop(columns=["pending_key"]), partial_schema(schema, paths), model, error)

    return resolve_pending(batches, one, result, "batch_id", retries)


ROLLUP = "array<struct<measure:string,value:string>>"
#: The kinds of records that a measure of ``log_rollups`` counts; of the others no record is made.
MEASURED = ("validation_error", "retry_attempt", "batch_outcome", "uuid_event")


def log_rollups(logs: DataFrame) -> DataFrame:
    """``(measure, value, n)`` over the records of ``log_datasets``, in one pass.

    Measures: missing_field by path, retry by action, retry_error by kind, outcome of batches,
    event of identities, and fallback by reason.
    """
    field = lambda name: F.get_json_object("record", f"$.{name}")
    part = lambda kind, measure, value: F.when((F.col("kind") == kind) & value.isNotNull(), F.struct(F.lit(measure).alias("measure"), value.alias("value")))
    found = [
        part("validation_error", "missing_field", F.when(field("rule") == "required", field("path"))), part("retry_attempt", "retry", field("action")), part("retry_attempt", "retry_error", field("error")),
        part("batch_outcome", "outcome", field("outcome")), part("uuid_event", "event", field("event")), part("uuid_event", "fallback", field("reason")),
    ]
    return logs.where(F.col("kind").isin(*MEASURED)).select(F.explode(F.array_compact(F.array(*found)).cast(ROLLUP)).alias("x")).groupBy("x.measure", "x.value").agg(F.count("*").alias("n"))


def overlay(mapped: DataFrame, answers: DataFrame, batch: str = "batch_id", row_id: str = "row_id") -> DataFrame:
    """``(batch, row_id, result)``: answers with what rules gave laid over them, value by value.

    ``mapped`` and ``answers`` have structs of these names and of one type. Batches whose numbers
    of rows differ keep their answers as they are; rows without an answer have none.
    """
    counts = [x.groupBy(batch).agg(F.count("*").alias(n)) for x, n in ((mapped, "rows"), (answers, "got"))]
    alike = counts[0].join(counts[1], batch).where(F.col("rows") == F.col("got")).select(batch, F.lit(True).alias("alike"))
    both = answers.join(mapped.select(batch, row_id, "mapped"), [batch, row_id], "left").join(alike, batch, "left")
    whole = rules.merge_deep(F.col("answers"), F.col("mapped"), answers.schema["answers"].dataType)
    return both.select(batch, row_id, F.when(F.coalesce("alike", F.lit(False)), whole).otherwise(F.col("answers")).alias("result"))


def process_batch(rows: DataFrame, rule_set: rules.RuleSet, resolver: Resolver, schema: str, masked: dict[str, tuple[str, bool]], constraints: list[checks.Constraint], batch: str = "batch_id", row_id: str = "row_id", retries: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, violations, attempts): rules, masking, resolver, unmasking, overlay and checks.

    Only rows with pending fields reach the resolver, with the ``masked`` columns alone and their
    values replaced; ``schema`` starts with the row id. Rule values stay in ``mapped``; resolved
    columns are null where the resolver failed or was not needed. The resolver is called here,
    once per attempt.
    """
    mapped = rules.transform_row(rows, rule_set)
    hidden, table = pii.mask_fields(mapped.where(F.size("pending") > 0).select(batch, row_id, *masked), masked, row_id)
    attempts = resolve_pending(hidden, resolver, schema, batch, retries)
    names = [x.split()[0] for x in schema.split(",")][1:]
    texts = [x.split()[0] for x in schema.split(",")[1:] if x.split()[1] == "string"]
    answers = pii.unmask(attempts.where("status = 'success'").select(row_id, *names), texts, row_id, table)
    results = mapped.join(answers, row_id, "left")
    return results, checks.validate(results, constraints, row_id), attempts


def log_datasets(mapped: DataFrame, violations: DataFrame, attempts: DataFrame, identities: DataFrame, batch: str = "batch_id") -> DataFrame:
    """All records of a run as ``(kind, batch_id, record)``: model_input, validation_error, retry_attempt, batch_outcome, uuid_event."""
    def kind(name: str, df: DataFrame, key: str | None) -> DataFrame:
        return df.select(F.lit(name).alias("kind"), (F.col(key) if key else F.lit(None)).cast("long").alias("batch_id"), F.to_json(F.struct("*")).alias("record"))

    return (
        kind("model_input", mapped.where(F.size("pending") > 0), batch).unionByName(kind("validation_error", violations, None)).unionByName(kind("retry_attempt", attempts.where("status = 'failed'"), batch))
        .unionByName(kind("batch_outcome", batch_outcomes(attempts, batch), batch)).unionByName(kind("uuid_event", identities, None))
    )
