"""Data-quality checks: every check is a row of one violations table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityspark.operators import nested

EMAIL_FORMAT = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"
FORMATS = {
    "date": r"^\d{4}-\d{2}-\d{2}$", "time": r"^\d{2}:\d{2}:\d{2}", "duration": r"^P(?=.)(\d+D)?(T(\d+H)?(\d+M)?(\d+S)?)?$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "email": EMAIL_FORMAT,
}


@dataclass(frozen=True)
class Constraint:
    """What a path must satisfy; None means not asked for. ``a.b[].c`` is c of every item of b of a."""

    path: str
    required: bool = False
    kind: str | None = None
    one_of: tuple[str, ...] | None = None
    minimum: float | None = None
    maximum: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    min_items: int | None = None
    max_items: int | None = None
    pattern: str | None = None
    format: str | None = None


def _tests(k: Constraint, c: Column, is_list: bool) -> list[tuple[str, Column, str]]:
    """(rule, violated, expected); null values violate ``required`` alone."""
    number = c.try_cast("double") if not is_list else None
    out = [("required", c.isNull(), "present")] if k.required else []
    if k.kind in ("double", "bigint", "int", "boolean", "date", "timestamp"):
        out.append(("type", c.isNotNull() & c.cast("string").try_cast(k.kind).isNull(), k.kind))
    if k.one_of is not None:
        out.append(("enum", ~c.isin(*k.one_of), "|".join(k.one_of)))
    if k.minimum is not None or k.maximum is not None:
        low, high = k.minimum if k.minimum is not None else float("-inf"), k.maximum if k.maximum is not None else float("inf")
        out.append(("range", ~number.between(low, high), f"{low}..{high}"))
    if k.min_length is not None or k.max_length is not None:
        out.append(("length", ~F.length(c).between(k.min_length or 0, k.max_length if k.max_length is not None else 2**31 - 1), f"{k.min_length}..{k.max_length}"))
    if k.min_items is not None or k.max_items is not None:
        out.append(("items", ~F.size(c).between(k.min_items or 0, k.max_items if k.max_items is not None else 2**31 - 1), f"{k.min_items}..{k.max_items}"))
    if k.pattern is not None:
        out.append(("pattern", ~c.rlike(k.pattern), k.pattern))
    if k.format == "date-time":
        out.append(("format", c.isNotNull() & F.try_to_timestamp(c).isNull(), k.format))
    elif k.format is not None:
        out.append(("format", ~c.rlike(FORMATS[k.format]), k.format))
    return out


VIOLATIONS = "array<struct<path:string,rule:string,expected:string,actual:string>>"


def _violation(path: Column, rule: str, violated: Column, expected: str, actual: Column) -> Column:
    return F.when(F.coalesce(violated, F.lit(False)), F.struct(path.alias("path"), F.lit(rule).alias("rule"), F.lit(expected).alias("expected"), actual.alias("actual")))


def _below(c: Column, kind: T.DataType, node: dict, path: Column, is_field: bool) -> list[Column]:
    """The violations at and below one place of a nested column, as arrays; ``node`` is the trie of what is asked for there."""
    none, out = F.array().cast(VIOLATIONS), []
    value, inner, absent = c, kind, c.isNull()
    if is_field and nested.is_wrapper(kind):
        present = F.coalesce(c["present"], F.lit(False))
        value, inner, absent = F.when(present, c["value"]), kind["value"].dataType, c.isNotNull() & ~present
    is_list = isinstance(inner, T.ArrayType)
    actual = F.to_json(value) if isinstance(inner, (T.ArrayType, T.StructType, T.MapType)) else value.cast("string")
    tests = [(rule, absent if rule == "required" else violated, expected) for k in node.get(None, []) for rule, violated, expected in _tests(k, value, is_list)]
    if tests:
        out.append(F.array_compact(F.array(*[_violation(path, rule, violated, expected, actual) for rule, violated, expected in tests])))
    for step, child in node.items():
        if step is None:
            continue
        if step == "[]":
            out.append(F.coalesce(F.flatten(F.transform(value, _item(inner.elementType, child, path))), none))
        else:
            found = _below(value[step], inner[step].dataType, child, F.concat(path, F.lit(f".{step}")), True)
            out += [F.when(value.isNotNull(), x).otherwise(none) for x in found]
    return out


def _item(kind: T.DataType, node: dict, path: Column):  # noqa: ANN202
    return lambda x, i: F.concat(*_below(x, kind, node, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), False))


def validate(df: DataFrame, constraints: list[Constraint], row_id: str = "row_id") -> DataFrame:
    """``(row_id, path, rule, expected, actual)`` of every violation; one pass, one explode.

    Paths that are no column of ``df`` lead into nested ones, ``[]`` through the items of an
    array; a violation then has the item's index, as ``a.b[0].c``. All paths are compiled to one
    trie, so an array is walked once whatever is asked of its items. Of a ``{value, present}``
    the value is checked, and it is missing unless it is present. Below a null object, item or
    list nothing is required.
    """
    kinds = dict(df.dtypes)
    found, trie = [], {}
    for k in constraints:
        if k.path in kinds:
            if not nested.is_wrapper(df.schema[k.path].dataType):
                is_list = kinds[k.path].startswith("array")
                actual = F.to_json(k.path) if is_list else F.col(k.path).cast("string")
                found += [_violation(F.lit(k.path), rule, violated, expected, actual) for rule, violated, expected in _tests(k, F.col(k.path), is_list)]
                continue
        at = trie
        for step in nested.segments(k.path):
            at = at.setdefault(step, {})
        at.setdefault(None, []).append(k)
    deep = [x for name, node in trie.items() for x in _below(F.col(name), df.schema[name].dataType, node, F.lit(name), True)]
    flat = [F.array_compact(F.array(*found))] if found else []
    return df.select(row_id, F.explode(F.concat(F.array().cast(VIOLATIONS), *flat, *deep)).alias("v")).select(row_id, "v.*")


def required_constraints(df: DataFrame, columns: list[str]) -> list[Constraint]:
    """A ``required`` constraint for every wrapped field in the given columns, at any depth."""
    return [Constraint(p, required=True) for p in nested.wrapped_paths(df.select(*columns).schema)]


def nullability_constraints(schema: T.StructType, prefix: str = "") -> list[Constraint]:
    """A ``required`` constraint for every field, at any depth, that a schema does not let be null."""
    out = []
    for f in schema:
        path, inner, nullable = prefix + f.name, f.dataType, f.nullable
        while True:
            if not nullable:
                out.append(Constraint(path, required=True))
            if not isinstance(inner, T.ArrayType):
                break
            path, nullable, inner = path + "[]", inner.containsNull, inner.elementType
        if isinstance(inner, T.StructType):
            out += nullability_constraints(inner, path + ".")
    return out


def described(violations: DataFrame) -> DataFrame:
    """Adds ``message``, what is wrong in words."""
    field = F.regexp_extract("path", r"([^.]*)$", 1)
    missing = F.format_string("Required field '%s' is missing or null", field)
    other = F.format_string("%s: expected %s, got %s", field, F.coalesce("expected", F.lit("null")), F.coalesce("actual", F.lit("null")))
    length = F.format_string("Expected %s results, got %s", F.regexp_extract("expected", r"(\d+)$", 1), F.regexp_extract("actual", r"(\d+)$", 1))
    return violations.withColumn("message", F.when(F.col("rule") == "required", missing).when(F.col("rule") == "length_of_batch", length).otherwise(other))


def validate_batches(inputs: DataFrame, results: DataFrame, constraints: list[Constraint], required_fails: bool = False, batch: str = "batch_id", row_id: str = "row_id") -> DataFrame:
    """``(batch, row_id, stage, path, rule, expected, actual, message)``: length, then required fields, then the rest.

    A batch with another number of results than inputs has that one violation, with a null
    row, and is not looked at further. ``required_fails`` ends a batch with a missing required
    field at that stage, else such fields are reported and the other rules checked too.
    """
    a, b = (x.groupBy(batch).agg(F.count("*").alias(n)) for x, n in ((inputs, "wanted"), (results, "got")))
    counted = a.join(b, batch, "full").select(batch, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("wanted", "got")])
    wrong = counted.where("wanted <> got")
    of_length = lambda c: F.concat(F.lit("array of length "), F.col(c).cast("string"))
    no_row = F.lit(None).cast(results.schema[row_id].dataType).alias(row_id)
    lengths = wrong.select(batch, no_row, F.lit("length").alias("stage"), F.lit("results").alias("path"), F.lit("length_of_batch").alias("rule"), of_length("wanted").alias("expected"), of_length("got").alias("actual"))
    right = results.join(wrong, batch, "left_anti")
    keyed = right.withColumn("__at", F.struct(F.col(batch).alias("b"), F.col(row_id).alias("r")))
    stage = F.when(F.col("rule") == "required", "required").otherwise("schema")
    found = validate(keyed, constraints, "__at").select(F.col("__at.b").alias(batch), F.col("__at.r").alias(row_id), stage.alias("stage"), "path", "rule", "expected", "actual")
    if required_fails:
        ended = found.where("stage = 'required'").select(batch).distinct().withColumn("__ended", F.lit(True))
        found = found.join(ended, batch, "left").where("stage = 'required' OR __ended IS NULL").drop("__ended")
    return described(lengths.unionByName(found))


def batch_length(inputs: DataFrame, results: DataFrame) -> DataFrame:
    """Batches whose number of results differs from that of inputs."""
    a, b = (x.groupBy("batch_id").agg(F.count("*").alias(n)) for x, n in ((inputs, "expected"), (results, "actual")))
    return a.join(b, "batch_id", "full").select("batch_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("expected", "actual")]).where("expected <> actual")


def required_policy(df: DataFrame, violations: DataFrame, mode: str = "log", batch: str = "batch_id", row_id: str = "row_id") -> DataFrame:
    """log keeps all rows; drop_batch drops batches with a required violation; raise fails if there is one."""
    if mode == "log":
        return df
    bad = violations.where("rule = 'required'")
    if mode == "raise":
        if bad.limit(1).count():
            raise ValueError("required fields are missing")
        return df
    return df.join(df.join(bad.select(row_id).distinct(), row_id, "left_semi").select(batch).distinct(), batch, "left_anti")


def places(rows: DataFrame, batch: str = "batch_id", row_id: str = "row_id") -> DataFrame:
    """Adds ``place``, a row's index in its batch from 0."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(batch).orderBy(row_id)) - 1)


def row_mapping(errors: DataFrame, placed: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Errors with paths ``results.<place>.<path>`` joined to their rows; ``path`` loses the prefix. Other paths are left out."""
    form = r"^results\.([0-9]+)\.(.*)$"
    parsed = errors.where(F.col("path").rlike(form)).withColumn("place", F.regexp_extract("path", form, 1).cast("int")).withColumn("path", F.regexp_extract("path", form, 2))
    return parsed.join(placed, [batch, "place"])
