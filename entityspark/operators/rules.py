"""Declarative row mapping: rules compiled to one projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entityspark.functions import text as fx

Transform = str | dict


@dataclass(frozen=True)
class Rule:
    """Where a target path comes from. ``when`` holds {type, column, value} conditions, all of which must hold."""

    source: str | list[str] | None = None
    literal: str | None = None
    transforms: tuple[Transform, ...] = ()
    taxonomy: dict[str, str] | None = None
    fallback: str | None = None
    when: tuple[dict, ...] = ()
    custom: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class RuleSet:
    """Rules by target path, required paths, and the paths left to a resolver."""

    fields: dict[str, Rule]
    required: tuple[str, ...] = ()
    model_fields: tuple[str, ...] = ()
    schema_fields: tuple[str, ...] = field(default=())


STEPS = {"trim", "lowercase", "uppercase", "split", "map", "toNumber", "secondsToDuration", "filterEmpty", "unique"}


def compile_rules(rules: RuleSet) -> RuleSet:
    """Checks rules: each needs a source, literal or custom function; unknown steps are errors; unknown paths are left out."""
    kept = {}
    for path, rule in rules.fields.items():
        if rules.schema_fields and path not in rules.schema_fields:
            continue
        if rule.source is None and rule.literal is None and rule.custom is None:
            raise ValueError(f"{path}: a rule needs a source, a literal or a custom function")
        for step in rule.transforms:
            if (step if isinstance(step, str) else step["type"]) not in STEPS:
                raise ValueError(f"{path}: unknown transform {step!r}")
        if any("column" not in c for c in rule.when):
            raise ValueError(f"{path}: a condition needs a column")
        kept[path] = rule
    return RuleSet(kept, rules.required, rules.model_fields, rules.schema_fields)


def model_field_set(schema_fields: list[str], default: bool, listed: list[str], include: list[str] = (), exclude: list[str] = ()) -> list[str]:
    """Paths a resolver fills: all but the listed, or the listed only; then additions and exclusions. Unknown names are ignored."""
    chosen = [f for f in schema_fields if (f not in listed) == default]
    return [f for f in schema_fields if (f in chosen or f in include) and f not in exclude]


def with_taxonomies(schema: dict, taxonomies: dict[str, dict[str, str]]) -> dict:
    """A target schema whose properties that name a taxonomy list its values; one that is not there allows none."""

    def one(spec: dict) -> dict:
        out = {k: v for k, v in spec.items() if k != "enumFromTaxonomy"}
        if "enumFromTaxonomy" in spec:
            out["enum"] = list(dict.fromkeys(taxonomies.get(spec["enumFromTaxonomy"], {}).values()))
        if "properties" in spec:
            out["properties"] = {n: one(p) for n, p in spec["properties"].items()}
        return out | {"items": one(spec["items"])} if "items" in spec else out

    return schema | {"entities": {name: one(entity) for name, entity in schema["entities"].items()}}


def rules_of(config: dict, schema: dict, taxonomies: dict[str, dict[str, str]] | None = None, include: list[str] = (), exclude: list[str] = (), custom: dict[str, Callable[[Column], Column]] | None = None) -> RuleSet:
    """The rules of a configuration ``{"fields": {path: rule}, "llm": {"default", "fields"}}`` for a target schema.

    A rule has source, literal, transforms, taxonomy (a name), fallback, when and custom (the name
    of a function of ``custom``). Rules of paths that the schema lacks are left out; faulty ones
    are errors, and so are names of functions that are not given. Required paths are the
    schema's; a resolver fills what ``llm`` says, with ``include`` and without ``exclude``.
    """
    named = {path: required for path, required, _ in schema_fields(target_struct_type(schema))}
    fields = {}
    for path, spec in config.get("fields", {}).items():
        if path not in named:
            continue
        taxonomy = (taxonomies or {}).get(spec["taxonomy"]) if spec.get("taxonomy") else None
        function = (custom or {})[spec["custom"]] if spec.get("custom") else None
        fields[path] = Rule(spec.get("source"), spec.get("literal"), tuple(spec.get("transforms") or ()), taxonomy, spec.get("fallback"), tuple(spec.get("when") or ()), function)
    asked = config.get("llm") or {}
    model = model_field_set(list(named), asked.get("default", True), asked.get("fields") or [], include, exclude)
    return compile_rules(RuleSet(fields, tuple(p for p, required in named.items() if required), tuple(model), tuple(named)))


def condition(columns: list[str], spec: dict) -> Column:
    """A condition as a Column that is never null; unknown types are false."""
    name, kind = spec["column"], spec["type"]
    if kind == "columnExists":
        return F.lit(name in columns)
    c = F.col(name) if name in columns else F.lit(None).cast("string")
    tests = {"notEmpty": lambda: ~fx.is_blank(c), "equals": lambda: c == F.lit(spec.get("value")), "matches": lambda: c.rlike(spec.get("value"))}
    return F.coalesce(tests[kind](), F.lit(False)) if kind in tests else F.lit(False)


def taxonomy_normalize(c: Column, taxonomy: dict[str, str]) -> Column:
    """Canonical value of a notation or value, whatever its case and surrounding blanks; unknown ones stay."""
    table = {}
    for notation, value in taxonomy.items():
        table[value.strip().lower()] = value
        table[notation.strip().lower()] = value
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(literal, F.lower(fx.js_trim(c))), c)


def _mapped(c: Column, kind: str, values: dict[str, str]) -> Column:
    return F.transform(c, lambda x: fx.t_map(x, values)) if kind == "list" else fx.t_map(c, values)


def apply_steps(c: Column, steps: tuple[Transform, ...]) -> tuple[Column, str]:
    """Runs transforms in order; the second value is the resulting kind: text, list or number."""
    kind = "text"
    each = lambda f, x, k: F.transform(x, f) if k == "list" else f(x)
    for step in steps:
        spec = {"type": step} if isinstance(step, str) else step
        name = spec["type"]
        if name in ("trim", "lowercase", "uppercase"):
            c = each({"trim": fx.js_trim, "lowercase": F.lower, "uppercase": F.upper}[name], c, kind) if kind != "number" else c
        elif name == "map":
            c = _mapped(c, kind, spec["values"])
        elif name == "split":
            c, kind = fx.t_split(F.array_join(c, spec.get("delimiter", ",")) if kind == "list" else c, spec.get("delimiter", ","), spec.get("trimItems", True), spec.get("filterEmpty", True)), "list"
        elif name == "toNumber":
            c, kind = (fx.t_to_number(c), "number") if kind == "text" else (c, kind)
        elif name == "secondsToDuration":
            c, kind = fx.t_seconds_to_duration(c if kind == "number" else fx.t_to_number(c)), "text"
        elif kind == "list":
            c = fx.t_filter_empty(c) if name == "filterEmpty" else fx.t_unique(c)
    return c, kind


def is_empty(c: Column, kind: str) -> Column:
    return F.coalesce(F.size(c) <= 0, F.lit(True)) if kind == "list" else c.isNull() if kind == "number" else fx.is_blank(c)


def value_of(columns: list[str], rule: Rule) -> tuple[Column, str]:
    """A rule's value and kind: literal or source, transforms, fallback, taxonomy, under its conditions.

    A value that is still empty after the fallback is null.
    """
    absent = F.lit(None).cast("string")
    pick = lambda n: F.col(n).cast("string") if n in columns else absent
    if rule.literal is not None:
        c = F.lit(rule.literal)
    else:
        c = pick(rule.source) if isinstance(rule.source, str) else fx.coalesce_nonblank([pick(n) for n in rule.source or [""]])
    c = rule.custom(c) if rule.custom else c
    c, kind = apply_steps(c, rule.transforms)
    if rule.fallback is not None:
        given = F.array(F.lit(rule.fallback)) if kind == "list" else F.lit(rule.fallback).cast("double" if kind == "number" else "string")
        c = F.when(is_empty(c, kind), given).otherwise(c)
    c = F.when(~is_empty(c, kind), c)
    if rule.taxonomy:
        c = F.transform(c, lambda x: taxonomy_normalize(x, rule.taxonomy)) if kind == "list" else taxonomy_normalize(c, rule.taxonomy)
    if rule.when:
        c = F.when(fx.all_of([condition(columns, w) for w in rule.when]), c)
    return c, kind


def nest(leaves: dict[str, Column]) -> list[Column]:
    """Columns by dotted path as nested structs."""
    tree: dict = {}
    for path, c in leaves.items():
        *parents, last = path.split(".")
        at = tree
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = c
    build = lambda t: [(F.struct(*build(v)) if isinstance(v, dict) else v).alias(k) for k, v in t.items()]
    return build(tree)


def transform_row(df: DataFrame, rules: RuleSet, wrap: bool = False) -> DataFrame:
    """Adds ``mapped`` (nested), ``pending`` (paths left to a resolver) and ``missing`` (required, no value).

    ``wrap`` gives required values as {value, present}. One projection; nulls and absent columns
    give null values, never errors.
    """
    rules = compile_rules(rules)
    values = {path: value_of(df.columns, rule) for path, rule in rules.fields.items()}
    flat = df.select("*", *[c.alias(f"__{i}") for i, (c, _) in enumerate(values.values())])  # named once, not expanded again
    named = {path: (F.col(f"__{i}"), kind) for i, (path, (_, kind)) in enumerate(values.items())}
    has = lambda path: F.lit(False) if path not in named else ~is_empty(*named[path])
    ancestors = lambda path: [p for p in named if p == path or path.startswith(p + ".")]
    found = lambda path: F.greatest(F.lit(False), F.lit(False), *[has(p) for p in ancestors(path)])
    pending = [F.lit(p) for p in rules.model_fields] + [F.when(~found(p), F.lit(p)) for p in rules.required if p not in rules.model_fields]
    missing = [F.when(~found(p), F.lit(p)) for p in rules.required]
    leaf = {p: F.struct(c.alias("value"), (~is_empty(c, k)).alias("present")) if wrap and p in rules.required else c for p, (c, k) in named.items()}
    compact = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    return flat.select(*df.columns, F.struct(*nest(leaf)).alias("mapped"), compact(pending).alias("pending"), compact(missing).alias("missing"))


def schema_fields(schema: T.StructType, prefix: str = "") -> list[tuple[str, bool, str]]:
    """(path, required, type) of the leaves; structs are walked, arrays kept with their items' leaves."""
    out = []
    for f in schema.fields:
        path = prefix + f.name
        if isinstance(f.dataType, T.StructType):
            out += schema_fields(f.dataType, path + ".")
        else:
            out.append((path, not f.nullable, f.dataType.simpleString()))
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                out += schema_fields(f.dataType.elementType, path + ".")
    return out


SCALARS = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}


def _property_type(spec: dict) -> T.DataType:
    """A property's type; what has no type of its own, such as a bare enumeration, is text."""
    if spec.get("properties"):
        return _properties(spec["properties"])
    if spec.get("type") == "array" or "items" in spec:
        items = spec.get("items", {})
        return T.ArrayType(_property_type(items), items.get("required") is not True)
    return SCALARS.get(spec.get("type", "string"), T.StringType())


def _properties(properties: dict[str, dict]) -> T.StructType:
    constraints = lambda spec: {k: v for k, v in spec.items() if k not in ("type", "required", "items", "properties")}
    return T.StructType([T.StructField(name, _property_type(spec), spec.get("required") is not True, constraints(spec)) for name, spec in properties.items()])


def target_struct_type(schema: dict) -> T.StructType:
    """A target schema ``{"entities": {name: {"properties": {..}}}}`` as a typed struct of entities, for ``from_json``.

    All properties are there, those not required are nullable; enumerations, patterns and other
    constraints are the fields' metadata. An entity without properties is an empty struct.
    """
    return T.StructType([T.StructField(name, _properties(entity.get("properties", {})), True) for name, entity in schema["entities"].items()])


def prune_schema(schema: T.StructType, paths: list[str]) -> T.StructType:
    """The parts of a schema under the given paths, through arrays and structs; no paths: all of it."""
    if not paths:
        return schema

    def walk(s: T.StructType, wanted: list[str]) -> T.StructType:
        fields = []
        for f in s.fields:
            if f.name in wanted:
                fields.append(f)
                continue
            inner = [w[len(f.name) + 1 :] for w in wanted if w.startswith(f.name + ".")]
            of = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if inner and isinstance(of, T.StructType):
                kept = walk(of, inner)
                if kept.fields:
                    fields.append(T.StructField(f.name, T.ArrayType(kept) if isinstance(f.dataType, T.ArrayType) else kept, f.nullable, f.metadata))
        return T.StructType(fields)

    return walk(schema, paths)


def project(c: Column, schema: T.StructType) -> Column:
    """The parts of a struct that ``schema`` has, through structs and arrays of structs; Catalyst prunes the scan alike."""

    def part(x: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return project(x, kind)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(x, lambda e: project(e, kind.elementType))
        return x

    return F.when(c.isNotNull(), F.struct(*[part(c[f.name], f.dataType).alias(f.name) for f in schema.fields]))


def wrap_required_schema(schema: T.StructType) -> T.StructType:
    """Required fields of each entity as {value, present}."""
    wrapped = lambda f: f if f.nullable else T.StructField(f.name, T.StructType([T.StructField("value", f.dataType), T.StructField("present", T.BooleanType())]), True)
    entity = lambda t: T.StructType([wrapped(f) for f in t.fields]) if isinstance(t, T.StructType) else t
    return T.StructType([T.StructField(f.name, entity(f.dataType), True) for f in schema.fields])


def unwrap_required(c: Column) -> Column:
    """The value of a {value, present} struct, null where it is not present."""
    return F.when(c["present"], c["value"])


def merge_deep(left: Column, right: Column, kind: T.DataType) -> Column:
    """Right wins on scalars and arrays, structs are merged field by field, null never wins."""
    if not isinstance(kind, T.StructType):
        return F.coalesce(right, left)
    return F.struct(*[merge_deep(left[f.name], right[f.name], f.dataType).alias(f.name) for f in kind.fields])
