"""Recursion over nested columns by their schema: every function compiles to one expression, no Python runs on rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXTS = "array<string>"
#: Not data: the vocabulary of a JSON-LD document (fixed value).
CONTEXT = "@context"


def is_wrapper(kind: T.DataType) -> bool:
    """True for the ``{value, present}`` of a required field."""
    return isinstance(kind, T.StructType) and {"value", "present"} <= set(kind.names)


def has_text(kind: T.DataType) -> bool:
    """True if a value of this type can hold text."""
    if isinstance(kind, T.StructType):
        return any(has_text(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return has_text(kind.elementType)
    return has_text(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, T.StringType)


def rewrite_text(c: Column, kind: T.DataType, change: Callable[[Column], Column]) -> Column:
    """``c`` with every text in it, at any depth, replaced by ``change`` of it; keys of maps stay, nulls too."""
    if isinstance(kind, T.StringType):
        return change(c)
    if not has_text(kind):
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: rewrite_text(x, kind.elementType, change))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: rewrite_text(x, kind.valueType, change))
    return F.when(c.isNotNull(), F.struct(*[rewrite_text(c.getField(f.name), f.dataType, change).alias(f.name) for f in kind]))


def texts(c: Column, kind: T.DataType) -> Column:
    """All texts in ``c``, at any depth, in order; nulls are left out."""
    none = F.array().cast(TEXTS)
    if isinstance(kind, T.StringType):
        return F.array_compact(F.array(c))
    if not has_text(kind):
        return none
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(c, lambda x: texts(x, kind.elementType))), none)
    if isinstance(kind, T.MapType):
        return texts(F.map_values(c), T.ArrayType(kind.valueType))
    return F.concat(*[texts(c.getField(f.name), f.dataType) for f in kind if has_text(f.dataType)])


def unwrap(c: Column, kind: T.DataType) -> Column:
    """``c`` with every ``{value, present}`` in it, at any depth, replaced by the value, null where it is not present."""
    if is_wrapper(kind):
        return F.when(c.getField("present"), unwrap(c.getField("value"), kind["value"].dataType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[unwrap(c.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(c, lambda x: unwrap(x, kind.elementType))
    return c


def wrapped_paths(kind: T.StructType, prefix: str = "") -> list[str]:
    """Paths (``a.b[].c``) of all wrapped fields, also of those in the value of another; ``@context`` is left out.

    Fields are wrapped; an item of an array is not, even if it looks so.
    """
    out = []
    for f in kind:
        if f.name == CONTEXT:
            continue
        path, inner = prefix + f.name, f.dataType
        if is_wrapper(inner):
            out.append(path)
            inner = inner["value"].dataType
        while isinstance(inner, T.ArrayType):
            path, inner = path + "[]", inner.elementType
        if isinstance(inner, T.StructType):
            out += wrapped_paths(inner, path + ".")
    return out


def segments(path: str) -> list[str]:
    """``a.b[].c`` as a, b, [], c."""
    return path.replace("[]", ".[]").split(".")


def at_path(c: Column, kind: T.DataType, steps: list[str], change: Callable[[Column, T.DataType], Column]) -> Column:
    """``c`` with what lies under a path replaced by ``change`` of it, in every item of the arrays on the way."""
    if not steps:
        return change(c, kind)
    if steps[0] == "[]":
        return F.transform(c, lambda x: at_path(x, kind.elementType, steps[1:], change))
    part = lambda f: at_path(c.getField(f.name), f.dataType, steps[1:], change) if f.name == steps[0] else c.getField(f.name)
    return F.when(c.isNotNull(), F.struct(*[part(f).alias(f.name) for f in kind]))


def values_at(c: Column, kind: T.DataType, steps: list[str]) -> Column:
    """All text values under a path, in order, as an array; nulls are left out. An unknown path is a KeyError."""
    if not steps:
        return texts(c, kind)
    if steps[0] == "[]":
        return F.coalesce(F.flatten(F.transform(c, lambda x: values_at(x, kind.elementType, steps[1:]))), F.array().cast(TEXTS))
    return values_at(c.getField(steps[0]), kind[steps[0]].dataType, steps[1:])
