"""Merging all records of a person into one entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_nonempty(c: Column, order: Column) -> Column:
    """The value of the first record, by order, that is neither null nor empty text."""
    return F.min_by(c, F.when(c.isNotNull() & (c.cast("string") != ""), order))


def ordered_union(c: Column, order: Column) -> Column:
    """Distinct items of all records' lists in record order; nulls dropped."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(c, F.array().cast("array<string>")).alias("v")))), lambda s: s["v"])
    return F.array_distinct(F.array_compact(F.flatten(lists)))


def collect_children(c: Column, order: Column) -> Column:
    """The records' children in order, null if there are none."""
    found = F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(order.alias("o"), c.alias("v"))))), lambda s: s["v"])
    return F.when(F.size(found) > 0, found)


def entity_merge(records: DataFrame, key: str, order: str, scalars: list[str] = (), lists: list[str] = (), children: list[str] = (), spans: list[str] = ()) -> DataFrame:
    """One row per key: scalars by first non-empty, lists by ordered distinct union, children collected; and ``n_records``.

    Of ``spans`` the smallest and largest value, as ``first_`` and ``last_`` of the column.

    Lists in lists are taken apart once. Rows without a key are left out. List items are made distinct before they are collected, so a
    key with very many records costs its different items only.
    """
    o = F.col(order)
    given = records.where(F.col(key).isNotNull())
    aggregates = [first_nonempty(F.col(c), o).alias(c) for c in scalars] + [collect_children(F.col(c), o).alias(c) for c in children]
    aggregates += [f(c).alias(f"{n}_{c}") for c in spans for n, f in (("first", F.min), ("last", F.max))]
    merged = given.groupBy(key).agg(F.count("*").alias("n_records"), *aggregates)
    if lists:
        kinds = dict(records.dtypes)
        flat = {c: F.flatten(F.array_compact(c)) if kinds[c].startswith("array<array<") else F.col(c) for c in lists}
        tagged = [F.transform(F.coalesce(flat[c], F.array().cast("array<string>")), _placed(k)) for k, c in enumerate(lists)]
        items = given.select(key, o.alias("__o"), F.explode(F.concat(*tagged)).alias("x")).select(key, "__o", "x.*").where(F.col("__item").isNotNull())
        first = items.groupBy(key, "__list", "__item").agg(F.min(F.struct("__o", "__at")).alias("__first"))
        union = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("__list") == k, F.struct("__first", "__item")))), lambda x: x["__item"])
        unions = first.groupBy(key).agg(*[union(k).alias(c) for k, c in enumerate(lists)])
        merged = merged.join(unions, key, "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})
    return merged.select(key, "n_records", *scalars, *lists, *children, *[f"{n}_{c}" for c in spans for n in ("first", "last")])


def identified(merged: DataFrame, key: str) -> DataFrame:
    """Merged entities with ``userID`` and ``@id``, the key; an entity of one record is as that was, without."""
    own = F.when(F.col("n_records") > 1, F.col(key))
    return merged.withColumns({"userID": own, "@id": own})


def _placed(k: int):  # noqa: ANN202
    return lambda v, i: F.struct(F.lit(k).alias("__list"), i.alias("__at"), v.alias("__item"))


def jsonld_project(entities: DataFrame, key: str, kind: str, columns: list[str], context: str = "https://schema.org/") -> DataFrame:
    """``(key, jsonld)``: JSON-LD text per entity; nulls are left out, an empty id too."""
    identity = F.when(F.coalesce(F.col(key), F.lit("")) != "", F.col(key)).alias("@id")
    return entities.select(key, F.to_json(F.struct(F.lit(context).alias("@context"), F.lit(kind).alias("@type"), identity, *columns)).alias("jsonld"))


def jsonld_array(items: Column, kind: str, columns: list[str]) -> Column:
    """An array of structs as JSON-LD entities of a type, with the given columns only; null stays null."""
    return F.transform(items, lambda x: F.struct(F.lit(kind).alias("@type"), *[x[c].alias(c) for c in columns]))
