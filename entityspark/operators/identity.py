"""Identity resolution: which rows are one person."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityspark.functions import text as fx
from entityspark.functions.text import NAMESPACE, uuid_v5
from entityspark.operators.components import connected_components, cut


def identity_components(rows: DataFrame, row_id: str = "row_id", values: str = "id_values") -> DataFrame:
    """``(row_id, component)``: rows that share a value, directly or through others; component is the smallest value.

    Rows without values have none and are left out.
    """
    exploded = rows.select(row_id, F.col(values)[0].alias("head"), F.explode(values).alias("value"))
    edges = exploded.where("head <> value").select("head", "value").distinct()
    parts = connected_components(edges, "head", "value").withColumnRenamed("id", "head")
    heads = rows.where(F.size(values) > 0).select(row_id, F.col(values)[0].alias("head"))
    return heads.join(parts, "head", "left").select(row_id, F.coalesce("component", "head").alias("component"))


#: Orders of one range: no window holds more rows of one value.
RANGE_ROWS = 1 << 16


def last_before(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the last ``value``, not null, of the rows with the same ``key`` that come earlier.

    ``order`` is a struct without ties whose first field, ``ord``, is a number. Ranges of it are
    dealt separately and then told what the ranges before them ended with, so a key with a third
    of all rows is many tasks.
    """
    o, v = F.col(order), F.col(value)
    ranged = rows.withColumn("__range", F.floor(F.col(f"{order}.ord") / RANGE_ROWS))
    within = Window.partitionBy(key, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy(key, "__range").agg(F.max_by(v, F.when(v.isNotNull(), o)).alias("__end")).select(key, "__range", F.last("__end", ignorenulls=True).over(ranges).alias("__earlier"))
    near = ranged.withColumn("__near", F.last(v, ignorenulls=True).over(within))
    return near.join(ends, [key, "__range"]).withColumn(name, F.coalesce("__near", "__earlier")).drop("__range", "__near", "__earlier")


def _ordered(some: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """``(row_id, uuid, event)``: every row takes the identity that the first of its known values has at its turn.

    A value is known if an earlier row has it, whose identity it then has, or else by an alias.
    So a row points to the latest earlier row with its first known value, or is a root. Along
    one value, rows that point by it follow one another as a run and take over what the run
    began with: a row's anchor is the latest earlier row with that value that does not point by
    it. What is left are chains from one value to another, resolved by doubling: each
    round joins the open rows with what their anchor points to, so rounds grow with the
    logarithm of the number of changes of value, and no round needs a component in one place.
    """
    order = F.struct("ord", "row_id")
    occurrences = some.select("row_id", order.alias("at"), F.posexplode("id_values").alias("pos", "value"))
    # the first occurrence of a value in a row counts; a value is known to the rows after the first one that has it
    first = last_before(occurrences.withColumn("seen", F.lit(True)), "value", "at", "seen", "known")
    if aliases is None:
        named = first.withColumn("alias", F.lit(None).cast("string"))
    else:  # an alias matters where a value occurs first, which is one row of each value
        fresh = first.where("known IS NULL").join(aliases.select("value", F.col("uuid").alias("alias")).dropDuplicates(["value"]), "value", "left")
        named = first.where("known IS NOT NULL").withColumn("alias", F.lit(None).cast("string")).unionByName(fresh)
    known = F.when(F.col("known").isNotNull() | F.col("alias").isNotNull(), F.struct("pos", "value", "alias"))
    via = named.groupBy("row_id").agg(F.min(known).alias("via"), F.first("at").alias("at"))
    root = F.when(F.col("via").isNull(), uuid_v5(F.col("id_values")[0])).otherwise(F.col("via.alias"))
    event = F.when(F.col("via").isNull(), "generated").otherwise("cached")
    rows = cut(some.join(via.select("row_id", "via"), "row_id").select("row_id", order.alias("at"), "id_values", F.col("via.value").alias("by"), root.alias("root"), event.alias("event")))

    spread = rows.select("row_id", "at", "by", "root", F.explode("id_values").alias("value"))
    points = F.col("root").isNull() & (F.col("value") == F.col("by"))
    anchored = last_before(spread.withColumn("anchor", F.when(~points, F.struct("row_id", "root"))), "value", "at", "anchor", "found").where(points)
    found = anchored.select("row_id", F.col("found.row_id").alias("to"), F.col("found.root").alias("uuid"))
    done = [rows.where("root IS NOT NULL").select("row_id", F.col("root").alias("uuid")), found.where("uuid IS NOT NULL").select("row_id", "uuid")]
    open_rows = cut(found.where("uuid IS NULL").select("row_id", "to"))
    targets = cut(found.select("row_id", "to", "uuid"))  # every row that is no root, with its anchor
    while not open_rows.isEmpty():
        step = cut(open_rows.join(targets.select(F.col("row_id").alias("to"), F.col("to").alias("next"), "uuid"), "to").select("row_id", F.col("next").alias("to"), "uuid"))
        done.append(step.where("uuid IS NOT NULL").select("row_id", "uuid"))
        open_rows = step.where("uuid IS NULL").select("row_id", "to")
        targets = cut(targets.join(step.select("row_id", F.col("to").alias("far"), F.col("uuid").alias("named")), "row_id", "left").select("row_id", F.coalesce("far", "to").alias("to"), F.coalesce("named", "uuid").alias("uuid")))
    return rows.select("row_id", "event").join(reduce(DataFrame.unionByName, done), "row_id").select("row_id", "uuid", "event")


def assign_identity(rows: DataFrame, linking: str = "ordered", row_id: str = "row_id", order: str = "ord", values: str = "id_values", aliases: DataFrame | None = None) -> DataFrame:
    """``(row_id, uuid, event)`` of every row. ``linking``: first_value, ordered or transitive.

    ``ordered`` gives what one pass over all rows in the order of (order, row_id) gives: a row
    takes the identity of the first of its values that is known, else that of its first value,
    and all its values then have it. ``aliases`` (value, uuid) are what is known at the start,
    for instance the ``alias_dictionary`` of earlier runs. ``transitive`` links all rows that
    share values, directly or not; ``first_value`` links by the first value alone; with either,
    a row takes the uuid of its first value that is among the aliases.

    The event is generated, cached (known), or random: rows without a value have an identity of
    their own from their id. Null and repeated values in a list are left out. ``order`` is a
    number, row ids are unique.
    """
    given = rows.select(F.col(row_id).alias("row_id"), F.col(order).alias("ord"), F.array_distinct(F.array_compact(F.col(values))).alias("id_values"))
    none = given.where(F.coalesce(F.size("id_values"), F.lit(0)) <= 0).select("row_id", uuid_v5(F.concat(F.lit("row:"), F.col("row_id").cast("string"))).alias("uuid"), F.lit("random").alias("event"))
    some = given.where(F.size("id_values") > 0)
    if linking == "ordered":
        return _ordered(some, aliases).unionByName(none)
    if linking == "first_value":
        found = some.select("row_id", uuid_v5(F.col("id_values")[0]).alias("uuid"), F.lit("generated").alias("event"))
    else:
        found = some.join(identity_components(some, "row_id", "id_values"), "row_id").select("row_id", uuid_v5("component").alias("uuid"), F.lit("generated").alias("event"))
    if aliases is not None:
        hits = some.select("row_id", F.posexplode("id_values").alias("pos", "value")).join(aliases, "value").groupBy("row_id").agg(F.min_by("uuid", "pos").alias("earlier"))
        found = found.join(hits, "row_id", "left").select("row_id", F.coalesce("earlier", "uuid").alias("uuid"), F.when(F.col("earlier").isNotNull(), "cached").otherwise(F.col("event")).alias("event"))
    return found.unionByName(none)


def alias_dictionary(rows: DataFrame, identities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``(value, uuid)``: the identity a value points to after the last row that has it; earlier ``aliases`` of other values stay."""
    values = rows.select("row_id", "ord", F.explode("id_values").alias("value")).join(identities.select("row_id", "uuid"), "row_id")
    now = values.where(F.col("value").isNotNull()).groupBy("value").agg(F.max_by("uuid", F.struct("ord", "row_id")).alias("uuid"))
    return now if aliases is None else aliases.select("value", "uuid").join(now, "value", "left_anti").unionByName(now)


EVENT = "array<struct<event:string,input_values:array<string>,uuid:string,reason:string>>"


def identity_events(rows: DataFrame, identities: DataFrame, columns: list[str], key_column: str | None = None, row_id: str = "row_id") -> DataFrame:
    """``(row_id, event, input_values, uuid, reason)``: what happened to each row, one or two records.

    column_missing or column_empty where a key column was asked for and gave no value, so that
    addresses were taken; then generated, cached, or fallback_to_random, after the event that
    ``assign_identity`` gives. ``columns`` are the cells of a row.
    """
    values, none = fx.id_values(columns, key_column), F.lit(None).cast("string")
    record = lambda event, given, uuid, reason: F.struct(event.alias("event"), given.alias("input_values"), uuid.alias("uuid"), reason.alias("reason"))
    out = F.when(F.col("__event") == "random", "fallback_to_random").otherwise(F.col("__event"))
    asked = f"'{key_column}' column" if key_column else "email columns"
    found = [record(out, values, F.col("__uuid"), F.when(out == "fallback_to_random", F.lit(f"No valid UUID values found (no email or {asked}), generating random UUID")))]
    if key_column:
        there = key_column in columns
        kind, reason = ("column_empty", "is empty or invalid") if there else ("column_missing", "not found in record")
        absent = F.size(fx.key_values(columns, key_column)) == 0
        found.insert(0, F.when(absent, record(F.lit(kind), fx.emails_of(columns), none, F.lit(f"UUID column '{key_column}' {reason}, falling back to email"))))
    named = identities.select(row_id, F.col("uuid").alias("__uuid"), F.col("event").alias("__event"))
    return rows.join(named, row_id).select(row_id, F.explode(F.array_compact(F.array(*found)).cast(EVENT)).alias("e")).select(row_id, "e.*")


#: Columns that name a person in the order in which they are looked at (fixed values).
SOURCE_COLUMNS = ("email", "primaryEmail", "primaryemail", "Email", "EMAIL")


def source_value(columns: list[str], key_column: str | None = None) -> Column:
    """What identified a row: the key column, else an address column by its exact name, else the first cell with text, else ``unknown``."""
    ladder = [c for c in (key_column, *SOURCE_COLUMNS) if c in columns] + [c for c in columns if c != "userID"]
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ladder], F.lit("unknown"))


def v5(value: str) -> str:
    """The version-5 identifier of a text, for tests."""
    digest = bytearray(hashlib.sha1(bytes.fromhex(NAMESPACE) + value.encode()).digest()[:16])
    digest[6], digest[8] = digest[6] & 15 | 80, digest[8] & 63 | 128
    h = digest.hex()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def sequential(rows: Iterator[tuple[int, list[str]]], aliases: dict[str, str] | None = None) -> dict[int, tuple[str, str]]:
    """Row to (uuid, event) by one pass over all rows in order, in plain Python, for tests."""
    known = dict(aliases or {})
    out = {}
    for row, values in rows:
        if values:
            hit = next((known[v] for v in values if v in known), None)
            out[row] = (hit or v5(values[0]), "cached" if hit else "generated")
            known.update(dict.fromkeys(values, out[row][0]))
    return out
