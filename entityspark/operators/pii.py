"""Masking of personal data in columns and free text, and its reversal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityspark.functions.text import js_trim, split_values
from entityspark.operators import nested
from entityspark.operators.components import stored

#: Patterns of free-text detection (fixed values).
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b|(?:\+\d{1,3}[-.\s]?)?\(?[0-9]{1,4}\)?[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,9}"
ADDRESS = r"(?i)\b\d+\s+[A-Za-z0-9\s,.-]+\s+(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Place|Pl\.?|Boulevard|Blvd\.?|Way|Circle|Cir\.?|Highway|Hwy\.?|Parkway|Pkwy\.?)(?:\s|,|$)"
#: The beginning of a run of the characters that an address is made of, with the one before it, up to the last street word in it.
STREETS = r"(?i)(?:^|[^A-Za-z0-9\s,.-])[A-Za-z0-9\s,.-]*\s" + ADDRESS[ADDRESS.index("(?:Street") :]
PLACEHOLDER = r"(?=[AEINP])(?:NAME|EMAIL|PHONE|ADDRESS|ID)_[0-9]+(?:@GMAIL\.COM)?"


def valid_email(c: Column) -> Column:
    domain = F.substring_index(c, "@", -1)
    return (F.size(F.split(c, "@")) == 2) & (F.length(F.substring_index(c, "@", 1)) > 0) & domain.contains(".") & ~domain.startswith(".") & ~domain.endswith(".") & (F.length(domain) > 3)


def valid_phone(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\D", "")).between(10, 15)


def valid_address(c: Column) -> Column:
    return c.rlike(r"\d") & (F.length(js_trim(c)) > 10)


KINDS = {"EMAIL": (EMAIL, valid_email), "PHONE": (PHONE, valid_phone), "ADDRESS": (ADDRESS, valid_address)}


def matches(c: Column, kind: str) -> Column:
    """Matches of a kind's pattern, valid or not, in order; null text has none.

    An address goes from the first number of a run to the last street word of it, so the pattern is
    tried only up to there: time stays linear also in long runs of numbers and plain words.
    """
    given, pattern = F.coalesce(c, F.lit("")), F.lit(KINDS[kind][0])
    if kind != "ADDRESS":
        return F.regexp_extract_all(given, pattern, F.lit(0))
    return F.flatten(F.transform(F.regexp_extract_all(given, F.lit(STREETS), F.lit(0)), lambda run: F.regexp_extract_all(run, pattern, F.lit(0))))


def replace_kind(c: Column, kind: str, replacement: Callable[[Column], Column]) -> Column:
    """``c`` with every match of a kind's pattern replaced."""
    pattern = KINDS[kind][0]
    if kind != "ADDRESS":
        return replace_matches(c, pattern, replacement)
    return replace_matches(c, STREETS, lambda run: replace_matches(run, pattern, replacement))


def detect(c: Column, kind: str) -> Column:
    """Valid matches of a kind, in order; null text has none."""
    return F.filter(matches(c, kind), KINDS[kind][1])


def once(c: Column, function: Callable[[Column], Column]) -> Column:
    """``function(c)`` with ``c`` computed once, however often the function uses it."""
    return F.get(F.transform(F.array(c), function), F.lit(0))


def replace_matches(c: Column, pattern: str, replacement: Callable[[Column], Column]) -> Column:
    """``c`` with every match m replaced by ``replacement(m)``: gaps and matches zipped, no Python. Null stays null."""

    def zipped(t: Column) -> Column:
        gaps, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda x: F.concat(F.coalesce(x["g"], F.lit("")), F.coalesce(replacement(x["m"]), F.lit("")))), "")

    def marked(t: Column) -> Column:  # one regular expression instead of two: matches between marks are the odd pieces
        pieces = F.split(F.regexp_replace(t, pattern, "\x00$0\x00"), "\x00", -1)
        return F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.coalesce(replacement(x), F.lit(""))).otherwise(x)), "")

    def replaced(t: Column) -> Column:
        return F.when(t.contains("\x00"), zipped(t)).otherwise(marked(t))

    return once(c, replaced)


def written(template: Column, n: Column) -> Column:
    return F.concat(template, F.lit("_"), n.cast("string"), F.when(template == "EMAIL", F.lit("@GMAIL.COM")).otherwise(F.lit("")))


#: Row numbers of one range of placeholders.
RANGE_ROWS = 1 << 16


def dictionary(found: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``(scope.., value, template, n, placeholder)`` from occurrences (scope.., value, template, ord).

    A value gets one placeholder: the template of its first occurrence, numbered per scope and
    template by first occurrence. ``ord`` is a struct whose first field, ``row``, is a number.
    Numbers come from counts of ranges of RANGE_ROWS row numbers, so no window holds a whole
    template, and the window over the ranges has one row for each of them.
    """
    scope = scope or []
    first = found.groupBy(*scope, "value").agg(F.min_by("template", "ord").alias("template"), F.min("ord").alias("ord"))
    ranged = first.withColumn("range", F.floor(F.col("ord.row") / RANGE_ROWS))
    key = [*scope, "template"]
    before = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy(*key, "range").agg(F.count("*").alias("c")).select(*key, "range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy(*key, "range").orderBy("ord", "value"))
    numbered = ranged.withColumn("place", place).join(bases, [*key, "range"])
    n = F.col("base") + F.col("place")
    return numbered.select(*scope, "value", "template", n.alias("n"), written(F.col("template"), n).alias("placeholder"))


def mask_fields(df: DataFrame, fields: dict[str, tuple[str, bool]], row_id: str, scope: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Masks whole values, or each item of multi-value columns; returns the masked frame and its dictionary.

    ``fields``: column to (template, multi). Blank values stay. Unmapped columns stay.
    """
    scope = scope or []
    names = list(fields)
    items = [split_values(F.col(c)) if multi else F.filter(F.array(F.col(c)), lambda x: js_trim(x) != "") for c, (_, multi) in fields.items()]
    parts = [F.transform(x, _tagged(k, fields[c][0])) for k, (c, x) in enumerate(zip(names, items))]
    flat = df.select(row_id, *scope, F.explode(F.concat(*parts)).alias("x")).select(row_id, *scope, "x.field", "x.pos", "x.value", "x.template", F.struct(F.col(row_id).alias("row"), "x.field", "x.pos").alias("ord"))
    table = dictionary(flat, scope)
    named = flat.join(table.select(*scope, "value", "placeholder"), [*scope, "value"])
    text = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == k, F.struct("pos", "placeholder")))), lambda s: s["placeholder"]), ", ")
    masked = named.groupBy(row_id).agg(*[text(k).alias(f"__m{k}") for k in range(len(names))])
    joined = df.join(masked, row_id, "left")
    return joined.select(*[F.coalesce(F.nullif(F.col(f"__m{names.index(c)}"), F.lit("")), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns]), table


def _tagged(k: int, template: str):  # noqa: ANN202
    return lambda v, i: F.struct(F.lit(k).alias("field"), i.alias("pos"), v.alias("value"), F.lit(template).alias("template"))


def mask_text(c: Column) -> Column:
    """Free text with valid emails, then phones, then addresses replaced by their kind."""
    for kind, (_, valid) in KINDS.items():
        c = replace_kind(c, kind, _label(kind, valid))
    return c


def _label(kind: str, valid):  # noqa: ANN001, ANN202
    return lambda m: F.when(valid(m), F.lit(f"[{kind}]")).otherwise(m)


#: Stands for a number not yet given; it and the escape are escaped in the texts. After a placeholder it parts it from a digit.
MARK, ESCAPE = "\x02", "\x03"
#: What in a text looks like a placeholder; it is masked like anything else, so that it comes back.
LITERAL = "LITERAL"


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "\x05")), F.lit(MARK), F.lit(ESCAPE + "\x04"))


def _plain(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESCAPE + "\x04"), F.lit(MARK)), F.lit(ESCAPE + "\x05"), F.lit(ESCAPE))


def _mark(kind: str) -> str:  # like ``mask_text``'s label to later kinds: a number next to it begins and ends there; of the first kind, nothing that they could match
    return MARK + MARK if kind == LITERAL else f"{MARK}{kind}]"


def _pieces(t: Column, pattern: str, found: Callable[[Column], Column]) -> Column:
    """``t`` cut at the matches of a pattern: pieces (text, found) in order, where ``found(m)`` is of a match m and false of what lies between."""
    piece = lambda x, is_found: F.struct(x.alias("text"), is_found.alias("found"))
    gaps, matched = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    zipped = F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), matched.alias("m")), lambda x: F.array(piece(x["g"], F.lit(False)), piece(F.coalesce(x["m"], F.lit("")), x["m"].isNotNull() & F.coalesce(found(x["m"]), F.lit(False))))))
    marked = F.split(F.regexp_replace(t, pattern, "\x00$0\x00"), "\x00", -1)  # one search instead of two
    return F.when(t.contains("\x00"), zipped).otherwise(F.transform(marked, lambda x, i: piece(x, (i % 2 == 1) & F.coalesce(found(x), F.lit(False)))))


def _found(t: Column, kind: str) -> Column:
    """The pieces of a text and whether they are valid matches of a kind, as ``detect`` finds them, by one search; null has none."""
    none = F.when(t.isNotNull(), F.array(F.struct(t.alias("text"), F.lit(False).alias("found"))))
    if kind == LITERAL:
        return F.when(t.contains("_"), _pieces(t, PLACEHOLDER, lambda _: F.lit(True))).otherwise(none)
    pattern, valid = KINDS[kind]
    if kind == "ADDRESS":
        whole = lambda x: F.array(F.struct(x["text"].alias("text"), F.lit(False).alias("found")))
        return F.flatten(F.transform(_pieces(t, STREETS, lambda _: F.lit(True)), lambda x: F.when(x["found"], _pieces(x["text"], pattern, valid)).otherwise(whole(x))))
    if kind == "PHONE":
        return _pieces(t, f"(?=[0-9+(])(?:{pattern})", valid)  # what its matches begin with is tried first
    return F.when(t.contains("@"), _pieces(t, pattern, valid)).otherwise(none)


def mask_texts(df: DataFrame, columns: list[str], row_id: str, scope: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Free text with numbered placeholders that ``unmask`` restores; returns the masked frame and its dictionary.

    What already looks like a placeholder, then emails, phones and addresses, each in what the
    kind before left. A value has one placeholder in all rows and columns, numbered by row,
    column, kind and place. A digit that follows a placeholder is parted from it. ``row_id`` is a
    unique number. Null and empty texts stay, and so do texts without matches. Texts are searched
    here, once, and stored with what was found, which the dictionary and the masked frame read.
    """
    scope = scope or []
    kinds = [LITERAL, *KINDS]
    marked, found = df, []
    for k, c in enumerate(columns):
        marked = marked.withColumn(f"__t{k}", _escaped(F.col(c)))
        for j, kind in enumerate(kinds):
            marked = marked.withColumn("__pieces", _found(F.col(f"__t{k}"), kind))
            values = F.transform(F.filter("__pieces", lambda x: x["found"]), lambda x: x["text"])
            mark = _mark(kind)
            hidden = F.array_join(F.transform("__pieces", lambda x: F.when(x["found"], mark).otherwise(x["text"])), "")
            marked = marked.withColumns({f"__v{k}_{j}": F.coalesce(values, F.array().cast("array<string>")), f"__t{k}": hidden})
            found.append(F.transform(F.col(f"__v{k}_{j}"), _placed(k, j, kind)))
    texts = [f"__t{k}" for k in range(len(columns))]
    marked = stored(marked.select(*[c for c in df.columns if c not in columns], *texts, F.concat(*found).alias("__found")), "marked")
    flat = marked.select(row_id, *scope, F.explode("__found").alias("x")).select(row_id, *scope, "x.*")
    flat = flat.withColumn("ord", F.struct(F.col(row_id).alias("row"), "field", "kind", "pos"))
    table = dictionary(flat, scope)
    named = flat.join(table.select(*scope, "value", "placeholder"), [*scope, "value"])
    each = [(k, j) for k in range(len(columns)) for j in range(len(kinds))]
    of = lambda k, j: F.transform(F.array_sort(F.collect_list(F.when((F.col("field") == k) & (F.col("kind") == j), F.struct("pos", "placeholder")))), lambda x: x["placeholder"])
    joined = marked.drop("__found").join(named.groupBy(row_id).agg(*[of(k, j).alias(f"__p{k}_{j}") for k, j in each]), row_id, "left")

    def rebuilt(k: int, c: str) -> Column:
        text = F.col(f"__t{k}")
        for j, kind in enumerate(kinds):
            text = once(text, _filled(_mark(kind), F.col(f"__p{k}_{j}")))
        return _plain(text).alias(c)

    return joined.select(*[rebuilt(columns.index(c), c) if c in columns else F.col(c) for c in df.columns]), table


def _filled(mark: str, names: Column) -> Callable[[Column], Column]:
    """What puts names in the place of the marks of a text, each parted from what could be taken for a part of it."""

    def joined(gaps: Column) -> Column:
        pairs = F.arrays_zip(gaps.alias("gap"), F.slice(gaps, 2, F.size(gaps)).alias("next"), names.alias("name"))
        return F.array_join(F.transform(pairs, lambda x: F.concat(x["gap"], F.coalesce(F.concat(x["name"], F.when(x["next"].rlike(f"^([0-9@]|{ESCAPE}\x04)"), MARK).otherwise("")), F.lit("")))), "")

    return lambda t: F.when(t.contains(mark), once(F.split(t, rf"\Q{mark}\E", -1), joined)).otherwise(t)


def _placed(k: int, j: int, kind: str) -> Callable[[Column, Column], Column]:
    template = lambda v: F.regexp_extract(v, "^[A-Z]+", 0) if kind == LITERAL else F.lit(kind)
    return lambda v, i: F.struct(F.lit(k).alias("field"), F.lit(j).alias("kind"), i.alias("pos"), _plain(v).alias("value"), template(v).alias("template"))


def unmask(df: DataFrame, columns: list[str], row_id: str, table: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Restores every placeholder of ``table`` in all texts of the columns, at any depth; others stay.

    Placeholders are whole matches, so _1 never hits _10; the sign that parts one from a digit goes. One map a row holds what it needs, so
    structs, arrays and maps are rewritten where they are. ``scope`` columns, in both frames, keep
    placeholders of one scope from another's. ``row_id`` is unique.
    """
    scope, kinds = scope or [], {f.name: f.dataType for f in df.schema}
    every = F.flatten(F.array(*[nested.texts(F.col(c), kinds[c]) for c in columns]))
    named = F.array_distinct(F.flatten(F.transform(every, lambda t: F.regexp_extract_all(t, F.lit(PLACEHOLDER), F.lit(0)))))
    found = df.select(row_id, *scope, F.explode(named).alias("placeholder"))
    maps = found.join(table.select(*scope, "placeholder", "value"), [*scope, "placeholder"]).groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("__map"))
    joined = df.join(maps, row_id, "left")
    restored = lambda t: replace_matches(t, PLACEHOLDER + f"{MARK}?", lambda m: F.coalesce(F.try_element_at(F.col("__map"), F.rtrim(m, F.lit(MARK))), m))
    whole = lambda c: F.when(F.col("__map").isNull(), F.col(c)).otherwise(nested.rewrite_text(F.col(c), kinds[c], restored))
    return joined.select(*[whole(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def mask(df: DataFrame, fields: dict[str, tuple[str, bool]], row_id: str, scope: list[str] | None = None, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """``mask_nested``, or, where masking is switched off, the frame as it is and an empty dictionary."""
    if enabled:
        return mask_nested(df, fields, row_id, scope)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    columns = "".join(f"`{c}` {kinds[c]}, " for c in scope or [])
    return df, df.sparkSession.createDataFrame([], f"{columns}value string, template string, n long, placeholder string")


def mask_nested(df: DataFrame, fields: dict[str, tuple[str, bool]], row_id: str, scope: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Masks the texts under paths such as ``people[].email``; returns the masked frame and its dictionary.

    ``fields``: path to (template, multi), as in ``mask_fields``, which this equals on plain
    columns; of a struct, array or map under a path all texts are masked. Placeholders are
    numbered by row, path and place. Blank texts and nulls stay. ``row_id`` is a unique number.
    """
    scope, kinds = scope or [], {f.name: f.dataType for f in df.schema}
    paths = {p: nested.segments(p) for p in fields}

    def items(path: str) -> Column:
        whole = nested.values_at(F.col(paths[path][0]), kinds[paths[path][0]], paths[path][1:])
        return F.flatten(F.transform(whole, split_values)) if fields[path][1] else F.filter(whole, lambda x: js_trim(x) != "")

    parts = [F.transform(items(p), _tagged(k, fields[p][0])) for k, p in enumerate(paths)]
    flat = df.select(row_id, *scope, F.explode(F.concat(*parts)).alias("x")).select(row_id, *scope, "x.field", "x.pos", "x.value", "x.template", F.struct(F.col(row_id).alias("row"), "x.field", "x.pos").alias("ord"))
    table = dictionary(flat, scope)
    own = flat.select(row_id, *scope, "value").distinct().join(table.select(*scope, "value", "placeholder"), [*scope, "value"])
    joined = df.join(own.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("value", "placeholder"))).alias("__map")), row_id, "left")
    named = lambda v: F.coalesce(F.try_element_at(F.col("__map"), v), v)

    def masked(path: str) -> Callable[[Column, object], Column]:
        one = lambda t: named(t)
        many = lambda t: F.when(F.size(split_values(t)) > 0, F.array_join(F.transform(split_values(t), named), ", ")).otherwise(t)
        change = many if fields[path][1] else one
        return lambda c, kind: nested.rewrite_text(c, kind, lambda t: F.when(t.isNotNull(), change(t)))

    columns = {}
    for path, steps in paths.items():
        columns[steps[0]] = nested.at_path(columns.get(steps[0], F.col(steps[0])), kinds[steps[0]], steps[1:], masked(path))
    whole = lambda c: F.when(F.col("__map").isNull(), F.col(c)).otherwise(columns[c]).alias(c)
    return joined.select(*[whole(c) if c in columns else F.col(c) for c in df.columns]), table
