"""Column functions: trimming, splitting, rule transforms, identifiers. All stay inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts on the web trim it (fixed values).
SPACE = " \t\n\x0b\x0c\r\u00a0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Name space of version-5 identifiers, as hexadecimal (fixed value).
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
#: Names of columns with one address and with several, without case and punctuation (fixed values).
EMAIL_NAMES = ("email", "primaryemail", "mainemail", "useremail", "emailaddress")
MULTI_EMAIL_NAMES = ("additionalemails", "otheremails", "emails", "emailaddresses")


def js_trim(c: Column) -> Column:
    """Trims Unicode white space at both ends (plain trim keeps no-break spaces)."""
    return F.btrim(c, F.lit(SPACE))


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(js_trim(c)) == 0, F.lit(True))


def split_values(c: Column) -> Column:
    """Items between runs of comma, bar, semicolon or tab, trimmed, empty ones dropped; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,|;\\t]+"), js_trim), lambda x: x != "")


def t_split(c: Column, delimiter: str = ",", trim_items: bool = True, filter_empty: bool = True) -> Column:
    """Splits at a literal delimiter."""
    items = F.split(c, "\\Q" + delimiter + "\\E", -1)
    items = F.transform(items, js_trim) if trim_items else items
    return t_filter_empty(items) if filter_empty else items


def t_filter_empty(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull() & ~is_blank(x))


def t_unique(items: Column) -> Column:
    """Distinct items, case-insensitive; the first spelling and the order stay."""
    return F.filter(items, lambda x, i: F.array_position(F.transform(items, F.lower), F.lower(x)) == i + 1)


def t_map(c: Column, values: dict[str, str], case_sensitive: bool = False) -> Column:
    """Replaces known values, keeps others."""
    key = (lambda x: x) if case_sensitive else str.lower
    table = {key(k): v for k, v in values.items()}
    if not table:
        return c
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(literal, c if case_sensitive else F.lower(c)), c)


def t_to_number(c: Column) -> Column:
    """Decimal notation to double; blank and everything else to null."""
    text = js_trim(c)
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def t_seconds_to_duration(seconds: Column) -> Column:
    """Rounded half up, at least zero, as ISO 8601; not finite gives null."""
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < 1e15)
    return F.when(finite, F.concat(F.lit("PT"), F.greatest(F.lit(0), F.floor(seconds + 0.5)).cast("bigint").cast("string"), F.lit("S")))


def add_if_missing(items: Column, value: Column) -> Column:
    return F.when(F.array_contains(items, value), items).otherwise(F.array_append(items, value))


def normalize_field_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", ""))


def normalize_pii_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "\\s+", "")


def strip_result_prefix(path: Column) -> Column:
    return F.regexp_replace(path, r"^results\.[0-9]+\.", "")


def uuid_v5(value: Column, namespace: str = NAMESPACE) -> Column:
    """The version-5 identifier of a text; null stays null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(value, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def row_hash(uuid: Column, columns: list[str]) -> Column:
    """SHA-256 of a row's identity and cells as JSON; equal rows of one person have equal hashes."""
    return F.sha2(F.to_json(F.struct(uuid.alias("uuid"), F.struct(*columns).alias("rawData"))), 256)


def emails_of(columns: list[str]) -> Column:
    """All addresses of the email-like columns among ``columns``, in column order, trimmed and lower-cased."""
    plain = lambda n: "".join(ch for ch in n if ch.isalnum() and ch.isascii()).lower()
    parts = []
    for name in columns:
        if plain(name) in EMAIL_NAMES:
            parts.append(F.array(F.lower(js_trim(F.coalesce(F.col(name), F.lit(""))))))
        elif plain(name) in MULTI_EMAIL_NAMES:
            parts.append(F.transform(split_values(F.col(name)), F.lower))
    return F.filter(F.flatten(F.array(*parts)), lambda x: x != "") if parts else F.array().cast("array<string>")


def key_values(columns: list[str], key_column: str | None) -> Column:
    """Values of the key column, split if it has a comma; none if it is missing or blank."""
    if key_column is None or key_column not in columns:
        return F.array().cast("array<string>")
    key = F.lower(js_trim(F.coalesce(F.col(key_column), F.lit(""))))
    return F.when(key.contains(","), split_values(key)).when(key != "", F.array(key)).otherwise(F.array().cast("array<string>"))


def id_values(columns: list[str], key_column: str | None = None) -> Column:
    """Values of the key column, or the addresses where it is missing or empty."""
    values, emails = key_values(columns, key_column), emails_of(columns)
    return F.when(F.size(values) > 0, values).otherwise(emails)


def error_type(message: Column, status: Column) -> Column:
    """Class of a failed attempt from its validation message and status."""
    return (
        F.when(F.lower(message).contains("required field"), "required_field_error").when(message.isNotNull(), "validation_error")
        .when((status == 429) | (status >= 500), "api_error").otherwise("network_error")
    )


def coalesce_nonblank(columns: list[Column]) -> Column:
    """The first value that is not blank, else the last column as it is."""
    return F.coalesce(*[F.when(~is_blank(c), c) for c in columns], columns[-1])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
