"""Masking, keyed pseudonyms and safe projections."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

C = F.col

HASH_BLOCK = 64
MIN_ID_LENGTH = 8
MAX_ID_LENGTH = 256


def mask_phone(column: Column) -> Column:
    """Keep the first three and last four digits; anything else is hidden whole."""
    shape = r"^(\d{3})\d{4}(\d{4})$"
    return (
        F.when(column.isNull(), F.lit(None).cast("string"))
        .when(column.rlike(shape), F.regexp_replace(column, shape, "$1****$2"))
        .otherwise("****")
    )


def mask_identifier(column: Column) -> Column:
    """Keep the first and the last two characters."""
    text = column.cast("string")
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(F.length(text) <= 3, F.lit("***"))
        .otherwise(F.concat(F.substring(text, 1, 1), F.repeat(F.lit("*"), F.length(text) - 3), F.right(text, F.lit(2))))
    )


def mask_name(column: Column) -> Column:
    """Keep the first character."""
    return F.when(column.isNotNull(), F.concat(F.substring(column, 1, 1), F.lit("**")))


def mask_frame(df: DataFrame) -> DataFrame:
    """Mask the sensitive columns that are present; keep the others."""
    rules = {"phone": mask_phone, "resident_id": mask_identifier, "name": mask_name}
    return df.withColumns({name: rule(C(name)) for name, rule in rules.items() if name in df.columns})


def stripped(column: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def keyed_pseudonym(column: Column, key: bytes) -> Column:
    """HMAC-SHA256 as 64 hex characters, built from ``sha2`` only.

    Keys longer than one hash block are hashed first, as the HMAC standard says.
    """
    short = hashlib.sha256(key).digest() if len(key) > HASH_BLOCK else key
    padded = short.ljust(HASH_BLOCK, b"\0")
    inner_pad = F.lit(bytes(b ^ 0x36 for b in padded))
    outer_pad = F.lit(bytes(b ^ 0x5C for b in padded))
    inner = F.sha2(F.concat(inner_pad, F.encode(stripped(column), "UTF-8")), 256)
    return F.sha2(F.concat(outer_pad, F.unhex(inner)), 256)


def is_client_id(column: Column) -> Column:
    return F.coalesce(F.length(stripped(column)).between(MIN_ID_LENGTH, MAX_ID_LENGTH), F.lit(False))


def _number_text(column: Column) -> Column:
    """Shortest decimal that reads back as the same double, written out between 1e-4 and 1e16, else with an exponent.

    The value is printed with 15, 16 and 17 digits; the first that reads back as itself is taken apart into digits and
    exponent. Whole numbers keep ``.0``.
    """
    size = F.abs(column)
    tries = [F.format_string(f"%.{digits - 1}e", size) for digits in range(1, 18)]
    exact = [F.when(text.cast("double") == size, text) for text in tries]
    # below the least normal double fewer than 15 digits may do; above it, fewer are 15 with zeros at the end
    printed = F.when(size < 2.2250738585072014e-308, F.coalesce(*exact, tries[-1])).otherwise(F.coalesce(*exact[14:], tries[-1]))
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(printed, "e", 1), r"\.", ""), "(?<=.)0+$", "")
    place = F.substring_index(printed, "e", -1).cast("int")
    count = F.length(digits)
    whole = F.concat(F.rpad(F.substring(digits, F.lit(1), place + 1), place + 1, F.lit("0")), F.lit("."),
                     F.when(count > place + 1, F.substring(digits, place + 2, count)).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -place - 1), digits)
    tail = F.when(count > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), count))).otherwise("")
    sign = F.when(place < 0, "-").otherwise("+")
    power = F.concat(F.substring(digits, F.lit(1), F.lit(1)), tail, F.lit("e"), sign, F.lpad(F.abs(place).cast("string"), F.greatest(F.length(F.abs(place).cast("string")), F.lit(2)), F.lit("0")))
    text = F.when(size == 0, "0.0").when(place.between(0, 15), whole).when(place.between(-4, -1), small).otherwise(power)
    text = F.when(size == float("inf"), "Infinity").otherwise(text)
    negative = (column < 0) | ((column == 0) & F.startswith(column.cast("string"), F.lit("-")))
    return F.when(F.isnan(column), "NaN").when(negative, F.concat(F.lit("-"), text)).otherwise(text)


#: Control characters as they stand in a JSON string; those without a letter of their own by number.
_ESCAPES = {chr(k): f"\\u{k:04x}" for k in range(32)} | {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _string_text(column: Column) -> Column:
    plain = F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = plain
    for char, shown in _ESCAPES.items():
        escaped = F.replace(escaped, F.lit(char), F.lit(shown))
    return F.concat(F.lit('"'), F.when(column.rlike("[\\x00-\\x1f]"), escaped).otherwise(plain), F.lit('"'))


def _listed(parts: Column, opened: str, closed: str) -> Column:
    return F.concat(F.lit(opened), F.array_join(parts, ","), F.lit(closed))


def json_text(column: Column, kind: T.DataType) -> Column:
    """Compact JSON of a value of any type: keys sorted, characters beyond ASCII as they are, numbers in their shortest form.

    Values that JSON doesn't have (dates, times, decimals) are written as strings.
    """
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = F.array(*[F.concat(_string_text(F.lit(f.name)), F.lit(":"), json_text(column[f.name], f.dataType)) for f in fields]) if fields else F.array()
        text = _listed(parts, "{", "}")
    elif isinstance(kind, T.ArrayType):
        text = _listed(F.transform(column, lambda x: json_text(x, kind.elementType)), "[", "]")
    elif isinstance(kind, T.MapType):
        entries = F.sort_array(F.map_entries(column))
        text = _listed(F.transform(entries, lambda e: F.concat(_string_text(e["key"].cast("string")), F.lit(":"), json_text(e["value"], kind.valueType))), "{", "}")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = _number_text(column.cast("double"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = column.cast("string")
    else:
        text = _string_text(column.cast("string"))
    return F.when(column.isNull(), "null").otherwise(text)


def canonical_json(df: DataFrame, names: list[str]) -> Column:
    """Compact JSON of some columns with sorted keys; nulls are written out."""
    present = sorted(name for name in names if name in df.columns)
    parts = [F.concat(F.lit(f'"{name}":'), json_text(C(name), df.schema[name].dataType)) for name in present]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
