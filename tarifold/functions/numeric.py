"""Parsing of prices and quantities as column expressions.

Each parser returns a struct. Texts pass a grammar check before any cast, so
that type suffixes, hexadecimal or "NaN" never become numbers, and all rounding
is decimal, half away from zero. Values beyond DECIMAL(38,12) are format errors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarifold.functions.text import norm_ws, strip, text

NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
FIRST_NUMBER = "-?[0-9]+(?:[.,][0-9]+)?"
WIDE = "decimal(38,12)"


def _decimal(s: Column) -> Column:
    return F.when(s.rlike(NUMBER), s).try_cast(WIDE)


def _double(s: Column) -> Column:
    return F.when(s.rlike(NUMBER), s).try_cast("double")


def flags(*pairs: tuple[Column, str]) -> Column:
    """The names whose conditions hold, in order."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in pairs)))


def price_minor(raw: Column, scale: int = 100) -> Column:
    """struct(value long, flags, error): price in minor units; an empty text is a missing price, not an error."""
    s = text(raw)
    d = _decimal(strip(s))
    minor = F.round(d * F.lit(scale), 0).try_cast("long")
    blank = s == ""
    error = F.when(~blank & minor.isNull(), F.lit("invalid_price_format"))
    found = flags((blank, "missing_price"), (minor == 0, "zero_price"), (minor < 0, "negative_price"))
    return F.struct(minor.alias("value"), found.alias("flags"), error.alias("error"))


def qty_soft(raw: Column) -> Column:
    """struct(value long, flags): a quantity, or the first number of a text, rounded; nothing is an error.

    Sign, zero and fraction are judged before rounding.
    """
    s = text(raw)
    exact = _decimal(strip(s))
    loose = F.replace(F.nullif(F.regexp_extract(s, FIRST_NUMBER, 0), F.lit("")), F.lit(","), F.lit(".")).try_cast(WIDE)
    d, blank = F.coalesce(exact, loose), s == ""
    found = flags(
        (blank, "no_qty"), (~blank & d.isNull(), "qty_textual"), (exact.isNull() & loose.isNotNull(), "qty_approximated"),
        (d < 0, "negative_qty"), (d == 0, "qty_zero"), (d != F.round(d, 0), "qty_fractional"),
    )
    return F.struct(F.round(d, 0).try_cast("long").alias("value"), found.alias("flags"))


def _cleaned(s: Column) -> Column:
    return F.replace(F.regexp_replace(s, "[^0-9.,-]", ""), F.lit(","), F.lit("."))


def int_text(raw: Column) -> Column:
    """struct(value string, flags): whole number as text, "" where there is none (string contract)."""
    s = strip(text(raw))
    above = s.startswith(">")
    d = _double(_cleaned(F.regexp_replace(s, "^>+", "")))
    value = F.when(d == F.floor(d), F.floor(d).cast("string")).otherwise("")
    blank = text(raw) == ""
    found = F.when(blank, F.array().cast("array<string>")).when(d.isNull(), F.array(F.lit("qty_non_numeric"))).when(d != F.floor(d), F.array(F.lit("qty_has_fraction"))).otherwise(flags((above, "qty_approximated")))
    return F.struct(F.coalesce(value, F.lit("")).alias("value"), found.alias("flags"))


def price_text(raw: Column) -> Column:
    """struct(value string, flags): price as text with at most six decimals, "" where there is none."""
    s = text(raw)
    d = _double(_cleaned(strip(s)))
    near = F.abs(d - F.when(d < 0, F.ceil(d)).otherwise(F.floor(d))) < 1e-9
    whole = F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("string")
    six = d.try_cast("decimal(38,6)").cast("string")
    shown = F.regexp_replace(F.regexp_replace(six, "0+$", ""), "[.]$", "")
    found = flags((s == "", "missing_price"), ((s != "") & d.isNull(), "bad_price"))
    return F.struct(F.coalesce(F.when(near, whole).otherwise(shown), F.lit("")).alias("value"), found.alias("flags"))


def as_number(raw: Column) -> Column:
    """Double with a decimal comma or point, else null."""
    return _double(F.replace(strip(text(raw)), F.lit(","), F.lit(".")))


def as_float(raw: Column) -> Column:
    """Double after removal of blanks, decimal comma or point; words for nothing are null."""
    return _double(F.replace(F.replace(strip(text(raw)), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")))


def as_int(raw: Column) -> Column:
    """as_float cut towards zero."""
    return as_float(raw).try_cast("long")


def lower_bound_qty(raw: Column) -> Column:
    """Whole quantity, cut towards zero; "> N" counts as N."""
    s = strip(text(raw))
    above = F.nullif(F.regexp_extract(s, "^>[ ]*([0-9]+)[ ]*$", 1), F.lit(""))
    return F.coalesce(above.try_cast("long"), as_int(raw))


def first_digits_qty(raw: Column) -> Column:
    """struct(value string, flags): first run of digits; anything around it makes it approximate."""
    s = F.lower(norm_ws(raw))
    digits = F.nullif(F.regexp_extract(s, "([0-9]+)", 1), F.lit(""))
    found = flags((s == "", "missing_qty"), ((s != "") & digits.isNull(), "qty_non_numeric"), (digits.isNotNull() & ~s.rlike("^[0-9]+$"), "qty_approximated"))
    return F.struct(F.coalesce(digits, F.lit("")).alias("value"), found.alias("flags"))


def positive_price(raw: Column) -> Column:
    """struct(value string, flags): positive price as text, near-integers whole."""
    s = norm_ws(raw)
    d = _double(F.replace(s, F.lit(","), F.lit(".")))
    good = (d > 0) & (d < float("inf"))
    near = F.abs(d - F.rint(d)) < 1e-9
    value = F.when(good & near, F.rint(d).cast("decimal(38,0)").cast("string")).when(good, d.cast("string"))
    found = flags((s == "", "missing_price"), ((s != "") & ~F.coalesce(good, F.lit(False)), "bad_price"))
    return F.struct(F.coalesce(value, F.lit("")).alias("value"), found.alias("flags"))


def normalize_value(raw: Column, kind: str) -> Column:
    """Documented value normaliser: double or null, for kind "qty" or "price"."""
    s = F.lower(norm_ws(raw))
    one_comma = s.rlike("^[^.,]*[0-9],[0-9][^.,]*$")
    s = F.regexp_replace(F.when(one_comma, F.replace(s, F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit(""))), " |₽|[$€]|руб[.]?|р[.]?$", "")
    plain = _double(s)
    if kind == "price":
        return plain
    nothing = s.isin("неограничено", "отсутствует", "нет", "-", "—", "")
    bound = F.coalesce(F.nullif(F.regexp_extract(s, "^>=?([0-9.]+)$", 1), F.lit("")), F.nullif(F.regexp_extract(s, "^([0-9.]+)(?:[+]|-[0-9.]+)$", 1), F.lit("")))
    return F.when(nothing, F.lit(None).cast("double")).otherwise(F.coalesce(plain, _double(bound)))
