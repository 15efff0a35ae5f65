"""Text normalisation as column expressions.

White space is spelled out: the set that a Unicode-aware strip removes, which
neither the default trim nor an ASCII `\\s` covers. NFKC has no expression of
its own: texts that are not plain ASCII go to the normaliser of ICU, which
Spark ships for its collations, so that no row leaves the JVM for it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WS = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_CHARS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
ZERO_WIDTH = "[\u200b\u200c\u200d\ufeff]"
ASCII_ONLY = "^[\\x00-\\x7F]*$"


def text(c: Column) -> Column:
    """The value as text, null as the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def norm_ws(c: Column) -> Column:
    """Strip, and make every run of white space one blank; then none but blanks are left to strip."""
    return F.trim(F.regexp_replace(text(c), f"{WS}+", " "))


def norm_header(c: Column) -> Column:
    """norm_ws in lower case: header cells and dispatch tokens."""
    return F.lower(norm_ws(c))


def norm_warehouse(c: Column) -> Column:
    """Warehouse name for matching: stripped, lower case, single blanks."""
    return F.lower(norm_ws(c))


@F.pandas_udf(StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfkc(c: Column) -> Column:
    """Compatibility composition; ASCII is left alone.

    Spark takes the call as not deterministic: where the result is used more
    than once, it belongs in a column of its own.
    """
    c = text(c)
    return F.when(c.rlike(ASCII_ONLY), c).otherwise(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True)))


def normalize_sku(c: Column) -> Column:
    """Article key: NFKC, no zero-width marks, single blanks, no trailing .0 of a number."""
    return sku_tail(nfkc(c))


def sku_tail(c: Column) -> Column:
    """normalize_sku after NFKC."""
    s = norm_ws(F.regexp_replace(text(c), ZERO_WIDTH, ""))
    return F.when(s.rlike("^[\\p{Nd}.-]*[.]0$"), F.substring(s, 1, F.length(s) - 2)).otherwise(s)


def sanitize_tag(c: Column) -> Column:
    """File tag: runs of anything but Latin and Cyrillic letters, digits, dot, underscore and minus become _."""
    return F.regexp_replace(F.regexp_replace(strip(text(c)), "[ \\\\/()]", "_"), "[^-._0-9a-zA-Zа-яА-Я]+", "_")


def clean_tag(value: str) -> str:
    """The same on the driver, for one tag."""
    import re

    return re.sub("[^-._0-9a-zA-Zа-яА-Я]+", "_", re.sub("[ \\\\/()]", "_", value.strip()))


def is_numberish(c: Column) -> Column:
    return strip(text(c)).rlike("^-?[0-9]+(?:[,.][0-9]+)?$")


def nonempty_count(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda x: strip(F.coalesce(x, F.lit(""))) != ""))


def trim_right(cells: Column) -> Column:
    """Drop the blank cells at the end of a row."""
    filled = F.transform(cells, lambda x, i: F.when(strip(F.coalesce(x, F.lit(""))) != "", i + 1).otherwise(0))
    return F.slice(cells, F.lit(1), F.coalesce(F.array_max(filled), F.lit(0)))


def signature_tokens(row1: Column, row2: Column | None = None) -> Column:
    """Distinct header tokens in order; under a second header row each is "upper|lower"."""
    if row2 is None:
        return F.array_distinct(F.filter(F.transform(row1, norm_header), lambda t: t != ""))
    both = F.zip_with(row1, row2, lambda a, b: F.concat(norm_header(a), F.lit("|"), norm_header(b)))
    return F.array_distinct(F.filter(both, lambda t: t != "|"))


def normalize_signature(c: Column, homoglyphs: dict[str, str] | None = None) -> Column:
    """Signature rule: NFC, strip and collapse, lower case, given homoglyphs, no surrounding punctuation."""
    c = text(c)
    s = F.lower(norm_ws(F.when(c.rlike(ASCII_ONLY), c).otherwise(_nfc(F.when(~c.rlike(ASCII_ONLY), c)))))
    if homoglyphs:
        s = F.translate(s, "".join(homoglyphs), "".join(homoglyphs.values()))
    return F.regexp_replace(s, "^\\p{Punct}+|\\p{Punct}+$", "")


def unreviewed_alias(key: Column, name: Column) -> Column:
    """The warehouse key, or a marked raw name where there is none."""
    return F.coalesce(key, F.concat(F.lit("__unreviewed__:"), text(name)))
