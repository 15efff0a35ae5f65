"""Keys, digests and times as column expressions, with driver-side twins."""

from __future__ import annotations

import hashlib
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarifold.functions.text import text


def fallback_sku(article: Column, code: Column, brand: Column, name: Column) -> Column:
    """struct(value, flags): article, else code, else a key hashed from brand and name."""
    a, c = F.trim(text(article)), F.trim(text(code))
    made = F.concat(F.lit("unknown_sku_"), F.substring(F.sha1(F.concat(text(brand), F.lit("|"), text(name))), 1, 12))
    value = F.when(a != "", a).when(c != "", c).otherwise(made)
    found = F.when(a != "", F.array().cast("array<string>")).when(c != "", F.array(F.lit("missing_article_used_code1c"))).otherwise(F.array(F.lit("missing_sku")))
    return F.struct(value.alias("value"), found.alias("flags"))


def fingerprint(*parts: Column) -> Column:
    """sha256 in hex of the parts joined by |."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def core_key(*parts: Column) -> Column:
    """Conflict signature: first 16 hex digits of sha256 over the parts joined by ":" (a declared choice)."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def effective_month(effective_at: Column) -> Column:
    """YYYY-MM in UTC of an RFC 3339 text (the session's time zone must be UTC)."""
    return F.date_format(F.try_to_timestamp(effective_at), "yyyy-MM")


def sha256_file(path: str, lf: bool = False) -> str:
    """sha256 of a file in chunks; lf: with CRLF read as LF."""
    digest, held = hashlib.sha256(), b""
    with open(path, "rb") as file:
        while chunk := file.read(1 << 20):
            if lf:
                chunk = held + chunk
                held = b"\r" if chunk.endswith(b"\r") else b""
                chunk = b"\n".join(chunk[: len(chunk) - len(held)].split(b"\r\n"))
            digest.update(chunk)
    digest.update(held)
    return digest.hexdigest()


def utc_text(value: str) -> str:
    """RFC 3339 with an offset as the same instant in UTC, ending in Z; naive times are refused."""
    at = datetime.fromisoformat(value)
    if at.tzinfo is None:
        raise ValueError(f"time without offset: {value}")
    return at.astimezone(UTC).replace(tzinfo=None).isoformat() + "Z"


def utc_month(value: str) -> str:
    return utc_text(value)[:7]
