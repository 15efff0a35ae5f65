"""Supplier mappings: YAML read on the driver into a frozen description of a grid."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from tarifold import storage


class MappingError(ValueError):
    """A mapping that cannot be used; code is the exit code of the command line."""

    def __init__(self, message: str, code: int = 1):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Warehouse:
    column: int
    name: str


@dataclass(frozen=True)
class Mapping:
    """Columns are 1-based positions. missing ones are 0 and read as empty."""

    version: str
    hash: str
    sheet: str
    header_row: int
    data_row: int
    columns: dict[str, int]
    warehouses: tuple[Warehouse, ...]
    price_scale: int = 100
    currency: str = "RUB"
    defaults: dict[str, Any] = field(default_factory=dict)


#: Roles and the names they have in the two mapping dialects.
ROLES = {
    "article_primary": ("article_primary", "sku"), "article_fallback": ("article_fallback", "code", "code1c"), "brand": ("brand",), "name": ("name",), "price": ("price", "price_opt"),
}
POSITIONS = {"article_primary": 7, "article_fallback": 8, "brand": 9, "name": 10, "price": 11}


def hash_lf(data: bytes) -> str:
    return hashlib.sha256(b"\n".join(data.split(b"\r\n"))).hexdigest()


def _position(value: Any, role: str, strict: bool) -> int:
    if isinstance(value, dict):
        if strict and value.get("type") != "column_position":
            raise MappingError(f"column {role} must be of type column_position", 3)
        value = value.get("column")
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise MappingError(f"column {role} must be a positive position", 3)
    return value


def parse_mapping(data: bytes, strict: bool = True) -> Mapping:
    """A mapping from YAML bytes.

    strict demands all keys of the typed contract; otherwise missing columns
    fall back to fixed positions. Columns may be given under `columns` or `cols`.
    """
    raw = yaml.safe_load(data) or {}
    hints, columns = raw.get("format_hints") or {}, raw.get("columns") or raw.get("cols") or {}
    defaults = raw.get("defaults") or {}
    if strict:
        lacking = [k for k in ("mapping_version", "format_hints", "warehouses") if k not in raw] + ([] if columns else ["columns"]) + ([] if "price_scale" in defaults else ["defaults.price_scale"])
        if lacking:
            raise MappingError(f"mapping lacks {', '.join(lacking)}", 1)
    found = {}
    for role, names in ROLES.items():
        value = next((columns[n] for n in names if n in columns), None)
        if value is None and strict:
            raise MappingError(f"column {role} is missing", 3)
        found[role] = POSITIONS[role] if value is None else _position(value, role, strict)
    warehouses = []
    for w in raw.get("warehouses") or []:
        if not isinstance(w, dict) or "column" not in w or (strict and "warehouse_name" not in w):
            raise MappingError("warehouses need column and warehouse_name", 3)
        warehouses.append(Warehouse(_position(w["column"], "warehouse", False), str(w.get("warehouse_name", f"c{w['column']}"))))
    if not warehouses and raw.get("warehouses") is not None:
        raise MappingError("no warehouses in mapping", 1)
    data_row = hints.get("data_start_row_1based", 3)
    if strict and (not hints.get("sheet") or isinstance(data_row, bool) or not isinstance(data_row, int) or data_row < 1):
        raise MappingError("format_hints need sheet and a positive data_start_row_1based", 3)
    return Mapping(
        str(raw.get("mapping_version", "")), hash_lf(data), str(hints.get("sheet", "TDSheet")), int(hints.get("header_row_1based", 1)), int(data_row),
        found, tuple(warehouses), int(defaults.get("price_scale", 100)), str(defaults.get("currency", "RUB")), dict(defaults),
    )


def mapping_bytes(path: str) -> bytes:
    """A mapping file of the driver, or of any file system where the path names one."""
    return storage.read_text(path).encode() if ":/" in path else Path(path).read_bytes()


def load_mapping(path: str, strict: bool = True) -> Mapping:
    return parse_mapping(mapping_bytes(path), strict)
